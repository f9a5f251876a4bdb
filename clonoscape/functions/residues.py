"""Amino-acid alphabet, substitution scores and residue vectors."""

from __future__ import annotations

import numpy as np

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

# The public BLOSUM62 matrix (Henikoff and Henikoff 1992), lower triangle in its usual order.
BLOSUM_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def substitution_scores(clip: int = 4) -> dict[tuple[str, str], int]:
    """Score of each ordered pair of residues, at most ``clip``."""
    out = {}
    for a, line in zip(BLOSUM_ORDER, BLOSUM62.strip().splitlines(), strict=True):
        for b, value in zip(BLOSUM_ORDER, line.split(), strict=False):
            out[a, b] = out[b, a] = min(int(value), clip)
    return out


def residue_vectors(dimensions: int = 16) -> dict[str, list[float]]:
    """Vectors whose distances follow 4 - score, by classical scaling of the score matrix.

    A rule rather than a table; pass other vectors where results must agree with
    an encoder that was fitted elsewhere.  Signs are fixed by the largest entry.
    """
    score = substitution_scores()
    distance = np.array([[4 - score[a, b] for b in BLOSUM_ORDER] for a in BLOSUM_ORDER], float)
    n = len(distance)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ distance**2 @ centre)
    order = np.argsort(-values)[:dimensions]
    kept = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    kept = kept * np.sign(kept[np.abs(kept).argmax(0), np.arange(kept.shape[1])])
    return {a: [round(float(x), 6) for x in row] for a, row in zip(BLOSUM_ORDER, kept, strict=True)}
