"""PartEnum signatures for sets whose Jaccard similarity is at least 3/4.

Two sets of sizes a <= b with similarity 3/4 or more differ in at most
(a + b) / 7 elements.  The domain of element hashes is cut into n1 partitions;
by the pigeonhole principle some partitions then differ in at most k2 elements.
Each partition is cut into n2 parts, and for every choice of n2 - k2 of them
the elements inside make one signature: sets that differ in at most k2 elements
of the partition share one.  Sizes fall into bands, each with its own
partitions; a set signs in its own band and, if a partner may be larger than
the band, in the next one too.

A signature over no elements would be shared by unrelated sets.  It is left out
whenever the set has enough partitions without such signatures to keep the
pigeonhole argument, which is so for all but some very small sets.
"""

from __future__ import annotations

import numpy as np

from .textbatch import U64, mix

#: Similarity of at least NUM / DEN links two sets (fixed values).
NUM, DEN = 3, 4
BAND_RATIO, SMALL = 1.5, 32
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U64)


def _bands(most: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * BAND_RATIO))))
    return np.array(edges, np.int64)


EDGES = _bands()


def similar(shared, a, b):
    """Whether sets of sizes a and b with so many shared elements link, in whole numbers."""
    return DEN * shared >= NUM * (a + b - shared)


def difference_bound(a, b):
    """The most elements in which linked sets of sizes a and b can differ."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def plan(band: int) -> tuple[int, int, int]:
    """n1, n2, k2 of a band."""
    top = int(EDGES[band + 1]) - 1
    k = difference_bound(top, top)
    if top <= SMALL:
        return int(np.ceil(1.3 * k)) + 2, 1, 0
    return int(np.ceil(1.2 * (k // 2 + 1))) + 1, 3, 1


def bands_of(size: int) -> list[int]:
    own = int(np.searchsorted(EDGES, size, "right")) - 1
    return [own, own + 1] if size * DEN // NUM >= EDGES[own + 1] else [own]


def signatures(elements: np.ndarray) -> np.ndarray:
    """Signatures of a set given as sorted distinct 64-bit hashes (none for an empty set)."""
    return np.concatenate([np.zeros(0, U64), *(sig for _, sig in banded_signatures(elements))])


def banded_signatures(elements: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The bands a set signs in, each with its signatures there; sets can only share signatures of one band."""
    size = len(elements)
    if not size:
        return []
    total = np.zeros(size + 1, U64)
    np.cumsum(mix(elements ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    high = elements >> U64(32)
    out = []
    for band in bands_of(size):
        n1, n2, k2 = plan(band)
        k = difference_bound(size, min(size * DEN // NUM, int(EDGES[band + 1]) - 1))
        cuts = np.searchsorted((high * U64(n1 * n2)) >> U64(32), np.arange(n1 * n2 + 1, dtype=U64))
        count = np.diff(cuts).reshape(n1, n2)
        sums = (total[cuts[1:]] - total[cuts[:-1]]).reshape(n1, n2)
        good = (count > 0).sum(axis=1) > k2  # none of the partition's signatures is empty
        enough = np.flatnonzero((k2 + 1) * np.cumsum(good) > k)
        sparse = not len(enough)
        used = n1 if sparse else int(enough[0]) + 1
        sums, count = sums[:used], count[:used]
        at = np.arange(used, dtype=U64) * U64(8) + U64(band) * U64(1 << 40)
        if n2 == 1:
            sig, full = mix(sums[:, 0] + mix(at)), count[:, 0] > 0
            out.append((band, sig if sparse else sig[full]))
            continue
        parts = []
        for q in range(n2):  # the part that is left out
            rest = [r for r in range(n2) if r != q]
            sig = mix(sums[:, rest[0]] * _C[0] + sums[:, rest[1]] * _C[1] + mix(at + U64(q)))
            full = count[:, rest].sum(axis=1) > 0
            parts.append(sig if sparse else sig[full])
        out.append((band, np.concatenate(parts)))
    return out
