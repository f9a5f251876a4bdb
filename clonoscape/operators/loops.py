"""Sparse distances of receptors over several loops, joined within a radius.

The distance of two receptors is that of their genes' loops, which are aligned and
of equal length, plus that of the third loop, which counts three times.  A
substitution costs 4 less its BLOSUM62 score, at most 4; so does a residue that is
missing.  The third loop is compared without its first three and last two residues;
of two lengths, the longer one leaves out the difference at the best of some middle places.

Within the published radius a fiftieth of all pairs may be near, so that pairs that
meet by a common signature are hardly fewer than all, and cost far more each.
Receptors are therefore cut into blocks that meet once; of each two lengths the costs
are a matrix of small numbers, summed place by place, and only near pairs leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoscape.functions.residues import ALPHABET, substitution_scores

from .graph import staged
from .pivots import Forest
from .similarity import meeting

#: Weight of the third loop, cost of a missing residue and most cost of a substitution (fixed values of the published distance).
THIRD_WEIGHT, GAP, MOST_COST = 3, 4, 4
#: Residues left out at both ends of the third loop; shorter loops than LEAST_LENGTH take no part (fixed values).
HEAD, TAIL, LEAST_LENGTH = 3, 2, 6
#: Cost of two residues of different classes at least.
LEAST_CROSS = 3


def costs() -> np.ndarray:
    """Cost of each pair of bytes; what isn't a residue differs from everything else by the most."""
    out = np.full((256, 256), MOST_COST, np.int64)
    for (a, b), v in substitution_scores().items():
        out[ord(a), ord(b)] = out[ord(b), ord(a)] = min(MOST_COST, MOST_COST - v)
    np.fill_diagonal(out, 0)
    return out


def classes(least: int = LEAST_CROSS) -> dict[str, str]:
    """The first residue of each residue's class: those linked by substitutions that cost less than ``least``."""
    cost = costs()
    of = {a: a for a in ALPHABET}
    for a in ALPHABET:
        for b in ALPHABET:
            if cost[ord(a), ord(b)] < least and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {x: low if c == high else c for x, c in of.items()}
    return of


def _bytes(texts: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8).reshape(len(texts), width)


def aligned_cost(gap_as: str = "-"):
    """A pandas UDF: cost of two aligned texts, place by place; null for unequal lengths."""
    cost = costs()

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype="Int64")
        sizes = a.str.len().where(a.str.len() == b.str.len())
        for n, at in sizes.groupby(sizes).groups.items():
            out[at] = cost[_bytes(a[at], int(n)), _bytes(b[at], int(n))].sum(1)
        return out

    return run


def gap_places(short: int) -> range:
    """Places at which a loop of ``short`` residues may have its gap: from the fifth residue on either side, or around the middle."""
    widen = max(0, -((short - 10) // 2))
    return range(5 - widen, short - 5 + widen + 1)


def gene_distances(genes: DataFrame, name: str, loops: list[str]) -> DataFrame:
    """g, h, gene_d of all ordered pairs of a gene table (a reference of some hundred rows), their own included."""
    text = F.concat(*[F.col(c) for c in loops])
    x, y = genes.select(F.col(name).alias("g"), text.alias("x")), genes.select(F.col(name).alias("h"), text.alias("y"))
    return x.join(y, F.length("x") == F.length("y")).select("g", "h", aligned_cost()("x", "y").alias("gene_d"))


#: Least and most receptors of a block, least blocks of larger tables, pairs whose costs are worked out at once (a row of them then stays in a core's cache), and near pairs that a task hands on, or adds to its forest, at a time.
LEAST_ROWS, MOST_ROWS, BLOCKS, PAIRS, SENT, TREE_SENT = 512, 16384, 24, 1 << 15, 1 << 16, 1 << 20


def _third_costs(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Least unweighted cost of every third loop x with every one y (bytes, none shorter than x), without missing residues: a matrix for each slice of x."""
    s, gap = x.shape[1], y.shape[1] - x.shape[1]
    kind = np.int8 if MOST_COST * s <= np.iinfo(np.int8).max else np.int32
    letters, coded = np.unique(x, return_inverse=True)
    coded = coded.reshape(x.shape)
    worth = [cost[letters[:, None], y[None, :, j]].astype(kind) for j in range(y.shape[1])]
    places = gap_places(s) if gap else [s]
    step = max(1, PAIRS // len(y))
    for at in range(0, len(x), step):
        own = coded[at : at + step]
        now, cell = np.zeros((len(own), len(y)), kind), np.empty((len(own), len(y)), kind)
        of = lambda place, j: np.take(worth[j], own[:, place], axis=0, out=cell, mode="clip")  # noqa: B023, E731
        for p in range(HEAD, s - TAIL):
            now += of(p, p if p < places[0] else p + gap)
        best = now.copy() if len(places) > 1 else now
        for g in places[:-1]:  # the gap moves on by one
            now += of(g, g)
            now -= of(g, g + gap)
            np.minimum(best, now, out=best)
        yield slice(at, at + len(own)), best


def gathered(tables: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in tables of some ``rows`` each."""
    held, many = [], 0
    for t in tables:
        held.append(t)
        many += len(t)
        if many > rows:
            yield pd.concat(held)
            held, many = [], 0
    if held:
        yield pd.concat(held)


def least_forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Those of the pairs i, j, d that make a minimum spanning forest."""
    nodes, at = np.unique(np.concatenate([pairs["i"], pairs["j"]]), return_inverse=True)
    a, b, d = at[: len(pairs)], at[len(pairs) :], pairs["d"].to_numpy()
    order = np.argsort(d, kind="stable")
    heights, begins = np.unique(d[order], return_index=True)
    forest, ends, out = Forest(len(nodes)), [*begins[1:], len(d)], []
    for height, begin, end in zip(heights, begins, ends, strict=True):
        level, before = order[begin:end], len(forest.edges)
        forest.add(a[level], b[level])
        for i, j in forest.edges[before:]:
            out.append(pd.DataFrame({"i": nodes[np.minimum(i, j)], "j": nodes[np.maximum(i, j)], "d": height}))
    return pd.concat(out) if out else pairs[:0]


def loop_neighbours(df: DataFrame, key: str, gene: str, third: str, genes: DataFrame, name: str, loops: list[str], radius: int = 50, forest: bool = False) -> DataFrame:
    """i < j, d: all pairs of receptors within the radius, as a sparse matrix.

    With ``forest`` only those that a minimum spanning forest of two blocks needs: the pairs
    of a spanning forest of all (``tree.spanning_forest``) are among these, but for ties.

    Rows without key, gene or third loop, with genes that ``genes`` lacks, or with a third loop
    of fewer than six residues take no part.  Genes whose loops differ in length are never near.
    """
    near = gene_distances(genes, name, loops).where(F.col("gene_d") <= radius).collect()  # pairs of a reference of some hundred genes
    number = {g: i for i, g in enumerate(sorted({r["g"] for r in near}))}
    apart = np.full((len(number), len(number)), radius + 1)
    for r in near:
        apart[number[r["g"]], number[r["h"]]] = r["gene_d"]
    cost, most_gaps, kind = costs(), radius // (THIRD_WEIGHT * GAP), dict(df.dtypes)[key]
    known = df.select(F.col(key).alias("id"), F.col(gene).alias("g"), F.col(third).alias("s")).where(F.col("id").isNotNull() & (F.length("s") >= LEAST_LENGTH) & F.col("g").isNotNull())
    rows = staged(known, "receptors")
    n = rows.count()
    blocks = max(1, -(-n // min(MOST_ROWS, max(LEAST_ROWS, n // BLOCKS))))

    def near_of(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        """Near pairs of two tables of one length each, the right one's none shorter; ``same`` for a table with itself."""
        s, l = len(left["s"].iloc[0]), len(right["s"].iloc[0])
        gap = THIRD_WEIGHT * GAP * (l - s)
        a, b, g, h = left["id"].to_numpy(), right["id"].to_numpy(), left["g"].to_numpy(), right["g"].to_numpy()
        left_over = (radius - apart - gap) // THIRD_WEIGHT
        most = np.clip(left_over, -1, MOST_COST * l)[:, h]
        for some, c in _third_costs(_bytes(left["s"], s), _bytes(right["s"], l), cost):
            i, j = np.nonzero(c <= most.astype(c.dtype)[g[some]])
            d = c[i, j] * np.int64(THIRD_WEIGHT) + gap + apart[g[some][i], h[j]]
            x, y = a[some][i], b[j]
            if same:
                x, y, d = (t[x < y] for t in (x, y, d))
            yield pd.DataFrame({"i": np.where(x < y, x, y), "j": np.where(x < y, y, x), "d": d})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches))
        t = t.assign(g=t["g"].map(number), n=t["s"].str.len()).dropna(subset="g").astype({"g": int})
        home = len(t) and t["row"].iloc[0] == t["column"].iloc[0]
        sides = [dict(list(t[t["own"] == t[c]].groupby("n"))) for c in ("row", "column")]
        tables = ((left, right, home and s == l) for one, other in ([sides] if home else [sides, sides[::-1]]) for s, left in one.items() for l, right in other.items() if s <= l <= s + most_gaps and (s < l or one is sides[0]))
        some = gathered((found for each in tables for found in near_of(*each)), TREE_SENT if forest else SENT)
        if not forest:
            yield from some
            return
        kept = None
        for found in some:
            kept = least_forest(found if kept is None else pd.concat([kept, found]))
        if kept is not None:
            yield kept

    met = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return meeting(met, df.sparkSession.range(blocks).withColumnRenamed("id", "other")).groupBy("row", "column").applyInPandas(run, f"i {kind}, j {kind}, d long")
