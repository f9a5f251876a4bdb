"""Exact nearest-neighbour and radius joins of vectors over a partition of space.

Pivots are taken farthest-first from a bounded sample.  Every row belongs to the
cell of its nearest pivot, and a cell is kept as blocks of bounded size.  A vector
needs to meet a cell only if the triangle inequality leaves room there for a row
near enough:

* rows of cell j lie between ``low`` and ``high`` from its pivot, so none is nearer than |distance to the pivot - that range|;
* they lie on the pivot's side of the plane halfway to the asking vector's own pivot.

Blocks that may meet form one group each, of at most two blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import parts, staged

#: Rows a cell is meant for, rows of a block, and most pivots (they are sent to every task) and sampled rows for each of them. A row travels once for each block that it meets, so large cells send less.
CELL_ROWS, BLOCK_ROWS, MOST_PIVOTS, SAMPLED = 8192, 16384, 2048, 4
#: Rows that are compared with pivots at a time, rows with their vectors that a task hands on at a time, and distances that it holds.
SLICE, SENT, HELD = 512, 8192, 1 << 20
#: Distances are compared with this relative slack, so that rounding never drops a cell.
SLACK = 1e-9


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def matrix(vectors) -> np.ndarray:
    """Rows of vectors, which are lists at first and then travel as bytes."""
    if len(vectors) and isinstance(vectors.iloc[0], bytes):
        return np.frombuffer(b"".join(vectors), float).reshape(len(vectors), -1)
    return np.array(list(vectors), float).reshape(len(vectors), -1)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows, each the farthest from those before it; ties to the first row."""
    chosen, near = [0], squared_distances(x, x[:1])[:, 0]
    while len(chosen) < k:
        at = int(near.argmax())
        if near[at] <= 1e-12:
            break
        chosen.append(at)
        near = np.minimum(near, squared_distances(x, x[at : at + 1])[:, 0])
    return x[chosen]


def choose_pivots(rows: DataFrame, n: int, cell_rows: int, decode=matrix) -> np.ndarray:
    """Pivots for n rows (id, v) from the first rows by a hash of the id; at most MOST_PIVOTS * SAMPLED rows come to the driver."""
    k = min(MOST_PIVOTS, -(-n // cell_rows))
    few = rows.orderBy(F.xxhash64("id"), "id").limit(k * SAMPLED).select("v").toPandas()
    return farthest_first(decode(few["v"]), k) if len(few) else np.zeros((0, 0))


def placed(rows: DataFrame, within: list[str], pivots: np.ndarray, decode=matrix) -> DataFrame:
    """The rows with v as bytes (as it is, if it is bytes), cell (nearest pivot) and away (distance from it)."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = decode(b["v"])
                cell, away = np.zeros(len(x), np.int64), np.zeros(len(x))
                for at in range(0, len(x), SLICE):
                    d = squared_distances(x[at : at + SLICE], sent.value)
                    cell[at : at + SLICE], away[at : at + SLICE] = d.argmin(1), np.sqrt(d.min(1))
                told = b if isinstance(b["v"].iloc[0], bytes) else b.assign(v=[r.tobytes() for r in x])
                yield told.assign(cell=cell, away=away)

    own = f"{_schema(rows, within)}, " if within else ""
    return rows.select(*within, "id", "v").mapInPandas(run, f"{own}id {dict(rows.dtypes)['id']}, v binary, cell int, away double")


def _schema(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


class Reach:
    """Which cells of a group a vector may have to meet."""

    def __init__(self, pivots: np.ndarray, cells: pd.DataFrame):
        self.cell, self.n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
        self.low, self.high = cells["low"].to_numpy(float), cells["high"].to_numpy(float)
        self.pivots, self.own = pivots, pivots[self.cell]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each vector to the pivot of each cell, and how near a row of the cell may be at least."""
        to = np.sqrt(squared_distances(x, self.own))
        every = squared_distances(x, self.pivots)
        nearest = every.argmin(1)
        apart = np.sqrt(squared_distances(self.pivots[nearest], self.own))
        plane = np.divide(to**2 - every[np.arange(len(x)), nearest][:, None], 2 * apart, out=np.zeros_like(to), where=apart > 1e-9)
        ring = np.maximum(to - self.high, self.low - to)
        return to, np.maximum(np.maximum(ring, plane), 0)

    def surely(self, to: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each vector has k rows at least (infinite if there are fewer)."""
        far = to + self.high
        order = far.argsort(1)
        enough = np.cumsum(self.n[order], 1) >= k
        first = enough.argmax(1)
        return np.where(enough.any(1), np.take_along_axis(far, order, 1)[np.arange(len(to)), first], np.inf)


def cells_of(rows: DataFrame, within: list[str], block_rows: int) -> DataFrame:
    """cell, n, low, high, blocks of each cell of each group."""
    return rows.groupBy(*within, "cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")


def targets(asks: DataFrame, cells: DataFrame, within: list[str], pivots: np.ndarray, radius: float | None, k: int = 0, mark: str | None = None, decode=matrix) -> DataFrame:
    """The asks, a row for each cell (``to``) that may hold a row within ``radius``, or else within their ``bound``.

    Without a bound, the cells say within what distance k rows surely lie.  A task
    gets the cells of a group first, at most MOST_PIVOTS, then asks of that group,
    which are dealt out as it may hold most of them.  ``mark`` names a column that travels along.
    """
    spark = asks.sparkSession
    sent = spark.sparkContext.broadcast(pivots)
    salts = parts(spark)
    also, stats = ["block", "bound"] + ([mark] if mark else []), ["n", "low", "high"]
    columns = ["id", "v", "cell", *also]
    kinds = dict(asks.dtypes) | dict(cells.dtypes)
    none = lambda names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
    told = cells.select(*within, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *none(["id", "v"]), "cell", *none(also), *stats)
    asking = asks.select(*within, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), *columns, *none(stats))
    rows = told.unionByName(asking).repartition(*within, "salt").sortWithinPartitions(*within, "salt", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, known, reach = None, [], None
        for b in batches:
            for key, g in b.groupby([*within, "salt"], dropna=False, sort=False):
                if group != (key := tuple(map(str, key))):
                    group, known, reach = key, [], None
                asking = g["kind"].to_numpy() == 1
                if not asking.all():
                    known.append(g[~asking])
                g = g[asking]
                if not len(g) or not known:
                    continue
                reach = reach or Reach(sent.value, pd.concat(known))
                for at in range(0, len(g), SLICE):  # a slice has a row of numbers for each cell, several times over
                    some = g.iloc[at : at + SLICE]
                    to, least = reach.bounds(decode(some["v"]))
                    limit = np.full(len(some), radius) if radius is not None else np.minimum(some["bound"].fillna(np.inf).to_numpy(float), reach.surely(to, k))
                    i, j = np.nonzero(least <= (limit * (1 + SLACK) + SLACK)[:, None])
                    for n in range(0, len(i), SENT):
                        yield some[[*within, *columns]].iloc[i[n : n + SENT]].assign(to=reach.cell[j[n : n + SENT]])

    return rows.mapInPandas(run, f"{_schema(rows, [*within, *columns])}, to int")


def meet(asks: DataFrame, rows: DataFrame, within: list[str], run, schema: str, mark: str | None = None) -> DataFrame:
    """Groups of an ask block (cell, block) and a row block (to, to_block): ``run(left, right, home)`` gets the asks and the rows (id, v, bound), both by id, and whether a block meets itself, and yields columns of ``schema``.

    Rows are sent once for each ask block that meets theirs, asks once for each row
    block; ``mark`` names a column of both that travels along.
    """
    pair, also = [*within, "cell", "block", "to", "to_block"], [mark] if mark else []
    left = asks.select(*pair, "id", "v", *also, F.col("bound").cast("double").alias("bound"), F.lit(True).alias("asks"))
    pairs = left.select(*pair).distinct()
    right = rows.select(*within, F.col("cell").alias("to"), F.col("block").alias("to_block"), "id", "v", *also).join(pairs.hint("merge"), [*within, "to", "to_block"]).select(*pair, "id", "v", *also, F.lit(None).cast("double").alias("bound"), F.lit(False).alias("asks"))

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches))
        t = t.iloc[np.argsort(t["id"].to_numpy(), kind="stable")]
        asking = t["asks"].to_numpy(bool)
        home = t["cell"].iloc[0] == t["to"].iloc[0] and t["block"].iloc[0] == t["to_block"].iloc[0]
        if asking.any() and not asking.all():
            yield from run(t[asking], t[~asking], home)

    return spread(left.unionByName(right), pair).groupBy(*pair).applyInPandas(group, schema)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows over several partitions a core: blocks that meet are work, not bytes, and few of them shouldn't share a task."""
    return df.repartition(parts(df.sparkSession), *keys)


def distances(left: pd.DataFrame, right: pd.DataFrame, held: int | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of all rows of two tables, for a slice of the left one at a time."""
    x, y = matrix(left["v"]), matrix(right["v"])
    step = max(1, (held or HELD) // len(y))
    for at in range(0, len(x), step):
        s = slice(at, min(len(x), at + step))
        yield s, squared_distances(x[s], y)


def indexed(df: DataFrame, within: list[str], cell_rows: int, block_rows: int, decode=matrix) -> tuple[np.ndarray, DataFrame, DataFrame] | None:
    """Pivots, the rows (id, v) with cell, away and block, and the cells; None for no rows."""
    rows = df.where("v is not null")
    n = rows.count()
    if not n:
        return None
    pivots = choose_pivots(rows, n, cell_rows, decode)
    at = staged(placed(rows, within, pivots, decode), "cells")
    cells = staged(cells_of(at, within, block_rows), "cells")
    return pivots, _blocked(at, cells, within), cells


def _blocked(at: DataFrame, cells: DataFrame, within: list[str]) -> DataFrame:
    """``at`` with the block of each row; cells beyond one block are found in the (small) table of such cells."""
    many = cells.where("blocks > 1").select(*within, "cell", "blocks")  # at most a row for each block of rows
    return at.join(F.broadcast(many), [*within, "cell"], "left").withColumn("block", F.coalesce(block_of(F.col("blocks")), F.lit(0))).drop("blocks")


def _to_blocks(asked: DataFrame, cells: DataFrame, within: list[str]) -> DataFrame:
    many = cells.where("blocks > 1").select(*within, F.col("cell").alias("to"), "blocks")
    found = asked.join(F.broadcast(many), [*within, "to"], "left")
    return found.withColumn("to_block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")


def least_of(d: np.ndarray, m: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the m least of each row of ``d`` (to 12 places, ties to the smaller column) that are finite and not above ``most``; only those are sorted."""
    m = min(m, d.shape[1])
    last = d.min(1) if m == 1 else np.partition(d, m - 1, axis=1)[:, m - 1]
    i, j = np.nonzero(d <= np.minimum(last, most)[:, None] + 2e-12)
    near = np.round(d[i, j], 12)
    order = np.lexsort((j, near, i))
    order = order[np.isfinite(near[order])]
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < m
    return i[kept], j[kept]


#: Candidates whose distances are worked out at a time, and the share of a block's variance that its leading axes hold.
EXACT, AXES = 1 << 14, 0.9


def least_pairs(x: np.ndarray, y: np.ndarray, k: int, most: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and squared distances (to 12 places) of the k least of each row of x, none above ``most``; ties to the smaller column. ``own`` is the column that is the row itself, or -1.

    All distances come of one product of single precision first. Those that its error leaves
    among the least are worked out anew, so that what is told is exact.  Where ``most`` bounds all
    rows, leading axes and the length of what they leave tell how near two rows are at least.
    """
    centre = y.mean(0)
    p, q = x - centre, y - centre
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    top = qq.max()
    plain = not (pp.max() + top < 1e30)  # numbers that single precision can't hold, or no numbers
    error = (x.shape[1] + 8) * 2.0**-22 * (pp + top) + 1e-30
    bounded = not plain and np.isfinite(most).all()
    if bounded:
        worth, axes = np.linalg.eigh(q.T @ q)
        n = int(np.searchsorted(np.cumsum(worth[::-1]), AXES * worth.sum())) + 1
        if n < x.shape[1] // 2:
            short = [t @ axes[:, ::-1][:, :n] for t in (p, q)]
            p, q = (np.column_stack([t, np.sqrt(np.maximum(tt - (t * t).sum(1), 0))]) for t, tt in zip(short, (pp, qq), strict=True))
    if not plain:
        wide, tall = np.column_stack([p, pp, np.ones(len(p))]).astype(np.float32), np.column_stack([-2 * q, np.ones(len(q)), qq]).astype(np.float32).T.copy()
    m, step = min(k, len(y)), max(1, HELD // len(y))
    for at in range(0, len(x), step):
        s = slice(at, min(len(x), at + step))
        d = squared_distances(x[s], y) if plain else wide[s] @ tall
        mine = np.flatnonzero(own[s] >= 0)
        d[mine, own[s][mine]] = np.inf
        if plain:
            d[np.isnan(d)] = np.inf
            i, j = least_of(d, k, most[s])
            yield i + at, j, np.round(d[i, j], 12)
            continue
        far = most[s]
        if not bounded:
            far = np.minimum((d.min(1) if m == 1 else np.partition(d, m - 1, axis=1)[:, m - 1]) + error[s], far)
        i, j = np.nonzero(d <= (far + error[s]).astype(np.float32)[:, None])
        some = np.isfinite(d[i, j])
        i, j = i[some] + at, j[some]
        near = np.empty(len(i))
        for c in range(0, len(i), EXACT):
            near[c : c + EXACT] = ((x[i[c : c + EXACT]] - y[j[c : c + EXACT]]) ** 2).sum(1)
        near = np.round(near, 12)
        order = np.lexsort((j, near, i))
        order = order[near[order] <= most[i[order]]]
        i, j, near = i[order], j[order], near[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[kept], j[kept], near[kept]


#: Blocks up to which all meet, without pivots.
FEW_BLOCKS = 4


def _all_blocks(df: DataFrame, queries: DataFrame | None, within: list[str], run, schema: str, blocks: int) -> DataFrame:
    """Every block of queries (of all rows without) meets every block of rows of its group, by ``run`` as in ``meet``."""
    block, every = block_of(F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = df.where("v is not null").select(*within, every.alias("block"), block.alias("to_block"), "id", "v", F.lit(False).alias("asks"))
    asks = (df if queries is None else queries).where("v is not null").select(*within, block.alias("block"), every.alias("to_block"), "id", "v", F.lit(True).alias("asks"))
    pair = [*within, "block", "to_block"]

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches)).assign(bound=np.nan)
        t = t.iloc[np.argsort(t["id"].to_numpy(), kind="stable")]
        asking = t["asks"].to_numpy(bool)
        if asking.any() and not asking.all():
            yield from run(t[asking], t[~asking], False)

    return spread(asks.unionByName(rows), pair).groupBy(*pair).applyInPandas(group, schema)


def nearest(df: DataFrame, queries: DataFrame | None, k: int, within: list[str], cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, decode=matrix) -> DataFrame:
    """a, b, d (squared, to 12 places), rank: the k nearest other rows of (id, v) in the same group for each query, ties to the smaller id.

    A first meeting with its own block bounds how far a query has to look; then
    it meets the blocks of all cells within that bound.  Of a few blocks, all meet at once.
    ``decode`` makes a matrix of a series of v.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame, home: bool) -> Iterator[pd.DataFrame]:
        a, b, far = left["id"].to_numpy(), right["id"].to_numpy(), left["bound"].fillna(np.inf).to_numpy(float)
        own = np.minimum(np.searchsorted(b, a), len(b) - 1)  # b is sorted, so ties keep the smaller id
        for i, j, d in least_pairs(decode(left["v"]), decode(right["v"]), k, far**2 * (1 + SLACK) + SLACK, np.where(b[own] == a, own, -1)):
            yield pd.DataFrame({"a": a[i], "b": b[j], "d": d})

    schema = "a long, b long, d double"
    order = Window.partitionBy("a").orderBy("d", "b")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    n = df.count()
    if n <= FEW_BLOCKS * min(cell_rows, block_rows):
        return ranked(_all_blocks(df, queries, within, run, schema, max(1, -(-n // min(cell_rows, block_rows)))))
    known = indexed(df, within, cell_rows, block_rows, decode)
    if known is None:
        return df.sparkSession.createDataFrame([], f"{schema}, rank int")
    pivots, rows, cells = known
    asking = rows
    if queries is not None:
        at = staged(placed(queries.where("v is not null"), within, pivots, decode), "asking")
        asking = _blocked(at, cells, within)
    home = asking.withColumns({"to": F.col("cell"), "to_block": F.col("block"), "bound": F.lit(None).cast("double")})
    first = staged(meet(home, rows, within, run, schema), "nearest")
    bound = first.groupBy("a").agg(F.count("*").alias("n"), F.max("d").alias("far")).where(F.col("n") >= k).select(F.col("a").alias("id"), F.sqrt("far").alias("bound"))
    bounded = asking.join(bound.hint("merge"), "id", "left")
    asked = _to_blocks(targets(bounded, cells, within, pivots, None, k + 1, decode=decode), cells, within).where("not (cell = to and block = to_block)")
    return ranked(first.unionByName(meet(asked, rows, within, run, schema)))


def _asked(rows: DataFrame, cells: DataFrame, within: list[str], pivots: np.ndarray, radius: float, mark: str | None = None) -> DataFrame:
    """Asks such that each pair of rows within the (squared) radius meets once, or in a block that meets itself. Of two cells the lower asks."""
    asked = targets(rows.withColumn("bound", F.lit(None).cast("double")), cells, within, pivots, float(np.sqrt(radius)), mark=mark)
    return _to_blocks(asked, cells, within).where("cell < to or cell = to and block <= to_block")


def near_pairs(df: DataFrame, radius: float, within: list[str], cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a < b, d: pairs of rows (id, v) of a group whose squared distance is below ``radius``."""

    def run(left: pd.DataFrame, right: pd.DataFrame, home: bool) -> Iterator[pd.DataFrame]:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        for s, d in distances(left, right):
            i, j = np.nonzero((d < radius) & (a[s, None] < b[None, :] if home else True))
            yield pd.DataFrame({"a": np.minimum(a[s][i], b[j]), "b": np.maximum(a[s][i], b[j]), "d": d[i, j]})

    schema = "a long, b long, d double"
    known = indexed(df, within, cell_rows, block_rows)
    if known is None:
        return df.sparkSession.createDataFrame([], schema)
    pivots, rows, cells = known
    return meet(_asked(rows, cells, within, pivots, radius), rows, within, run, schema)


class Forest:
    """Components of numbered nodes, and the edges that made them: one less than nodes at most."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = self.root[i], self.root[j]
        while (apart := x != y).any():
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            high, at = np.unique(np.maximum(x, y), return_index=True)
            self.edges.append((i[at], j[at]))
            up = np.arange(len(self.root))
            up[high] = np.minimum(x, y)[at]  # always to a smaller root, so without circles
            while ((further := up[up]) != up).any():
                up = further
            self.root, x, y = up[self.root], up[x], up[y]


def near_counts_and_links(df: DataFrame, radius: float, least: int, within: list[str], cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame] | None:
    """Core rows (id) of (id, v), which have ``least`` rows at least of their group within the radius, themselves counted; and links (a, b, border).

    Blocks meet twice and pairs never leave them.  First they hand on how many
    near rows each row has; then, of core rows, the edges of a forest of theirs
    (border is false), and for each other row a its smallest core row b.  None for no rows.
    """
    known = indexed(df, within, cell_rows, block_rows)
    if known is None:
        return None
    pivots, rows, cells = known

    def count(left: pd.DataFrame, right: pd.DataFrame, home: bool) -> Iterator[pd.DataFrame]:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        one, other = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for s, d in distances(left, right):
            near = (d < radius) & (a[s, None] != b[None, :] if home else True)
            one[s] = near.sum(1)
            other += near.sum(0)
        for ids, n in ((a, one),) if home else ((a, one), (b, other)):
            yield pd.DataFrame({"id": ids[n > 0], "n": n[n > 0]})

    core = rows.select("id")
    if least > 1:
        counts = meet(_asked(rows, cells, within, pivots, radius), rows, within, count, "id long, n long")
        core = staged(counts.groupBy("id").agg((F.sum("n") + 1).alias("n")).where(F.col("n") >= least).select("id"), "core")

    def link(left: pd.DataFrame, right: pd.DataFrame, home: bool) -> Iterator[pd.DataFrame]:
        a, b, p, q = left["id"].to_numpy(), right["id"].to_numpy(), left["core"].to_numpy(bool), right["core"].to_numpy(bool)
        nodes = b if home else np.concatenate([b, a])
        forest, shift, none = Forest(len(nodes)), 0 if home else len(b), np.iinfo(np.int64).max
        one, other = np.full(len(a), none), np.full(len(b), none)
        for s, d in distances(left, right):
            near = d < radius
            i, j = np.nonzero(near & p[s, None] & q[None, :])
            forest.add(i + s.start + shift, j)
            for some, least_, rows_, by, axis in ((~p[s], one[s], near, b[q], 1), (~q, other, near, a[s][p[s]], 0)):
                if some.any() and len(by):
                    mine = rows_[some][:, q] if axis else rows_[p[s]][:, some].T
                    first = by[mine.argmax(1)]  # ids are in order
                    least_[some] = np.where(mine.any(1), np.minimum(least_[some], first), least_[some])
        if forest.edges:
            i, j = (nodes[np.concatenate(x)] for x in zip(*forest.edges, strict=True))
            yield pd.DataFrame({"a": i, "b": j, "border": False})
        for ids, least_ in ((a, one),) if home else ((a, one), (b, other)):
            yield pd.DataFrame({"a": ids[least_ < none], "b": least_[least_ < none], "border": True})

    told = core.select("id", F.lit(True).alias("core_")).hint("merge")
    marked = staged(rows.join(told, "id", "left").withColumn("core", F.coalesce("core_", F.lit(False))).drop("core_"), "marked")
    links = meet(_asked(marked, cells, within, pivots, radius, "core"), marked, within, link, "a long, b long, border boolean", "core")
    return core, staged(links, "links")
