import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscape.operators import pivots
from clonoscape.operators import similarity as si


def points(kind, n=600, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "clustered":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, n)] * 8 + rng.normal(size=(n, 8)) * 0.3
    elif kind == "hot":  # a third of the rows are one vector
        x = rng.normal(size=(n, 8))
        x[: n // 3] = x[0]
    else:
        x = rng.normal(size=(n, 8))
    return x.round(3), rng.integers(0, 3, n)


def frame(spark, x, g):
    rows = [(int(i * 7 % 10007), [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, g, strict=True))]
    more = [(20001, None, 1), (20002, [1.0] * x.shape[1], None)]
    return spark.createDataFrame(rows + more, "id long, x array<double>, g int").repartition(5), np.array([r[0] for r in rows])


def distances(x, g=None):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    if g is not None:
        d[g[:, None] != g[None]] = np.inf
    return np.round(d, 12)


@pytest.mark.parametrize("kind", ["clustered", "hot", "plain"])
@pytest.mark.parametrize("grouped", [False, True])
def test_nearest(spark, kind, grouped):
    x, g = points(kind)
    df, ids = frame(spark, x, g)
    df = df if grouped else df.where("id < 20000")
    d = distances(x, g if grouped else None)
    got = {(r["a"], r["rank"]): (r["b"], round(r["d"], 9)) for r in si.nearest_vectors(df, "id", "x", 4, ["g"] if grouped else [], cell_rows=40, block_rows=64).collect()}
    want = {}
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (d[i, j], ids[j]))[:4]
        want |= {(int(ids[i]), r + 1): (int(ids[j]), round(float(d[i, j]), 9)) for r, j in enumerate(order) if np.isfinite(d[i, j])}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    if kind != "hot":
        assert got == want


def test_queries_need_not_be_rows(spark):
    x, g = points("clustered")
    df, ids = frame(spark, x, g)
    q = spark.createDataFrame([(50000 + i, [float(v) for v in r]) for i, r in enumerate(points("plain", 50, 9)[0] * 9)], "id long, x array<double>")
    y = np.array([r["x"] for r in q.orderBy("id").collect()])
    d = np.sort(((y[:, None] - x[None]) ** 2).sum(-1), 1)[:, :3]
    got = {(r["a"] - 50000, r["rank"]): r["d"] for r in si.nearest_vectors(df.where("id < 20000"), "id", "x", 3, queries=q, cell_rows=30, block_rows=64).collect()}
    assert len(got) == 150 and all(abs(got[i, k + 1] - d[i, k]) < 1e-9 for i in range(50) for k in range(3))


def test_fewer_rows_than_asked_for_and_none(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 2.0])], "id long, x array<double>")
    got = sorted((r["a"], r["b"], r["d"]) for r in si.nearest_vectors(few, "id", "x", 9).collect())
    assert got == [(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0), (2, 3, 0.0), (3, 1, 1.0), (3, 2, 0.0)]
    for empty in (few.limit(0), few.withColumn("x", F.lit(None).cast("array<double>"))):
        assert si.nearest_vectors(empty, "id", "x").collect() == si.vectors_within(empty, "id", "x", 1.0).collect() == []


@pytest.mark.parametrize("kind", ["clustered", "hot", "plain"])
@pytest.mark.parametrize("grouped", [False, True])
def test_pairs_within(spark, kind, grouped):
    x, g = points(kind, 300)
    df, ids = frame(spark, x, g)
    df = df if grouped else df.where("id < 20000")
    radius = 4.0 if kind == "plain" else 0.9
    d = distances(x, g if grouped else None)
    want = sorted((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))) for i, j in zip(*np.nonzero(d < radius), strict=True) if i < j)
    got = sorted((r["a"], r["b"]) for r in si.vectors_within(df, "id", "x", radius, ["g"] if grouped else [], cell_rows=25, block_rows=32).collect())
    assert got == want and len(want) > 20


def test_cells_that_meet_grow_less_than_quadratically(spark):
    """On clustered rows, four times the rows meet in far less than sixteen times the pairs of blocks."""
    met = []
    for n in (500, 2000):
        rng = np.random.default_rng(5)
        x = rng.normal(size=(n // 25, 6))[rng.integers(0, n // 25, n)] * 20 + rng.normal(size=(n, 6)) * 0.1
        rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
        centres, at, cells = pivots.indexed(rows, [], 25, 64)
        asked = pivots.targets(at.withColumn("bound", F.lit(None).cast("double")), cells, [], centres, 1.0)
        met.append(asked.select("cell", "to").distinct().count())
    assert met[1] < 6 * met[0]
