"""What failed by time or memory in round 3: plans that must not come back, and results against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from clonoscape.functions import alignment as al
from clonoscape.operators import cluster as cl
from clonoscape.operators import pivots
from clonoscape.operators import scoring as sc
from clonoscape.operators import similarity as si
from clonoscape.operators.graph import connected_components, staged

from .test_growth import plan


def test_scores_of_slices_are_those_of_pairs(monkeypatch):  # F13
    rng = np.random.default_rng(2)
    a, b = (["".join(rng.choice(list("ACDE"), n)) for n in rng.integers(0, 60, k)] for k in (23, 31))
    monkeypatch.setattr(al, "PAIRS", 100)  # several slices
    for some in (slice(0, 30), slice(0, 3)):  # of more letters than a byte's scores, and of few
        got = np.concatenate([s for _, s in al.local_score_slices(a, b[some])])
        assert got.tolist() == [al.local_scores([x] * len(b[some]), b[some]).tolist() for x in a]
    assert next(al.local_score_slices(["CASS"], ["CAST"]))[1].dtype == np.int8


@pytest.mark.parametrize("size", [512, 4])
def test_clusters_are_aligned_without_a_shuffle_of_scores(spark, monkeypatch, size):  # F13
    rng = np.random.default_rng(3)
    rows = sorted({(int(c), "".join(rng.choice(list("ACD"), n))) for c, n in zip(rng.choice([0, 1, 1, 1, 2, 3, 5, 7], 40), rng.integers(4, 9, 40), strict=True)})
    monkeypatch.setattr(si, "LEAST_ALIGNED", size)  # of 4: clusters in several blocks
    monkeypatch.setattr(si, "MOST_ALIGNED", size)
    monkeypatch.setattr(al, "PAIRS", 20)
    df = spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(rows)], "cluster int, cdr3 string, id long")
    out = si.cluster_alignments(df)
    assert ("hashpartitioning(ca" in plan(out)) == (size == 4)  # nothing is added up over blocks but for cut clusters
    want = defaultdict(list)
    for i, (c, s) in enumerate(rows):
        for d, t in rows[i + 1 :]:
            want[c, d].append(int(al.local_scores([s], [t])[0]))
    assert {(r["ca"], r["cb"]): (r["mean_score"], r["pairs"]) for r in out.collect()} == {k: (sum(v) / len(v), len(v)) for k, v in want.items()}
    assert dict(out.dtypes) == {"ca": "int", "cb": "int", "mean_score": "double", "pairs": "bigint"}


@pytest.mark.parametrize("groups", [1, 3])
def test_dbscan_writes_no_pairs(spark, monkeypatch, groups):  # F23
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 3)), 300, 0), rng.normal(size=(300, 3)) * 2])  # copies, which are all near one another
    g, eps, least = rng.integers(0, groups, 600), 0.6, 4
    keys = rng.permutation(600) * 3
    written = []
    for m in (cl, pivots):
        monkeypatch.setattr(m, "staged", lambda df, name="": (out := staged(df, name), written.append(out.count()))[0])
    df = spark.createDataFrame([(int(k), v.tolist(), int(i)) for k, v, i in zip(keys, x, g, strict=True)], "k int, v array<double>, g int")
    monkeypatch.setattr(pivots, "HELD", 500)
    got = {r["k"]: r["cluster"] for r in cl.dbscan(df, "k", "v", eps, least, ["g"], cell_rows=60, block_rows=50).collect()}
    assert max(written) < 6000  # of some 50,000 pairs
    near = (((x[:, None] - x[None, :]) ** 2).sum(2) < eps * eps + 1e-12) & (g[:, None] == g[None, :])
    core = near.sum(1) >= least
    label = np.where(core, keys, -1)
    while True:
        low = np.where(core, np.where(near & core[None, :], label[None, :], 10**6).min(1), -1)
        if (low == label).all():
            break
        label = low
    by = np.where(near & core[None, :], keys[None, :], 10**6)
    want = {int(k): int(label[i]) if core[i] else int(label[by[i].argmin()]) if by[i].min() < 10**6 else None for i, k in enumerate(keys)}
    assert got == want and 0 < sum(core) < 600 and any(not core[i] and want[int(k)] is not None for i, k in enumerate(keys)) and None in want.values()


def test_edges_are_worked_out_once(spark):  # the result's plan held them again
    runs = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (None, 4), (7, 6)], "src int, dst int")

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    found = connected_components(rows.mapInPandas(counted, "src int, dst int"))
    assert "MapInPandas" not in plan(found)
    assert {r["node"]: r["component"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6}
    assert runs.value == 5


def test_draws_of_groups_are_dealt_out(spark):  # small rows were drawn for in one task
    rows = spark.range(200).selectExpr("cast(id % 50 as string) as g", "concat('V', id % 3) as v")
    got = sc.category_p(rows, rows, "g", "v", 20)
    told = plan(got)
    assert "REPARTITION_BY_NUM" in told[: told.index("Window")], told
    assert got.count() == 50


def test_pairs_of_regions_travel_one_way(spark):  # F40
    rows = [("a", "CAS"), ("b", "CAT"), ("c", "CAS"), ("d", "CGT"), ("a", "CAG"), ("e", None)]  # one key with two regions
    got = si.one_mismatch_pairs(spark.createDataFrame(rows, "k string, r string"), "k", "r")
    assert plan(got).split("isFinalPlan")[1].count("Generate explode(flatten") == 1  # pairs are made once, not once for each way
    near = lambda x, y: x and y and sum(p != q for p, q in zip(x, y, strict=True)) <= 1
    want = sorted((a, b, int(x != y)) for a, x in rows for b, y in rows if a < b and near(x, y))
    assert sorted(map(tuple, got.collect())) == want
