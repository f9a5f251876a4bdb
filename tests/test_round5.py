"""What round 4 found: work that was left out, and steps that took too long; results against brute force."""

from itertools import product

import numpy as np
import pytest

from clonoscape.functions import alignment as al
from clonoscape.operators import cluster as cl
from clonoscape.operators import encode as en
from clonoscape.operators import loops as lo
from clonoscape.operators import pivots
from clonoscape.operators import similarity as si
from clonoscape.operators import tree as tr
from clonoscape.plans import catalogue, wider

from .test_growth import plan
from .test_isometric import brute


def test_features_hold_whole_texts(spark):  # F11
    sf = "/root/testdata/sf0.001"
    rows = {r["id"]: r for r in catalogue.repertoire(spark, sf).collect()}
    s, g = (max(len(r[c]) for r in rows.values()) for c in ("cdr3", "v_gene"))
    hot = lambda t, n: "".join(str(int(t[i : i + 1] == a)) for i in range(n) for a in en.ALPHABET)
    got = wider.features_joined(spark, sf).collect()
    assert len(got) == len(rows) and s > 8 and g > 4
    assert all(r["code"][:-2] == hot(rows[r["id"]]["cdr3"], s) + hot(rows[r["id"]]["v_gene"], g) for r in got)


@pytest.mark.parametrize("block", [4096, 3])
def test_all_pairs_with_one_gap(spark, monkeypatch, block):  # F12
    monkeypatch.setattr(si, "GAP_BLOCK", block)
    monkeypatch.setattr(al, "PAIRS", 5)
    texts = ["CAS", "GAS", "CASF", "WASF", "XASF", "CAXX", "C-SF", "CAASF", "YYYYY", "CASSFF", "", "A"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    got = {(r["x"], r["y"]): r["score"] for r in si.one_gap_pairs(df, "s").collect()}
    pairs = spark.createDataFrame([(a, b) for a, b in product(texts, texts) if len(a) == len(b) + 1], "a string, b string")
    want = {(r["a"], r["b"]): r["d"] for r in pairs.select("a", "b", al.one_gap_score("a", "b").alias("d")).collect()}
    assert got == want and ("WASF", "GAS") in got and None in want.values()


def receptors(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    cores = ["".join(rng.choice(list("ACDE"), int(rng.integers(4, 9)))) for _ in range(n)]
    rows = spark.createDataFrame([(i, f"V{i % 3}", f"CASS{c}EQYF") for i, c in enumerate(cores)], "id long, v string, s string")
    genes = spark.createDataFrame([("V0", "SNAAAA"), ("V1", "SNAAAC"), ("V2", "WWWWWW")], "name string, c string")
    return rows, genes


def test_near_loops_come_of_blocks(spark, monkeypatch):  # pairs met by signatures that nearly all shared
    rows, genes = receptors(spark, 150)
    ask = lambda **more: lo.loop_neighbours(rows, "id", "v", "s", genes, "name", ["c"], **more)
    whole = sorted(map(tuple, ask().collect()))
    monkeypatch.setattr(lo, "MOST_ROWS", 40)
    monkeypatch.setattr(lo, "LEAST_ROWS", 40)
    monkeypatch.setattr(lo, "PAIRS", 300)
    monkeypatch.setattr(lo, "SENT", 100)
    monkeypatch.setattr(lo, "TREE_SENT", 200)
    cut = ask()
    assert sorted(map(tuple, cut.collect())) == whole and len(whole) > 1000
    assert "SortMergeJoin" not in plan(cut)
    few = ask(forest=True)  # a tree needs no more than forests of blocks
    assert few.count() < len(whole) / 3
    tree = lambda e: sorted(r["d"] for r in tr.spanning_forest(e.selectExpr("i as src", "j as dst", "d")).collect())
    assert tree(few) == tree(cut) and set(map(tuple, few.collect())) <= set(whole)


def test_regions_stand_for_their_vectors(spark):  # encodings were worked out by one task, and sent
    texts = ["CASSLGQAYEQYF", "CASSF", "CASSPDRGTEAFF", "CASXFFFFF", "CASSF", "", None]
    df = spark.createDataFrame([(s,) for s in texts], "s string").select("s", en.isometric("s").alias("x"), en.isometric_regions("s").alias("r")).toPandas()
    known = df["x"].notna()
    assert (known == df["r"].notna()).all() and known.sum() == 2
    assert np.array_equal(en.isometric_vectors()(df["r"][known]), np.array(df["x"][known].tolist()))
    assert dict(catalogue._iso_rows(spark, "/root/testdata/sf0.001").dtypes)["x"] == "binary"


@pytest.mark.parametrize("k", [1, 3])
def test_least_pairs_are_exact(monkeypatch, k):  # F3
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, (300, 24)) / 7 + 1000.0  # many ties, far from the origin
    y[:, 6:] = y[:, :1] * np.arange(18)  # leading axes hold nearly all
    x = np.concatenate([y[:50], y[50:90] + 0.01])
    own = np.concatenate([np.arange(50), np.full(40, -1)])
    monkeypatch.setattr(pivots, "HELD", 3000)
    monkeypatch.setattr(pivots, "EXACT", 70)
    d = np.round(((x[:, None] - y[None]) ** 2).sum(-1), 12)
    d[np.arange(50), np.arange(50)] = np.inf
    for most in (np.full(90, np.inf), np.full(90, 3.0), np.where(np.arange(90) % 2, np.inf, 0.5), np.zeros(90)):
        got = [(i, j, v) for t in pivots.least_pairs(x, y, k, most, own) for i, j, v in zip(*t, strict=True)]
        want = [(i, j, d[i, j]) for i in range(90) for j in np.argsort(d[i], kind="stable")[:k] if d[i, j] <= most[i]]
        assert got == want
    big = [(i, j) for t in pivots.least_pairs(x * 1e20, y * 1e20, 1, np.full(90, np.inf), own) for i, j, v in zip(*t, strict=True)]
    assert len(big) == 90


@pytest.mark.parametrize("few", [0, 25, 10_000])
def test_rounds_in_tasks_are_those_of_joins(spark, few):  # F2, F7
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for g in range(3):
        x = (rng.normal(size=(50, 3)) * 1.5).round(2)
        rows += [(g, 100 * g + i, v.tolist(), 1.0) for i, v in enumerate(x)]
        want |= brute(100 * g + np.arange(50), x, 1.0)
    df = spark.createDataFrame(rows, "g int, id long, x array<double>, t double")
    got = {}
    for r in cl.centroid_clusters(df, ["g"], few=few).collect():
        got.setdefault(r["cluster"], set()).add(r["member"])
    named = {}
    for g in want:
        named.setdefault(min(g), set()).update(g)
    assert got == named and len(named) > 5


def test_pairs_of_k_mers_are_not_shuffled(spark):  # all candidates were written to disk, several times each
    texts = ["AAAAAAA", "AAAAACA", "CCAAAAA", "ACACACA", "CACACAC", "GGGGGGG"]
    got = si.shared_kmer_pairs(spark.createDataFrame([(t,) for t in texts], "s string"), "s", "s", 4, 2, 1, (0, 0))
    told = plan(got)
    assert "Exchange" not in told[: told.index("SortMergeJoin")] and "HashAggregate" not in told[: told.index("SortMergeJoin")]
    mers = lambda s: {s[i : i + 4] for i in range(4)}
    shared = lambda a, b: sum(any(sum(p != q for p, q in zip(m, x, strict=True)) <= 1 for x in mers(b)) for m in mers(a))
    want = sorted((a, b, shared(a, b)) for a in texts for b in texts if a < b and shared(a, b) > 1)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 2
