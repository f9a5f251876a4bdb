"""What grew faster than the input in round 3: plans that must not come back, and results against brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscape.operators import encode as en
from clonoscape.operators import loops as lo
from clonoscape.operators import motif as mf
from clonoscape.operators import scoring as sc
from clonoscape.operators import similarity as si

from .test_growth import plan


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    return sorted({"".join(rng.choice(list("ACD"), n)) for n in rng.integers(7, 10, 120)})


def frame(spark, texts):
    return spark.createDataFrame([(s,) for s in texts], "s string")


def test_expansion_joins_draws_by_size_and_mean(spark):  # F1
    rows = spark.range(200).selectExpr("id", "cast(id % 4 + 1 as int) as n", "cast(case when id < 150 then 0 else id end as string) as g")
    got = sc.expansion_enrichment(rows, rows, "g", "n", "id", 20)
    assert "collect_list" in plan(got)
    p = {r["g"]: r["p"] for r in got.collect()}
    import hashlib

    draws = [sorted(range(200), key=lambda i: (hashlib.md5(f"|{sim}|{i}".encode()).hexdigest(), i)) for sim in range(1, 21)]
    for g, own in [("0", range(150)), *[(str(i), [i]) for i in range(150, 200)]]:
        mean, k = np.mean([i % 4 + 1 for i in own]), len(own)
        assert p[g] == round(max(1, sum(np.mean([i % 4 + 1 for i in d[:k]]) >= mean for d in draws)) / 20, 3)


def test_drawn_members_are_not_shuffled(spark, monkeypatch):  # F6
    rows = spark.range(90).selectExpr("cast(case when id < 60 then 0 else id end as string) as g", "concat('V', id % 3) as v")
    whole = sc.category_enrichment(rows, rows, "g", "v", 50)
    assert "hashpartitioning(g" in plan(whole) and "hashpartitioning(g#" in plan(whole) and "sim#" not in plan(whole)
    want = {r["g"]: r["p"] for r in whole.collect()}
    monkeypatch.setattr(sc, "DRAWS", 7)  # draws of many tasks, members in many steps
    assert {r["g"]: r["p"] for r in sc.category_enrichment(rows, rows, "g", "v", 50).collect()} == want


def test_draws_are_not_ranked_whole(spark):  # F36, F37
    df = spark.range(300).selectExpr("id", "cast(id % 3 as string) as v")
    quotas = spark.createDataFrame([("0", 20), ("1", 500), ("9", 5)], "v string, quota long")
    drawn = mf.resamples(df, "id", 130, 5, ["v"], quotas)
    assert "Window" not in plan(drawn) and "Window" not in plan(mf.resamples(df, "id", 10, 5))
    got = drawn.groupBy("sim").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.count_if(F.col("v") == "1").alias("one")).collect()
    assert [(r["n"], r["d"], r["one"]) for r in got] == [(130, 130, 100)] * 5


def test_draws_carry_bits(spark, texts):  # F4, F32
    df = frame(spark, texts)
    got = mf.resample_enrichment(df.limit(20), df, "s", "s", 30)
    assert "hashpartitioning(sim" not in plan(got)


def test_only_near_pairs_meet(spark, texts, monkeypatch):  # F27
    for most in (1, 2, 3):
        want = sorted((a, b, apart(a, b)) for a, b in combinations(texts, 2) if len(a) == len(b) and apart(a, b) <= most)
        got = si.hamming_pairs(frame(spark, texts), "s", "s", most)
        assert "HashAggregate" not in plan(got)  # no pair is made twice
        assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(si, "MOST_MASKS", 2)
    assert sorted(map(tuple, si.hamming_pairs(frame(spark, texts), "s", "s", 3).collect())) == want


def test_nearest_by_patterns(spark, texts, monkeypatch):  # F35
    rows = [*texts, "DDDDDDDDDDDDD"]
    want = {a: min(apart(a, b) for b in rows if a != b and len(a) == len(b)) for a in texts}
    calls, pairs = [], si._candidates
    monkeypatch.setattr(si, "_candidates", lambda *a: calls.append(a) or pairs(*a))
    assert {r["s"]: r["d"] for r in si.nearest_hamming(frame(spark, rows), "s", "s").collect()} == want and not calls
    monkeypatch.setattr(si, "MOST_MASKS", 2)
    assert {r["s"]: r["d"] for r in si.nearest_hamming(frame(spark, rows), "s", "s").collect()} == want and calls
    monkeypatch.undo()
    twice = spark.createDataFrame([(1, "AC"), (2, "AC"), (3, "AD"), (4, ""), (5, "")], "k int, s string")
    assert {r["k"]: r["d"] for r in si.nearest_hamming(twice, "k", "s").collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


@pytest.mark.parametrize("positional", [False, True])
def test_pairs_of_motifs_are_not_made_twice(spark, texts, positional):  # F30, F41
    motifs = spark.createDataFrame([("ACD",), ("AAC",), ("DD",), ("C.A",)], "motif string")
    held = si.motif_members(frame(spark, texts), "s", "s", motifs).collect()
    of = {s: {(r["motif"], r["at"] if positional else 0) for r in held if r["s"] == s} for s in texts}
    got = si.motif_pairs(frame(spark, texts), "s", "s", motifs, positional)
    assert "HashAggregate" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(a, b) for a, b in combinations(texts, 2) if of[a] & of[b]]


@pytest.mark.parametrize(("least", "mismatches"), [(1, 0), (2, 1), (3, 2)])
def test_rarest_k_mers_find_all_pairs(spark, texts, least, mismatches):  # F19
    mers = lambda s: {s[i : i + 4] for i in range(len(s) - 3)}
    shared = lambda a, b: sum(any(apart(m, x) <= mismatches for x in mers(b)) for m in mers(a))
    want = sorted((a, b, shared(a, b)) for a, b in combinations(texts, 2) if len(a) == len(b) and shared(a, b) >= least)
    got = si.shared_kmer_pairs(frame(spark, texts), "s", "s", 4, least, mismatches, (0, 0))
    assert "shared" in plan(got) and "ArrowEvalPython" in plan(got)  # counted once two rows have met
    assert sorted(map(tuple, got.collect())) == want


def test_one_hot_reads_its_sequence_once(spark):  # F38, F39
    df = spark.createDataFrame([("ACX",), ("",), (None,), ("YYYYYY",)], "s string")
    got = df.select(F.concat("s", F.lit("A")).alias("s")).select(en.one_hot("s", 4).alias("x"))
    assert "concat" not in got._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction", 1)[1]
    rows = [r["x"] for r in got.collect()]
    want = lambda s: [int(s[i : i + 1] == a) for i in range(4) for a in en.ALPHABET]
    assert rows == [want("ACXA"), want("A"), [None] * 80, want("YYYYYYA")]


def test_pairs_of_loops_are_not_made_twice(spark):  # F5, F9
    df = spark.createDataFrame([(1, "V", "CASSAAAAEQYF"), (2, "V", "CASSAAACEQYF"), (3, "V", "CASSAAACGEQYF")], "id long, v string, s string")
    genes = spark.createDataFrame([("V", "SN", "YD")], "name string, one string, two string")
    got = lo.loop_neighbours(df, "id", "v", "s", genes, "name", ["one", "two"])
    assert "HashAggregate" not in plan(got)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == [(1, 2), (1, 3), (2, 3)]
