"""Small frames with results worked out by hand or by plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscape.functions import alignment as al
from clonoscape.functions import strings as st
from clonoscape.functions import vectors as V
from clonoscape.functions.residues import residue_vectors, substitution_scores
from clonoscape.operators import cluster as cl
from clonoscape.operators import curate as cu
from clonoscape.operators import encode as en
from clonoscape.operators import metrics as me
from clonoscape.operators import motif as mf
from clonoscape.operators import sample as sa
from clonoscape.operators import scoring as sc
from clonoscape.operators import similarity as si
from clonoscape.operators.graph import connected_components


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_strings(spark):
    assert one(spark, st.spaced("a"), a="CAF") == "C A F"
    assert one(spark, st.trim_ends("a", 3), a="CASSXYEQYF") == "SXYE"
    assert one(spark, st.trim_ends("a", 3), a="CAF") == ""
    assert one(spark, st.middle("a"), a="ABCDEFGH") == "BCDEFG"
    assert one(spark, st.middle("a"), a="ABCDE") is None
    assert one(spark, st.kmers("a", 3), a="ABCD") == ["ABC", "BCD"]
    assert one(spark, st.kmers("a", 3), a="AB") == []
    assert one(spark, st.masked_kmers("a", 4), a="ABCDE") == ["A.CD", "B.DE", "AB.D", "BC.E"]
    assert one(spark, st.wildcards("a"), a="ABC") == ["*BC", "A*C", "AB*"]
    assert one(spark, st.hamming("a", "b"), a="ABC", b="ABD") == 1
    assert one(spark, st.hamming("a", "b"), a="ABC", b="AB") is None
    assert one(spark, st.numbers("a"), a="[0.5 -1 2e1]") == [0.5, -1.0, 20.0]
    assert one(spark, st.crop_around("a", "b", 2), a="AAACASSAAA", b="CASS") == "AACASSAA"
    assert one(spark, st.truncate("a"), a=1.23456) == 1.234
    assert one(spark, st.mask_rare("a"), a="CUZF") == "CXXF"


def test_choose(spark):
    assert round(one(spark, F.exp(st.ln_choose("a", "b")), a=10, b=3)) == 120
    assert one(spark, st.ln_choose("a", "b"), a=3, b=10) is None


def test_alignment(spark):
    s = substitution_scores()
    assert s["W", "W"] == 4 and s["A", "R"] == -1 and s["F", "Y"] == 3
    assert one(spark, al.gapless_score("a", "b"), a="CAF", b="CRF") == 4 - 1 + 4
    assert one(spark, al.gapless_score("a", "b"), a="C-F", b="CAF") == 8 - 6
    assert one(spark, al.one_gap_score("a", "b"), a="CAF", b="CF") == 8 - 6
    assert one(spark, al.one_gap_score("a", "b"), a="CAAF", b="CF") == -1


def plain_local(a, b, match=3, mismatch=-3, gap=-2):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (match if a[i] == b[j] else mismatch), h[i, j + 1] + gap, h[i + 1, j] + gap)
    return int(h.max())


def test_smith_waterman(spark):
    rng = np.random.default_rng(1)
    pairs = [("".join(rng.choice(list("ACD"), rng.integers(0, 12))), "".join(rng.choice(list("ACD"), rng.integers(0, 12)))) for _ in range(200)] + [(None, "A")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", al.smith_waterman()("a", "b").alias("s")).collect()
    assert all(r["s"] == (None if r["a"] is None else plain_local(r["a"], r["b"])) for r in got)


def plain_isometric(s, vectors):
    d = 16
    zero, eye = np.zeros((d, d)), np.eye(d)
    half = np.block([[zero, zero, eye], [eye, zero, zero], [zero, eye, zero]])
    m = np.block([[np.zeros((3 * d, 3 * d)), half], [half, np.zeros((3 * d, 3 * d))]])
    x = np.zeros(6 * d)
    for c in s:
        x = m @ (x + np.concatenate([vectors[c], np.zeros(5 * d)]))
    return x


def test_isometric_closed_form(spark):
    v = residue_vectors()
    seqs = ["CASSLGQAYEQYF", "CASSF", "CASSPDRGTEAFF", "CAXF"]
    rows = spark.createDataFrame([(s,) for s in seqs], ["s"]).select("s", en.isometric("s", trim=(0, 0)).alias("x")).collect()
    for r in rows:
        assert (r["x"] is None) == ("X" in r["s"])
        if r["x"]:
            assert np.allclose(r["x"], plain_isometric(r["s"], v))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 103), (101, 102), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 103: 103}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pairs_within_mismatches(spark):
    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice(list("AC"), rng.integers(4, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(seqs)), ["k", "s"])
    want = lambda m: {(i, j) for i in range(60) for j in range(i + 1, 60) if len(seqs[i]) == len(seqs[j]) and sum(a != b for a, b in zip(seqs[i], seqs[j], strict=True)) <= m}
    assert {(r["a"], r["b"]) for r in si.one_mismatch_pairs(df, "k", "s").collect()} == want(1)
    assert {(r["a"], r["b"]) for r in si.hamming_pairs(df, "k", "s", 2).collect()} == want(2)


def test_pivot_refuses_repeats(spark):
    df = spark.createDataFrame([(1, "TRA", "x"), (1, "TRA", "y")], ["id", "gene", "cdr3"])
    with pytest.raises(Exception, match="several rows"):
        cu.pivot_chains(df, "id", "gene", ["TRA", "TRB"], ["cdr3"]).collect()


def test_splits_are_disjoint_and_whole(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 7)
    parts = sa.group_split(df, ["g"], {"train": 50, "test": 50}).groupBy("g").agg(F.count_distinct("part").alias("n")).collect()
    assert all(r["n"] == 1 for r in parts)
    s = sa.stratified_split(df, "id", "g", 0.2).groupBy("g").agg(F.avg((F.col("part") == "test").cast("double")).alias("t")).collect()
    assert all(abs(r["t"] - 0.2) < 0.02 for r in s)


@pytest.mark.parametrize("values", [30, 6, 300])
def test_negatives_are_drawn_from_all_that_are_free(spark, values):
    """``per`` different free donors for each positive, or all there are; a chain of a third of the rows, rows that lack chains or an epitope."""
    rng = np.random.default_rng(values)
    rows = [(i, f"E{rng.integers(4)}" if i % 50 else None, int(rng.integers(values)) if i % 3 else 7, int(rng.integers(values)) if i % 11 else None) for i in range(150)]
    rows += [(200 + i, "rare", None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, epitope string, a long, b long").repartition(4)
    got = {}
    for r in sa.negatives(df, "id", "epitope", ("a", "b"), per=3).collect():
        got.setdefault((r["id"], r["epitope"]), []).append((r["rank"], r["donor"]))
    for i, e, _, _ in rows:
        bound_a, bound_b = {r[2] for r in rows if r[1] == e}, {r[3] for r in rows if r[1] == e}
        free = {r[0] for r in rows if None not in r[2:] and r[2] not in bound_a and r[3] not in bound_b} if e else set()
        mine = sorted(got.pop((i, e), []))
        assert [k for k, _ in mine] == list(range(1, 1 + min(3, len(free))))
        assert len({d for _, d in mine}) == len(mine) and {d for _, d in mine} <= free
    assert not got


def test_drawn_numbers_are_different_and_even(spark):
    df = spark.range(4000).select("id", sa.drawn_numbers(F.lit(8).cast("long"), 3, F.col("id")).alias("x"), sa.drawn_numbers(F.lit(2).cast("long"), 3, F.col("id")).alias("all"))
    rows = df.collect()
    assert all(len(set(r["x"])) == 3 and sorted(r["all"]) == [0, 1] for r in rows)
    counts = np.bincount(np.concatenate([r["x"] for r in rows]), minlength=8)
    assert len(counts) == 8 and abs(counts / 1500 - 1).max() < 0.1


def test_tail_of_many_donors(spark):
    """The tail from one term and ratios against exact whole numbers, also where factorials are far beyond a double."""
    from math import comb

    rows = []
    for n, carriers, group, hits in ((40, 12, 9, 5), (3000, 800, 500, 150), (3000, 2900, 2950, 2851), (50, 50, 20, 20)):
        g, tag = f"g{n}-{carriers}", f"{n}-{carriers}-"
        rows.append((g, [f"{tag}{i}" for i in range(n)], carriers, group, hits))
    for g, donors, carriers, group, hits in rows:
        n = len(donors)
        hla = spark.createDataFrame([(d, "A1" if i < carriers else "B") for i, d in enumerate(donors)], "patient string, allele string")
        members = donors[:hits] + donors[carriers : carriers + group - hits]
        got = [r for r in sc.hla_association(spark.createDataFrame([(g, d) for d in members], "grp string, patient string"), hla, "grp").collect() if r["allele"] == "A1"][0]
        want = sum(comb(carriers, i) * comb(n - carriers, group - i) for i in range(hits, min(carriers, group) + 1)) / comb(n, group)
        assert got["p"] == pytest.approx(want, rel=1e-9) and got["group_carriers"] == hits


def test_kmer_totals_and_enrichment(spark):
    df = spark.createDataFrame([("ABCDE",), ("ABC",), ("A",)], ["r"])
    assert mf.kmer_counts(df, "r", (2, 3)).agg(F.sum("n")).first()[0] == 4 + 2 + 3 + 1
    obs = spark.createDataFrame([("AB", 5), ("CD", 3)], ["motif", "n"])
    log = spark.createDataFrame([(1, "AB", 5), (2, "AB", 1)], ["sim", "motif", "n"])
    got = {r["motif"]: r for r in mf.enrichment(obs, log, 4, 10).collect()}
    assert got["AB"]["p"] == 0.25 and got["AB"]["avg_ref"] == 1.5 and got["AB"]["top_ref"] == 5
    assert got["CD"]["p"] == 0.25 and got["CD"]["avg_ref"] == 0 and got["CD"]["ove"] == pytest.approx(1 / 40)


def test_normal_tail_and_null_model(spark):
    from math import erfc, sqrt

    z = [-30.0, -7.5, -3.1, -2.9, -1.0, -0.01, 0.0, 0.5, 1.96, 2.99, 3.0, 3.01, 5.0, 12.0, 30.0]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", st.normal_tail("z").alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * erfc(r["z"] / sqrt(2)), rel=1e-9)
    got = mf.edge_count_null(spark.range(25), spark.range(1000)).first()
    mean, sd = 9.786049e-06 * 1000**2, 1.421e-07 * 1000**2 + 3.176e-03 * 1000
    assert got["z"] == pytest.approx((25 - mean) / sd) and got["p"] == pytest.approx(0.5 * erfc((25 - mean) / sd / sqrt(2)), rel=1e-9)


def test_metrics(spark):
    one_class = spark.createDataFrame([(1, 0.5), (1, 0.7)], ["y", "s"])
    assert me.auroc(one_class, "y", "s").first()[0] is None
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], ["y", "s"])
    assert me.auroc(df, "y", "s").first()[0] == pytest.approx(3.5 / 4)
    assert me.average_precision(df, "y", "s").first()[0] == pytest.approx((1 + 2 / 3) / 2)


def test_vectors(spark):
    assert one(spark, V.correlation("a", "b"), a=[1.0, 2.0, 3.0], b=[2.0, 4.0, 6.0]) == pytest.approx(1)
    assert one(spark, V.correlation("a", "b"), a=[1.0, 1.0], b=[2.0, 4.0]) is None
    assert one(spark, V.pooled("a"), a=[[1.0, 2.0], [3.0, 0.0]])[:6] == [1.0, 2.0, 3.0, 2.0, 2.0, 1.0]


def test_dbscan(spark):
    pts = [(i, [float(i) * 0.1]) for i in range(6)] + [(9, [50.0])]
    got = {r["k"]: r["cluster"] for r in cl.dbscan(spark.createDataFrame(pts, ["k", "v"]), "k", "v", 0.25, 4).collect()}
    assert got == {**{i: 1 for i in range(6)}, 9: None}  # 1 to 4 are cores, 0 and 5 border points
