import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscape.llm import langid, pitmanyor, quality
from clonoscape.llm.common import fold

SF = "/root/testdata/sf0.001"


# language identification


def test_probabilities_of_each_context_sum_to_one():
    m = langid.fit_models({"x": ["abcab cab abba", "cabbage"], "y": ["zzxy xyz zyx"]})
    letters = sorted({c for t in ("abcab cab abba cabbage", "zzxy xyz zyx") for c in t if c != " "})
    for context in ("", "a", "ab", "zz", "qa", "abc", "b "):
        last = []
        for c in [*letters, "w", " "]:  # w stands for any symbol never seen
            x, _, _ = langid.ngrams([context + c])
            if x.shape[1] > 1:  # a separator ends every text, but none leads one
                last.append(m.of_symbols(x)[-1 if c == " " else -2])
        if context == "" or context.endswith(" "):
            last = last[: len(letters) + 1]  # no separator follows another
            assert (np.exp(last).sum(axis=0) < 1 + 1e-5).all()
        else:
            assert np.exp(last).sum(axis=0) == pytest.approx([1, 1], abs=1e-5)


def test_language_of_odd_rows(spark, odd, docs):
    train = docs(["the cat and the dog and the house", "der hund und die katze und das haus"] * 10, ["en", "de"] * 10)
    m = langid.train(train, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict_language(odd, m).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (0, 1, 2, None))
    assert got[4]["lang_pred"] == "en" and 0 < got[4]["score"] <= 1
    assert langid.predict_language(odd, m).count() == odd.count()
    assert langid.keep_identified(odd, m).columns == odd.columns
    assert langid.predict_language(odd.limit(0), m).count() == 0
    empty = langid.train(odd.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict_language(odd, empty).collect()} == {"und"}


def test_languages_of_long_texts_and_rows_without_ids(spark, docs):
    words = {"en": "the cat and the dog and the house ", "de": "der hund und die katze und das haus "}
    rows = docs([words["en"]] * 10 + [words["de"] * 2_000] * 10, ["en"] * 10 + ["de"] * 10)
    anonymous = docs(["le chat et le chien et la maison"] * 10, ["fr"] * 10).withColumn("doc_id", F.lit(None).cast("long"))
    m = langid.train(rows.unionByName(anonymous), F.lit(True))
    assert m.langs == ["de", "en", "fr"]
    assert langid.identify(m, ["die katze und der hund", "the dog and the house", "la maison et le chat"])[0] == ["de", "en", "fr"]


def test_held_out_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op5_kneser_ney_langid(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97


# quality


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op8_bradley_terry_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_quality_of_odd_rows(spark, odd, docs):
    bad, good = "BUY!! NOW!! ###", "A quiet sentence about nothing much, with a few words more."
    train = docs([good, bad] * 20)
    labels = train.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    q = quality.train(train, labels, F.lit(True))
    got = quality.score_quality(odd, q).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in quality.score_quality(train, q).collect()}
    assert min(by[i] for i in range(0, 40, 2)) > 0.9 > 0.3 > max(by[i] for i in range(1, 40, 2))
    none = quality.train(train, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), q).count() == 0


def test_monotone():
    assert quality.monotone(np.array([0, 1, 0, 1])).tolist() == [0, 0.5, 0.5, 1]


# language-model scores


def brute_base(texts, train):
    toks = [(t or "").encode().lower().split() + [None] for t in texts]
    c = Counter(w for x, k in zip(toks, train, strict=True) if k for w in x)
    n, v = sum(c.values()), len(c)
    return n, [(len(x), sum(c[w] > 0 for w in x), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for x in toks]


def test_counts_and_base(odd):
    train = fold(F.col("doc_id"), 5) != 1
    rows = odd.select("doc_id", "text", train.alias("k")).collect()
    n, want = brute_base([r["text"] for r in rows], [r["k"] for r in rows])
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, not r["k"], *w[:2], round(w[2], 6)) for r, w in zip(rows, want, strict=True))
    got = pitmanyor.pitman_yor_scores(odd, train, share=20_000, sweeps=(0, 2, 1)).collect()
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want


def test_without_rows_or_training(odd):
    assert pitmanyor.pitman_yor_scores(odd.limit(0), F.lit(True), sweeps=(0, 1, 1)).count() == 0
    untrained = pitmanyor.pitman_yor_scores(odd, F.lit(False), sweeps=(0, 1, 1)).collect()
    assert len(untrained) == odd.count() and all(r["train_tokens"] == r["n_known"] == 0 and r["score"] == pytest.approx(0, abs=1e-6) for r in untrained)


def test_predictive_probabilities_sum_to_one(docs):
    """From scores of texts of one and two words, with an unknown one among them.

    score("a w") holds p(a | start) p(w | a) p(end | w).  That the probabilities
    after each word sum to one gives those after the start, which must too.
    """
    base = ["a b a c a b b a", "b a b c c a", "a b a b a b"] * 3
    letters = ["a", "b", "c", "unseen"]
    probes = [""] + letters + [f"{x} {y}" for x in letters for y in letters]
    rows = pitmanyor.pitman_yor_scores(docs(base + probes), F.col("doc_id") < len(base), sweeps=(1, 2, 1)).collect()
    p = {probes[r["doc_id"] - len(base)]: 10 ** r["score"] for r in rows if r["doc_id"] >= len(base)}
    one = np.array([p[x] for x in letters])
    two = np.array([[p[f"{x} {y}"] for y in letters] for x in letters])
    first = np.linalg.solve(np.eye(4) - two / one, one)
    assert (first > 0).all() and first.sum() + p[""] == pytest.approx(1, abs=1e-9)


def test_scores_hang_on_the_texts_alone(spark, docs):
    """Not on partitions, chunks or the order of rows."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").orderBy("doc_id").collect()]
    found = []
    for parts, split in (("4", 1), ("11", 3), ("211", 9)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        try:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = pitmanyor.pitman_yor_scores(docs(texts).repartition(split), F.col("doc_id") % 5 != 1, share=50_000, sweeps=(1, 2, 1)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        found.append({r["doc_id"]: r["score"] for r in got})
    assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_better_than_the_base_on_held_out_rows(spark):
    got = pitmanyor.op3_pitman_yor_scores(spark, SF).where("held_out").toPandas()
    assert got["score"].sum() > 0.85 * got["base_score"].sum()


def test_packed_columns():
    columns = [np.zeros(0, np.int64), np.array([0, 1, 255]), np.array([7, 70_000]), np.array([2**64 - 1, 3], np.uint64), np.arange(300)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, pitmanyor.unpacked(pitmanyor.packed(*columns)), strict=True))


def table_weights(c, theta, p, d):
    """Of 1 to c tables, by all customers in turn: each opens a table or joins one, at n - d."""
    w = {(1,): theta * p}
    for _ in range(c - 1):
        new = Counter()
        for sizes, x in w.items():
            new[tuple(sorted((*sizes, 1)))] += x * (theta + d * len(sizes)) * p
            for i, n in enumerate(sizes):
                new[tuple(sorted((*sizes[:i], n + 1, *sizes[i + 1 :])))] += x * (n - d)
        w = new
    t = np.zeros(c)
    for sizes, x in w.items():
        t[len(sizes) - 1] += x
    return t / t.sum()


def test_a_sweep_reseats_every_customer():
    """Table counts follow their distribution given the rest."""
    n = 20_000
    key = np.arange(n).astype(np.uint64)
    for c, theta, p, d in ((2, 1.5, 0.3, 0.6), (6, 3.0, 0.2, 0.5), (8, 40.0, 0.1, 0.7)):
        drawn = pitmanyor.reseat(np.full(n, c), np.full(n, theta), np.full(n, p), d, key, 3)
        assert np.bincount(drawn, minlength=c + 1)[1:] / n == pytest.approx(table_weights(c, theta, p, d), abs=0.02)


def test_seatings_of_many_customers(monkeypatch):
    for d in (0.1, 0.5, 0.6, 0.8, 0.95):
        t = np.arange(1, 513)
        want, got = pitmanyor.stirling(d, 512)[512, 1:], pitmanyor.seatings(np.full(512, 512), t, d)
        gap = (got - want) - (got - want)[0]
        assert np.abs(np.diff(gap)).max() < 0.3 and np.abs(np.diff(gap))[:400].max() < 0.05
    c, theta, p, d = np.full(3000, 512), np.full(3000, 200.0), np.full(3000, 0.05), 0.6
    key = np.arange(3000).astype(np.uint64)
    drawn = pitmanyor.reseat(c, theta, p, d, key, 1)
    monkeypatch.setattr(pitmanyor, "EXACT", 1)
    steps = np.ones(3000, np.int64)
    for sweep in range(2, 5):
        steps = pitmanyor.reseat(c, theta, p, d, key, sweep, steps)
    assert steps.mean() == pytest.approx(drawn.mean(), rel=0.02) and steps.std() == pytest.approx(drawn.std(), rel=0.06)


def test_quality_learns_from_every_labelled_row(spark):
    """More labelled rows than a former bound on a sample; the last ones carry what tells labels apart."""
    rows = [(i, "words of a text " * 3 if i % 3 else "W!?# 77 " * 9, i % 3 > 0) for i in range(9000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int")
    parts, share = quality.labelled_features(docs, labels, F.col("doc_id") >= 0)
    assert sum(len(r["y"]) for r in parts.collect()) == 9000 and abs(share - 2 / 3) < 1e-9
    q = quality.fit_pairs(parts, share)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, q).collect()}
    assert min(got[i] for i, _, y in rows if y) > 0.9 and max(got[i] for i, _, y in rows if not y) < 0.1
    none = quality.train(docs, labels.limit(0), F.col("doc_id") >= 0)
    assert none.curve.tolist() == [0.5]
