import hashlib

import corpus_pipeline as cp
from clonoscape.llm import bpe, decontaminate, jaccard, langid, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = cp.table(spark, SF, "documents")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = cp.staged(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count() <= before
        if name == "near_duplicates":
            groups = jaccard.near_duplicate_groups(docs)
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted({r[0] for r in groups.select("component_id").collect()})
        if name == "decontamination":
            clean = decontaminate.contamination(docs, cp.table(spark, SF, "benchmark")).where("not contaminated")
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in clean.select("doc_id").collect())
        docs, before = out, out.count()
    last = {r["doc_id"]: r for r in cp.STAGES[-1][1](spark, docs, SF).collect()}
    for r in docs.collect():
        ids = bpe.tokenizer(cp.public_tokenizers.path("byte_bpe_50k.json")).encode([r["text"]])[0].tolist()
        assert last[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        for df in (docs, docs.limit(0)):
            assert stage(spark, df, SF).count() <= df.count()


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_language_and_quality_keep_what_is_not_rejected(spark):
    docs = cp.table(spark, SF, "documents")
    told = langid.predict_language(docs, langid.train(docs, F.lit(True)))
    assert ids(cp.language(spark, docs, SF)) == ids(told.where("not rejected"))
    scored = quality.score_quality(docs, quality.train(docs, cp.table(spark, SF, "labels"), F.lit(True)))
    kept = ids(cp.rated(spark, docs, SF))
    assert kept == ids(scored.where("not rejected")) and 0 < len(kept)


def test_near_duplicates_keep_every_text_once(spark):
    """Rows of one id with different texts, and rows without ids, neither lose a text nor keep two of a group."""
    text = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "ABCMZ"}
    near = text["M"].rsplit(" ", 1)[0]  # one word less than M
    rows = [(1, text["A"]), (1, text["C"]), (2, text["A"]), (3, text["M"]), (7, text["M"]), (7, text["Z"]), (None, text["B"]), (None, text["B"]), (9, near), (None, text["M"]), (5, None), (5, ""), (6, " ")]
    rows += [(3, text["M"])] * 4
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = cp.distinct(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, text["A"]), (1, text["C"]), (3, text["M"]), (7, text["Z"]), (None, text["B"]), (5, None), (5, ""), (6, " ")]
    assert got == sorted(want, key=str)
