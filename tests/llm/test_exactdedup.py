import hashlib
import re

import pytest
from pyspark.sql import functions as F

from clonoscape.llm import exactdedup
from tests.duck import compare, connect

from .conftest import DOCS, documents


def brute(rows):
    """doc_id, keep_id, group_size, text_sha256 of (doc_id, text), and how many of each text stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(df, rows):
    got = df.collect()
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len({r["text_sha256"] for r in got})


def test_sql(spark):
    assert compare(exactdedup.op13_exact_dedup(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), exactdedup.SQL) == 200


def test_odd_rows(odd):
    check(exactdedup.exact_duplicates(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])


@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda t: F.length(t), lambda t: F.lit(1)])
def test_texts_of_one_digest_are_told_apart(docs, digest):
    texts = ["a b", "a  b", "a\tb", "b a", " a b", None, "", "ab ", "x" * 300_000, "x" * 299_999 + "y", "x" * 300_000]
    check(exactdedup.exact_duplicates(docs(texts), digest), list(enumerate(texts)))


def test_white_space_other_than_ascii_counts(docs):
    texts = ["a b", "a\xa0b", "a b", "a\x1cb", "A b", "a\x0b\x0cb"]
    got = {r["doc_id"]: r["keep_id"] for r in exactdedup.exact_duplicates(docs(texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}


def test_hot_groups_and_repeated_ids(spark):
    """A text of a third of 6,000 rows, whose rows repeat ids; ids that stand for several texts; null ids."""
    rows = [(i % 40 if i % 3 == 0 else i % 1500 if i % 3 == 1 else None, "hot text" if i % 3 == 0 else f"text {i % 700}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    check(exactdedup.exact_duplicates(df), rows)


def test_empty_and_strings_as_ids(spark):
    assert exactdedup.exact_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    got = exactdedup.exact_duplicates(spark.createDataFrame([("b", "t"), ("a", "t")], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in got) == [("a", "a", True), ("b", "a", False)]


def test_no_python_in_the_plan(spark, capsys):
    """Everything runs in DataFrame functions; columns that clash or aren't needed are not read."""
    df = documents(spark, ["a", "a"]).select("*", F.lit(1).alias("digest"), F.lit(2).alias("row"), F.lit(3).alias("keep_id"))
    out = exactdedup.exact_duplicates(df)
    out.explain("simple")
    assert "Python" not in capsys.readouterr().out
    assert out.count() == 2
