"""Exact duplicates by skew-safe combining, in DataFrame functions alone.

Equal texts are combined in three steps, each of which groups by digest *and*
whole text, so that content is compared at every step: within the rows of one
scan task (Spark's partial aggregate), among the tasks of one salt, and among
the winners of the salts.  A text that a third of all rows share reaches the
second step as one row a task and the third as one row a salt.

Documents then look up the winner by digest.  Digests of several texts, if
there were any, are looked up by digest and text.  Groups of more than a
thousandth of all rows, at most a thousand of them, are looked up in a broadcast
table, all others by a join in which no key has more rows than that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, looked_up, staged, table

#: Salts of the second step.
SALTS = 16


def normal(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def winners(keyed: DataFrame) -> DataFrame:
    """digest, text, keep_id, n of each text of (digest, text, doc_id)."""
    # equal texts of one task become one row, as rows of a task have one salt
    salted = keyed.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("digest", "salt", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    # a digest has at most a row a salt and text here; the partitioning serves both groupings
    return salted.repartition("digest").groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Texts are equal when they are identical after each run of ASCII white space
    became one space; null counts as empty, and long texts are compared whole.
    Of equal texts the row of the smallest doc_id stays; null ids come after all
    others (keep_id is null only if all of a group are); of rows that repeat the
    id too, one stays.  An empty table gives no rows; other columns are ignored.
    ``digest`` only spreads the texts: texts that share one are told apart.
    """
    own = docs.select("doc_id", normal(F.col("text")).alias("text"))
    keyed = own.withColumn("digest", digest(F.col("text")))
    found = winners(keyed).groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))  # no shuffle: partitioned by digest
    groups = staged(found, "groups")
    ids = keyed.select("doc_id", "digest", sha256(F.col("text")).alias("sha"))
    rows = looked_up(ids, groups.where("texts = 1").select("digest", "keep_id", "n"), "digest", "n")
    clash = groups.where("texts > 1").select("digest")
    if not clash.isEmpty():  # one digest, several texts
        some = keyed.join(clash, "digest", "left_semi")
        told = some.join(winners(some), ["digest", "text"]).select("digest", "doc_id", sha256(F.col("text")).alias("sha"), "keep_id", "n")
        rows = rows.unionByName(told)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "members")
    discard(groups)
    # rows that repeat the smallest id of their text: the first of them stays
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return rows.join(first, "row", "left").select("doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce("first", F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, row_number() over (partition by t order by doc_id nulls last) = 1 as kept, t from n window w as (partition by t))
select doc_id, keep_id, group_size, kept, sha256(t) as text_sha256 from g
"""
