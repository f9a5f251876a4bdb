"""Session and table helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscape.operators.graph import shared_folder, staged  # noqa: F401  also for the modules beside this one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def discard(df: DataFrame) -> None:
    """Remove what staged() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shares(texts: DataFrame, column: str, most_bytes: int) -> int:
    """How many groups of up to about ``most_bytes`` of text there are: their number follows the data, not the session's settings."""
    return 1 + (texts.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0) // most_bytes


#: A key that more than one in so many rows ask for is looked up in a broadcast table.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, values: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, which has each key once and in ``n`` at least how many of the rows ask for it.

    Keys of more than a thousandth of all that ``n`` sums to are broadcast: there
    can't be more than a thousand of them, and rows that found theirs are dealt out
    by their place in the scan.  The rest meets by a shuffle in which no key has
    more rows than that.  ``rows`` should be a scan (of a source or a staged table,
    whose rows come in one order whenever they are read); ``values`` should be staged.
    """
    total = values.agg(F.sum(n).alias("n")).first()["n"] or 0
    value = F.struct(*[c for c in values.columns if c != key])
    few = values.where(F.col(n) * HOT_SHARE > total).select(F.col(key).alias("hot key"), value.alias("hot value"))
    rest = values.where(F.col(n) * HOT_SHARE <= total).select(F.col(key).alias("cold key"), F.lit(0).cast("long").alias("cold place"), value.alias("cold value"))
    told = rows.withColumn("place", F.monotonically_increasing_id() + 1).join(F.broadcast(few), F.col(key) == F.col("hot key"), "left")  # at most a thousand rows
    asks = told.withColumn("asked key", F.when(F.col("hot key").isNull(), F.col(key))).withColumn("place", F.when(F.col("hot key").isNull() & F.col(key).isNotNull(), 0).otherwise(F.col("place")))
    joined = asks.join(rest, (F.col("asked key") == F.col("cold key")) & (F.col("place") == F.col("cold place")), "left").withColumn("value", F.coalesce("hot value", "cold value"))
    out = joined if how == "left" else joined.where("value is not null")
    return out.select(*rows.columns, *[F.col("value")[c].alias(c) for c in values.columns if c != key])
