"""New repertoires against a frozen reference, as a stream.

An addition: nothing of the kind is required by the batch operators.  Each
micro-batch asks for the nearest reference sequence of its own length and gene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoscape.functions.strings import trim_ends, wildcards


def reference_patterns(reference: DataFrame, seq: str = "cdr3") -> DataFrame:
    """Patterns of the reference's regions with one place masked; write it once and read it for every batch."""
    region = trim_ends(seq, 3)
    return reference.select(seq, region.alias("r"), F.explode(wildcards(region)).alias("p"))


def matches(batch: DataFrame, patterns: DataFrame, key: str, seq: str = "cdr3") -> DataFrame:
    """key, matched: reference sequences whose region differs from the row's in one place at most."""
    region = trim_ends(seq, 3)
    x = batch.select(key, region.alias("q"), F.explode(wildcards(region)).alias("p"))
    return x.join(patterns.select("p", "r", F.col(seq).alias("matched")), "p").select(key, "matched").distinct()


def start(stream: DataFrame, patterns: DataFrame, key: str, out: str, checkpoint: str, seq: str = "cdr3"):
    """Writes each micro-batch's matches to its own folder, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        matches(batch, patterns, key, seq).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
