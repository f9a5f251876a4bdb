"""Numbers and running sums over a whole table in order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column], within: list[str] = ()) -> DataFrame:
    """The rows with, for each name, the sum of its column over all rows before them in ``order``.

    With ``within``, only over rows that agree with them in those columns, however
    many these are.  Rows are dealt out by range of the order and written; what the
    driver's plan adds up across ranges is a row for each range (and, with
    ``within``, for each group that a range shares with the one before it: at most
    one).  Rows of equal order count in any sequence; an empty table stays empty.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = staged(df.withColumns({f"{c} own": x for c, x in sums.items()}).repartitionByRange(n, *within, *order).withColumn("range at", F.spark_partition_id()), "ranges")
    ranges = parted.groupBy("range at", *within).agg(*[F.sum(f"{c} own").alias(f"{c} range") for c in sums])
    before = Window.partitionBy(*within).orderBy("range at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = ranges.select("range at", *[F.col(c).alias(f"{c} of range") for c in within], *[F.sum(f"{c} range").over(before).alias(f"{c} base") for c in sums])
    some = base.where(F.greatest(*[F.col(f"{c} base").isNotNull() for c in sums], F.lit(False)))  # at most a row for each range
    inside = Window.partitionBy("range at", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parted.select("*", *[F.coalesce(F.sum(f"{c} own").over(inside), F.lit(0)).alias(f"{c} inside") for c in sums])
    same = own["range at"] == some["range at"]
    for c in within:
        same = same & own[c].eqNullSafe(some[f"{c} of range"])
    joined = own.join(F.broadcast(some), same, "left")
    return joined.select(*[own[c] for c in df.columns], *[(F.coalesce(f"{c} base", F.lit(0)) + F.col(f"{c} inside")).alias(c) for c in sums])


def numbered(df: DataFrame, order: list[Column | str], name: str = "at", first: int = 1, within: list[str] = ()) -> DataFrame:
    """The rows with their place in ``order`` (among those that agree in ``within``), which should tell all rows apart."""
    return running(df, order, {name: F.lit(1).cast("long")}, within).withColumn(name, F.col(name) + first)
