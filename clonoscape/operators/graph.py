"""Connected components and group tables over edge lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the session has none, a local one is set if everything runs on one
    machine (tests); on a cluster that raises, as executors would each write to
    their own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file:///tmp/clonoscape-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Over how many partitions rows are dealt out: several for each core, but no more than shuffles have. Each costs something however few rows it has, and two shuffles in a row cost that squared."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism)))


def _signed(edges: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """The edges, staged, and numbers that are equal for equal edge sets, whatever their order.

    They are summed over what was written: an Observation would keep its session
    from being sent along with a model, which some estimators of MLlib do.
    """
    out, mixed = staged(edges, "components"), F.xxhash64("src", "dst")
    sums = [F.coalesce(F.sum(F.pmod(mixed, F.lit(m))), F.lit(0)) for m in (1 << 40, (1 << 40) - 87)]
    return out, tuple(int(x) for x in out.agg(F.count(F.lit(1)), *sums).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
    return both.join(low.hint("merge"), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest neighbour."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    joined = down.join(low.hint("merge"), "src")
    links = joined.where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return links.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Components of undirected edges (src, dst): one row (node, component) for each node on an edge.

    ``component`` is the smallest node of the component.  Alternates large-star
    and small-star steps (Kiveris et al. 2014), each a grouped minimum with map
    side combining and an equi-join, so that no group is gathered in one place
    and the number of rounds grows with the logarithm of the diameter.  Null
    ends and self-loops: nulls are dropped, a node with only a self-loop is its
    own component; repeated edges count once.  Edges are written first, so that
    what makes them runs once and is no part of the result's plan.  Raises if the labels still change
    after ``max_rounds``.
    """
    known = staged(edges.select("src", "dst").where("src is not null and dst is not null"), "edges")
    current, before = _signed(_small_star(known))
    for _ in range(max_rounds):
        current, now = _signed(_small_star(_large_star(current)))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    loops = known.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
    return found.unionByName(loops).groupBy("node").agg(F.min("component").alias("component")).hint("merge")
