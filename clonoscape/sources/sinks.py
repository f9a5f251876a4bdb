"""Sinks: Parquet by default, delimited text where a layout asks for it."""

from __future__ import annotations

import dataclasses
import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_unless_there(df: DataFrame, path: str, save: bool = True) -> bool:
    """Parquet at the path, unless saving is off or an output is there already: then it warns and leaves everything as it is."""
    if save and not exists(df.sparkSession, path):
        df.write.parquet(path)
        return True
    warnings.warn(f"{path} is there already; it is kept" if save else f"{path} isn't written: saving is off", stacklevel=2)
    return False


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    """CSV or TSV with a header. ``mode`` ignore leaves an existing output as it is."""
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def write_clusters(clusters: DataFrame, path: str, parameters: dict, mode: str = "errorifexists") -> None:
    """Cluster rows (sequence, cluster, info) as Parquet, with the run's parameters beside them."""
    clusters.write.mode(mode).parquet(f"{path}/rows")
    clusters.sparkSession.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "parameters string").coalesce(1).write.mode(mode).text(f"{path}/parameters")


def write_cluster_text(clusters: DataFrame, path: str, parameters: dict, mode: str = "errorifexists") -> None:
    """Cluster rows as tab-separated lines below two lines that begin with ##: the parameters, and the names of the columns.

    Parts are in order, so that the first one begins with these two lines.
    """
    spark = clusters.sparkSession
    told = " ".join(f"{k}={v}" for k, v in sorted(parameters.items()))
    head = spark.createDataFrame([(0, f"##{told}"), (1, "##" + "\t".join(clusters.columns))], "at int, value string")
    rows = clusters.select(F.lit(2).alias("at"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in clusters.columns]).alias("value"))
    head.unionByName(rows).orderBy("at", "value").select("value").write.mode(mode).text(path)


def write_encodings(encoded: DataFrame, path: str, per_file: int = 50_000, mode: str = "errorifexists") -> None:
    """Vectors as an array column, so many rows a file."""
    encoded.write.mode(mode).option("maxRecordsPerFile", per_file).parquet(path)


def write_distances(pairs: DataFrame, path: str, radius: float | None = None, mode: str = "errorifexists") -> None:
    """A distance matrix in long form (i, j, d); with a radius only what lies within it."""
    out = pairs.select("i", "j", "d")
    (out if radius is None else out.where(F.col("d") <= radius)).write.mode(mode).parquet(path)


def write_results(results: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each result of a run as a dataset of its own."""
    for name, df in results.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with epitope and part, in one folder for each."""
    df.write.mode(mode).partitionBy("epitope", "part").parquet(path)


def parameter_table(spark: SparkSession, parameters) -> DataFrame:
    """name, value of a dataclass or dict of run parameters."""
    items = dataclasses.asdict(parameters) if dataclasses.is_dataclass(parameters) else parameters
    return spark.createDataFrame([(str(k), str(v)) for k, v in items.items()], "name string, value string")


def read_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """A key and value file of run parameters (a few rows)."""
    return {r["name"]: r["value"] for r in spark.read.schema("name string, value string").option("sep", "\t").csv(path).collect()}
