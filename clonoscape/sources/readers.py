"""Readers of the text layouts that receptor data come in. All return DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoscape.operators.ordered import numbered, running

#: Columns of a chain table (fixed values).
CHAIN_COLUMNS = (
    "complex.id:int gene:string cdr3:string v.segm:string j.segm:string species:string mhc.a:string mhc.b:string mhc.class:string antigen.epitope:string "
    "antigen.gene:string antigen.species:string reference.id:string method:string meta:string cdr3fix:string vdjdb.score:int web.method:string "
    "web.method.seq:string web.cdr3fix.nc:string web.cdr3fix.unmp:string"
).split()


def chain_schema() -> T.StructType:
    kinds = {"int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, _, k in (c.rpartition(":") for c in CHAIN_COLUMNS)])


def validate(df: DataFrame, required: list[str], optional: list[str] = ()) -> set[str]:
    """Which optional columns there are; raises if a required one is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return {c for c in optional if c in df.columns}


def undotted(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def read_table(spark: SparkSession, path, schema: T.StructType | str | None = None, sep: str = "\t", header: bool = True, tolerant: bool = False, comment: str | None = None, drop_index: bool = False) -> DataFrame:
    """A delimited table. ``tolerant`` drops malformed lines, ``drop_index`` the first column, ``comment`` lines that begin so."""
    r = spark.read.option("sep", sep).option("header", header).option("mode", "DROPMALFORMED" if tolerant else "PERMISSIVE")
    if comment:
        r = r.option("comment", comment)
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    return df.drop(df.columns[0]) if drop_index else df


def read_whitespace(spark: SparkSession, path, names: list[str], skip_header: bool = True) -> DataFrame:
    """Columns separated by runs of white space."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x"), "value").where("trim(value) <> ''")
    out = lines.select(*[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.where(F.col(names[0]) != names[0]) if skip_header else out


def read_unmarked(spark: SparkSession, path, mark: str = "##") -> DataFrame:
    """Lines that don't begin with the mark, as ``value``."""
    return spark.read.text(path).where(~F.col("value").startswith(mark))


def fields_from(x, at: int):
    """All fields from a place (1-based) on; none if there are fewer."""
    return F.slice(x, F.lit(at), F.greatest(F.size(x) - (at - 1), F.lit(0)))


def read_repertoire(spark: SparkSession, path, header: bool | None = None) -> DataFrame:
    """cdr3, v_gene, info (further fields joined by tabs), file; sequences with ``*`` or ``_`` are left out.

    Only the first line of a file may be a header.  With ``header`` None it is
    one if its first field doesn't begin with C or has CDR3 in it; True says
    that it is, False that it isn't.
    """
    x = F.split("value", "\t")
    first = F.col("_metadata.file_block_start") == 0
    rows = spark.read.text(path).select("value", first.alias("first"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    if header is not False:
        heads = rows.where("first").groupBy("file").agg(F.min("line").alias("line"), F.min_by("value", "line").alias("value"))  # a line for each file
        field = F.split("value", "\t")[0]
        heads = heads if header else heads.where(~field.startswith("C") | F.upper(field).contains("CDR3"))
        rows = rows.join(F.broadcast(heads.select("file", "value", "line")), ["file", "value", "line"], "left_anti")
    rows = rows.select(F.get(x, F.lit(0)).alias("cdr3"), F.get(x, F.lit(1)).alias("v_gene"), F.array_join(fields_from(x, 3), "\t").alias("info"), "file")
    return rows.where((F.col("cdr3") != "") & ~F.col("cdr3").rlike(r"[*_]"))


def _numbered(spark: SparkSession, path) -> DataFrame:
    """file, line (from 0), value of all lines; a file may be read by many tasks, whose places are added up."""
    at = [F.col("start"), F.col("id")]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    return numbered(rows, at, "line", 0, ["file"]).select("file", "line", "value")


def read_fasta(spark: SparkSession, path, upper: bool = False) -> DataFrame:
    """name, sequence: lines below a header joined; the name is the header, or its second field if it has several.

    Files are split among tasks; a record may begin in one and end in another.
    """
    lines = _numbered(spark, path).where("trim(value) <> ''")
    is_header = F.col("value").startswith(">")
    begun = running(lines, ["line"], {"before": is_header.cast("long")}, ["file"])
    records = begun.withColumn("record", F.col("before") + is_header.cast("long")).where("record > 0")
    parts = records.groupBy("file", "record").agg(
        F.max(F.when(is_header, F.substring("value", F.lit(2), F.length("value")))).alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_header, F.struct("line", F.trim("value").alias("s"))))), lambda x: x["s"]), "").alias("sequence"),
    )
    fields = F.split("header", r"\|")
    name = F.when(F.size(fields) > 1, fields[1]).otherwise(F.col("header"))
    return parts.select(name.alias("name"), (F.upper("sequence") if upper else F.col("sequence")).alias("sequence"))


def read_pseudo_fasta(spark: SparkSession, path, field: int = 5) -> DataFrame:
    """cdr3: one ``;``-separated field of every header line."""
    return spark.read.text(path).where(F.col("value").startswith(">")).select(F.get(F.split("value", ";"), F.lit(field - 1)).alias("cdr3"))


def read_unique_sequences(spark: SparkSession, path, gate: str = "^C[AC-WY]{3,}F") -> DataFrame:
    """cdr3, n of the first fields that pass the gate."""
    first = F.split("value", r"\s+")[0]
    return spark.read.text(path).select(first.alias("cdr3")).where(F.col("cdr3").rlike(gate)).groupBy("cdr3").agg(F.count("*").alias("n"))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Every line, repeated ones too, as ``value``."""
    return spark.read.text(path)


def read_motif_p(spark: SparkSession, path) -> DataFrame:
    """motif, p of a motif table with a header (Motif ... p-value)."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.select(F.col("Motif").alias("motif"), F.col("`p-value`").cast("double").alias("p"))


def read_frequencies(spark: SparkSession, path) -> DataFrame:
    """name, freq without a header."""
    return spark.read.schema("name string, freq double").option("sep", "\t").csv(path)


def read_hla(spark: SparkSession, path) -> DataFrame:
    """patient, allele (without what follows a colon) of a ragged table."""
    x = F.split("value", "\t")
    rows = spark.read.text(path).select(x[0].alias("patient"), F.explode(fields_from(x, 2)).alias("allele"))
    return rows.select("patient", F.regexp_replace("allele", ":.*", "").alias("allele")).where("allele <> ''").distinct()


def read_cluster_lines(spark: SparkSession, path) -> DataFrame:
    """cluster (line number from 0), member of lines of comma-separated ids."""
    lines = _numbered(spark, path).where("trim(value) <> ''")
    return lines.select(F.col("line").alias("cluster"), F.explode(F.split("value", ",")).alias("member")).withColumn("member", F.trim("member"))


def read_many(spark: SparkSession, paths: list[str], schema: T.StructType | str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Several files or folders of one layout, with the file each row is from."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(paths).withColumn("file", F.input_file_name())


def read_list_file(spark: SparkSession, path, schema, sep: str = "\t") -> DataFrame:
    """The files named by the lines of a list file (one name a line: a bounded list)."""
    names = [r["value"] for r in spark.read.text(path).where("trim(value) <> ''").collect()]
    return read_many(spark, names, schema, sep)


def read_split(spark: SparkSession, path, epitope: str, part: str) -> DataFrame:
    """One epitope's train or test rows of a partitioned dataset; only its folders are read."""
    return spark.read.parquet(path).where((F.col("epitope") == epitope) & (F.col("part") == part))
