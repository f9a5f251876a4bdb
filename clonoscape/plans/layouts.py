"""Registered queries of sources and sinks: tables are written in a layout to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscape.operators.graph import shared_folder
from clonoscape.sources import readers as rd
from clonoscape.sources import sinks as sk

from .catalogue import query, t
from .repertoire import CTE, repertoire


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def lines(df: DataFrame, line, name: str) -> str:
    """A folder of text files with one expression of each row."""
    at = fresh(df.sparkSession, name)
    df.select(line.alias("value")).write.text(at)
    return at


def tabs(*parts):
    return F.concat_ws("\t", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


PART = "p_partkey long, p_name string, p_brand string, p_size int"
_PART = ["p_partkey", "p_name", "p_brand", "p_size"]


def _part_file(spark, sf) -> str:
    at = fresh(spark, "part")
    sk.write_delimited(t(spark, sf, "part").select(*_PART), at)
    return at


@query("select p_partkey, p_name, p_brand, p_size from part")
def table_with_header(spark, sf):
    return rd.read_table(spark, _part_file(spark, sf), PART)


@query("select p_name, p_brand, p_size from part")
def table_with_index(spark, sf):
    return rd.read_table(spark, _part_file(spark, sf), PART, drop_index=True)


@query("select p_partkey, p_size from part")
def table_columns(spark, sf):
    return rd.read_table(spark, _part_file(spark, sf), PART).select("p_partkey", "p_size")


@query("select cast(p_partkey as varchar) as a, p_brand as b, cast(p_size as varchar) as c from part")
def whitespace_table(spark, sf):
    head = spark.createDataFrame([("a  b\t c",)], "value string")
    rows = t(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("   "), "p_brand", F.lit("\t "), F.col("p_size").cast("string")).alias("value"))
    return rd.read_whitespace(spark, lines(head.unionByName(rows), F.col("value"), "white"), ["a", "b", "c"])


@query("select p_partkey, p_size from part where p_partkey % 7 <> 0")
def tolerant_table(spark, sf):
    """Lines whose size is no number are malformed, and skipped."""
    size = F.when(F.col("p_partkey") % 7 == 0, "bad").otherwise(F.col("p_size").cast("string"))
    return rd.read_table(spark, lines(t(spark, sf, "part"), tabs("p_partkey", size), "tolerant"), "p_partkey long, p_size int", header=False, tolerant=True)


@query("select p_partkey, p_brand from part where p_partkey % 10 <> 3")
def commented_table(spark, sf):
    line = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("#"), F.col("p_name"))).otherwise(tabs("p_partkey", "p_brand"))
    return rd.read_table(spark, lines(t(spark, sf, "part"), line, "comments"), "p_partkey long, p_brand string", header=False, comment="#")


@query("select p_name as value from part where p_partkey % 10 <> 3")
def unmarked_lines(spark, sf):
    line = F.when(F.col("p_partkey") % 10 == 3, F.concat(F.lit("##"), F.col("p_name"))).otherwise(F.col("p_name"))
    return rd.read_unmarked(spark, lines(t(spark, sf, "part"), line, "marks"))


@query(f"with {CTE} select cdr3, v_gene, concat(patient, chr(9), counts) as info from rep where id % 6 <> 5")
def repertoire_file(spark, sf):
    """Sequences with a stop are left out, and the header of each file is found."""
    cdr3 = F.when(F.col("id") % 6 == 5, F.concat("cdr3", F.lit("*"))).otherwise(F.col("cdr3"))
    path = fresh(spark, "repertoire")
    sk.write_delimited(repertoire(spark, sf).select(cdr3.alias("aminoAcid"), F.col("v_gene").alias("vMaxResolved"), F.col("patient").alias("info"), "counts"), path)
    return rd.read_repertoire(spark, path).drop("file")


@query("select distinct p_brand as name, concat(upper(p_type), 'MK') as sequence from part qualify row_number() over (partition by p_brand order by p_partkey) = 1")
def fasta_records(spark, sf):
    """Records over several lines, named by the second field of their header."""
    once = t(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("p_type"))
    return rd.read_fasta(spark, lines(once, F.concat(F.lit(">x|"), "p_brand", F.lit("|y\n"), "p_type", F.lit("\nmk\n")), "fasta"), upper=True)


@query("select p_brand as cdr3 from part")
def pseudo_fasta_field(spark, sf):
    return rd.read_pseudo_fasta(spark, lines(t(spark, sf, "part"), F.concat(F.lit(">a;b;c;d;"), "p_brand", F.lit(";e\nXX")), "pseudo"))


@query(f"with {CTE} select cdr3, count(*) as n from rep where regexp_matches(cdr3, '^C[AC-WY]{{3,}}F') group by 1")
def unique_sequence_file(spark, sf):
    return rd.read_unique_sequences(spark, lines(repertoire(spark, sf), F.concat("cdr3", F.lit(" "), "v_gene"), "unique"))


@query("select p_brand as value, count(*) as n from part group by 1")
def redundant_lines(spark, sf):
    return rd.read_lines(spark, lines(t(spark, sf, "part"), F.col("p_brand"), "lines")).groupBy("value").agg(F.count("*").alias("n"))


@query("select p_brand as motif, p_size / 1000.0::double as p from part")
def motif_p_values(spark, sf):
    path = fresh(spark, "motifs")
    sk.write_delimited(t(spark, sf, "part").select(F.col("p_brand").alias("Motif"), F.lit(3).alias("Counts"), (F.col("p_size") / 1000.0).alias("p-value")), path)
    return rd.read_motif_p(spark, path)


@query("select p_brand as name, p_size / 64.0::double as freq from part")
def background_frequencies(spark, sf):
    return rd.read_frequencies(spark, lines(t(spark, sf, "part"), tabs("p_brand", F.col("p_size") / 64.0), "background"))


@query("with h as (select o_custkey, 'A*' || (o_orderkey % 50) as a from orders) select distinct cast(o_custkey as varchar) as patient, a as allele from h")
def hla_table(spark, sf):
    """Ragged lines: a patient, and as many alleles as there are."""
    alleles = t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("A*"), (F.col("o_orderkey") % 50).cast("string"), F.lit(":0"), (F.col("o_orderkey") % 3).cast("string"))).alias("a"))
    return rd.read_hla(spark, lines(alleles, tabs(F.col("o_custkey").cast("string"), F.array_join("a", "\t")), "hla"))


@query("select n_regionkey as cluster, n_name as member from nation")
def cluster_lines(spark, sf):
    """The number of a line is its cluster, so the lines go to one file in order."""
    path = fresh(spark, "clusters")
    t(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list("n_name"), ", ").alias("value")).coalesce(1).sortWithinPartitions("n_regionkey").select("value").write.text(path)
    return rd.read_cluster_lines(spark, path)


@query("select p_partkey, p_name, p_brand, p_size from part union all select s_suppkey, s_name, 'x', s_nationkey from supplier")
def files_of_a_list(spark, sf):
    other = fresh(spark, "supplier")
    sk.write_delimited(t(spark, sf, "supplier").selectExpr("s_suppkey as p_partkey", "s_name as p_name", "'x' as p_brand", "s_nationkey as p_size"), other)
    names = spark.createDataFrame([(_part_file(spark, sf),), (other,)], "value string")
    return rd.read_list_file(spark, lines(names, F.col("value"), "list"), PART).drop("file")


@query("select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def split_files(spark, sf):
    """One folder for each epitope and part, of which one is read."""
    path = fresh(spark, "split")
    sk.write_split(t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("epitope"), F.col("o_orderstatus").alias("part")), path)
    return rd.read_split(spark, path, "1-URGENT", "F").select("o_orderkey", "o_totalprice")


@query(f"with {CTE} select cdr3 as sequence, v_gene as cluster, patient as info, '{{\"cutoff\": 7}}' as parameters from rep")
def cluster_sink(spark, sf):
    path = fresh(spark, "clusters")
    sk.write_clusters(repertoire(spark, sf).select(F.col("cdr3").alias("sequence"), F.col("v_gene").alias("cluster"), F.col("patient").alias("info")), path, {"cutoff": 7})
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(spark.read.text(f"{path}/parameters").withColumnRenamed("value", "parameters")))  # one row


@query("select vec_id, label, list_sum(list_transform(embedding, lambda x: round(x::double, 6))) as total from embeddings")
def encoding_sink(spark, sf):
    """Vectors in shards of a bounded number of rows."""
    path = fresh(spark, "encodings")
    sk.write_encodings(t(spark, sf, "embeddings"), path, per_file=100)
    return spark.read.parquet(path).select("vec_id", "label", F.aggregate(F.transform("embedding", lambda x: F.round(x.cast("double"), 6)), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("select a.n_nationkey as i, b.n_nationkey as j, abs(length(a.n_name) - length(b.n_name))::double as d from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey where abs(length(a.n_name) - length(b.n_name)) <= 3")
def distance_sink(spark, sf):
    """A sparse matrix: only what lies within the radius is written."""
    n = t(spark, sf, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i"), F.length("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("j"), F.length("n_name").alias("y"))
    path = fresh(spark, "distances")
    sk.write_distances(a.join(b, "n_regionkey").where("i < j").select("i", "j", F.abs(F.col("x") - F.col("y")).cast("double").alias("d")), path, 3)
    return spark.read.parquet(path)


@query("select 'brands' as result, p_brand as key, count(*) as n from part group by 2 union all select 'types', p_type, count(*) from part group by 2")
def result_sinks(spark, sf):
    """Each result of a run as a dataset of its own."""
    path, p = fresh(spark, "results"), t(spark, sf, "part")
    sk.write_results({c: p.groupBy(F.col(k).alias("key")).agg(F.count("*").alias("n")) for c, k in (("brands", "p_brand"), ("types", "p_type"))}, path)
    return spark.read.parquet(f"{path}/brands").withColumn("result", F.lit("brands")).unionByName(spark.read.parquet(f"{path}/types").withColumn("result", F.lit("types")))


@query("select n_nationkey, n_name from nation")
def output_is_kept(spark, sf):
    """A second run leaves the first one's output as it is."""
    path, n = fresh(spark, "kept"), t(spark, sf, "nation").select("n_nationkey", "n_name")
    sk.write_unless_there(n, path)
    sk.write_unless_there(n.withColumn("n_name", F.lit("other")), path)
    return spark.read.parquet(path)


@query("select r_name as name, r_regionkey::varchar as value from region")
def parameter_file(spark, sf):
    """Names and values of a table, written as a file of parameters and read as such."""
    path = fresh(spark, "parameters")
    t(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value")).write.option("sep", "\t").csv(path)
    return sk.parameter_table(spark, sk.read_parameters(spark, path))
