"""Registered queries of the receptor operators, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscape.functions import alignment as al
from clonoscape.functions import strings as st
from clonoscape.functions import vectors as V
from clonoscape.functions.residues import ALPHABET, residue_vectors, substitution_scores
from clonoscape.operators import cluster as cl
from clonoscape.operators import curate as cu
from clonoscape.operators import encode as en
from clonoscape.operators import loops as lo
from clonoscape.operators import metrics as me
from clonoscape.operators import models as mo
from clonoscape.operators import motif as mf
from clonoscape.operators import sample as sa
from clonoscape.operators import scoring as sc
from clonoscape.operators import similarity as si
from clonoscape.operators.graph import connected_components, parts, staged

from .repertoire import CTE, repertoire

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def unique_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct gated sequences of the repertoire, with their trimmed region."""
    return cu.gated_sequences(repertoire(spark, sf)).select("cdr3").distinct().withColumn("region", st.trim_ends("cdr3", 3))


REP = f"with recursive {CTE}, u as (select distinct cdr3, substring(cdr3, 4, length(cdr3) - 6) as region from rep where length(cdr3) between 10 and 24)"
EDGES = "e as (select a.cdr3 as a, b.cdr3 as b from u a join u b on length(a.cdr3) = length(b.cdr3) and a.cdr3 < b.cdr3 and hamming(a.cdr3, b.cdr3) <= 1)"
REACH = "r as (select cdr3 as s, cdr3 as c from u union select x.d, r.c from r join (select a as s, b as d from e union all select b, a from e) x on x.s = r.s), comp as (select s, min(c) as c from r group by s)"


# groups


def _edges(spark, sf):
    return si.one_mismatch_pairs(unique_sequences(spark, sf), "cdr3", "cdr3")


@query(f"{REP}, {EDGES}, {REACH} select concat('CRG-', min(s)) as tag, cast(count(*) as int) as size, string_agg(s, ' ' order by s) as members from comp group by c")
def convergence_groups(spark, sf):
    edges = _edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return cl.group_table(cl.with_components(unique_sequences(spark, sf), edges, "cdr3"), "cdr3")


@query(f"{REP}, {EDGES} select cdr3 from u where cdr3 not in (select a from e union select b from e)")
def singletons(spark, sf):
    edges = _edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return cl.singletons(unique_sequences(spark, sf), edges, "cdr3")


@query(
    "with recursive m as (select c_custkey as cluster, cast(floor(c_acctbal) as bigint) as member from customer union select c_custkey, cast(floor(c_acctbal + 0.5) as bigint) from customer), "
    "p as (select distinct a.cluster as x, b.cluster as y from m a join m b using (member)), r as (select cluster as s, cluster as c from m union select p.y, r.c from r join p on p.x = r.s), "
    "k as (select s, min(c) as component from r group by s) select distinct member, component from m join k on m.cluster = k.s"
)
def merge_overlaps(spark, sf):
    """Customers whose balances round to a common number."""
    member = F.explode(F.array_distinct(F.array(F.floor("c_acctbal"), F.floor(F.col("c_acctbal") + 0.5))))
    return cl.merge_overlaps(t(spark, sf, "customer").select(F.col("c_custkey").alias("cluster"), member.alias("member")))


@query(f"{REP}, {EDGES}, {REACH} select s as node, c as component from comp where s in (select a from e union select b from e)")
def components(spark, sf):
    return connected_components(_edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst")))


# curation

CHAINS = "select o_orderkey as row_id, o_custkey as complex_id, case when o_orderkey % 2 = 0 then 'TRA' else 'TRB' end as gene, concat('C', substring(o_orderpriority, 3, 4), case when o_orderkey % 3 = 0 then 'F' when o_orderkey % 3 = 1 then 'W' else 'L' end) as cdr3, case when o_custkey % 4 = 0 then concat('TRAV', cast(o_custkey as varchar(9))) else 'TRBV1' end as v_segm, case when o_orderstatus = 'O' then 'HLA-A' else 'B' end as mhc_a, case when o_totalprice < 200000 then 'MHCI' else 'other' end as mhc_class, cast(o_orderkey % 4 as int) as vdjdb_score, concat('E', cast(o_orderkey * 7 % 53 as varchar(9))) as epitope from "


def chains(spark, sf):
    """A chain table derived from orders."""
    return spark.sql(CHAINS + "{o}", o=t(spark, sf, "orders"))


CH = f"with ch as ({CHAINS} orders)"


@query(f"{CH} select row_id, case when gene = 'TRA' and not regexp_matches(cdr3, '^C.*[FW]$') then 0 else 1 end as is_cdr3_alpha_valid, case when mhc_a like 'HLA-%' then 1 else 0 end as is_mhc_a_valid from ch")
def validity_flags(spark, sf):
    return cu.with_validity(chains(spark, sf)).select("row_id", "is_cdr3_alpha_valid", "is_mhc_a_valid")


@query(
    f"{CH} select count(*) filter (gene = 'TRA' and not regexp_matches(cdr3, '^C.*[FW]$')) as invalid_cdr3_alpha, count(*) filter (gene = 'TRA' and v_segm not like 'TRAV%') as invalid_v_alpha, count(*) filter (mhc_a not like 'HLA-%') as invalid_mhc_a, count(*) filter (mhc_class not in ('MHCI', 'MHCII')) as invalid_mhc_class from ch"
)
def validity_counts(spark, sf):
    return cu.validity_counts(chains(spark, sf))


@query(f"{CH}, f as (select * from ch where vdjdb_score >= 1 and cdr3 is not null and mhc_a like 'HLA-%' and complex_id <> 0), k as (select epitope from f group by epitope order by count(*) desc, epitope limit 30) select row_id, epitope from f where epitope in (select epitope from k)")
def quality_filter_topk(spark, sf):
    good = cu.quality_filter(cu.with_validity(chains(spark, sf)), ["cdr3"], ["is_mhc_a_valid"], 1, complex_id="complex_id")
    return cu.keep_top(good, "epitope", 30).select("row_id", "epitope")


@query(f"{CH}, a as (select complex_id, min_by(cdr3, row_id) as cdr3_a, min_by(v_segm, row_id) as v_segm_a from ch where gene = 'TRA' group by 1) select complex_id, row_id, cdr3 as cdr3_b, v_segm as v_segm_b, cdr3_a, v_segm_a from ch join a using (complex_id) where gene = 'TRB' and complex_id <> 0")
def pair_first_match(spark, sf):
    return cu.pair_chains(chains(spark, sf), "row_id", keep=["cdr3", "v_segm"])


@query(f"{CH}, o as (select * from ch qualify row_number() over (partition by complex_id, gene order by row_id) = 1) select complex_id, max(case when gene = 'TRA' then cdr3 end) as \"TRA_cdr3\", max(case when gene = 'TRA' then v_segm end) as \"TRA_v_segm\", max(case when gene = 'TRB' then cdr3 end) as \"TRB_cdr3\", max(case when gene = 'TRB' then v_segm end) as \"TRB_v_segm\" from o group by 1")
def pivot_by_chain(spark, sf):
    once = cu.first_per_key(chains(spark, sf), ["complex_id", "gene"], ["row_id"])
    return cu.pivot_chains(once, "complex_id", "gene", ["TRA", "TRB"], ["cdr3", "v_segm"])


_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(" union all ".join(f"select '{c}' as name, count(*) - count({c}) as nulls, (count(*) - count({c})) * 100.0::double / count(*) as null_percent, count(distinct {c}) as distinct_values from part" for c in _COLS))
def table_profile(spark, sf):
    return cu.profile(t(spark, sf, "part").select(*_COLS)).drop("kind")


@query(f"{CH} select cdr3, v_segm, string_agg(distinct epitope, ' ' order by epitope) as labels from ch group by 1, 2")
def multi_label_sets(spark, sf):
    return cu.label_sets(chains(spark, sf), ["cdr3", "v_segm"], "epitope").withColumn("labels", F.array_join("labels", " "))


@query(f"{CH} select cdr3, v_segm, count(distinct epitope) as n from ch group by 1, 2 having count(distinct epitope) > 6")
def cross_reactive_groups(spark, sf):
    return cu.cross_reactive(chains(spark, sf), ["cdr3", "v_segm"], "epitope", 6).select("cdr3", "v_segm", F.size("labels").cast("long").alias("n"))


@query(f"with {CTE} select cdr3, v_gene, string_agg(patient, ' ' order by patient) as infos, count(*) - 1 as extra from rep group by 1, 2")
def collapse_identical(spark, sf):
    return cu.collapse_identical(repertoire(spark, sf), ["cdr3", "v_gene"], "patient").withColumn("infos", F.array_join("infos", " "))


@query(f"with {CTE} select cdr3, v_gene, min(id) as id, min_by(patient, id) as patient from rep group by 1, 2")
def first_per_key(spark, sf):
    return cu.first_per_key(repertoire(spark, sf), ["cdr3", "v_gene"], ["id"]).select("cdr3", "v_gene", "id", "patient")


@query("with o as (select o_orderkey from orders where o_orderstatus = 'O') select n as o_orderkey from range(1, (select max(o_orderkey) from o)) r(n) where n not in (select o_orderkey from o)")
def missing_ids(spark, sf):
    """Orders that aren't open, as gaps between the open ones."""
    open_ = t(spark, sf, "orders").where("o_orderstatus = 'O'")
    return cu.missing_ids(open_, "o_orderkey", 1, open_.agg(F.max("o_orderkey").alias("n")).first()["n"])


@query("select p_partkey, (p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part) as p_size from part")
def standardised(spark, sf):
    return cu.standardised(t(spark, sf, "part").select("p_partkey", "p_size"), ["p_size"])


@query("select p_brand, avg(p_retailprice) filter (p_size < 20) as small, avg(p_retailprice) filter (p_size >= 20) as large from part group by 1")
def pivot_mean(spark, sf):
    p = t(spark, sf, "part").withColumn("s", F.when(F.col("p_size") < 20, "small").otherwise("large"))
    return cu.pivot_mean(p, "p_brand", "s", "p_retailprice", ["small", "large"])


@query("with s as (select p_brand, count(*) as n from part group by 1), k as (select *, row_number() over (order by n, p_brand) as i, (select count(*) from s) as c from s) select p_brand, n from k where i > greatest(c // 2 - 2, 0) and i <= greatest(c // 2 - 2, 0) + 5")
def middle_ranked(spark, sf):
    return cu.middle_ranked(t(spark, sf, "part"), "p_brand")


@query("select p_type, count(*) as n from part group by 1 order by 2 desc, 1 limit 10")
def top_values(spark, sf):
    return cu.top_values(t(spark, sf, "part"), "p_type", 10)


@query("(select n_nationkey as k from nation except select s_nationkey from supplier) union all (select s_nationkey from supplier except select n_nationkey from nation)")
def symmetric_difference(spark, sf):
    return cu.symmetric_difference(t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("select s.s_suppkey, n.n_name from supplier s left join (select n_regionkey, max_by(n_name, n_nationkey) as n_name from nation group by 1) n on s.s_nationkey = n.n_regionkey")
def lookup_last(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_regionkey"))
    return cu.lookup(s, t(spark, sf, "nation"), "n_regionkey", "n_name", "n_nationkey").select("s_suppkey", "n_name")


@query("with q as (select c_custkey as id, c_mktsegment as seg, c_nationkey as cluster from customer where c_nationkey = 3), r as (select c_custkey + 1 as id, c_mktsegment as seg, c_nationkey + 100 as cluster from customer), h as (select distinct r.cluster from r join q using (id, seg)) select distinct id, seg, cluster from (select * from q union all select r.* from r where cluster in (select cluster from h))")
def merge_reference(spark, sf):
    c = t(spark, sf, "customer")
    q = c.where("c_nationkey = 3").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("cluster"))
    r = c.select((F.col("c_custkey") + 1).alias("id"), F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") + 100).alias("cluster"))
    return cu.merge_reference(q, r, ["id", "seg"])


@query("select count(*) as n, round(avg(p_retailprice), 6) as mean, round(stddev_samp(p_retailprice), 6) as deviation, min(p_retailprice) as low, round(quantile_cont(p_retailprice, 0.25), 6) as q1, round(quantile_cont(p_retailprice, 0.5), 6) as q2, round(quantile_cont(p_retailprice, 0.75), 6) as q3, max(p_retailprice) as high from part")
def numeric_summary(spark, sf):
    x = "p_retailprice"
    quartiles = [F.round(F.percentile(x, p), 6).alias(f"q{i}") for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))]
    return t(spark, sf, "part").agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("deviation"), F.min(x).alias("low"), *quartiles, F.max(x).alias("high"))


@query("select p_brand, count(*) as n from part group by 1 order by 2 desc, 1 limit 1")
def most_frequent_value(spark, sf):
    return cu.top_values(t(spark, sf, "part"), "p_brand", 1)


# strings


@query(f"with {CTE} select min(length(cdr3)) as shortest, max(length(cdr3)) as longest from rep")
def length_range(spark, sf):
    n = F.length("cdr3").cast("long")
    return repertoire(spark, sf).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query(f"with {CTE} select distinct substring(cdr3, i::int, 1) as letter from (select cdr3, unnest(range(1, length(cdr3) + 1)) as i from rep)")
def alphabet_found(spark, sf):
    return repertoire(spark, sf).select(F.explode(F.split("cdr3", "")).alias("letter")).where("letter <> ''").distinct()


@query(f"with {CTE} select distinct cdr3, substring(cdr3, (length(cdr3) // 2 - 2)::int, 6) as mid from rep")
def middle_six(spark, sf):
    return repertoire(spark, sf).select("cdr3", st.middle("cdr3").alias("mid")).distinct()


@query(f"{REP}, {EDGES} select a, b, hamming(substring(a, 4, length(a) - 6), substring(b, 4, length(b) - 6)) as d from e")
def contact_distances(spark, sf):
    return _edges(spark, sf).select("a", "b", st.contact_distance("a", "b").cast("long").alias("d"))


@query(f"with {CTE} select patient, substring(cdr3, i::int, 2) as kmer, count(*) as n from (select patient, cdr3, unnest(range(1, length(cdr3))) as i from rep) group by 1, 2")
def kmer_totals_by_patient(spark, sf):
    return en.kmer_counts_by_row(repertoire(spark, sf), "patient", "cdr3", 2)


# encoders


@query("select p_partkey, dense_rank() over (order by p_brand) - 1 as code from part")
def label_codes_alpha(spark, sf):
    return en.label_codes(t(spark, sf, "part"), "p_brand").select("p_partkey", F.col("code").cast("long").alias("code"))


@query("with f as (select p_brand, min(p_partkey) as m from part group by 1), c as (select p_brand, row_number() over (order by m) + 1 as code from f) select p_partkey, code from part join c using (p_brand)")
def label_codes_first_seen(spark, sf):
    return en.first_seen_codes(t(spark, sf, "part"), "p_brand", "p_partkey", offset=2).select("p_partkey", F.col("code").cast("long").alias("code"))


@query(f"with {CTE} select id, array_to_string(list_transform(range(0, 20 * 20), lambda i: case when substring(cdr3, (i // 20 + 1)::int, 1) = substring('{ALPHABET}', (i % 20 + 1)::int, 1) then 1 else 0 end), '') as code from rep")
def one_hot_sequence(spark, sf):
    return repertoire(spark, sf).select("id", F.array_join(en.one_hot("cdr3", 20), "").alias("code"))


@query(f"{CH} select complex_id, " + " || ".join(f"(case when list_contains(list(epitope), 'E{i}') then '1' else '0' end)" for i in range(8)) + " as code from ch group by 1")
def multi_label_indicator(spark, sf):
    sets = cu.label_sets(chains(spark, sf), ["complex_id"], "epitope")
    return sets.select("complex_id", F.array_join(en.indicators("labels", [f"E{i}" for i in range(8)]), "").alias("code"))


_VALUES = ", ".join(f"('{a}', [{', '.join(repr(x) for x in v)}]::double[])" for a, v in sorted(residue_vectors().items()))


def _iso_sql(tail: str) -> str:
    return f"""with {CTE}, v(aa, x) as (values {_VALUES}), u as (select distinct cdr3, substring(cdr3, 4, length(cdr3) - 5) as s from rep),
  p as (select cdr3, length(s) as n, i, substring(s, i::int, 1) as aa from (select cdr3, s, unnest(range(1, length(s) + 1)) as i from u)),
  b as (select cdr3, ([0, 4, 2, 3, 1, 5])[((n - i + 1) % 6 + 1)::int] as block, x from p join v using (aa)),
  g as (select cdr3, block * 16 + d - 1 as dim, sum(x[d::int]) as value from (select cdr3, block, x, unnest(range(1, 17)) as d from b) group by 1, 2) {tail}"""


@query(_iso_sql("select cdr3, cast(dim as int) as dim, round(value, 6) + 0.0 as value from g where round(value, 6) <> 0"))
def iso_encoding(spark, sf):
    u = repertoire(spark, sf).select("cdr3").distinct()
    return u.select("cdr3", F.posexplode(en.isometric("cdr3")).alias("dim", "value")).select("cdr3", "dim", (F.round("value", 6) + 0.0).alias("value")).where("value <> 0")


_ISO_NN = _iso_sql(
    """, w as (select cdr3, length(cdr3) as n, (select min(id) from rep r where r.cdr3 = u.cdr3) as id, (select bool_or(patient = 'BUILDING') from rep r where r.cdr3 = u.cdr3) as query from u), full_ as (select cdr3, dim, value from g),
  d as (select a.cdr3 as x, b.cdr3 as y, sum((coalesce(fa.value, 0) - coalesce(fb.value, 0)) ** 2) as d from w a join w b on a.n = b.n and a.id <> b.id cross join range(0, 96) k(dim)
        left join full_ fa on fa.cdr3 = a.cdr3 and fa.dim = k.dim left join full_ fb on fb.cdr3 = b.cdr3 and fb.dim = k.dim group by 1, 2),
  k as (select a.id as a, round(d, 6) as d, row_number() over (partition by a.id order by round(d, 9), b.id) as rank from d join w a on a.cdr3 = d.x join w b on b.cdr3 = d.y)
  select a, d from k where rank = 1"""
)


#: Sequences travel as letters, so large cells cost little: each row is sent once for each cell that it meets.
_ISO = {"decode": en.isometric_vectors(), "cell_rows": 65536}


def _iso_rows(spark, sf):
    u = repertoire(spark, sf).groupBy("cdr3").agg(F.min("id").alias("id"), F.bool_or(F.col("patient") == "BUILDING").alias("query"))
    rows = u.select("id", "cdr3", F.length("cdr3").alias("n"), en.isometric_regions("cdr3").alias("x"), "query")
    return staged(rows.repartition(parts(spark)), "regions")  # so few bytes would all be read by one task


@query(_ISO_NN)
def iso_nearest_neighbour(spark, sf):
    return si.nearest_vectors(_iso_rows(spark, sf), "id", "x", 1, ["n"], **_ISO).select("a", F.round("d", 6).alias("d"))


@query(_ISO_NN.replace("select a, d from k where rank = 1", "select a, d from k where rank = 1 and a in (select id from w where query)"))
def iso_query_mode(spark, sf):
    rows = _iso_rows(spark, sf)
    return si.nearest_vectors(rows, "id", "x", 1, ["n"], queries=rows.where("query"), **_ISO).select("a", F.round("d", 6).alias("d"))


def _iso_members(spark, sf):
    """The members of isometric clusters."""
    u = repertoire(spark, sf).groupBy("cdr3", "v_gene").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("extra"))
    u = staged(u, "receptors")
    return staged(cl.isometric_clusters(u, "id", base=40.0).join(u, "id"), "members")  # the vectors by rule lie wider apart than those that 7 was set for


@query()
def iso_clusters(spark, sf):
    by_gene = staged(cl.gene_split(_iso_members(spark, sf), "id", multiplicity="extra"), "members")
    return cl.alignment_refined(by_gene, "id", gene="v_gene")


# similarity


@query(f"{REP} select a.cdr3 as a, b.cdr3 as b, hamming(a.cdr3, b.cdr3) as d from u a join u b on length(a.cdr3) = length(b.cdr3) and a.cdr3 < b.cdr3 where hamming(a.cdr3, b.cdr3) <= 2")
def hamming_pairs(spark, sf):
    return si.hamming_pairs(unique_sequences(spark, sf), "cdr3", "cdr3", 2).withColumn("d", F.col("d").cast("long"))


@query(f"{REP}, p as (select a.cdr3 as a, hamming(a.cdr3, b.cdr3) as d from u a join u b on length(a.cdr3) = length(b.cdr3) and a.cdr3 <> b.cdr3), m as (select a, min(d) as d from p group by 1) select d, count(*) as n from m group by 1")
def min_distance_histogram(spark, sf):
    return si.distance_histogram(si.nearest_hamming(unique_sequences(spark, sf), "cdr3", "cdr3")).select(F.col("d").cast("long").alias("d"), "n")


@query(f"{REP} select a.cdr3 as a, b.cdr3 as b from u a join u b on length(a.region) = length(b.region) and a.cdr3 < b.cdr3 where hamming(a.region, b.region) <= 1")
def global_edges(spark, sf):
    return si.one_mismatch_pairs(unique_sequences(spark, sf), "cdr3", "region").select("a", "b")


_K4 = "k as (select distinct cdr3, substring(region, i::int, 4) as motif, min(i) over (partition by cdr3, substring(region, i::int, 4)) as place from (select cdr3, region, unnest(range(1, length(region) - 2)) as i from u)), m as (select motif from k group by 1 having count(distinct cdr3) >= 3)"


def _motifs(spark, sf):
    u = unique_sequences(spark, sf)
    k = u.select("cdr3", F.explode(F.array_distinct(st.kmers("region", 4))).alias("motif")).groupBy("motif").agg(F.count("*").alias("n"))
    return u, k.where("n >= 3").select("motif")


@query(f"{REP}, {_K4} select distinct x.cdr3 as a, y.cdr3 as b from k x join k y using (motif) where x.cdr3 < y.cdr3 and motif in (select motif from m)")
def local_edges(spark, sf):
    u, m = _motifs(spark, sf)
    return si.motif_pairs(u, "cdr3", "region", m)


@query(f"{REP}, {_K4} select distinct x.cdr3 as a, y.cdr3 as b from k x join k y using (motif, place) where x.cdr3 < y.cdr3 and motif in (select motif from m)")
def positional_edges(spark, sf):
    u, m = _motifs(spark, sf)
    return si.motif_pairs(u, "cdr3", "region", m, positional=True)


@query(f"{REP}, {EDGES}, p as (select distinct cdr3, patient from rep) select distinct a, b from e join p x on x.cdr3 = a join p y on y.cdr3 = b and x.patient = y.patient")
def donor_edges(spark, sf):
    return si.same_group_pairs(_edges(spark, sf).select("a", "b"), repertoire(spark, sf), "cdr3", "patient")


@query(f"{REP}, {EDGES}, p as (select distinct cdr3, v_gene from rep) select distinct a, b from e join p x on x.cdr3 = a join p y on y.cdr3 = b and x.v_gene = y.v_gene")
def vgene_edges(spark, sf):
    return si.same_group_pairs(_edges(spark, sf).select("a", "b"), repertoire(spark, sf), "cdr3", "v_gene")


@query(f"{REP}, {EDGES} select count(*) as n, sum(x.id) as record_a, sum(y.id) as record_b from e join rep x on x.cdr3 = a join rep y on y.cdr3 = b")
def records_of_edges(spark, sf):
    pairs = si.records_of_pairs(_edges(spark, sf).select("a", "b"), repertoire(spark, sf), "cdr3", "id")
    return pairs.agg(F.count("*").alias("n"), F.sum("record_a").alias("record_a"), F.sum("record_b").alias("record_b"))


@query(
    f"{REP}, k as (select distinct cdr3, length(cdr3) as n, substring(s, i::int, 5) as m from (select cdr3, s, unnest(range(1, length(s) - 3)) as i from (select cdr3, substring(cdr3, 4, length(cdr3) - 5) as s from u))) "
    "select x.cdr3 as a, y.cdr3 as b, count(distinct x.m) as shared from k x join k y on x.n = y.n and x.cdr3 < y.cdr3 and hamming(x.m, y.m) <= 1 group by 1, 2 having count(distinct x.m) >= 2"
)
def kmer_candidate_pairs(spark, sf):
    return si.shared_kmer_pairs(unique_sequences(spark, sf), "cdr3", "cdr3", 5, 2)


_S = "s(p, v) as (values " + ", ".join(f"('{a}{b}', {v})" for (a, b), v in sorted(substitution_scores().items())) + ")"


@query(f"{REP}, {EDGES}, {_S} select a, b, sum(v) as score from (select a, b, substring(a, i::int, 1) || substring(b, i::int, 1) as p from (select a, b, unnest(range(1, length(a) + 1)) as i from e)) join s using (p) group by 1, 2")
def blosum_score(spark, sf):
    return _edges(spark, sf).select("a", "b", al.gapless_score("a", "b").cast("long").alias("score"))


@query(
    f"{REP}, {_S}, q as (select a.cdr3 as x, b.cdr3 as y from u a join u b on length(a.cdr3) = length(b.cdr3) + 1), "
    "g as (select x, y, k, substring(y, 1, k::int) || '-' || substring(y, k::int + 1) as z from (select x, y, unnest(range(0, length(y) + 1)) as k from q)), "
    "w as (select x, y, k, sum(case when substring(z, i::int, 1) = '-' then -6 else v end) as score from (select x, y, k, z, unnest(range(1, length(x) + 1)) as i from g) left join s on s.p = substring(x, i::int, 1) || substring(z, i::int, 1) group by 1, 2, 3) select x, y, max(score) as score from w group by 1, 2"
)
def one_gap_alignment(spark, sf):
    """Every pair of sequences whose lengths differ by one."""
    return si.one_gap_pairs(unique_sequences(spark, sf), "cdr3")


@query()
def smith_waterman_clusters(spark, sf):
    edges = _edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = cl.with_components(unique_sequences(spark, sf), edges, "cdr3")
    numbered = en.label_codes(groups, "component", "cluster").select("cluster", "cdr3", F.xxhash64("cdr3").alias("id"))
    return si.cluster_alignments(numbered)


_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) ** 2))"


@query(f"select a, d, rank from (select a.vec_id as a, round({_D2}, 6) as d, row_number() over (partition by a.vec_id order by round({_D2}, 12), b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rank <= 5")
def vector_knn(spark, sf):
    return si.nearest_vectors(t(spark, sf, "embeddings"), "vec_id", "embedding", 5).select("a", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


@query(f"select a.vec_id as a, b.vec_id as b, round({_D2}, 6) as d from embeddings a join embeddings b on a.vec_id < b.vec_id where {_D2} < 1.3")
def vector_radius(spark, sf):
    return si.vectors_within(t(spark, sf, "embeddings"), "vec_id", "embedding", 1.3).withColumn("d", F.round("d", 6))


def _label_pairs(spark, sf):
    """Each vector with the next one of its label."""
    from pyspark.sql import Window

    e = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    nxt = Window.partitionBy("label").orderBy("vec_id")
    return e.select(F.col("vec_id").alias("i"), F.lead("vec_id").over(nxt).alias("j"), "x", F.lead("x").over(nxt).alias("y")).where("j is not null")


_NEXT = "with n as (select vec_id as i, lead(vec_id) over w as j, embedding as x, lead(embedding) over w as y from embeddings window w as (partition by label order by vec_id)), p as (select * from n where j is not null), q as (select i, j, x[k::int]::double as x, y[k::int]::double as y from (select *, unnest(range(1, 65)) as k from p))"


@query(f"{_NEXT} select i, j, round(sqrt(1 - corr(x, y)), 6) as d from q group by 1, 2")
def corr_distance(spark, sf):
    return _label_pairs(spark, sf).select("i", "j", F.round(V.correlation_distance("x", "y"), 6).alias("d"))


@query(f"{_NEXT} select i, j, round(0.5 * sqrt(1 - corr(x, y)) + 2 * (1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))), 6) as d from q group by 1, 2")
def combined_distance(spark, sf):
    p = _label_pairs(spark, sf)
    first, second = p.select("i", "j", V.correlation_distance("x", "y").alias("d")), p.select("i", "j", V.cosine_distance("x", "y").alias("d"))
    return si.combined_distance(first, second, 0.5, 2.0).withColumn("d", F.round("d", 6))


@query(f"{_NEXT}, d as (select i, j, sqrt(sum((x - y) ** 2)) as d from q group by 1, 2) select label, round(sum(d) / count(*), 6) as mean_distance, count(*) as pairs from d join embeddings e on e.vec_id = i group by 1")
def mean_pair_distance(spark, sf):
    d = _label_pairs(spark, sf).select("i", "j", V.l2("x", "y").alias("d"))
    return si.mean_pair_distance(d, t(spark, sf, "embeddings"), "vec_id", "label").withColumn("mean_distance", F.round("mean_distance", 6))


_KNN = f"(select a, label, row_number() over (partition by a order by d, b) as rank from (select a.vec_id as a, b.vec_id as b, b.label, round({_D2}, 12) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id))"
_VOTE = f"select a, label as predicted from (select a, label, row_number() over (partition by a order by count(*) desc, label) as k from {_KNN} where rank <= 10 group by 1, 2) where k = 1"


def _votes(spark, sf):
    e = t(spark, sf, "embeddings")
    return me.knn_vote(si.nearest_vectors(e, "vec_id", "embedding", 10), e, "vec_id", "label"), e


@query(_VOTE)
def knn_vote(spark, sf):
    return _votes(spark, sf)[0]


def _voted(spark, sf):
    votes, e = _votes(spark, sf)
    return votes.join(e.select(F.col("vec_id").alias("a"), "label"), "a")


@query(f"with v as ({_VOTE}) select label, predicted, count(*) as n from v join embeddings e on e.vec_id = v.a group by 1, 2")
def confusion_matrix(spark, sf):
    return me.confusion(_voted(spark, sf), "label", "predicted")


@query(
    f"with v as (select e.label, v.predicted from ({_VOTE}) v join embeddings e on e.vec_id = v.a), c as (select label as c from v union select predicted from v), n as (select c, (select count(*) from v where label = c) as p, (select count(*) from v where predicted = c) as s, (select count(*) from v where label = c and predicted = c) as h from c), "
    "k as (select case when s > 0 then h / s::double else 0 end as pr, case when p > 0 then h / p::double else 0 end as re from n) select round(avg(pr), 9) as macro_precision, round(avg(re), 9) as macro_recall, round(avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end), 9) as macro_f1 from k"
)
def macro_prf(spark, sf):
    return me.macro_scores(_voted(spark, sf), "label", "predicted").select(*[F.round(f"macro_{c}", 9).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


@query(f"select avg((e.label = v.predicted)::int) as accuracy from ({_VOTE}) v join embeddings e on e.vec_id = v.a")
def accuracy(spark, sf):
    return me.accuracy(_voted(spark, sf), "label", "predicted")


def _binary(spark, sf):
    """Quality labels with the rounded length of the text as a score, so that there are ties."""
    d = t(spark, sf, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 50).cast("double").alias("score"))
    return d.join(t(spark, sf, "labels"), "doc_id")


_BIN = "with b as (select quality as y, floor(n_chars / 50) as s from documents join labels using (doc_id))"


@query(f"{_BIN}, r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from b) select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * count(*) filter (y = 0))::double, 9) as auroc from r")
def auroc(spark, sf):
    return me.auroc(_binary(spark, sf), "quality", "score").select(F.round("auroc", 9).alias("auroc"))


@query(f"{_BIN}, g as (select s, sum(y) as p, count(*) as n from b group by 1), c as (select p, sum(p) over (order by s desc) as tp, sum(n) over (order by s desc) as k from g) select round(sum(p * tp / k::double) / sum(p)::double, 9) as average_precision from c")
def average_precision(spark, sf):
    return me.average_precision(_binary(spark, sf), "quality", "score").select(F.round("average_precision", 9).alias("average_precision"))


@query(
    f"with d as (select a.vec_id as a, a.label as la, b.label as lb, avg(sqrt({_D2})) as m from embeddings a join embeddings b on a.vec_id <> b.vec_id group by 1, 2, 3), p as (select a, min(m) filter (la = lb) as own, min(m) filter (la <> lb) as other from d group by 1) "
    "select round(avg(case when own is null or other is null then 0 else (other - own) / greatest(own, other) end), 6) as silhouette from p"
)
def silhouette(spark, sf):
    return me.silhouette(t(spark, sf, "embeddings"), "vec_id", "label", "embedding").select(F.round("silhouette", 6).alias("silhouette"))


_LONG = "with x as (select vec_id, label, i, embedding[i::int]::double as x from (select *, unnest(range(1, 65)) as i from embeddings)), c as (select label, i, avg(x) as c, count(*) as n from x group by 1, 2)"


@query(
    f"{_LONG}, g as (select i, avg(x) as g from x group by 1), b as (select sum(n * (c - g) ** 2) as b, count(distinct label) as k from c join g using (i)), w as (select sum((x - c) ** 2) as w, count(*) filter (i = 1) as n from x join c using (label, i)) select round((b / (k - 1)) / (w / (w.n - k)), 6) as calinski_harabasz from b, w"
)
def calinski_harabasz(spark, sf):
    return me.calinski_harabasz(t(spark, sf, "embeddings"), "label", "embedding").select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(
    f"{_LONG}, s as (select label, avg(d) as s from (select vec_id, label, sqrt(sum((x - c) ** 2)) as d from x join c using (label, i) group by 1, 2) group by 1), m as (select a.label as la, b.label as lb, sqrt(sum((a.c - b.c) ** 2)) as m from c a join c b using (i) where a.label <> b.label group by 1, 2), "
    "r as (select la, max((x.s + y.s) / m) as r from m join s x on x.label = la join s y on y.label = lb group by 1) select round(avg(r), 6) as davies_bouldin from r"
)
def davies_bouldin(spark, sf):
    return me.davies_bouldin(t(spark, sf, "embeddings"), "label", "embedding").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(
    f"with recursive p as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id where {_D2} < 1.3456 + 1e-12), k as (select a from p group by 1 having count(*) + 1 >= 5), ce as (select a, b from p where a in (from k) and b in (from k)), "
    "r as (select a as s, a as c from k union select ce.b, r.c from r join ce on ce.a = r.s), m as (select s, min(c) as c from r group by 1), e as (select p.a, min_by(m.c, p.b) as c from p join m on m.s = p.b where p.a not in (from k) group by 1) "
    "select vec_id, coalesce(m.c, e.c) as cluster from embeddings left join m on m.s = vec_id left join e on e.a = vec_id"
)
def dbscan(spark, sf):
    return cl.dbscan(t(spark, sf, "embeddings"), "vec_id", "embedding", 1.16, 5)


#: The genes of the repertoire with two loops each, which agree but for three residues.
_GENES = "select v_gene as name, concat('SNHY', substring(x, 1, 2)) as loop_1, concat('YDGEK', substring(x, 3, 1)) as loop_2 from (select distinct v_gene, translate(md5(v_gene), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') as x from {rep}) g"


def _receptors(spark, sf):
    """Distinct receptors by their smallest id, and the gene table."""
    rep = repertoire(spark, sf)
    return rep.groupBy("cdr3", "v_gene").agg(F.min("id").alias("id")), spark.sql(_GENES, rep=rep)


_COSTS = "c(p, c) as (values " + ", ".join(f"('{a}{b}', {min(4, 4 - v) if a != b else 0})" for (a, b), v in sorted(substitution_scores().items())) + ")"
_LOOPS = f"""{REP}, {_COSTS}, rec as (select cdr3, v_gene, min(id) as id, length(cdr3) as n from rep group by 1, 2), gn as ({_GENES.replace("{rep}", "rep")}),
  gp as (select x.name as g, y.name as h, sum(c) as gd from (select *, unnest(range(1, 13)) as i, loop_1 || loop_2 as l from gn) x join (select *, unnest(range(1, 13)) as i, loop_1 || loop_2 as l from gn) y using (i) join c on p = substring(x.l, i::int, 1) || substring(y.l, i::int, 1) group by 1, 2),
  pr as (select x.id as a, y.id as b, x.cdr3 as s, y.cdr3 as l, x.n as sn, y.n as ln, gd from rec x join rec y on x.n < y.n or x.n = y.n and x.id < y.id join gp on g = x.v_gene and h = y.v_gene where y.n - x.n <= 4),
  gaps as (select *, unnest(case when sn = ln then [sn] else range(5 - greatest(0, ceil((10 - sn) / 2.0)::bigint), sn - 5 + greatest(0, ceil((10 - sn) / 2.0)::bigint) + 1) end) as g from pr),
  cut as (select a, b, gd, sn, ln, g, substring(s, 4, (sn - 5)::int) as x, case when sn = ln then substring(l, 4, (ln - 5)::int) else substring(l, 4, (g - 3)::int) || substring(l, (g + ln - sn + 1)::int, (sn - 2 - g)::int) end as y from gaps),
  each as (select a, b, gd, sn, ln, g, sum(c) as cost from (select *, unnest(range(1, sn - 4)) as i from cut) join c on p = substring(x, i::int, 1) || substring(y, i::int, 1) group by all),
  nb as (select least(a, b) as i, greatest(a, b) as j, (gd + 3 * (min(cost) + 4 * (ln - sn)))::bigint as d from each group by a, b, gd, sn, ln having gd + 3 * (min(cost) + 4 * (ln - sn)) <= 50)"""


def _neighbours(spark, sf, forest=False):
    receptors, genes = _receptors(spark, sf)
    return lo.loop_neighbours(receptors, "id", "v_gene", "cdr3", genes, "name", ["loop_1", "loop_2"], 50, forest)


@query(f"{_LOOPS} select i, j, d from nb")
def loop_neighbours(spark, sf):
    """Sparse distances of all receptors within 50."""
    return _neighbours(spark, sf)


# motifs and scores


_KM = "select motif, count(*) as n from (select substring(region, i::int, k::int) as motif from (select region, k, unnest(range(1, length(region) - k + 2)) as i from (select region, unnest([2, 3, 4]) as k from u))) group by 1"


@query(f"{REP} {_KM}")
def kmer_counts(spark, sf):
    return mf.kmer_counts(unique_sequences(spark, sf), "region")


@query(f"{REP} {_KM} having count(*) >= 3")
def kmer_min_depth(spark, sf):
    return mf.kmer_counts(unique_sequences(spark, sf), "region", least=3)


@query(f"{REP}, w as (select substring(region, i::int, 4) as m from (select region, unnest(range(1, length(region) - 2)) as i from u)), g as (select m as motif from (select substring(region, i::int, 3) as m from (select region, unnest(range(1, length(region) - 1)) as i from u)) union all select substring(m, 1, 1) || '.' || substring(m, 3) from w union all select substring(m, 1, 2) || '.' || substring(m, 4) from w) select motif, count(*) as n from g group by 1")
def gapped_kmer_counts(spark, sf):
    return mf.kmer_counts(unique_sequences(spark, sf), "region", (3,), gapped=True)


_DEPTH, _SIZE = 1000, "(select count(*) from smp)"
_ENRICH = f"""{REP}, smp as (select cdr3, region from u where cdr3 in (select cdr3 from rep where patient = 'BUILDING')),
  mo as (select cdr3, substring(region, i::int, k::int) as motif from (select cdr3, region, k, unnest(range(1, length(region) - k + 2)) as i from (select *, unnest([2, 3, 4]) as k from u))),
  sims as (select sim, cdr3, row_number() over (partition by sim order by md5('|' || sim || '|' || cdr3), cdr3) as place from u cross join range(1, {_DEPTH + 1}) r(sim)),
  obs as (select motif, count(*) as n from mo where cdr3 in (select cdr3 from smp) group by 1),
  lg as (select sim, motif, count(*) as n from sims join mo using (cdr3) where place <= {_SIZE} group by 1, 2),
  st as (select motif, sum(lg.n) as total, max(lg.n) as top, count(*) filter (lg.n >= obs.n) as reached from obs join lg using (motif) group by 1)
  select motif, obs.n, round(coalesce(total, 0) / {_DEPTH}.0::double, 6) as avg_ref, coalesce(top, 0) as top_ref,
         round(case when coalesce(total, 0) > 0 then obs.n / (total / {_DEPTH}.0::double) else 1.0 / ({_DEPTH} * {_SIZE}) end, 6) as ove,
         round(greatest(coalesce(reached, 0) / {_DEPTH}.0::double, 1.0 / {_DEPTH}), 6) as p
  from obs left join st using (motif)"""


def _enriched(spark, sf):
    u = unique_sequences(spark, sf)
    smp = u.join(repertoire(spark, sf).where("patient = 'BUILDING'").select("cdr3").distinct(), "cdr3", "left_semi")
    return mf.resample_enrichment(smp, u, "cdr3", "region", _DEPTH)


@query(_ENRICH)
def motif_enrichment_md5(spark, sf):
    """Motifs of two to four residues of a patient against 1,000 samples of all sequences."""
    return _enriched(spark, sf).select("motif", "n", F.round("avg_ref", 6).alias("avg_ref"), "top_ref", F.round("ove", 6).alias("ove"), F.round("p", 6).alias("p"))


@query(f"with {CTE}, n as (select patient, v_gene, count(*) as n from rep group by 1, 2), k as (select *, sum(n) over (partition by patient) as a from n) select patient, round(exp(sum(ln(n / a::double))), 9) as score, max(a) as members from k group by 1")
def frequency_product(spark, sf):
    return sc.frequency_product(repertoire(spark, sf), "patient", "v_gene", None).withColumn("score", F.round("score", 9))


_HLA = "with h as (select distinct cast(floor(c_custkey / 4) as bigint) as patient, concat('A', cast(c_nationkey % 7 as varchar(9))) as allele from customer where c_mktsegment <> 'BUILDING'), g as (select distinct c_nationkey as grp, cast(floor(c_custkey / 4) as bigint) as patient from customer where c_mktsegment = 'MACHINERY')"


def _hla(spark, sf):
    c = t(spark, sf, "customer")
    donor = F.floor(F.col("c_custkey") / 4)
    h = c.where("c_mktsegment <> 'BUILDING'").select(donor.alias("patient"), F.concat(F.lit("A"), (F.col("c_nationkey") % 7).cast("string")).alias("allele")).distinct()
    return c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("grp"), donor.alias("patient")).distinct(), h


@query(
    f"{_HLA}, n as (select count(distinct patient) as n from h), d as (select g.* from g where patient in (select patient from h)), k as (select grp, count(*) as k from d group by 1), x as (select grp, allele, count(*) as x from d join h using (patient) group by 1, 2 having count(*) > 1), c as (select allele, count(distinct patient) as c from h group by 1), "
    "z as (select grp, allele, x, k, c, n, unnest(range(x, k + 1)) as i from x join k using (grp) join c using (allele), n) "
    "select grp, allele, x as group_carriers, k as group_donors, c as carriers, n as donors, round(sum(case when i <= c and k - i <= n - c then exp(lgamma(c + 1) - lgamma(i + 1) - lgamma(c - i + 1) + lgamma(n - c + 1) - lgamma(k - i + 1) - lgamma(n - c - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) else 0 end), 6) as p from z group by all"
)
def hla_association(spark, sf):
    g, h = _hla(spark, sf)
    return sc.hla_association(g, h, "grp").withColumn("p", F.round("p", 6))


@query(f"{_HLA} select allele, count(distinct patient) as carriers from h group by 1")
def hla_carriers(spark, sf):
    return sc.hla_carriers(_hla(spark, sf)[1])


def _groups(spark, sf):
    edges = _edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return cl.with_components(unique_sequences(spark, sf), edges, "cdr3").join(repertoire(spark, sf), "cdr3")


@query(f"{REP}, {EDGES}, {REACH}, g as (select c as component, rep.* from comp join rep on rep.cdr3 = comp.s), n as (select component, v_gene, count(*) as n from g group by 1, 2), k as (select *, sum(n) over (partition by component) as a from n), f as (select component, round(round(exp(sum(ln(n / a::double))), 9), 3) as v from k group by 1), z as (select component, least(count(distinct cdr3), 5) as size from g group by 1) select component, round(v * (1.0::double / (size * size)), 9) as score from f join z using (component)")
def group_scores_exact(spark, sf):
    g = _groups(spark, sf)
    sizes = spark.createDataFrame([(k, m, 1.0 / (k * k)) for k in range(1, 6) for m in (100, 100_000_000)], "size long, sample_size long, p double")
    parts = sc.frequency_product(g, "component", "v_gene").select("component", F.col("score").alias("v")).join(sc.size_score(g, sizes, "component", 100, most=5).withColumnRenamed("p", "s"), "component")
    return sc.total_score(parts, "component", ["v", "s"]).withColumn("score", F.round("score", 9))


_MC = f"{REP}, {EDGES}, {REACH}, g as (select c as component, rep.* from comp join rep on rep.cdr3 = comp.s)"


@query(
    f"{_MC}, n as (select component, v_gene, count(*) as n from g group by 1, 2), k as (select *, sum(n) over (partition by component) as a from n), o as (select component, round(round(exp(sum(ln(n / a::double))), 9), 3) as score, max(a) as members from k group by 1), "
    "f as (select v_gene, sum(count(*)) over (order by v_gene) / (sum(count(*)) over ())::double as high from rep group by 1), s as (select v_gene, coalesce(lag(high) over (order by v_gene), 0.0) as low, high from f), "
    "d as (select component, sim, ('0x' || substring(md5('|' || component || '|' || sim || '|' || pick), 1, 8))::bigint / 4294967296.0::double as u, members from (select component, sim, members, unnest(range(1, members::bigint + 1)) as pick from o cross join range(1, 1001) r(sim))), "
    "c as (select component, sim, members, v_gene, count(*) as n from d join s on u >= low and u < high group by 1, 2, 3, 4), q as (select component, sim, round(round(exp(sum(ln(n / members::double))), 9), 3) as s from c group by 1, 2), "
    "p as (select component, count(*) filter (q.s > o.score) / 1000.0::double as p from q join o using (component) group by 1) select component, case when p = 0 then 0.001 else p end as p from p"
)
def enrichment_p_mc(spark, sf):
    return sc.category_enrichment(_groups(spark, sf), repertoire(spark, sf), "component", "v_gene")


@query(
    f"{_MC}, o as (select component, avg(counts) as mean, count(*) as size from g group by 1), s as (select sim, row_number() over w as k, sum(counts) over w as total from rep cross join range(1, 1001) r(sim) window w as (partition by sim order by md5('|' || sim || '|' || id), id rows unbounded preceding)), "
    "p as (select component, count(*) filter (total / k::double >= mean) / 1000.0::double as p from o join s on k = size group by 1) select component, round(case when p = 0 then 0.001 else p end, 3) as p from p"
)
def expansion_p_mc(spark, sf):
    return sc.expansion_enrichment(_groups(spark, sf), repertoire(spark, sf), "component", "counts", "id")


@query(f"{REP}, {_K4} select v_gene, motif, count(*) as n from (select distinct v_gene, r.cdr3, motif from rep r join k on k.cdr3 = r.cdr3 where motif in (select motif from m)) group by 1, 2")
def motif_occurrences(spark, sf):
    u, m = _motifs(spark, sf)
    members = repertoire(spark, sf).select("v_gene", "cdr3").distinct().join(u, "cdr3").select("v_gene", "cdr3", "region")
    rows = members.withColumn("key", F.struct("v_gene", "cdr3"))
    return si.motif_members(rows, "key", "region", m).groupBy(F.col("key.v_gene").alias("v_gene"), "motif").agg(F.count("*").alias("n"))


# samples


def _bucket(col: str, seed: str = "", of: int = 100) -> str:
    return f"(('0x' || substring(md5('{seed}|' || {col}), 1, 8))::bigint % {of})"


@query(f"select o_orderkey, case when {_bucket('o_orderkey')} < 60 then 'train' when {_bucket('o_orderkey')} < 80 then 'validation' else 'test' end as part from orders")
def split_hashed(spark, sf):
    return sa.split(t(spark, sf, "orders"), "o_orderkey", {"train": 60, "validation": 20, "test": 20}).select("o_orderkey", "part")


@query("select o_orderkey, case when row_number() over (partition by o_orderpriority order by md5('|' || o_orderkey), o_orderkey) <= round(count(*) over (partition by o_orderpriority) * 0.2) then 'test' else 'train' end as part from orders")
def split_stratified(spark, sf):
    return sa.stratified_split(t(spark, sf, "orders"), "o_orderkey", "o_orderpriority").select("o_orderkey", "part")


@query("select o_orderkey, case when " + _bucket("o_custkey || '__' || o_orderstatus") + " < 80 then 'train' else 'test' end as part from orders")
def split_by_group(spark, sf):
    return sa.group_split(t(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], {"train": 80, "test": 20}).select("o_orderkey", "part")


@query("select o_orderkey from orders order by md5('s|' || o_orderkey), o_orderkey limit 200")
def random_subset(spark, sf):
    return sa.subset(t(spark, sf, "orders"), "o_orderkey", 200, "s").select("o_orderkey")


#: Positives: chains shared by three or four customers each, one by a tenth of all, and some missing.
_POS = "select c_custkey as id, concat('E', cast(c_nationkey % 9 as varchar(9))) as epitope, cast(case when c_custkey % 13 = 0 then null when c_custkey % 10 = 0 then -1 else floor(c_custkey / 3) end as bigint) as a, cast(case when c_custkey % 17 < 2 then null else floor(c_custkey * 3 / 10) end as bigint) as b from "


def _floyd(i: int) -> str:
    at = f"(('0x' || substring(md5('|' || id || '|{i}'), 1, 15))::bigint % (m - k + {i + 1}))"
    return f"f{i + 1} as (select id, epitope, m, k, case when k <= {i} then l when list_contains(l, {at}) then list_append(l, m - k + {i}) else list_append(l, {at}) end as l from f{i})"


@query(
    f"with p as ({_POS} customer), d as (select id, a, b, row_number() over (order by a, b, id) as at_ from p where a is not null and b is not null), al as (select e.epitope, d.id as donor, row_number() over (partition by e.epitope order by at_) - 1 as r, count(*) over (partition by e.epitope) as m from (select distinct epitope from p) e, d "
    "where not exists (select 1 from p where p.epitope = e.epitope and p.a = d.a) and not exists (select 1 from p where p.epitope = e.epitope and p.b = d.b)), f0 as (select id, p.epitope, m, least(m, 5) as k, []::bigint[] as l from p join (select distinct epitope, m from al) using (epitope)), "
    + ", ".join(map(_floyd, range(5)))
    + ", x as (select id, epitope, unnest(l) as r, generate_subscripts(l, 1) as rank from f5) select x.id, x.epitope, al.donor, x.rank from x join al using (epitope, r)"
)
def negatives_hashed(spark, sf):
    p = spark.sql(_POS + "{c}", c=t(spark, sf, "customer"))
    return sa.negatives(p, "id", "epitope", ("a", "b")).withColumn("rank", F.col("rank").cast("long"))


@query("with x as (select c_custkey, row_number() over (order by md5('|' || c_custkey), c_custkey) as place from customer), y as (select c_mktsegment, row_number() over (order by md5('s|' || c_custkey), c_custkey) as place from customer) select c_custkey, c_mktsegment from x join y using (place)")
def permuted_column(spark, sf):
    return sa.permuted(t(spark, sf, "customer"), "c_custkey", "c_mktsegment", "s")


# models (rows only)


@query()
def kmeans_inertia(spark, sf):
    return cl.inertia_curve(t(spark, sf, "embeddings"), "embedding", [2, 5, 10])


@query()
def pca_2d(spark, sf):
    return cl.pca(t(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def svd_2d(spark, sf):
    return cl.truncated_svd(t(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def gbt_by_group(spark, sf):
    e = t(spark, sf, "embeddings").withColumn("group", F.col("vec_id") % 2).withColumn("y", (F.col("label") < 5).cast("int"))
    return mo.by_group(sa.split(e, "vec_id", {"train": 80, "test": 20}), "group", [0, 1], "embedding", "y", maxIter=5, maxDepth=3)
