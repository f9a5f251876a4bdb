"""More registered queries: cleaning, reshaping, encoders, scores and metrics, each with the SQL it must agree with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clonoscape.functions import alignment as al
from clonoscape.functions import strings as st
from clonoscape.functions import vectors as V
from clonoscape.functions.residues import ALPHABET, residue_vectors
from clonoscape.operators import cluster as cl
from clonoscape.operators import curate as cu
from clonoscape.operators import encode as en
from clonoscape.operators import metrics as me
from clonoscape.operators import motif as mf
from clonoscape.operators import sample as sa
from clonoscape.operators import scoring as sc
from clonoscape.operators import similarity as si

from .catalogue import _BIN, _ENRICH, _MC, _NEXT, _S, CH, EDGES, REACH, REP, _binary, _edges, _enriched, _groups, _label_pairs, chains, query, t, unique_sequences
from .repertoire import CTE, repertoire

# cleaning and reshaping


@query(f"{CH} select row_id from ch where cdr3 is not null and mhc_class = 'MHCI' and vdjdb_score >= 3")
def species_filter(spark, sf):
    return cu.quality_filter(chains(spark, sf), ["cdr3"], min_score=3, equal={"mhc_class": "MHCI"}).select("row_id")


@query("select o_orderkey, o_custkey // 100 as complex_id from orders where o_custkey // 100 = 0")
def unpaired_rows(spark, sf):
    return cu.unpaired(t(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_custkey") / 100).alias("complex_id")))


_GATED = "select id, cdr3 || case when id % 7 = 0 then '*' when id % 7 = 1 then 'B_' else '' end as s from rep"


@query(f"with {CTE} select id, regexp_matches(s, '^[{ALPHABET}]+$')::int as in_alphabet, (not regexp_matches(s, '[*_]'))::int as unambiguous from ({_GATED})")
def alphabet_gates(spark, sf):
    s = F.concat("cdr3", F.when(F.col("id") % 7 == 0, "*").when(F.col("id") % 7 == 1, "B_").otherwise(""))
    return repertoire(spark, sf).select("id", cu.in_alphabet(s).cast("int").alias("in_alphabet"), cu.unambiguous(s).cast("int").alias("unambiguous"))


@query(f"with {CTE} select distinct cdr3 from rep where regexp_matches(cdr3, '^C.*F$') and length(cdr3) >= 13")
def gated_unique_sequences(spark, sf):
    return cu.gated_unique(repertoire(spark, sf), least=13)


_HOLES = "select o_orderkey, nullif(o_orderstatus, 'P') as status, case when o_totalprice > 100000 then o_totalprice end as price, nullif(o_orderpriority, '5-LOW') as priority from orders"


def _holes(spark, sf):
    price = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return t(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), price.alias("price"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))


@query(f"select o_orderkey from ({_HOLES}) where status is not null and price is not null and priority is not null")
def complete_rows(spark, sf):
    return cu.drop_null_rows(_holes(spark, sf)).select("o_orderkey")


@query(f"select o_orderkey, coalesce(status, '') as status, coalesce(price, 0) as price, priority from ({_HOLES})")
def nulls_filled(spark, sf):
    return cu.fill_nulls(_holes(spark, sf), {"status": "", "price": 0.0})


@query(f"select o_orderkey, round(coalesce(price, (select avg(price) from ({_HOLES}))), 4) as price from ({_HOLES})")
def mean_imputed(spark, sf):
    return cu.impute_mean(_holes(spark, sf).select("o_orderkey", "price"), ["price"]).withColumn("price", F.round("price", 4))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 1 else o_orderkey % 9 end as counts from orders")
def counts_filled(spark, sf):
    counts = F.when(F.col("o_orderkey") % 5 == 0, "many").otherwise((F.col("o_orderkey") % 9).cast("string"))
    return cu.fill_counts(t(spark, sf, "orders").select("o_orderkey", counts.alias("counts")))


_TEXTS = "select p_partkey, case when p_partkey % 4 = 0 then 'none' else '[' || p_size || ', ' || p_partkey || '.5 ]' end as s from part"


def _texts(spark, sf):
    s = F.when(F.col("p_partkey") % 4 == 0, "none").otherwise(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", "), F.col("p_partkey").cast("string"), F.lit(".5 ]")))
    return t(spark, sf, "part").select("p_partkey", s.alias("s"))


@query(f"select p_partkey, list_sum(list_transform(regexp_extract_all(s, '[0-9]+[.]?[0-9]*'), lambda x: x::double)) as total from ({_TEXTS}) where s <> 'none'")
def parsed_vector_rows(spark, sf):
    """Numbers of a text; rows without any are dropped."""
    return cu.parsed_vectors(_texts(spark, sf), "s").select("p_partkey", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("select p_brand as brand, p_partkey as key, p_name from part")
def columns_reordered(spark, sf):
    return cu.reordered(t(spark, sf, "part"), {"p_brand": "brand", "p_partkey": "key", "p_name": "p_name"})


@query("select p_partkey, p_brand as p_name, p_brand from part")
def column_copied(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("p_brand"))
    return cu.copied(p, "p_brand", "p_name").withColumn("p_brand", F.trim("p_brand"))


@query("select p_partkey, p_name from part")
def unnamed_dropped(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name")
    return cu.drop_named(p.withColumn("Unnamed: 0", F.lit(1)).withColumn("Unnamed: 2", F.lit("x")))


@query("select s_suppkey, s_name || ',' || s_nationkey as pair from supplier")
def pair_texts(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("['"), "s_name", F.lit("']")).alias("a"), F.concat(F.lit("("), F.col("s_nationkey").cast("string"), F.lit(" )")).alias("b"))
    return cu.pair_text(s, "a", "b").select("s_suppkey", "pair")


@query("select 'Cluster ' || p_size || ' of ' || p_partkey as s from part order by p_size, s limit 30")
def first_by_number_in_text(spark, sf):
    s = F.concat(F.lit("Cluster "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_partkey").cast("string"))
    return cu.by_number_in(t(spark, sf, "part").select(s.alias("s")), "s").limit(30)


@query("select p_partkey, unnest(string_split(p_type, ' ')) as label from part")
def labels_exploded(spark, sf):
    return cu.exploded_labels(t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("label")), "label")


@query("select n_nationkey as k from nation union all select s_nationkey from supplier")
def union_of_all(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).unionByName(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("select n_nationkey as k from nation intersect select s_nationkey from supplier")
def intersection(spark, sf):
    return cu.intersection(t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("select c_custkey, c_mktsegment, s_name from customer join supplier on c_custkey = s_suppkey")
def zipped_by_position(spark, sf):
    return cu.zip_rows(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name"), "c_custkey")


@query("select o_orderkey, case when o_custkey in (select c_custkey from customer where c_nationkey < 10) then 'in' else 'out' end as side from orders")
def membership_sides(spark, sf):
    inside, outside = cu.split_membership(t(spark, sf, "orders"), t(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return inside.select("o_orderkey", F.lit("in").alias("side")).unionByName(outside.select("o_orderkey", F.lit("out").alias("side")))


@query(f"{CH}, a as (select complex_id, min_by(cdr3, row_id) as cdr3_a from ch where gene = 'TRA' and mhc_class = 'MHCI' group by 1) select complex_id, row_id, cdr3 as cdr3_b, cdr3_a from ch join a using (complex_id) where gene = 'TRB' and complex_id <> 0")
def pair_within_species(spark, sf):
    return cu.pair_chains(chains(spark, sf), "row_id", keep=["cdr3"], where=(F.col("gene") == "TRB") | (F.col("mhc_class") == "MHCI"))


@query(f"{CH} select cdr3, v_segm, string_agg(distinct epitope, ' ' order by epitope) as labels, sum(vdjdb_score) as vdjdb_score, min_by(mhc_a, row_id) as mhc_a from ch group by 1, 2")
def wide_totals(spark, sf):
    w = en.wide_totals(chains(spark, sf), ["cdr3", "v_segm"], "epitope", ["vdjdb_score"], ["mhc_a"], "row_id")
    return w.withColumn("labels", F.array_join("labels", " "))


@query(f"with {CTE} select cdr3, v_gene, count(*) as n from rep group by 1, 2 having count(*) > 1")
def identical_groups(spark, sf):
    return cu.collapse_identical(repertoire(spark, sf), ["cdr3", "v_gene"], "patient").where("extra > 0").select("cdr3", "v_gene", (F.col("extra") + 1).alias("n"))


# strings


@query("select p_partkey, trim('  ' || p_name || ' ') as stripped, replace(p_brand, 'Brand#', 'b') as replaced, regexp_extract(p_brand, '([0-9]+)', 1) as extracted, regexp_replace(p_type, '[AEIOU]', '', 'g') as removed from part")
def text_cleaning(spark, sf):
    return t(spark, sf, "part").select(
        "p_partkey", F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("stripped"), F.replace("p_brand", F.lit("Brand#"), F.lit("b")).alias("replaced"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("extracted"), F.regexp_replace("p_type", "[AEIOU]", "").alias("removed")
    )


@query("select id, array_to_string(string_split(translate(s, 'UZOB', 'XXXX'), ''), ' ') as s from (select o_orderkey as id, upper(substring(o_orderpriority, 3, 6)) as s from orders)")
def masked_and_spaced(spark, sf):
    s = F.upper(F.substring("o_orderpriority", 3, 6))
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), st.spaced(st.mask_rare(s)).alias("s"))


@query(f"with {CTE} select id, case when instr(cdr3, 'GF') > 0 then substring(cdr3, greatest(instr(cdr3, 'GF') - 2, 1)::int, (instr(cdr3, 'GF') - greatest(instr(cdr3, 'GF') - 2, 1) + 4)::int) end as crop from rep")
def cropped(spark, sf):
    return repertoire(spark, sf).select("id", st.crop_around("cdr3", F.lit("GF"), 2).alias("crop"))


@query("select p_partkey, floor(p_retailprice / 7 * 1000) / 1000 as x from part")
def truncated(spark, sf):
    return t(spark, sf, "part").select("p_partkey", st.truncate(F.col("p_retailprice") / 7).alias("x"))


@query(f"with {CTE} select distinct length(cdr3) as n, (7.0 - 0.5 * (15 - length(cdr3)))::double as threshold from rep")
def length_thresholds(spark, sf):
    n = F.length("cdr3")
    return repertoire(spark, sf).select(n.alias("n"), cl.length_threshold(n).cast("double").alias("threshold")).distinct()


# encoders


_RESIDUES = ", ".join(f"('{a}', [{', '.join(repr(x) for x in v)}]::double[])" for a, v in sorted(residue_vectors().items()))


@query(f"with {CTE}, v(aa, x) as (values {_RESIDUES}), p as (select cdr3, substring(cdr3, i::int, 1) as aa from (select distinct cdr3, unnest(range(1, length(cdr3) + 1)) as i from rep)) select cdr3, d - 1 as dim, round(sum(x[d::int]), 6) as value from (select cdr3, x, unnest(range(1, 17)) as d from p join v using (aa)) group by 1, 2 having round(sum(x[d::int]), 6) <> 0")
def additive_encoding(spark, sf):
    u = repertoire(spark, sf).select("cdr3").distinct()
    return u.select("cdr3", F.posexplode(en.additive("cdr3")).alias("dim", "value")).select("cdr3", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")).where("value <> 0")


def _hot_sql(c: str, n: str) -> str:
    return f"array_to_string(list_transform(range(0, 20 * {n}), lambda i: case when substring({c}, (i // 20 + 1)::int, 1) = substring('{ALPHABET}', (i % 20 + 1)::int, 1) then 1 else 0 end), '')"


@query(f"with {CTE}, wide as (select max(length(cdr3)) as s, max(length(v_gene)) as g from rep) select id, {_hot_sql('cdr3', 'wide.s')} || {_hot_sql('v_gene', 'wide.g')} || " + " || ".join(f"(patient = '{p}')::int" for p in ("BUILDING", "MACHINERY")) + " as code from rep, wide")
def features_joined(spark, sf):
    """Chains, genes and categories side by side, whole: as many places as the longest has."""
    rows = repertoire(spark, sf)
    patient = F.array(*[(F.col("patient") == p).cast("int") for p in ("BUILDING", "MACHINERY")])
    every = en.paired(*[en.one_hot(c, n) for c, n in en.longest(rows, "cdr3", "v_gene").items()], patient)
    return rows.select("id", F.array_join(F.transform(every, lambda x: x.cast("int")), "").alias("code"))


@query("select o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::int as o_orderstatus_{s}" for s in "FOP") + " from orders")
def category_columns(spark, sf):
    return en.category_columns(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", list("FOP")).drop("o_orderstatus")


def _tokens():
    """Four token vectors of sixteen numbers each."""
    return F.transform(F.array(*[F.lit(i) for i in (1, 17, 33, 49)]), lambda i: F.transform(F.slice("embedding", i, 16), lambda x: x.cast("double")))


_TOK = "with e as (select vec_id, k, [embedding[(k + 16 * r)::int]::double for r in range(0, 4)] as x from (select *, unnest(range(1, 17)) as k from embeddings))"


@query(f"{_TOK} select vec_id, round(sum(k * x[1] + 2 * k * list_max(x) + 3 * k * list_avg(x) + 4 * k * list_sum(x) / 2), 6) as total from e group by 1")
def pooled_vectors(spark, sf):
    """Four token vectors pooled by first, maximum, mean and sum over the root, weighted into one number."""
    p = F.transform(V.pooled("tokens"), lambda x, i: x * (i % 16 + 1) * (F.floor(i / 16) + 1))
    return t(spark, sf, "embeddings").select("vec_id", _tokens().alias("tokens")).select("vec_id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"{_TOK} select vec_id, round(sum(k * (x[2] + x[3]) / 2), 6) as total from e group by 1")
def masked_mean(spark, sf):
    """The mean of the second and third of four token vectors."""
    p = F.transform(V.masked_mean("tokens", F.lit(2), F.lit(2)), lambda x, i: x * (i + 1))
    return t(spark, sf, "embeddings").select("vec_id", _tokens().alias("tokens")).select("vec_id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_VECTORS = ", ".join(f"('{a}', [{', '.join(repr(x) for x in v[:2])}]::double[])" for a, v in sorted(residue_vectors().items()))


@query(f"with {CTE}, v(aa, x) as (values {_VECTORS}), c as (select id, substring(cdr3, greatest(instr(cdr3, 'SS') - 3, 1)::int, (instr(cdr3, 'SS') - greatest(instr(cdr3, 'SS') - 3, 1) + 5)::int) as s from rep) select id, round(sum(x[1]) / any_value(length(s)), 6) as a, round(sum(x[2]) / any_value(length(s)), 6) as b from (select id, s, substring(s, unnest(range(1, length(s) + 1))::int, 1) as aa from c) join v using (aa) group by 1")
def embedded_crops(spark, sf):
    """Crops around a motif, embedded as the mean of their residues' vectors by a function of batches of texts."""
    vectors = {a: np.array(v[:2]) for a, v in residue_vectors().items()}
    crops = repertoire(spark, sf).select("id", st.crop_around("cdr3", F.lit("SS"), 3).alias("cdr3"))
    e = en.embed(crops, lambda texts: [np.mean([vectors[x] for x in t], axis=0).tolist() for t in texts])
    return e.select("id", F.round(F.col("embedding")[0], 6).alias("a"), F.round(F.col("embedding")[1], 6).alias("b"))


# pairs, clusters and alignment


@query(f"{REP}, k as (select distinct cdr3, length(cdr3) as n, substring(s, i::int, 5) as m from (select cdr3, s, unnest(range(1, length(s) - 3)) as i from (select cdr3, substring(cdr3, 4, length(cdr3) - 5) as s from u))) select x.cdr3 as a, y.cdr3 as b, count(distinct x.m) as shared from k x join k y on x.n = y.n and x.cdr3 < y.cdr3 and hamming(x.m, y.m) <= 2 group by 1, 2 having count(distinct x.m) >= 4")
def two_mismatch_kmer_pairs(spark, sf):
    return si.shared_kmer_pairs(unique_sequences(spark, sf), "cdr3", "cdr3", 5, 4, mismatches=2)


@query(f"with {CTE}, c as (select distinct substring(cdr3, 1, (8 + id % 3)::int) as clone from rep) select clone, id from c join rep on starts_with(cdr3, clone)")
def prefix_annotations(spark, sf):
    """Records of every clone that is known by its first eight to ten residues."""
    r = repertoire(spark, sf)
    c = r.select(F.substring("cdr3", F.lit(1), (8 + F.col("id") % 3).cast("int")).alias("clone")).distinct()
    return si.prefix_annotations(c, r.select("id", "cdr3"), "clone", "cdr3", exact=False).select("clone", "id")


@query("select a.n_name as v1, b.n_name as v2, abs(length(a.n_name) - length(b.n_name)) as score from nation a join nation b on a.n_name <= b.n_name")
def gene_pair_scores(spark, sf):
    genes = t(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return si.gene_pair_scores(genes, F.abs(F.length("x.name") - F.length("y.name")).cast("long"))


@query(f"{_MC}, n as (select id, min(id) over (partition by component, v_gene) as cluster, count(*) over (partition by component, v_gene) as n from g) select id, cluster from n where n > 1")
def gene_split_groups(spark, sf):
    """Convergence groups split by V gene; members without a partner are left out."""
    g = _groups(spark, sf).select("id", F.col("component").alias("cluster"), "v_gene")
    return cl.gene_split(g, "id").select("id", "cluster")


@query(f"{_NEXT}, d as (select i, j, sqrt(sum((x - y) ** 2)) as d from q group by 1, 2), s as (select vec_id from embeddings where label in (1, 4)) select i, j, round(d, 6) as d from d where i in (select vec_id from s) and j in (select vec_id from s)")
def submatrix(spark, sf):
    d = _label_pairs(spark, sf).select("i", "j", F.round(V.l2("x", "y"), 6).alias("d"))
    return si.submatrix(d, t(spark, sf, "embeddings").where("label in (1, 4)"), "vec_id")


def _local_sql(pairs: str, match: int, mismatch: int, gap: int) -> str:
    """Local alignment row by row; within a row the best start of a gap is a maximum over the places before."""
    return (
        f"sw as (select a, b, 0 as i, list_transform(range(0, length(b) + 1), lambda j: 0::bigint) as h, 0::bigint as best from {pairs} union all "
        f"select a, b, i + 1, list_concat([0::bigint], hn), greatest(best, list_max(hn)) from (select a, b, i, best, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: tmp[k::int] + {gap} * (j - k)))) as hn "
        f"from (select a, b, i, best, list_transform(range(1, length(b) + 1), lambda j: greatest(0::bigint, h[j::int] + case when substring(a, i + 1, 1) = substring(b, j::int, 1) then {match} else {mismatch} end, h[(j + 1)::int] + {gap})) as tmp from sw where i < length(a)))), "
        "local as (select a, b, best as score from sw where i = length(a))"
    )


@query(f"{REP}, {EDGES}, {_local_sql('e', 1, -1, -1)} select a, b, score from local")
def local_alignment_unit(spark, sf):
    return _edges(spark, sf).select("a", "b", al.smith_waterman(1, -1, -1)("a", "b").alias("score"))


@query(f"{REP}, {EDGES}, {_local_sql('e', 3, -3, -2)} select a, b, score from local")
def local_alignment(spark, sf):
    return _edges(spark, sf).select("a", "b", al.smith_waterman(3, -3, -2)("a", "b").alias("score"))


@query(f"{REP}, {EDGES}, {_S}, g as (select cdr3, min_by(v_gene, id) as v from rep group by 1), w as (select a, b, sum(v) / count(*)::double as s from (select a, b, substring(a, i::int, 1) || substring(b, i::int, 1) as p from (select a, b, unnest(range(4, length(a) - 1)) as i from e)) join s using (p) group by 1, 2) select a, b, round(case when x.v = y.v then s + 4 else 0 end, 6) as score from w join g x on x.cdr3 = a join g y on y.cdr3 = b")
def full_alignment_scores(spark, sf):
    """Mean alignment plus 4 for the same gene; 0 where the genes' score isn't known."""
    g = repertoire(spark, sf).groupBy("cdr3").agg(F.min_by("v_gene", "id").alias("v"))
    e = _edges(spark, sf).select("a", "b").join(g.select(F.col("cdr3").alias("a"), F.col("v").alias("v1")), "a").join(g.select(F.col("cdr3").alias("b"), F.col("v").alias("v2")), "b")
    return e.select("a", "b", F.round(al.full_alignment("a", "b", "v1", "v2", F.lit(None).cast("double")), 6).alias("score"))


# samples, motifs and scores


@query(
    "with i as (select unnest(range(0, 5)) as time), x as (select time, c_custkey, row_number() over (partition by time order by md5('|' || c_custkey), c_custkey) as place from customer, i), "
    + ", ".join(f"{n} as (select time, {c}, row_number() over (partition by time order by md5(time || '{c}|' || c_custkey), c_custkey) as place from customer, i)" for n, c in (("a", "c_mktsegment"), ("b", "c_nationkey")))
    + " select c_custkey, time::int as time, c_mktsegment, c_nationkey from x join a using (time, place) join b using (time, place)"
)
def permuted_negatives(spark, sf):
    return sa.permuted_columns(t(spark, sf, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"])


_STRATA = f"""{REP}, smp as (select cdr3, length(cdr3) as n from u where cdr3 in (select cdr3 from rep where patient = 'BUILDING')), quo as (select n, count(*) as quota from smp group by 1),
  d as (select sim, cdr3, length(cdr3) as n, row_number() over (partition by sim, length(cdr3) order by md5('|' || sim || '|' || cdr3), cdr3) as place from u cross join range(1, 101) r(sim))
  select sim::int as sim, n, count(*) as drawn, min(cdr3) as first, max(cdr3) as last from d join quo using (n) where place <= quota group by 1, 2"""


@query(_STRATA)
def stratified_resamples(spark, sf):
    """Draws that keep the lengths of a patient's sequences."""
    u = unique_sequences(spark, sf).withColumn("n", F.length("cdr3").cast("long"))
    smp = u.join(repertoire(spark, sf).where("patient = 'BUILDING'").select("cdr3").distinct(), "cdr3", "left_semi")
    drawn = mf.resamples(u, "cdr3", smp.count(), 100, ["n"], mf.stratum_quotas(smp, ["n"]))
    return drawn.groupBy("sim", "n").agg(F.count("*").alias("drawn"), F.min("cdr3").alias("first"), F.max("cdr3").alias("last"))


@query(f"select motif, n from ({_ENRICH}) where p < 0.2 and ove >= 1.05 and n >= 3")
def selected_motifs(spark, sf):
    return mf.select_motifs(_enriched(spark, sf), 0.2, 1.05, 3).select("motif", "n")


@query("with n as (select p_type, count(*) as n from part group by 1), f as (select p_type, sum(n) over (order by p_type) / (sum(n) over ())::double as high from n) select p_type, round(coalesce(lag(high) over (order by p_type), 0), 9) as low, round(high, 9) as high from f")
def cumulative_shares(spark, sf):
    return sc.cumulative_frequencies(t(spark, sf, "part"), "p_type").select("p_type", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("with n as (select p_type, count(*) as n from part group by 1), f as (select p_type, sum(n) over (order by p_type) / (sum(n) over ())::double as high from n), s as (select p_type, coalesce(lag(high) over (order by p_type), 0.0) as low, high from f), d as (select o_orderkey, ('0x' || substring(md5('|' || o_orderkey), 1, 8))::bigint / 4294967296.0::double as u from orders) select o_orderkey, p_type from d join s on u >= low and u < high")
def weighted_draws(spark, sf):
    """A category for each row, drawn by the shares of a reference."""
    return sc.weighted_draws(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], t(spark, sf, "part"), "p_type")


_FULL = (
    "v as (select component, round(round(exp(sum(ln(n / a::double))), 9), 3) as v from (select *, sum(n) over (partition by component) as a from (select component, v_gene, count(*) as n from g group by 1, 2)) group by 1), "
    "l as (select component, round(round(exp(sum(ln(n / a::double))), 9), 3) as l from (select *, sum(n) over (partition by component) as a from (select component, length(cdr3) as len, count(*) as n from g group by 1, 2)) group by 1), "
    "z as (select component, least(count(distinct cdr3), 50) as k from g group by 1), "
    "h as (select distinct cast(floor(c_custkey / 4) as bigint) as donor, concat('A', cast(c_nationkey % 7 as varchar(9))) as allele from customer where c_mktsegment <> 'BUILDING'), "
    "d as (select distinct component, cast(floor(id / 4) as bigint) as donor from g where cast(floor(id / 4) as bigint) in (select donor from h)), m as (select component, count(*) as k from d group by 1), "
    "x as (select component, allele, count(*) as x from d join h using (donor) group by 1, 2 having count(*) > 1), c as (select allele, count(distinct donor) as c from h group by 1), nn as (select count(distinct donor) as n from h), "
    "hp as (select component, allele, sum(case when i <= c and k - i <= n - c then exp(lgamma(c + 1) - lgamma(i + 1) - lgamma(c - i + 1) + lgamma(n - c + 1) - lgamma(k - i + 1) - lgamma(n - c - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) else 0 end) as p from (select component, allele, x, k, c, n, unnest(range(x, k + 1)) as i from x join m using (component) join c using (allele), nn) group by 1, 2), "
    "hb as (select component, min(p) as p from hp group by 1)"
)


def _full_parts(spark, sf):
    g = _groups(spark, sf).withColumn("length", F.length("cdr3"))
    sizes = spark.createDataFrame([(k, 100, 1.0 / (k * k)) for k in range(1, 51)], "size long, sample_size long, p double")
    donor = F.floor(F.col("c_custkey") / 4)
    hla = t(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(donor.alias("donor"), F.concat(F.lit("A"), (F.col("c_nationkey") % 7).cast("string")).alias("allele")).distinct()
    members = g.select("component", F.floor(F.col("id") / 4).alias("donor"))
    hla_p = sc.hla_score(sc.hla_association(members, hla, "component", "donor"), members, "component").select("component", F.col("p").alias("h"))
    v, n = (sc.frequency_product(g, "component", c).select("component", F.col("score").alias(a)) for c, a in (("v_gene", "v"), ("length", "l")))
    size = sc.size_score(g, sizes, "component", 100, most=50).withColumnRenamed("p", "s")
    return v.join(n, "component").join(hla_p, "component").join(size, "component")


@query(f"{_MC}, {_FULL} select component, round(v * l * coalesce(p, 1) * (1.0::double / (k * k)), 9) as score from v join l using (component) join z using (component) left join hb using (component)")
def full_group_scores(spark, sf):
    """Genes, lengths, HLA association and size of each convergence group, multiplied."""
    return sc.total_score(_full_parts(spark, sf), "component", ["v", "l", "h", "s"]).withColumn("score", F.round("score", 9))


@query(f"{_MC}, {_FULL} select component, round(v * l * (1.0::double / (k * k)) * 0.001 * 64, 9) as score from v join l using (component) join z using (component)")
def first_version_scores(spark, sf):
    return sc.total_score(_full_parts(spark, sf), "component", ["v", "l", "s"], version=1).withColumn("score", F.round("score", 9))


# metrics


_PRED = f"{_BIN}, p as (select y, (s >= 20)::int as q from b), n as (select count(*) filter (y = 1 and q = 1) as h, count(*) filter (q = 1) as s, count(*) filter (y = 1) as t from p)"


@query(f"{_PRED} select round(case when s > 0 then h / s::double else 0 end, 9) as precision, round(case when t > 0 then h / t::double else 0 end, 9) as recall, round(case when s + t > 0 then 2 * h / (s + t)::double else 0 end, 9) as f1 from n")
def binary_prf(spark, sf):
    b = _binary(spark, sf).withColumn("said", (F.col("score") >= 20).cast("int"))
    return me.binary_scores(b, "quality", "said").select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _macro_sql(cases: str) -> str:
    return (
        f"with k as ({cases}), r as (select k.c, k.d, (label = k.c)::int as y, embedding[(k.c + 1)::int]::double as s from embeddings, k where k.d is null or label = k.c or label = k.d), "
        "a as (select c, d, y, rank() over (partition by c, d order by s) + (count(*) over (partition by c, d, s) - 1) / 2.0::double as r from r), "
        "u as (select c, d, (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * count(*) filter (y = 0))::double as a from a group by 1, 2) select round(avg(a), 9) as auroc from u"
    )


def _class_scores(spark, sf):
    return t(spark, sf, "embeddings").select("label", *[F.col("embedding")[c].alias(f"s{c}") for c in range(10)]), {str(c): f"s{c}" for c in range(10)}


@query(_macro_sql("select c, null::bigint as d from range(0, 10) r(c)"))
def macro_auroc_ovr(spark, sf):
    rows, scores = _class_scores(spark, sf)
    return me.macro_auroc(rows, "label", scores).select(F.round("auroc", 9).alias("auroc"))


@query(_macro_sql("select x.c, y.c as d from range(0, 10) x(c), range(0, 10) y(c) where x.c <> y.c"))
def macro_auroc_ovo(spark, sf):
    rows, scores = _class_scores(spark, sf)
    return me.macro_auroc(rows, "label", scores, "ovo").select(F.round("auroc", 9).alias("auroc"))


_BY = "with x as (select vec_id, label, label % 3 as grp, i, embedding[i::int]::double as x from (select *, unnest(range(1, 65)) as i from embeddings)), c as (select grp, label, i, avg(x) as c, count(*) as n from x group by 1, 2, 3)"


def _by_group(spark, sf):
    return t(spark, sf, "embeddings").withColumn("grp", F.col("label") % 3)


@query(f"{_BY}, g as (select grp, i, avg(x) as g from x group by 1, 2), b as (select grp, sum(n * (c - g) ** 2) as b, count(distinct label) as k from c join g using (grp, i) group by 1), w as (select grp, sum((x - c) ** 2) as w, count(*) filter (i = 1) as n from x join c using (grp, label, i) group by 1) select grp, round((b / (k - 1)) / (w / (w.n - k)), 5) as calinski_harabasz from b join w using (grp)")
def calinski_harabasz_by_group(spark, sf):
    return me.calinski_harabasz(_by_group(spark, sf), "label", "embedding", ["grp"]).withColumn("calinski_harabasz", F.round("calinski_harabasz", 5))


@query(
    f"{_BY}, s as (select grp, label, avg(d) as s from (select vec_id, grp, label, sqrt(sum((x - c) ** 2)) as d from x join c using (grp, label, i) group by 1, 2, 3) group by 1, 2), m as (select a.grp, a.label as la, b.label as lb, sqrt(sum((a.c - b.c) ** 2)) as m from c a join c b using (grp, i) where a.label <> b.label group by 1, 2, 3), "
    "r as (select m.grp, la, max((x.s + y.s) / m) as r from m join s x on x.label = la join s y on y.label = lb group by 1, 2) select grp, round(avg(r), 6) as davies_bouldin from r group by 1"
)
def davies_bouldin_by_group(spark, sf):
    return me.davies_bouldin(_by_group(spark, sf), "label", "embedding", ["grp"]).withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@query(f"{REP}, {EDGES}, {REACH} select c as component, count(*) as members, min(s) as first, max(length(s)) as longest from comp group by 1 having count(*) >= 3")
def groups_of_a_least_size(spark, sf):
    edges = _edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    g = cl.with_components(unique_sequences(spark, sf), edges, "cdr3")
    return g.groupBy("component").agg(F.count("*").alias("members"), F.min("cdr3").alias("first"), F.max(F.length("cdr3").cast("long")).alias("longest")).where("members >= 3")
