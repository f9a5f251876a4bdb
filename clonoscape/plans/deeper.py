"""Registered queries that join, cluster and test over several steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonoscape.functions import alignment as al
from clonoscape.operators import cluster as cl
from clonoscape.operators import communities as co
from clonoscape.operators import curate as cu
from clonoscape.operators import metrics as me
from clonoscape.operators import motif as mf
from clonoscape.operators import scoring as sc
from clonoscape.operators import similarity as si
from clonoscape.operators import tree as tr
from clonoscape.operators.graph import staged
from clonoscape.operators.ordered import numbered
from clonoscape.sources import readers as rd
from clonoscape.sources import sinks as sk

from .catalogue import _D2, _GENES, _ISO, _MC, _S, EDGES, REACH, REP, _edges, _groups, _iso_members, _iso_rows, _neighbours, _receptors, query, t, unique_sequences
from .layouts import fresh, lines
from .repertoire import CTE, repertoire
from .wider import _local_sql

# trees and communities


@query()
def differential_tree(spark, sf):
    """Single-linkage clusters of the sparse loop distances, and how far each is of one patient."""
    receptors = repertoire(spark, sf).groupBy("cdr3", "v_gene").agg(F.min("id").alias("node"), F.min_by("patient", "id").alias("label"))
    nodes = receptors.select("node", "label", F.lit(1).alias("n"))
    nodes = staged(nodes, "nodes")
    edges = _neighbours(spark, sf, forest=True).select(F.col("i").alias("src"), F.col("j").alias("dst"), "d")
    shape, counts = tr.merge_tree(tr.spanning_forest(edges), nodes)
    return tr.label_differences(shape, counts, nodes)


@query()
def neighbour_communities(spark, sf):
    """Communities of the graph of the five nearest encodings of each sequence."""
    rows = _iso_rows(spark, sf)
    return co.communities(co.neighbour_graph(si.nearest_vectors(rows, "id", "x", 5, ["n"], **_ISO)))


# Monte Carlo on counts


@query()
def enrichment_p_counts(spark, sf):
    return sc.category_p(_groups(spark, sf), repertoire(spark, sf), "component", "v_gene")


@query()
def expansion_p_counts(spark, sf):
    return sc.expansion_p(_groups(spark, sf), repertoire(spark, sf), "component", "counts")


_TOPPED = f"""{REP}, gen as (select cdr3, min(v_gene) as v, bool_or(patient = 'BUILDING') as own from rep group by 1), pool as (select cdr3, length(cdr3) as n, v from gen where not own), quo as (select n, v, count(*) as quota from (select length(cdr3) as n, v_gene as v from rep where patient = 'BUILDING') group by 1, 2),
  d as (select sim, cdr3, n, v, md5('|' || sim || '|' || cdr3) as o from pool cross join range(1, 51) r(sim)), k as (select *, row_number() over (partition by sim, n, v order by o, cdr3) as place from d), i as (select k.*, place <= coalesce(quota, 0) as own from k left join quo using (n, v)),
  f as (select *, row_number() over (partition by sim order by own::int desc, o, cdr3) as at_ from i) select sim::int as sim, n, v, count(*) as drawn, count(*) filter (own) as in_quota, min(cdr3) as first from f where at_ <= (select sum(quota) from quo) group by 1, 2, 3"""


@query(_TOPPED)
def topped_up_resamples(spark, sf):
    """Draws that keep the lengths and genes of a patient's records; strata that others lack are made up for from the rest."""
    rep = repertoire(spark, sf)
    n = F.length("cdr3").cast("long").alias("n")
    pool = rep.groupBy("cdr3").agg(F.min("v_gene").alias("v"), F.bool_or(F.col("patient") == "BUILDING").alias("own")).where("not own").select("cdr3", n, "v")
    quotas = mf.stratum_quotas(rep.where("patient = 'BUILDING'").select(n, F.col("v_gene").alias("v")), ["n", "v"])
    size = quotas.agg(F.sum("quota").alias("n")).first()["n"]
    drawn = mf.resamples(pool, "cdr3", size, 50, ["n", "v"], quotas).join(quotas.select("n", "v", "quota"), ["n", "v"], "left")
    g = drawn.groupBy("sim", "n", "v").agg(F.count("*").alias("drawn"), F.min("cdr3").alias("first"), F.max(F.coalesce("quota", F.lit(0))).alias("quota"))
    return g.select("sim", "n", "v", "drawn", F.least("drawn", "quota").alias("in_quota"), "first")


@query(
    f"{REP}, {EDGES}, c as (select (select count(*) from u)::bigint as n, (select count(*) from e)::bigint as edges), m as (select *, 9.786049e-06 * n::double * n as mean, 1.421e-07 * n::double * n + 3.176e-03 * n as sd from c) "
    "select n, edges, round(mean, 9) as mean, round(sd, 9) as sd, round((edges - mean) / sd, 6) as z, (edges - mean) / sd > 6 as beyond from m"
)
def edge_count_null(spark, sf):
    """The number of edges between sequences against its null model; beyond six deviations the tail is below 1e-9."""
    told = mf.edge_count_null(_edges(spark, sf), unique_sequences(spark, sf))
    return told.select("n", "edges", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round("z", 6).alias("z"), ((F.col("z") > 6) & (F.col("p") < 1e-9)).alias("beyond"))


# genes


def _gene_scores(spark, sf):
    """Scores of gene pairs from a FASTA of their loops."""
    genes = spark.sql(_GENES, rep=repertoire(spark, sf))
    path = lines(genes, F.concat(F.lit(">x|"), "name", F.lit("|y\n"), "loop_1", F.lit("\n"), "loop_2"), "genes")
    return si.gene_pair_scores(rd.read_fasta(spark, path), al.gapless_score("x.sequence", "y.sequence").cast("long"))


_GP = f"gn as ({_GENES.replace('{rep}', 'rep')}), gs as (select x.name as v1, y.name as v2, sum(v)::bigint as score from (select *, unnest(range(1, 13)) as i, loop_1 || loop_2 as l from gn) x join (select *, unnest(range(1, 13)) as i, loop_1 || loop_2 as l from gn) y using (i) join s on p = substring(x.l, i::int, 1) || substring(y.l, i::int, 1) where x.name <= y.name group by 1, 2)"


@query(f"{REP}, {_S}, {_GP} select v1, v2, score from gs")
def gene_fasta_scores(spark, sf):
    """All pairs of genes of a FASTA file, by substitution scores."""
    return _gene_scores(spark, sf)


_LEAST_GENES = 36


@query(
    f"{_MC}, {_S}, {_GP}, ok as (select v1, v2 from gs where score >= {_LEAST_GENES} and v1 <> v2 union select v2, v1 from gs where score >= {_LEAST_GENES} and v1 <> v2), w as (select distinct component, v_gene from g), k as (select x.component, x.v_gene as a, y.v_gene as b from w x join w y using (component) join ok on v1 = x.v_gene and v2 = y.v_gene), "
    "q as (select component, v_gene as a, v_gene as b from w union select q.component, q.a, k.b from q join k on k.component = q.component and k.a = q.b), n as (select g.id, min(h.id) as cluster, count(*) as n from g join q on q.component = g.component and q.a = g.v_gene join g h on h.component = q.component and h.v_gene = q.b group by 1) select id, cluster from n where n > 1"
)
def gene_compatible_groups(spark, sf):
    """Convergence groups split by V genes, of which those of like loops are compatible."""
    g = _groups(spark, sf).select("id", F.col("component").alias("cluster"), "v_gene")
    return cl.gene_split(g, "id", scores=_gene_scores(spark, sf), least=float(_LEAST_GENES)).select("id", "cluster")


@query(
    f"{REP}, {EDGES}, {_S}, {_GP}, f as (select cdr3, min_by(v_gene, id) as v from rep group by 1), w as (select a, b, sum(v) / count(*)::double as s from (select a, b, substring(a, i::int, 1) || substring(b, i::int, 1) as p from (select a, b, unnest(range(4, length(a) - 1)) as i from e)) join s using (p) group by 1, 2) "
    "select a, b, round(s + case when x.v = y.v then 4 else gs.score / 20.0::double end, 6) as score from w join f x on x.cdr3 = a join f y on y.cdr3 = b join gs on gs.v1 = least(x.v, y.v) and gs.v2 = greatest(x.v, y.v)"
)
def gene_alignment_scores(spark, sf):
    """Mean alignment plus what the genes' loops are worth."""
    g = repertoire(spark, sf).groupBy("cdr3").agg(F.min_by("v_gene", "id").alias("v"))
    e = _edges(spark, sf).select("a", "b").join(g.select(F.col("cdr3").alias("a"), F.col("v").alias("x")), "a").join(g.select(F.col("cdr3").alias("b"), F.col("v").alias("y")), "b")
    known = e.withColumn("v1", F.least("x", "y")).withColumn("v2", F.greatest("x", "y")).join(_gene_scores(spark, sf).withColumnRenamed("score", "known"), ["v1", "v2"])
    return known.select("a", "b", F.round(al.full_alignment("a", "b", "x", "y", F.col("known").cast("double")), 6).alias("score"))


@query()
def refined_iso_clusters(spark, sf):
    """Isometric clusters, split by compatible genes and refined by alignment with the genes' scores."""
    scores = staged(_gene_scores(spark, sf), "scores")
    by_gene = cl.gene_split(_iso_members(spark, sf), "id", scores=scores, least=float(_LEAST_GENES), multiplicity="extra")
    return cl.alignment_refined(staged(by_gene, "members"), "id", gene="v_gene", scores=scores)


# pairs


_MIDDLE = f"{REP}, {EDGES}, {REACH}, z as (select c, count(*) as n from comp group by 1 having count(*) >= 3), k as (select *, row_number() over (order by n, c) as i, (select count(*) from z) as m from z), mid as (select s, k.c from comp join k using (c) where i > greatest(m // 2 - 2, 0) and i <= greatest(m // 2 - 2, 0) + 5), pq as (select x.s as a, y.s as b, x.c as ca, y.c as cb from mid x join mid y on (x.c, x.s) < (y.c, y.s))"


@query(f"{_MIDDLE}, {_local_sql('pq', 3, -3, -2)} select ca, cb, pq.a as i, pq.b as j, score from local join pq using (a, b)")
def pair_alignments(spark, sf):
    """Every pair of sequences within and between the five middle-sized groups of three or more."""
    edges = _edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = cl.with_components(unique_sequences(spark, sf), edges, "cdr3")
    several = groups.join(groups.groupBy("component").agg(F.count("*").alias("n")).where("n >= 3").select("component"), "component", "left_semi")
    return si.pair_alignments(several.join(cu.middle_ranked(several, "component").select("component"), "component", "left_semi"), "component", "cdr3", "cdr3")


@query(f"select a.label, round(avg(sqrt({_D2})), 6) as mean_distance, count(*) // 2 as pairs from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by 1")
def mean_distance_of_all_pairs(spark, sf):
    """Mean over all n(n - 1) pairs of each label."""
    e = t(spark, sf, "embeddings")
    return me.mean_distances(e, "vec_id", "label", "embedding").select("label", F.round("mean_distance", 6).alias("mean_distance"), "pairs")


@query(
    f"with x as (select vec_id, label, vec_id % 3 as part, embedding from embeddings), d as (select a.part, a.vec_id as a, a.label as la, b.label as lb, avg(sqrt({_D2})) as m from x a join x b on a.part = b.part and a.vec_id <> b.vec_id group by 1, 2, 3, 4), p as (select part, a, min(m) filter (la = lb) as own, min(m) filter (la <> lb) as other from d group by 1, 2) "
    "select part, round(avg(case when own is null or other is null then 0 else (other - own) / greatest(own, other) end), 6) as silhouette from p group by 1"
)
def silhouette_by_group(spark, sf):
    """Silhouettes of each third of the vectors."""
    e = t(spark, sf, "embeddings").withColumn("part", F.col("vec_id") % 3)
    return me.silhouette(e, "vec_id", "label", "embedding", ["part"]).select("part", F.round("silhouette", 6).alias("silhouette"))


# layouts


@query(f"with {CTE} select cdr3, v_gene, patient from rep")
def cluster_text(spark, sf):
    """Lines below two lines of metadata, which a reader leaves out."""
    path = fresh(spark, "clusters")
    sk.write_cluster_text(repertoire(spark, sf).select("cdr3", "v_gene", "patient"), path, {"cutoff": 7, "v_gene": True})
    x = F.split("value", "\t")
    return rd.read_unmarked(spark, path).select(x[0].alias("cdr3"), x[1].alias("v_gene"), x[2].alias("patient"))


@query(f"with {CTE}, h as (select v_gene, patient, min(id) as id from rep group by 1, 2) select id, 'CRG-' || v_gene || case when k = 1 then '' else '-' || k end as tag from (select *, row_number() over (partition by v_gene order by id) as k from h)")
def tags_told_apart(spark, sf):
    """Groups of one gene share a tag, but for a number from the second on."""
    h = repertoire(spark, sf).groupBy("v_gene", "patient").agg(F.min("id").alias("id"))
    return cl.distinct_tags(h.select("id", F.concat(F.lit("CRG-"), "v_gene").alias("tag")), "tag", ["id"])
