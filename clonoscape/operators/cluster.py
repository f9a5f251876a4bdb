"""Clusters of sequences and of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscape.functions.alignment import full_alignment, gapless_score
from clonoscape.functions.strings import trim_ends

from .encode import isometric_regions, isometric_vectors
from .graph import connected_components, staged
from .ordered import numbered
from .pivots import least_pairs, matrix
from .similarity import core_links, nearest_vectors, shared_kmer_pairs, spread


# groups of a graph


def singletons(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Nodes on no edge."""
    on = edges.select(F.col("src").alias(node)).unionByName(edges.select(F.col("dst").alias(node)))
    return nodes.select(node).distinct().join(on, node, "left_anti")


def with_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Every node with its component; nodes on no edge are their own."""
    found = connected_components(edges).withColumnRenamed("node", node)
    return nodes.join(found, node, "left").withColumn("component", F.coalesce("component", F.col(node)))


def group_table(members: DataFrame, seq: str, least: int = 1, prefix: str = "CRG-") -> DataFrame:
    """tag (of the first member), size, members of each component with enough distinct sequences."""
    g = members.groupBy("component").agg(F.array_sort(F.collect_set(seq)).alias("m"))
    return g.where(F.size("m") >= least).select(F.concat(F.lit(prefix), F.element_at("m", 1)).alias("tag"), F.size("m").alias("size"), F.array_join("m", " ").alias("members"))


def distinct_tags(groups: DataFrame, tag: str, order: list[str]) -> DataFrame:
    """The groups with tags told apart: from the second of a tag on, in this order, its number is added."""
    return numbered(groups, order, "place_", 1, [tag]).withColumn(tag, F.when(F.col("place_") == 1, F.col(tag)).otherwise(F.concat_ws("-", tag, "place_"))).drop("place_")


def merge_overlaps(clusters: DataFrame, cluster: str = "cluster", member: str = "member") -> DataFrame:
    """member, component: clusters that share a member become one."""
    chained = clusters.select(cluster, member).distinct()
    lowest = chained.groupBy(member).agg(F.min(cluster).alias("low"))
    edges = chained.join(lowest, member).select(F.col(cluster).alias("src"), F.col("low").alias("dst")).distinct()
    found = connected_components(edges).withColumnRenamed("node", cluster)
    return chained.join(found, cluster).select(member, "component").distinct()


# isometric clustering


def length_threshold(length: Column, base: float = 7.0) -> Column:
    """Squared-distance threshold of a length: half a unit less for each residue below 15, more above."""
    return F.lit(base) - 0.5 * (15 - length)


def _set_marks(members: DataFrame, centres: DataFrame, within: list[str]) -> DataFrame:
    """For each group: its number of centres, and numbers that are equal for equal sets of member sets."""
    h = F.xxhash64("member")
    sets = members.groupBy("id").agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit((1 << 40) - 87))).alias("s"), F.count("*").alias("c")).join(centres.select("id", *within), "id")
    count = sets.groupBy(*within).agg(F.count("*").alias("centres"))
    marked = sets.select(*within, "x", "s", "c").distinct().groupBy(*within)
    m = F.xxhash64("x", "s", "c")
    return count.join(marked.agg(F.bit_xor(m).alias("sets_x"), F.sum(F.pmod(m, F.lit((1 << 40) - 87))).alias("sets_s"), F.count("*").alias("sets_n")), within)


#: Centres and members of all groups, up to which a group goes on in one task: then the jobs of a round cost far more than its work.
FEW_CENTRES, FEW_MEMBERS = 16_384, 1 << 19


def _as_bytes(rows: DataFrame, x: str, decode=matrix) -> DataFrame:
    """The rows with a column of vectors, or of what ``decode`` makes vectors of, as bytes of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(**{x: [r.tobytes() for r in decode(b[x])]})

    return rows.mapInPandas(run, ", ".join(f"`{c}` {'binary' if c == x else t}" for c, t in rows.dtypes))


def _halfway():
    """A pandas UDF: the midpoint of two vectors, all as bytes."""

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in (matrix(x) + matrix(y)) / 2])

    return run


def _rounds_of_a_group(centres: pd.DataFrame, members: pd.DataFrame, first: int, rounds: int) -> pd.DataFrame:
    """cluster, member: what centroid_clusters does from round ``first`` on, for the centres of one group."""
    centres = centres.sort_values("id")
    ids, x, t = centres["id"].to_numpy(), matrix(centres["x"]), centres["t"].to_numpy(float)
    own = members.groupby("id")["member"].agg(frozenset)
    sets, done = [own[i] for i in ids], []
    for _ in range(first, rounds):
        near, d = np.full(len(ids), -1), np.full(len(ids), np.inf)
        for i, j, some in least_pairs(x, x, 1, np.full(len(ids), np.inf), np.arange(len(ids))):
            near[i], d[i] = j, some
        moves = (near >= 0) & (d <= t)
        done += [s for s, m in zip(sets, moves, strict=True) if not m]
        at = np.flatnonzero(moves & moves[near])
        if not len(at):
            break
        low, high = np.minimum(at, near[at]), np.maximum(at, near[at])
        named = pd.DataFrame({"low": low, "high": high, "id": ids[at]}).groupby(["low", "high"], as_index=False)["id"].min().sort_values("id")
        low, high = named["low"].to_numpy(), named["high"].to_numpy()
        fresh = [sets[a] | sets[b] for a, b in zip(low, high, strict=True)]
        ended = len(fresh) == len(sets) and set(fresh) == set(sets)
        ids, x, t, sets = named["id"].to_numpy(), (x[low] + x[high]) / 2, t[low], fresh
        if ended:
            done += sets
            break
    else:
        done += sets
    found = [s for s in done if len(s) > 1]
    return pd.DataFrame({"cluster": np.repeat(np.array([min(s) for s in found], np.int64), [len(s) for s in found]), "member": np.array([m for s in found for m in s], np.int64)})


def centroid_clusters(rows: DataFrame, within: list[str], rounds: int = 100, decode=matrix, few: int | None = None, **sizes: int) -> DataFrame:
    """cluster, member of (within, id, x, t): every centre moves halfway to its nearest one of its group while that is within t.

    A round finds each centre's nearest other one by the pivot index (``pivots``; ties
    to the smaller id) and writes the midpoints, named after the smallest centre that
    moved there; centres that meet in one midpoint become one, with the members of
    both. A centre without a near one is done, and its members are a cluster.
    A group ends when nothing moves, when a round leaves its sets of members as they
    were, or after ``rounds``.  Rounds are joins and grouped minima; once no more than ``few``
    centres are left of all groups, each group does what is left of its rounds in one task.
    A cluster is named after its smallest member; single rows are none.
    """
    few = FEW_CENTRES if few is None else few
    centres = staged(_as_bytes(rows.select(*within, "id", "x", "t"), "x", decode), "centres")
    members = staged(centres.select("id", F.col("id").alias("member")), "members")
    done, marks, rest = [], None, None
    for r in range(rounds):
        near = nearest_vectors(centres, "id", "x", 1, within, **sizes).select(F.col("a").alias("id"), F.col("b").alias("near"), "d")
        moves = F.coalesce(F.col("d") <= F.col("t"), F.lit(False))
        stepped = staged(centres.join(near.hint("merge"), "id", "left").withColumn("moves", moves), "stepped")
        if r:  # a row that never moved is no cluster
            done.append(members.join(stepped.where("not moves").select("id"), "id", "left_semi").withColumn("round", F.lit(r)))
        moving = stepped.where("moves")
        pairs = moving.groupBy(F.least("id", "near").alias("low"), F.greatest("id", "near").alias("high")).agg(F.min("id").alias("id"))
        left, right = moving.select(*within, "t", F.col("id").alias("low"), "x"), moving.select(F.col("id").alias("high"), F.col("x").alias("y"))
        met = pairs.join(left, "low").join(right, "high")
        centres = staged(spread(met, "id").select(*within, "id", _halfway()("x", "y").alias("x"), "t", "low", "high"), "centres")
        n = centres.count()
        if not n:
            break
        joined = centres.select("id", F.explode(F.array("low", "high")).alias("old")).join(members.withColumnRenamed("id", "old"), "old")
        members = staged(joined.select("id", "member").distinct(), "members")
        centres = centres.drop("low", "high")
        now = staged(_set_marks(members, centres, within), "marks")
        if marks is not None:
            same = now.join(marks, now.columns, "left_semi").select(*within)
            if not same.isEmpty():
                ended = centres.join(same, within, "left_semi").select("id")
                done.append(members.join(ended, "id", "left_semi").withColumn("round", F.lit(r)))
                centres = staged(centres.join(same, within, "left_anti"), "centres")
                members = staged(members.join(centres.select("id"), "id", "left_semi"), "members")
        marks = now
        if n <= few and members.count() <= FEW_MEMBERS:
            theirs = [f"{c} held" for c in within]
            held = members.join(centres.select("id", *[F.col(c).alias(h) for c, h in zip(within, theirs, strict=True)]), "id").groupBy(*theirs)
            rest = centres.groupBy(*within).cogroup(held).applyInPandas(lambda c, m: _rounds_of_a_group(c, m, r + 1, rounds), "cluster long, member long")  # noqa: B023
            break
    else:
        done.append(members.withColumn("round", F.lit(rounds)))
    out = rows.sparkSession.createDataFrame([], "cluster long, member long") if rest is None else rest
    if done:
        all_ = done[0]
        for d in done[1:]:
            all_ = all_.unionByName(d)
        named = all_.groupBy("round", "id").agg(F.min("member").alias("cluster"), F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(all_.join(named, ["round", "id"]).select("cluster", "member"))
    return out.distinct()


def isometric_clusters(df: DataFrame, key: str, seq: str = "cdr3", base: float = 7.0, vectors=None, block: list[str] = (), **sizes: int) -> DataFrame:
    """key, cluster: nearest-neighbour clustering of isometric encodings within each length (and ``block`` columns, if any).

    Overlapping groups are merged.  Rows in no cluster are left out.
    """
    n = F.length(seq)
    rows = df.select(F.col(key).cast("long").alias("id"), n.alias("n of"), isometric_regions(seq, vectors).alias("x"), length_threshold(n, base).cast("double").alias("t"), *block).where("x is not null")
    clusters = centroid_clusters(spread(rows, "id"), ["n of", *block], decode=isometric_vectors(vectors), **sizes)
    return merge_overlaps(staged(clusters, "clusters")).select(F.col("member").alias(key), F.col("component").alias("cluster"))


def gene_split(members: DataFrame, key: str, cluster: str = "cluster", gene: str = "v_gene", scores: DataFrame | None = None, least: float = 3.7, multiplicity: str | None = None) -> DataFrame:
    """Clusters split by compatible V genes: the same gene, or a pair score (v1, v2, score) that reaches the bound.

    Members that lose all partners stay only if they stand for several records.
    """
    genes = members.groupBy(cluster, gene).agg(F.min(key).alias("head"), F.count("*").alias("n"))
    stars = members.join(genes, [cluster, gene]).where(F.col("n") > 1).select(F.col(key).alias("src"), F.col("head").alias("dst"))
    edges = stars
    if scores is not None:
        x, y = genes.alias("x"), genes.alias("y")
        pairs = x.join(y, (F.col(f"x.{cluster}") == F.col(f"y.{cluster}")) & (F.col(f"x.{gene}") < F.col(f"y.{gene}"))).select(F.col("x.head").alias("src"), F.col("y.head").alias("dst"), F.col(f"x.{gene}").alias("g1"), F.col(f"y.{gene}").alias("g2"))
        s = scores.select(F.least("v1", "v2").alias("g1"), F.greatest("v1", "v2").alias("g2"), "score").distinct()
        edges = edges.unionByName(pairs.join(s, ["g1", "g2"]).where(F.col("score") >= least).select("src", "dst"))
    found = connected_components(edges.where("src <> dst")).withColumnRenamed("node", key)
    joined = members.join(found, key, "left")
    alone = F.col(multiplicity) > 0 if multiplicity else F.lit(False)
    return joined.where(F.col("component").isNotNull() | alone).withColumn(cluster, F.coalesce("component", F.col(key))).drop("component")


def alignment_refined(members: DataFrame, key: str, seq: str = "cdr3", cluster: str = "cluster", least: float = 3.5, small: int = 3, gene: str | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Clusters refined by alignment: key, cluster.

    In clusters of up to ``small`` members, those stay whose best mean gapless
    score over the trimmed sequence reaches the bound; larger ones are split
    into components of pairs that share a 5-mer up to one substitution and
    align well.  With ``gene``, the genes' part of the alignment score is 4 for
    the same gene and else a twentieth of their score in ``scores`` (v1, v2,
    score; a reference table of gene pairs); without, all count as the same.
    """
    sized = members.withColumn("size_", F.count("*").over(Window.partitionBy(cluster)))
    few = sized.where(F.col("size_") <= small)
    x, y = few.select(cluster, F.col(key).alias("a"), F.col(seq).alias("x")), few.select(cluster, F.col(key).alias("b"), F.col(seq).alias("y"))
    region = lambda c: trim_ends(c, 3, 2)
    pairs = x.join(y, cluster).where("a <> b and length(x) = length(y) and length(x) > 5")
    kept = pairs.withColumn("s", gapless_score(region("x"), region("y")) / (F.length("x") - 5)).groupBy(cluster, "a").agg(F.max("s").alias("s")).where(F.col("s") >= least)
    kept = kept.withColumn("left_", F.count("*").over(Window.partitionBy(cluster))).where("left_ > 1").select(F.col("a").alias(key), cluster)
    many = sized.where(F.col("size_") > small)
    near = shared_kmer_pairs(many, key, seq)
    seqs = many.select(key, seq, cluster, (F.col(gene) if gene else F.lit("")).alias("v"))
    joined = near.join(seqs.select(F.col(key).alias("a"), F.col(seq).alias("x"), F.col(cluster).alias("ca"), F.col("v").alias("v1")), "a").join(seqs.select(F.col(key).alias("b"), F.col(seq).alias("y"), F.col(cluster).alias("cb"), F.col("v").alias("v2")), "b").where("ca = cb")
    if scores is None:
        known = joined.withColumn("known", F.lit(None).cast("double"))
    else:
        both = scores.select("v1", "v2", "score").unionByName(scores.select(F.col("v2").alias("v1"), F.col("v1").alias("v2"), "score")).groupBy("v1", "v2").agg(F.max("score").cast("double").alias("known"))
        known = joined.join(both, ["v1", "v2"], "left")
    edges = known.where(full_alignment("x", "y", "v1", "v2", F.col("known")) >= least + 4).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(edges).select(F.col("node").alias(key), F.col("component").alias(cluster))
    return kept.unionByName(found.select(key, cluster))


# clusters of vectors


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, least: int = 5, within: list[str] = (), **sizes: int) -> DataFrame:
    """key, cluster (smallest core key; null for noise). Border points go to the cluster of their smallest core neighbour.

    Neighbours are counted, and core rows linked by a forest, where blocks meet; pairs are not written.
    """
    found = core_links(df, key, vector, eps * eps + 1e-12, least, list(within), **sizes)
    if found is None:
        return df.select(key, F.lit(None).cast("long").alias("cluster"))
    core, links = found
    edges = connected_components(links.where("not border").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    cores = staged(core.join(edges, F.col("id") == F.col("node"), "left").select(F.col("id").alias("a"), F.coalesce("component", "id").alias("cluster")), "cores")
    nearest = links.where("border").groupBy("a").agg(F.min("b").alias("b"))
    border = nearest.join(cores.withColumnRenamed("a", "b").hint("merge"), "b").select("a", "cluster")
    return df.select(key).join(cores.unionByName(border).hint("merge"), F.col(key) == F.col("a"), "left").select(key, "cluster")


def vector_column(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 20) -> tuple[DataFrame, float]:
    """Rows with ``cluster``, and the inertia."""
    from pyspark.ml.clustering import KMeans

    rows = vector_column(df, vector)
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("features"), float(model.summary.trainingCost)


def inertia_curve(df: DataFrame, vector: str, ks: list[int], seed: int = 1) -> DataFrame:
    """k, inertia for a few numbers of clusters."""
    return df.sparkSession.createDataFrame([(k, kmeans(df, vector, k, seed)[1]) for k in ks], "k int, inertia double")


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """key, pc1..pck of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    rows = vector_column(df, vector)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(rows).transform(rows)
    out = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred).transform(centred).withColumn("pc", vector_to_array("pc"))
    return out.select(key, *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)])


def truncated_svd(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """key, sv1..svk: rows projected on the leading right singular vectors (of the Gram matrix, summed by Spark)."""
    first = df.select(F.size(vector).alias("n")).first()
    d = int(first["n"]) if first else 0

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for b in batches:
            x = np.array(b["v"].tolist(), float).reshape(-1, d)
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(d), "row": list(total)})

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # d * d sums
    g = np.zeros((d, d))
    for i, j, x in rows:
        g[i, j] = x
    _, v = np.linalg.eigh(g)
    v = v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    parts = [F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in v[:, c]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias(f"sv{c + 1}") for c in range(v.shape[1])]
    return df.select(key, *parts)
