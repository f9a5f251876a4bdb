"""Communities of a weighted graph by modularity: synchronous moves and coarsening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import staged


def modularity(edges: DataFrame, placed: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (node, community) over undirected edges (src, dst, w), each given once; loops count twice for their node."""
    ends = edges.join(placed.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(placed.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inside = F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(0.0)
    both = ends.select(F.explode(F.array(F.struct(F.col("a").alias("c"), inside.alias("in"), F.col("w").alias("k")), F.struct(F.col("b").alias("c"), F.lit(0.0).alias("in"), F.col("w").alias("k")))).alias("x")).select("x.*")
    per = both.groupBy("c").agg(F.sum("in").alias("in"), F.sum("k").alias("k"))
    sums = per.agg(F.sum("k").alias("all"), F.sum("in").alias("in"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    return 0.0 if not sums["all"] else sums["in"] / sums["all"] - resolution * sums["squares"] / sums["all"] ** 2


def _moves(links: DataFrame, degree: DataFrame, placed: DataFrame, total: float, turn: int, parts: int, resolution: float) -> DataFrame:
    """node, community after one in ``parts`` nodes have moved to the neighbouring community of most gain (ties to the smaller).

    Which may move hangs on the node and the round, so that two nodes that would
    swap communities for ever are parted sooner or later.
    """
    known = staged(placed.join(degree, "node"), "placed")
    weight = known.groupBy("community").agg(F.sum("k").alias("sum_k"))
    open_ = known.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(parts)) == 0)
    near = links.join(known.select(F.col("node").alias("dst"), F.col("community").alias("there")), "dst").groupBy("src", "there").agg(F.sum("w").alias("w"))
    offers = open_.join(near, open_["node"] == near["src"], "left").select("node", "community", "k", "there", "w")
    stays = open_.select("node", "community", "k", F.col("community").alias("there"), F.lit(0.0).alias("w"))  # also where no neighbour is in it
    both = offers.where("there is not null").unionByName(stays).groupBy("node", "community", "k", "there").agg(F.max("w").alias("w"))
    rest = F.col("sum_k") - F.when(F.col("there") == F.col("community"), F.col("k")).otherwise(0.0)
    gain = F.col("w") - resolution * F.col("k") * rest / total
    own = (F.col("there") == F.col("community")).cast("int")
    ranked = both.join(weight.withColumnRenamed("community", "there"), "there").select("node", F.struct((-F.round(gain, 9)).alias("loss"), (-own).alias("away"), "there").alias("x"))
    chosen = ranked.groupBy("node").agg(F.min("x").alias("x")).select("node", F.col("x.there").alias("next"))
    return known.join(chosen, "node", "left").select("node", F.coalesce("next", "community").alias("community"))


def improved(graph: DataFrame, placed: DataFrame, resolution: float, rounds: int, least_gain: float) -> tuple[DataFrame, float, bool]:
    """(node, community) after rounds of moves, its modularity, and whether that rose.

    At first half the nodes move at a time; when a round gains nothing a smaller part does, down to an eighth.
    """
    apart = graph.where("src <> dst")
    links = staged(apart.unionByName(apart.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "links")
    degree = staged(graph.select(F.explode(F.array("src", "dst")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k")), "degrees")
    total = degree.agg(F.sum("k").alias("k")).first()["k"] or 0.0
    best = first = modularity(graph, placed, resolution)
    parts = 2
    for turn in range(rounds):
        moved = staged(_moves(links, degree, placed, total, turn, parts, resolution), "placed")
        now = modularity(graph, moved, resolution)
        idle = now <= best + least_gain
        if now > best:
            placed, best = moved, now
        if idle and parts == 8:
            break
        parts = parts * 2 if idle else parts
    return placed, best, best > first + least_gain


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 16, levels: int = 10, passes: int = 3, least_gain: float = 1e-4) -> DataFrame:
    """node, community (its smallest node) of undirected edges (src, dst, w).

    Nodes move, a part of them at a time, to the neighbouring community that gains
    most modularity; a round that loses is taken back.  When rounds gain nothing,
    communities become the nodes of a coarser graph, until that gains nothing
    either; then single nodes may move once more, and so on for ``passes``.
    Rounds are joins and grouped sums, whatever a node's degree. Repeated edges add
    up, nulls are dropped.
    """
    known = edges.where("src is not null and dst is not null and w > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    base = staged(known, "graph")
    ends = lambda g: staged(g.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node")), "placed")
    whole, reached = ends(base), None
    for _ in range(passes):
        whole, best, _ = improved(base, whole, resolution, rounds, least_gain)
        graph, placed = base, whole
        for _ in range(levels):
            name = placed.groupBy("community").agg(F.min("node").alias("name"))
            named = staged(placed.join(name, "community").select("node", F.col("name").alias("community")), "named")
            if graph is base:
                whole = named
            else:
                whole = staged(whole.withColumnRenamed("community", "at").join(named.withColumnRenamed("node", "at"), "at").select("node", "community"), "communities")
            a, b = named.select(F.col("node").alias("src"), F.col("community").alias("a")), named.select(F.col("node").alias("dst"), F.col("community").alias("b"))
            graph = staged(graph.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")), "graph")
            placed, best, gained = improved(graph, ends(graph), resolution, rounds, least_gain)
            if not gained:
                break
        if reached is not None and best <= reached + least_gain:
            break
        reached = best
    return whole.select("node", "community")


def neighbour_graph(neighbours: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, w) of nearest neighbours (a, b): w is 1, or 2 where both name each other."""
    return neighbours.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").cast("double").alias("w"))
