"""Hierarchical clusters of a sparse distance graph, and which of them differ in their labels.

Single linkage needs only a minimum spanning forest, which rounds of Boruvka find:
each component takes its least edge outwards.  The merge tree is then built for all
heights at once by halving their range: edges below the middle are contracted, the
lower half goes on with them, the upper half with the contracted graph.  All parts
of a round are one graph, so that there are as many rounds as bits in the number of
heights, and no cluster is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, staged
from .ordered import numbered
from .scoring import hypergeometric_tail


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src < dst, d: a minimum spanning forest of (src, dst, d); of equal distances the edge of smaller ends wins.

    Nulls and loops are dropped, of repeated edges the least stays.
    """
    known = edges.where("src <> dst and d is not null").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("d").alias("d"))
    left = staged(known.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("d", "src", "dst").alias("e")), "edges")
    chosen = left.select("e.src", "e.dst", "e.d").limit(0)
    while not left.isEmpty():
        ends = lambda c: left.select(F.col(c).alias("c"), F.struct("e", "a", "b").alias("x"))  # noqa: B023, E731
        best = staged(ends("a").unionByName(ends("b")).groupBy("c").agg(F.min("x").alias("x")).select("x.*").distinct(), "forest")
        chosen = chosen.unionByName(best.select("e.src", "e.dst", "e.d"))
        joined = connected_components(best.select(F.col("a").alias("src"), F.col("b").alias("dst")))  # every component with an edge left takes part
        moved = left.join(joined.select(F.col("node").alias("a"), F.col("component").alias("a2")), "a").join(joined.select(F.col("node").alias("b"), F.col("component").alias("b2")), "b")
        left = staged(moved.where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"), "e"), "edges")
    return chosen


def _contracted(edges: DataFrame) -> DataFrame:
    """low, node, component: components of edges (low, a, b), each part (low) by itself."""
    key = lambda c: F.struct("low", F.col(c).alias("v"))
    found = connected_components(edges.select(key("a").alias("src"), key("b").alias("dst")))
    return found.select("node.low", F.col("node.v").alias("node"), F.col("component.v").alias("component"))


def merge_tree(forest: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inner nodes of the single-linkage tree: (height, cluster, children), and (height, cluster, label, n) of their members.

    ``nodes``: node, label, n (a row for each node and label).  A cluster is named after
    its smallest member; all that meets at one height is one node of the tree.
    """
    heights = staged(numbered(forest.select("d").distinct(), ["d"], "rank", 0), "heights")
    many = heights.count()
    edges = forest.join(heights, "d").select(F.lit(0).cast("long").alias("low"), F.lit(many).cast("long").alias("high"), "rank", F.col("src").alias("a"), F.col("dst").alias("b"))
    edges = staged(edges, "edges")
    members = staged(nodes.groupBy("node", "label").agg(F.sum("n").alias("n")).select(F.lit(0).cast("long").alias("low"), "node", "label", "n"), "members")
    ends = lambda e: e.select("low", F.explode(F.array("a", "b")).alias("node")).distinct()
    for _ in range(max(0, many - 1).bit_length()):
        halves = edges.withColumn("mid", F.floor((F.col("low") + F.col("high")) / 2))
        lower, upper = halves.where("rank < mid"), halves.where("rank >= mid")
        found = staged(_contracted(lower), "contracted")
        name = lambda c: found.select("low", F.col("node").alias(c), F.col("component").alias(f"{c}2"))  # noqa: B023, E731
        moved = upper.join(name("a"), ["low", "a"], "left").join(name("b"), ["low", "b"], "left")
        parts = halves.select("low", "mid").distinct()  # a row for each part
        below = members.join(ends(lower), ["low", "node"], "left_semi")
        above = members.join(found, ["low", "node"], "left").join(parts, "low").groupBy(F.col("mid").alias("low"), F.coalesce("component", "node").alias("node"), "label").agg(F.sum("n").alias("n"))
        edges = staged(lower.select("low", F.col("mid").alias("high"), "rank", "a", "b").unionByName(moved.select(F.col("mid").alias("low"), "high", "rank", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))), "edges")
        upper_ends = ends(edges.join(parts.select(F.col("mid").alias("low")).distinct(), "low", "left_semi"))
        members = staged(below.unionByName(above.join(upper_ends, ["low", "node"], "left_semi")), "members")
    found = staged(_contracted(edges), "contracted").join(heights.select(F.col("rank").alias("low"), F.col("d").alias("height")), "low")
    shape = found.groupBy("height", F.col("component").alias("cluster")).agg(F.count("*").alias("children"))
    counts = members.join(found, ["low", "node"]).groupBy("height", F.col("component").alias("cluster"), "label").agg(F.sum("n").alias("n"))
    return shape, counts


def label_differences(shape: DataFrame, counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """height, cluster, children, size, label, n, total, p, chi2: how far each inner node's share of a label exceeds that of all.

    p is the upper tail of Fisher's exact test, chi2 the statistic of the two-by-two
    table of inside or outside and label or not (0 where a margin is empty).
    """
    totals = nodes.groupBy("label").agg(F.sum("n").alias("total"))
    all_ = nodes.agg(F.sum("n").alias("all_n")).first()["all_n"] or 0
    sizes = counts.groupBy("height", "cluster").agg(F.sum("n").alias("size"))
    x = counts.join(sizes, ["height", "cluster"]).join(shape, ["height", "cluster"]).join(totals, "label").withColumn("all_n", F.lit(all_).cast("long"))
    p = hypergeometric_tail(F.col("n"), F.col("size"), F.col("total"), F.col("all_n"))
    return x.select("height", "cluster", "children", "size", "label", "n", "total", p.alias("p"), chi_square(F.col("n"), F.col("size"), F.col("total"), F.col("all_n")).alias("chi2"))


def chi_square(n: Column, size: Column, total: Column, all_n: Column) -> Column:
    a, b, c = n.cast("double"), (size - n).cast("double"), (total - n).cast("double")
    d = all_n.cast("double") - a - b - c
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, all_n * (a * d - b * c) * (a * d - b * c) / margins).otherwise(0.0)
