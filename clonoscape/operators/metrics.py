"""Quality of classifications and clusterings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonoscape.functions import vectors as V

from .ordered import running
from .similarity import squared_distances, vector_cells


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1 of each class that occurs; 0 where a denominator is 0."""
    x = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("is"), F.lit(0).alias("said"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("is"), F.lit(1).alias("said"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    n = x.groupBy("c").agg(F.sum("is").alias("positives"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p = n.select(F.col("c").alias(label), over("hit", "said").alias("precision"), over("hit", "positives").alias("recall"))
    return p.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return class_scores(df, label, predicted).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def _ranked(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Distinct scores of each group with their positives, negatives, and those of higher scores."""
    n = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1.0 - F.col(label).cast("double")).alias("q"))
    r = running(n, [*by, F.desc(score)], {"p_above": F.col("p"), "q_above": F.col("q")})
    every = r.groupBy(*by).agg(F.sum("p").alias("p_all"), F.sum("q").alias("q_all"), F.min("p_above").alias("p_first"), F.min("q_above").alias("q_first"))
    both = r.join(every, [*by]) if by else r.crossJoin(F.broadcast(every))  # one row
    return both.withColumns({c: F.col(c) - F.col(f"{c[0]}_first") for c in ("p_above", "q_above")})


def auroc(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties by halves; null with one class. Equal scores are added up before ranking."""
    r = _ranked(df, label, score, list(by))
    value = F.sum(F.col("q") * (F.col("p_above") + F.col("p") / 2.0)) / F.max(F.col("p_all") * F.col("q_all"))
    return r.groupBy(*by).agg(F.when(F.max(F.col("p_all") * F.col("q_all")) > 0, value).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Sum of precision at each score times the recall gained there; null without positives."""
    r = _ranked(df, label, score, list(by))
    at = (F.col("p_above") + F.col("p")) / (F.col("p_above") + F.col("p") + F.col("q_above") + F.col("q"))
    return r.groupBy(*by).agg(F.when(F.max("p_all") > 0, F.sum(F.col("p") * at) / F.max("p_all")).alias("average_precision"))


def macro_auroc(df: DataFrame, label: str, scores: dict[str, str], mode: str = "ovr") -> DataFrame:
    """Mean AUROC over classes; ``scores`` names the score column of each class.

    ``ovr`` sets each class against all others; ``ovo`` takes the mean over pairs
    of classes, each pair both ways, on the rows of the two alone.
    """
    classes = sorted(scores)
    cases = [(c, None) for c in classes] if mode == "ovr" else [(c, d) for c in classes for d in classes if c != d]
    case = F.explode(F.array(*[F.struct(F.lit(i).alias("case"), F.lit(c).alias("of"), F.lit(d).cast("string").alias("against"), F.col(scores[c]).cast("double").alias("s")) for i, (c, d) in enumerate(cases)]))
    rows = df.select(F.col(label).cast("string").alias("l"), case.alias("x")).select("l", "x.*").where("against is null or l = of or l = against")
    each = auroc(rows.withColumn("y", (F.col("l") == F.col("of")).cast("int")), "y", "s", ["case"])
    return each.agg(F.avg("auroc").alias("auroc"))


def binary_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of class 1; 0 where a denominator is 0."""
    hit, said, true = (F.count_if(x) for x in ((F.col(label) == 1) & (F.col(predicted) == 1), F.col(predicted) == 1, F.col(label) == 1))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.agg(over(hit, said).alias("precision"), over(hit, true).alias("recall"), over(2.0 * hit, said + true).alias("f1"))


def knn_vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """a, predicted: most frequent label among the neighbours (a, b), ties to the smaller label."""
    n = neighbours.join(labels.select(F.col(key).alias("b"), label), "b").groupBy("a", label).agg(F.count("*").alias("n"))
    return n.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), label))).where("at = 1").select("a", F.col(label).alias("predicted"))


def mean_distances(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """label, mean_distance, pairs: mean Euclidean distance over all n(n - 1) pairs of each label, which meet in blocks; only sums leave them."""

    def run(a, x, b, y) -> pd.DataFrame:
        d = np.sqrt(squared_distances(x, y))
        other = a[:, None] != b[None, :]
        return pd.DataFrame({"total": [np.where(other, d, 0).sum()], "n": [int(other.sum())]})

    rows = df.where(F.col(label).isNotNull()).select(label, F.col(key).cast("long").alias("a"), F.col(vector).cast("array<double>").alias("x")).where("x is not null")
    sums = vector_cells(rows, rows.select(label, F.col("a").alias("b"), F.col("x").alias("y")), [label], run, f"`{label}` {dict(df.dtypes)[label]}, total double, n long", keep=label)
    return sums.groupBy(label).agg((F.sum("total") / F.sum("n")).alias("mean_distance"), F.floor(F.sum("n") / 2).alias("pairs")).where("pairs > 0")


def silhouette(df: DataFrame, key: str, label: str, vector: str, within: list[str] = ()) -> DataFrame:
    """Mean silhouette by Euclidean distance; points alone in their label count 0.

    Exact: all pairs of rows meet in blocks, and only sums by label leave them.
    """
    known = df.where(F.col(label).isNotNull())

    def run(a, x, b, y) -> pd.DataFrame:
        # The label rides along as the vector's last number.
        lx, ly = x[:, -1].astype(int), y[:, -1].astype(int)
        d = np.sqrt(squared_distances(x[:, :-1], y[:, :-1]))
        own = a[:, None] == b[None, :]
        d[own] = 0
        c, at = np.unique(ly, return_inverse=True)
        of = np.zeros((len(ly), len(c)))
        of[np.arange(len(ly)), at] = 1
        n = of.sum(0)[None, :] - own @ of
        return pd.DataFrame({"a": np.repeat(a, len(c)), "la": np.repeat(lx, len(c)), "lb": np.tile(c, len(a)), "total": (d @ of).ravel(), "n": np.rint(n).astype(np.int64).ravel()})

    codes = F.dense_rank().over(Window.orderBy(label))
    labels = known.select(label).distinct().withColumn("code_", codes)  # one row a label
    rows = known.join(labels, label).select(F.col(key).cast("long").alias("a"), F.concat(F.col(vector).cast("array<double>"), F.array(F.col("code_").cast("double"))).alias("x"), *within)
    sums = vector_cells(rows, rows.select(F.col("a").alias("b"), F.col("x").alias("y"), *within), list(within), run, "a long, la int, lb int, total double, n long")
    mean = sums.groupBy("a", "la", "lb").agg((F.sum("total") / F.sum("n")).alias("m"), F.sum("n").alias("n")).where("n > 0")
    per = mean.groupBy("a").agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("other"))
    s = F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    joined = known.select(F.col(key).cast("long").alias("a"), *within).join(per, "a", "left")
    return joined.groupBy(*within).agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def _groups(df: DataFrame, label: str, vector: str, by: list[str]) -> DataFrame:
    """Rows of groups with two labels at least."""
    known = df.where(F.col(label).isNotNull()).select(*by, label, F.col(vector).cast("array<double>").alias("x"))
    if not by:
        return known
    several = known.groupBy(*by).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low <> high").select(*by)
    return known.join(several, by, "left_semi")


def calinski_harabasz(df: DataFrame, label: str, vector: str, by: list[str] = ()) -> DataFrame:
    """Between over within scatter of the labels, of each group if there are any; groups with one label are left out."""
    by = list(by)
    rows = _groups(df, label, vector, by).select(*by, label, F.posexplode("x").alias("i", "x"))
    centres = rows.groupBy(*by, label, "i").agg(F.avg("x").alias("c"), F.count("*").alias("n"), (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.avg("x")).alias("inside"))
    whole = centres.groupBy(*by, "i").agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("g"))
    joined = centres.join(whole, [*by, "i"])
    sums = joined.groupBy(*by).agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) * (F.col("c") - F.col("g"))).alias("between"), F.sum("inside").alias("inside"), F.count_distinct(label).alias("k"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"))
    return sums.select(*by, ((F.col("between") / (F.col("k") - 1)) / (F.col("inside") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str, vector: str, by: list[str] = ()) -> DataFrame:
    """Mean over labels of their worst ratio of spreads to the distance of centres, of each group if there are any."""
    by = list(by)
    x = _groups(df, label, vector, by)
    long = x.select(*by, label, F.posexplode("x").alias("i", "v")).groupBy(*by, label, "i").agg(F.avg("v").alias("c"))
    centres = long.groupBy(*by, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    spread = x.join(centres, [*by, label]).groupBy(*by, label).agg(F.avg(V.l2("x", "c")).alias("s"), F.first("c").alias("c"))
    a, b = spread.select(*by, F.col(label).alias("la"), F.col("s").alias("sa"), F.col("c").alias("ca")), spread.select(*by, F.col(label).alias("lb"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    both = a.join(b, by) if by else a.crossJoin(b)  # pairs of labels
    worst = both.where("la <> lb").groupBy(*by, "la").agg(F.max((F.col("sa") + F.col("sb")) / V.l2("ca", "cb")).alias("r"))
    return worst.groupBy(*by).agg(F.avg("r").alias("davies_bouldin"))
