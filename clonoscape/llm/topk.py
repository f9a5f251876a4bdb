"""Exact top-k inner-product search pruned by multi-resolution segment statistics.

Each vector is summarised at several resolutions by the mean and deviation of
its segments.  For a segment of length s, Cauchy-Schwarz gives
``q.x <= s*mean(q)*mean(x) + s*dev(q)*dev(x)``; summed over segments this is an
upper bound of the inner product, i.e. a lower bound of the squared distance
once both norms are known.  Candidates are dropped from coarse to fine and only
the survivors get an exact score, so the result is exact.

Queries and candidates meet in blocks: every (candidate part, query block) cell
is one bounded group, whatever the size of the tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 4096
QUERY_ROWS = 8192
LEVELS = (4, 8, 16)


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(s)*mean and sqrt(s)*deviation, so that bounds are inner products."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, dev]) * np.sqrt(np.hstack([size, size]))


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; float64 only while every partial sum is exact in it."""
    high = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return (x @ q).astype(np.int64) if high < 2**53 else x.astype(np.int64) @ q.astype(np.int64)


def search_cell(x_ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query of one block."""
    order = np.argsort(x_ids, kind="stable")  # then ties keep the smaller id by a stable sort
    x_ids, x = x_ids[order], x[order]
    levels = [n for n in LEVELS if n <= x.shape[1]] or [1]
    xf, qf = [segment_features(x, n) for n in levels], [segment_features(q, n) for n in levels]
    xnorm, qnorm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    out_q, out_x, out_s = [], [], []
    step = max(1, (1 << 24) // max(1, len(x)))
    for at in range(0, len(q), step):
        coarse = qf[0][at : at + step] @ xf[0].T
        for r in range(coarse.shape[0]):
            i = at + r
            own = x_ids != q_ids[i]
            slack = 1e-9 * (1 + xnorm * qnorm[i])  # rounding of the bounds
            bound = np.where(own, coarse[r] + slack, -np.inf)
            alive = np.flatnonzero(own)
            if len(alive) > k:
                seed = np.argpartition(-bound, k - 1)[:k]
                floor = np.partition(exact_scores(x[seed], q[i]), 0)[0]  # k candidates reach it
                alive = np.flatnonzero(bound >= floor)
                for xl, ql in zip(xf[1:], qf[1:], strict=True):
                    fine = xl[alive] @ ql[i] + slack[alive]
                    alive = alive[fine >= floor]
            score = exact_scores(x[alive], q[i])
            best = np.lexsort((x_ids[alive], -score))[:k]
            out_q.append(np.full(len(best), q_ids[i]))
            out_x.append(x_ids[alive][best])
            out_s.append(score[best])
    if not out_q:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_x), "score": np.concatenate(out_s)}).astype("int64")


def top_k_inner_product(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Exact k best inner products of the rows for which ``is_query`` holds, against all rows.

    Components become floor(scale * x).  Returns query_id, rank (from 1), vec_id,
    score; ties go to the smaller id.  Rows whose id or vector is null, empty or
    holds null or non-finite components take no part; vectors meet only those of
    their own length; a query repeated under one id is asked once (its smallest
    vector); an empty table gives no rows.  Other columns are ignored.
    """
    c = F.col("v")
    whole = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
        .where(F.col("id").isNotNull() & (F.size(c) > 0))
        .where(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .select("id", F.transform(c, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"), F.size(c).alias("dim"), "is_query")
    )
    n, n_query = whole.agg(F.count("*"), F.count_if("is_query")).first()
    parts, blocks = max(1, -(-n // PART_ROWS)), max(1, -(-n_query // QUERY_ROWS))
    spread = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    candidates = whole.select("dim", spread(parts, 1).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "v")
    asks = whole.where("is_query").groupBy("dim", "id").agg(F.min("v").alias("v"))
    queries = asks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), spread(blocks, 2).alias("block"), F.lit(True).alias("asks"), "id", "v")

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        v, ids, asks = np.array(rows["v"].tolist(), dtype=np.float64), rows["id"].to_numpy(), rows["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_cell(ids[~asks], v[~asks], ids[asks], v[asks], k)

    best = candidates.unionByName(queries).groupBy("dim", "part", "block").applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_segment_topk(spark, sf_dir):
    from .common import table

    return top_k_inner_product(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
  where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 10
"""
