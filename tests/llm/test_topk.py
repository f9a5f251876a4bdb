import numpy as np
from pyspark.sql import functions as F

from clonoscape.llm import topk


def brute(rows, queries, k):
    out = []
    whole = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows}
    for q in queries:
        s = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def test_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 32).astype("float32").tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # a common vector
    odd = [(900, None), (901, [None] * 32), (902, [float("nan")] + [0.0] * 31), (903, [float("inf")] * 32), (904, []), (None, [0.1] * 32)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    got = topk.top_k_inner_product(df, F.col("vec_id") % 20 == 0, 7)
    assert sorted(map(tuple, got.collect())) == brute(rows, [i for i, _ in rows if i % 20 == 0], 7)


def test_few_rows_empty_and_other_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [1.0])], schema)
    assert sorted(map(tuple, topk.top_k_inner_product(two, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 1024 * 1024)]
    assert topk.top_k_inner_product(spark.createDataFrame([], schema), F.lit(True)).count() == 0


def test_large_components_stay_exact(spark):
    big = [(0, [1e6, 3.0]), (1, [1e6, 5.0]), (2, [1e6, 4.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = topk.top_k_inner_product(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [r["score"] for r in got] == [1024**2 * (10**12 + 15), 1024**2 * (10**12 + 12)]
