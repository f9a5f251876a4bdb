"""What is sent, held or compared must not outgrow the input."""

import numpy as np
import pandas as pd

from clonoscape.functions import alignment as al
from clonoscape.operators import pivots
from clonoscape.operators import similarity as si
from clonoscape.operators.graph import connected_components


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_and_components_are_not_broadcast(spark):
    df = spark.createDataFrame([("CAST",), ("CASS",), ("CGSS",), ("XXXX",)], "cdr3 string")
    edges = si.one_mismatch_pairs(df, "cdr3", "cdr3")
    assert plan(edges).count("BroadcastHashJoin") <= 1  # the places of each length
    assert sorted(map(tuple, edges.collect())) == [("CASS", "CAST", 1), ("CASS", "CGSS", 1)]
    named = df.join(connected_components(edges.selectExpr("a as src", "b as dst")).withColumnRenamed("node", "cdr3"), "cdr3", "left")
    assert plan(named).count("BroadcastHashJoin") <= 1
    assert {r["cdr3"]: r["component"] for r in named.collect()} == {"CASS": "CASS", "CAST": "CASS", "CGSS": "CASS", "XXXX": None}


def test_blocks_grow_with_the_table(spark):
    """5,000 vectors meet in one cell; smaller blocks send every row several times."""
    rows = spark.range(5000).selectExpr("id as a", "array(cast(id as double)) as x")
    run = lambda a, x, b, y: pd.DataFrame({"a": a, "n": len(b)})
    got = si.vector_cells(rows, rows.selectExpr("a as b", "x as y"), [], run, "a long, n long").toPandas()
    assert len(got) == 5000 and set(got["n"]) == {5000}


def test_only_the_least_are_sorted():
    rng = np.random.default_rng(3)
    d = rng.integers(0, 6, (40, 30)) / 7.0  # many ties
    d[0], d[1, 4] = np.inf, np.inf
    for m in (1, 4, 30, 50):
        i, j = pivots.least_of(d, m, np.full(40, np.inf))
        for r in range(40):
            want = [c for c in np.argsort(np.round(d[r], 12), kind="stable")[:m] if np.isfinite(d[r, c])]
            assert j[i == r].tolist() == want
    i, j = pivots.least_of(d, 5, np.full(40, 1 / 7))
    assert (d[i, j] <= 1 / 7 + 1e-11).all() and len(i)


def test_one_gap_scores_of_batches_are_those_of_columns(spark):
    rows = [("CASSF", "CASF"), ("CASF", "CASSF"), ("CAXXF", "CAXF"), ("C-SSF", "CSSF"), ("CAS", "CAS"), ("CASSF", "CAS"), (None, "CAS"), ("ÄAS", "AS"), ("ACDEFG", "WCDEF"), ("", "A")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(al.one_gap_score("a", "b").cast("long").alias("one"), al.one_gap_scores()("a", "b").alias("many")).collect()
    assert [r["many"] for r in got] == [r["one"] for r in got]
