import pytest
from pyspark.sql import functions as F

from clonoscape.plans import catalogue, deeper, layouts, wider  # noqa: F401

from .duck import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_agrees_with_sql(spark, con, name):
    compare(catalogue.QUERIES[name](spark, SF), con, catalogue.SQL[name])


#: Queries without SQL, and what must hold of their rows.
KNOWN = {
    "iso_clusters": lambda r: len({x["id"] for x in r}) == len(r) and all(sum(y["cluster"] == x["cluster"] for y in r) > 1 for x in r),
    "refined_iso_clusters": lambda r: len({x["id"] for x in r}) == len(r) > 0 and all(sum(y["cluster"] == x["cluster"] for y in r) > 1 for x in r),
    "smith_waterman_clusters": lambda r: all(x["ca"] <= x["cb"] and x["mean_score"] >= 0 for x in r) and len(r) > 0,
    "kmeans_inertia": lambda r: [x["k"] for x in r] == [2, 5, 10] and r[0]["inertia"] > r[1]["inertia"] > r[2]["inertia"] > 0,
    "pca_2d": lambda r: abs(sum(x["pc1"] for x in r)) < 1e-6 * len(r) and sum(x["pc1"] ** 2 for x in r) > sum(x["pc2"] ** 2 for x in r) > 0,
    "svd_2d": lambda r: sum(x["sv1"] ** 2 for x in r) > sum(x["sv2"] ** 2 for x in r) > 0,
    "gbt_by_group": lambda r: len(r) > 50,
    "neighbour_communities": lambda r: len({x["node"] for x in r}) == len(r) and all(x["community"] <= x["node"] for x in r) and 1 < len({x["community"] for x in r}) < len(r) / 3,
}
#: Queries whose draws are others than those of a query with SQL, and may differ from it as draws do.
SAME_CHANCE = {"enrichment_p_counts": "enrichment_p_mc", "expansion_p_counts": "expansion_p_mc"}


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL and n not in SAME_CHANCE and n != "differential_tree"])
def test_holds(spark, name):
    assert KNOWN[name](catalogue.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", SAME_CHANCE)
def test_chances_agree(spark, name):
    one, other = ({r["component"]: r["p"] for r in catalogue.QUERIES[n](spark, SF).collect()} for n in (name, SAME_CHANCE[name]))
    assert set(one) == set(other) and all(abs(one[k] - other[k]) < 5 * (2 * max(0.002, other[k] * (1 - other[k])) / 1000) ** 0.5 for k in one)


def test_differential_tree(spark, con):
    """Every inner node against components of the pairs that SQL finds, and its members' labels."""
    pairs = con.execute(catalogue.SQL["loop_neighbours"]).fetchall()
    label = {r["node"]: r["label"] for r in catalogue.repertoire(spark, SF).groupBy("cdr3", "v_gene").agg(F.min("id").alias("node"), F.min_by("patient", "id").alias("label")).collect()}
    cluster, want = {i: frozenset([i]) for i in label}, {}
    for d in sorted({p[2] for p in pairs}):
        for i, j, _ in [p for p in pairs if p[2] == d]:
            if cluster[i] is not cluster[j]:
                both = cluster[i] | cluster[j]
                cluster |= dict.fromkeys(both, both)
        fresh = {cluster[i] for p in pairs if p[2] == d for i in p[:2]}
        for who in fresh:
            want |= {(d, min(who), x): (len(who), sum(label[i] == x for i in who)) for x in {label[i] for i in who}}
    got = {(r["height"], r["cluster"], r["label"]): (r["size"], r["n"]) for r in catalogue.QUERIES["differential_tree"](spark, SF).collect()}
    assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    heights = lambda rows: {k[:2] for k in rows}
    assert len(got) > 100 and len(heights(got)) > len(heights(want)) / 2  # the others met nothing new at that height


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
