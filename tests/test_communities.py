import numpy as np
import pytest

from clonoscape.operators import communities as co


def quality(edges, of):
    total = 2 * sum(w for *_, w in edges)
    inside, degree = 0.0, {}
    for a, b, w in edges:
        inside += 2 * w * (of[a] == of[b])
        degree[of[a]] = degree.get(of[a], 0) + w
        degree[of[b]] = degree.get(of[b], 0) + w
    return inside / total - sum((k / total) ** 2 for k in degree.values())


def greedy(edges):
    """Moves single nodes to the neighbouring community that gains most, until none gains; then whole communities."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    of = {x: x for x in nodes}
    groups = [[x] for x in nodes]
    while True:
        gained = False
        for g in groups:
            before = quality(edges, of)
            old = of[g[0]]
            best, to = before, old
            for c in {of[b] if a in g else of[a] for a, b, _ in edges if (a in g) != (b in g)}:
                for x in g:
                    of[x] = c
                if (q := quality(edges, of)) > best + 1e-9:
                    best, to = q, c
            for x in g:
                of[x] = to
            gained |= to != old
        merged = {}
        for x in nodes:
            merged.setdefault(of[x], []).append(x)
        if not gained and len(merged) == len(groups):
            return of
        groups = list(merged.values())


def planted(seed, sizes, inside, across):
    rng = np.random.default_rng(seed)
    block = np.repeat(np.arange(len(sizes)), sizes)
    n = len(block)
    return block, [(int(a), int(b), float(rng.integers(1, 3))) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if block[a] == block[b] else across)]


def test_planted_groups_are_found(spark):
    block, edges = planted(1, (25, 20, 15, 30), 0.5, 0.02)
    got = {r["node"]: r["community"] for r in co.communities(spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    for k in range(4):
        assert len({got[i] for i in np.flatnonzero(block == k)}) == 1
    assert len(set(got.values())) == 4 and all(c == min(x for x in got if got[x] == c) for c in got.values())


@pytest.mark.parametrize("seed", [2, 3])
def test_modularity_is_near_that_of_greedy_moves(spark, seed):
    _, edges = planted(seed, (8, 9, 10), 0.45, 0.12)
    df = spark.createDataFrame([*edges, (None, 1, 1.0)], "src long, dst long, w double")
    placed = co.communities(df)
    of = {r["node"]: r["community"] for r in placed.collect()}
    assert co.modularity(spark.createDataFrame(edges, "src long, dst long, w double"), placed) == pytest.approx(quality(edges, of))
    assert quality(edges, of) >= 0.98 * quality(edges, greedy(edges))


def test_hub_and_none(spark):
    """A hub that holds all edges, and no edges."""
    hub = spark.createDataFrame([(0, i, 1.0) for i in range(1, 30)], "src long, dst long, w double")
    assert len({r["community"] for r in co.communities(hub).collect()}) <= 2
    assert co.communities(hub.limit(0)).collect() == []
