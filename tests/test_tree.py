from collections import Counter
from math import comb

import numpy as np
import pytest

from clonoscape.operators import tree


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = {}
    for i in range(n):
        out.setdefault(find(i), set()).add(i)
    return out


def graph(seed, n, m, whole):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, whole, m) if whole else rng.random(m), strict=True)]


@pytest.mark.parametrize(("seed", "n", "m", "whole"), [(1, 40, 70, 9), (2, 60, 50, 0), (3, 30, 200, 3), (4, 25, 24, 1)])
def test_tree_is_single_linkage(spark, seed, n, m, whole):
    """Spanning forest, clusters at every height, and their sizes and labels against components of all edges up to it."""
    edges = graph(seed, n, m, whole)
    label = {i: "xyz"[i * i % 3] for i in range(n)}
    df = spark.createDataFrame([*edges, (None, 3, 1.0), (4, 4, 0.0)], "src long, dst long, d double")
    nodes = spark.createDataFrame([(i, label[i], 1 + i % 2) for i in range(n)], "node long, label string, n long")
    forest = tree.spanning_forest(df)
    rows = [(r["src"], r["dst"], r["d"]) for r in forest.collect()]
    best, total = {i: {i} for i in range(n)}, 0.0
    for a, b, w in sorted(edges, key=lambda e: e[2]):  # Kruskal
        if a != b and best[a] is not best[b]:
            best[a] |= best[b]
            for x in best[b]:
                best[x] = best[a]
            total += w
    assert sum(w for _, _, w in rows) == pytest.approx(total) and len(rows) == n - len({id(s) for s in best.values()})
    shape, counts = tree.merge_tree(forest, nodes)
    want_shape, want_counts = {}, {}
    before = {i: {i} for i in range(n)}
    for h in sorted({w for a, b, w in edges if a != b}):
        now = components(n, [(a, b) for a, b, w in edges if w <= h])
        for c, who in now.items():
            children = [s for s in before.values() if s <= who]
            if len(children) > 1:
                want_shape[h, c] = len(children)
                for x, k in Counter({x: sum(1 + i % 2 for i in who if label[i] == x) for x in "xyz"}).items():
                    if k:
                        want_counts[h, c, x] = k
        before = now
    assert {(r["height"], r["cluster"]): r["children"] for r in shape.collect()} == want_shape
    assert {(r["height"], r["cluster"], r["label"]): r["n"] for r in counts.collect()} == want_counts
    if seed != 1:
        return
    totals = Counter({x: sum(1 + i % 2 for i in range(n) if label[i] == x) for x in "xyz"})
    for r in tree.label_differences(shape, counts, nodes).collect():
        k, c, all_ = r["size"], totals[r["label"]], sum(totals.values())
        assert r["p"] == pytest.approx(sum(comb(c, i) * comb(all_ - c, k - i) for i in range(r["n"], min(c, k) + 1)) / comb(all_, k))
        table = np.array([[r["n"], k - r["n"]], [c - r["n"], all_ - k - c + r["n"]]], float)
        rest = table.sum(1)[:, None] * table.sum(0) / all_
        assert r["chi2"] == pytest.approx(((table - rest) ** 2 / rest).sum() if (rest > 0).all() else 0.0)


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, d double")
    shape, counts = tree.merge_tree(tree.spanning_forest(none), spark.createDataFrame([(1, "x", 1)], "node long, label string, n long"))
    assert shape.collect() == counts.collect() == []
