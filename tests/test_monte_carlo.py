"""Draws on counts against exact probabilities."""

from itertools import product
from math import comb, factorial

import pytest

from clonoscape.operators import motif as mf
from clonoscape.operators import scoring as sc


def near(p, exact, depth):
    return abs(p - max(exact, 1 / depth)) < 5 * (exact * (1 - exact) / depth) ** 0.5 + 1.5 / depth


def test_category_p_is_that_of_the_multinomial(spark):
    shares = {"a": 50, "b": 30, "c": 20}
    reference = spark.createDataFrame([(c,) for c, n in shares.items() for _ in range(n)], "v string")
    members = {"x": "aaaab", "y": "abcab", "z": "a", "w": "cccccc"}
    groups = spark.createDataFrame([(g, v) for g, vs in members.items() for v in vs], "grp string, v string")

    def score(counts):
        n = sum(counts)
        out = 1.0
        for k in counts:
            out *= (k / n) if k else 1.0
        return round(round(out, 9), 3)

    for version in (1, 2):
        got = {r["grp"]: r["p"] for r in sc.category_p(groups, reference, "grp", "v", 4000, version).collect()}
        for g, vs in members.items():
            n, own, exact = len(vs), score([vs.count(c) for c in "abc"]), 0.0
            for k in product(range(n + 1), repeat=3):
                if sum(k) == n:
                    chance = factorial(n) / (factorial(k[0]) * factorial(k[1]) * factorial(k[2])) * 0.5 ** k[0] * 0.3 ** k[1] * 0.2 ** k[2]
                    exact += chance * (score(k) >= own if version == 1 else score(k) > own)
            assert near(got[g], exact, 4000), (g, version, got[g], exact)


def test_expansion_p_is_that_of_draws_without_replacement(spark):
    counts = [1] * 12 + [2] * 5 + [9] * 3
    sample = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "id int, n int")
    own = {"x": [9, 9, 9], "y": [1, 2], "z": [2, 9, 1, 1], "all": counts}
    groups = spark.createDataFrame([(g, c) for g, cs in own.items() for c in cs], "grp string, n int")
    got = {r["grp"]: r["p"] for r in sc.expansion_p(groups, sample, "grp", "n", 4000).collect()}
    for g, cs in own.items():
        m, exact = len(cs), 0.0
        for a, b, c in product(range(13), range(6), range(4)):
            if a + b + c == m and a + 2 * b + 9 * c >= sum(cs):
                exact += comb(12, a) * comb(5, b) * comb(3, c) / comb(20, m)
        assert near(got[g], exact, 4000), (g, got[g], exact)


def test_both_kinds_of_draws_agree(spark):
    """The draws on counts and those member by member estimate the same."""
    reference = spark.createDataFrame([("ab"[i % 3 == 0],) for i in range(90)], "v string")
    groups = spark.createDataFrame([(g, "ab"[i < k]) for g, (k, n) in {"p": (1, 6), "q": (3, 7), "r": (0, 4)}.items() for i in range(n)], "grp string, v string")
    one = {r["grp"]: r["p"] for r in sc.category_p(groups, reference, "grp", "v", 3000).collect()}
    other = {r["grp"]: r["p"] for r in sc.category_enrichment(groups, reference, "grp", "v", 3000).collect()}
    assert all(abs(one[g] - other[g]) < 0.06 for g in one) and len(one) == 3


def test_strata_that_fall_short_are_topped_up(spark):
    pool = spark.createDataFrame([(f"k{i}", i % 5) for i in range(400)] + [("only", 9)], "k string, g int")
    quotas = spark.createDataFrame([(0, 10), (1, 5), (9, 4), (77, 3)], "g int, quota long")
    rows = mf.resamples(pool, "k", 22, 20, ["g"], quotas).collect()
    for sim in range(1, 21):
        own = [r for r in rows if r["sim"] == sim]
        assert len(own) == 22 == len({r["k"] for r in own})
        of = lambda g, own=own: sum(r["g"] == g for r in own)
        assert of(0) >= 10 and of(1) >= 5 and of(9) == 1
    assert len({frozenset(r["k"] for r in rows if r["sim"] == s) for s in range(1, 21)}) == 20
