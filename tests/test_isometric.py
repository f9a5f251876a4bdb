import numpy as np
import pytest

from clonoscape.operators import cluster as cl


def brute(ids, x, threshold, rounds=100):
    """Sets of ids: the rounds over lists, all distances at once."""
    order = np.argsort(ids)
    ids, x = np.array(ids)[order], x[order]
    members, done = [frozenset([int(i)]) for i in ids], []
    for r in range(rounds):
        d = np.round(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0), 12)
        np.fill_diagonal(d, np.inf)
        near = d.argmin(1) if len(x) > 1 else np.zeros(len(x), int)
        moves = d.min(1) <= threshold if len(x) > 1 else np.zeros(len(x), bool)
        done += [m for m, ok in zip(members, moves, strict=True) if not ok and r]
        pairs = {}
        for i in np.flatnonzero(moves):
            pairs.setdefault(tuple(sorted((int(i), int(near[i])))), None)
        if not pairs:
            break
        fresh = [members[a] | members[b] for a, b in pairs]
        x = np.array([(x[a] + x[b]) / 2 for a, b in pairs])
        if len(fresh) == len(members) and set(fresh) == set(members):
            return {g for g in done + fresh if len(g) > 1}
        members = fresh
    else:
        done += members
    return {g for g in done if len(g) > 1}


def merged(groups):
    out = []
    for g in groups:
        touch = [o for o in out if o & g]
        out = [o for o in out if not o & g] + [frozenset(g.union(*touch))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rounds_are_those_of_the_lists(spark, seed):
    """Groups of unlike thresholds, tight and chained rows, equal rows; what brute force finds by group."""
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for g, t in ((1, 0.5), (2, 2.0), (3, 0.05)):
        n = 60
        x = rng.normal(size=(n, 3)) * (3 if g == 1 else 1.5)
        x[:20] = np.cumsum(np.full((20, 3), 0.3), 0) + rng.normal(size=(20, 3)) * 0.02  # a chain
        x[20:24] = x[20]
        x = x.round(2)
        ids = rng.permutation(n) + 1000 * g
        rows += [(g, int(i), [float(v) for v in r], t) for i, r in zip(ids, x, strict=True)]
        want[g] = brute(ids, x, t)
    rows.append((4, 9999, [0.0, 0.0, 0.0], 5.0))  # alone in its group
    df = spark.createDataFrame(rows, "g int, id long, x array<double>, t double").repartition(4)
    got = cl.centroid_clusters(df, ["g"], cell_rows=12, block_rows=16).collect()
    sets = {}
    for r in got:
        sets.setdefault(r["cluster"], set()).add(r["member"])
    # clusters of equal smallest member share a name, and are merged afterwards anyway
    named = {}
    for g in set().union(*want.values()):
        named.setdefault(min(g), set()).update(g)
    assert sets == named and len(named) > 5


def test_merged_clusters(spark):
    """Sequences: what brute force gives by length, overlapping groups merged."""
    rng = np.random.default_rng(7)
    letters = np.array(list("ACDEFGHIKLMNPQRSTVWY"))
    seqs = set()
    while len(seqs) < 120:
        core = "".join(rng.choice(letters, 5))
        seqs |= {"CASS" + core[:i] + str(rng.choice(letters)) + core[i + 1 :] + "EQYF" for i in range(5)}
    rows = list(enumerate(sorted(seqs)))
    df = spark.createDataFrame(rows, "id long, cdr3 string")
    from clonoscape.operators.encode import isometric

    x = {r["id"]: r["x"] for r in df.select("id", isometric("cdr3").alias("x")).collect()}
    t = 40.0 - 0.5 * (15 - 13)
    want = merged(brute(list(x), np.array(list(x.values())), t))
    got = {}
    for r in cl.isometric_clusters(df, "id", base=40.0, cell_rows=30, block_rows=64).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and len(want) > 3
    assert all(c == min(m) for c, m in got.items())


def test_none(spark):
    df = spark.createDataFrame([(1, "CASSAAEQYF"), (2, None)], "id long, cdr3 string")
    assert cl.isometric_clusters(df, "id").collect() == [] == cl.isometric_clusters(df.limit(0), "id").collect()
