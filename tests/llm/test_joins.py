import random

import numpy as np
import pyarrow as pa
import pytest

from clonoscape.llm import decontaminate as dc
from clonoscape.llm import jaccard, partenum
from clonoscape.llm import queries as llm_queries

from ..duck import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(llm_queries.SQL))
def test_agrees_with_sql(spark, con, name):
    compare(llm_queries.QUERIES[name](spark, SF), con, llm_queries.SQL[name])


# near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), low.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in jaccard.near_duplicate_groups(df).collect())
    assert got == brute_groups(rows)


def near_copies(seed, sizes, copies, edits):
    """Groups of texts with some words replaced, so that similarities lie around 3/4."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for n in sizes:
        text = [r.choice(vocabulary) for _ in range(n)]
        for c in range(copies):
            t = list(text)
            for _ in range(max(0, round(n * r.choice(edits)))):
                t[r.randrange(n)] = r.choice(vocabulary)
            if c % 3 == 0 and n > 100:
                at = r.randrange(n - 60)
                t[at : at + 60] = passage
            out.append(" ".join(t))
    r.shuffle(out)
    return out


def test_groups_against_brute_force(spark, docs):
    check(docs(near_copies(1, [3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 60, 90, 150, 220, 400], 12, [0, 0.01, 0.02, 0.03, 0.05])))


def test_blocks_of_long_lists(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_NODES", 0)
    check(docs(near_copies(2, [40, 120], 30, [0.005, 0.01, 0.03])))


def test_odd_rows(spark, odd):
    check(odd)
    assert jaccard.near_duplicate_groups(odd.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for size in [1, 2, 3, 4, 5, 7, 9, 12, 17, 25, 33, 48, 70, 101, 150, 333, 700]:
        for _ in range(60):
            pool = rng.integers(0, 2**63, 3 * size + 4).astype(np.uint64)
            a = set(pool[:size].tolist())
            drop, add = rng.integers(0, size // 4 + 2), rng.integers(0, size // 3 + 2)
            b = set(list(a)[drop:]) | set(pool[size : size + add].tolist())
            if b and partenum.similar(len(a & b), len(a), len(b)):
                sa, sb = (set(partenum.signatures(np.sort(np.array(list(x), np.uint64))).tolist()) for x in (a, b))
                assert sa & sb, (len(a), len(b), len(a & b))


def test_buckets_of_bands(spark):
    sizes = [*range(1, 400), 1000, 99_999, 5_000_000]
    got = jaccard.band_buckets(spark.createDataFrame([(n,) for n in sizes], "n_shingles long"), 1000)
    weight = {}
    for n in sizes:
        for band in partenum.bands_of(n):
            weight[band] = weight.get(band, 0) + n
    start = 0
    for band in sorted(weight):
        assert got.pop(band) == (start, 1 + weight[band] // 1000)
        start += 1 + weight[band] // 1000
    assert not got


def test_sketches_bound_differences():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard.sketch_of(s), np.uint64)[None, :] for s in (a, b))
        n = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard.fold_to(x, n) ^ jaccard.fold_to(y, n)).sum() <= len(np.setxor1d(a, b))


# decontamination


def dc_words(text):
    import re

    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = dc_words(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = dc_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((-1 if d is None else d, len(w), len(hit), len(found), dc.digest(sorted(found)), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [dc.BLOCK_WINDOWS, 40])
def test_hits_against_brute_force(spark, docs, odd, block):
    r = random.Random(4)
    v = ["the", "a", "of", "Rare", "ÉTÉ", "x1", "b", "c"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)] + [(12, ""), (13, None), (None, "the a"), (3, "of of of of"), (14, "a " * 30)]
    texts = [" ".join(r.choice(v) for _ in range(r.choice([0, 5, 40, 200]))) for _ in range(40)]
    texts += [f"start, {t}! end" for _, t in items if t] + ["the-the a.a  of/of/of of 12 RARE"]
    df = docs(texts).unionByName(odd)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in dc.contamination(df, bench, block_windows=block).collect())
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got == brute_hits(rows, items)
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in dc.drop_contaminated(df, bench, block_windows=block).collect())
    assert kept == sorted(r[0] for r in got if not r[5])


def test_empty_sides(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in dc.contamination(odd, none).collect())
    assert dc.contamination(odd.limit(0), none).count() == 0
    w = dc.words(*dc.buffers(pa.array(["Aa1-é b"])), dc.ALNUM)
    assert [w.text(i).decode() for i in range(3)] == ["aa1", "é", "b"]
