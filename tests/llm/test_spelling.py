import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clonoscape.llm import spelling
from tests.duck import compare, connect

from .conftest import DOCS

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sql(spark):
    assert compare(spelling.op12_spelling_variants(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), spelling.SQL) > 100


def test_odd_rows(odd):
    more = odd.selectExpr("doc_id + 100 as doc_id", "repeat('Spelling, spélling spellling; speling SPELLING ÀÉÎÕÜ×÷ àéîõüx ', 9) as text")
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").unionByName(more).collect()]
    got = rows_of(spelling.spelling_variants(odd.select("doc_id", "text").unionByName(more)))
    assert got == brute(brute_words(rows)) and len(got) > 5


def test_columns_of_clashing_names_and_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([(1, "longer " * 30 + "longar " * 6)], "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as form", "4 as head")
    assert rows_of(spelling.spelling_variants(df)) == [("longar", "longer", "longer", 6, 1, 30), ("longer", None, "longer", 30, 1, None)]


def vocabulary(size, seed=1):
    """Words and errors of them, most of which begin with the same letters, and many that tie."""
    rng, n = random.Random(seed), {}
    while len(n) < size:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        w = "aba" + w[3:] if rng.random() < 0.6 else w
        n[w] = rng.choice([5, 5, 25, 25, 130, 700])
    return n


@pytest.mark.parametrize(("share", "block"), [(20_000, 50_000), (40, 17), (30, 400)])
def test_hot_heads_are_split(spark, share, block):
    n = vocabulary(500)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["form_n"], r["form"]) for r in spelling.neighbours(df, share, block).collect()}
    want = {}
    for w in n:
        vs = [v for v in n if one_error(w, v)]
        if vs:
            best = min(vs, key=lambda v: (-n[v], v))
            want[w] = (len(vs), n[best], best)
    assert got == want


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 11 else None) for i in range(12)] + [("alone", None), ("side", "w5")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w11" for i in range(12)} | {"alone": "alone", "side": "w11"}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=40), st.text("abc", min_size=6, max_size=7))
def test_automaton(words, asked):
    own = sorted(words)
    machine = spelling.Automaton(own)
    for i, w in enumerate(own):
        s, number = machine.walk(0, 0, w)
        assert machine.final[s] and number == i
    for exact in range(len(asked) + 1):
        hits = machine.near(asked, exact)
        assert {own[k] for k in hits} == {v for v in own if v[:exact] == asked[:exact] and one_error(asked[exact:], v[exact:])}


def test_automaton_is_minimal():
    own = sorted(a + b for a in ("re", "un", "dis") for b in ("do", "doing", "done", "cover", "covering"))
    machine = spelling.Automaton(own)
    tails = lambda s: frozenset({""} if machine.final[s] else ()) | {x + t for x, (k, _) in machine.edges[s].items() for t in tails(k)}
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        reached.add(s)
        todo += [t for t, _ in machine.edges[s].values()]
    assert len({tails(s) for s in reached}) == len(reached)
