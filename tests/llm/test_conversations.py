import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from clonoscape.llm import conversations
from tests.duck import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node's row, from the lists of turns themselves."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    order = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()[:16])
    own = {c: [x[1:] for x in sorted(v, key=order)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h, family = zlib.crc32(str(c).encode()) % 9, int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        made[c] = own.get(family, [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(path))))
        out.append((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows, schema=SCHEMA):
    df = conversations.conversation_trie(spark.createDataFrame(rows, schema).repartition(5))
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute([r[:4] for r in rows])


def test_sql(spark):
    assert compare(conversations.op11_conversation_trie(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), conversations.SQL) > 10


def test_branches_at_every_depth(spark):
    """Conversations of few different turns, so that chains hang on chains on chains; some of 40 turns, and gaps between the ids."""
    rows = []
    for c in [*range(0, 60), 200, 203, 1007]:
        n = 40 if c % 17 == 0 else 1 + c * 7 % 13
        rows += [(c, t, "user" if t % 2 else "assistant", "äb"[: (c >> (t % 5)) % 2 + 1] if t < 12 else f"t{t % 3}") for t in range(n)]
    check(spark, rows)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows and turns, empty and long texts, negative ids, a family's first conversation that isn't there."""
    rows = [(None, 1, "user", "x"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, None, None), (5, 1, "", ""), (5, 2, "a", "b"), (7, 0, "user", "first"), (7, 1, "", ""), (8, None, None, None), (-3, 0, "user", "first"), (-3, 2, "user", "y" * 100_000), (-3, 2, "user", "z"), (-7, 0, "us", "erfirst"), (13, 0, "user", "no family"), (14, 0, "user", "no family"), (0, 0, "user", "first"), (0, 1, "", "")]
    check(spark, rows)


def test_hot_conversation_and_hot_turn(spark):
    """One conversation holds a third of the turns; all begin alike, and a hundred are the same."""
    rows = [(10, t, "user", f"turn {t % 7}") for t in range(700)]
    rows += [(c, t, "user", f"turn {t % 7}" if c % 3 else f"other {c} {t}"[: 6 + 6 * (t > 1)]) for c in range(15, 215) for t in range(4 + c % 4)]
    check(spark, rows)


def test_columns_of_clashing_names_and_empty_table(spark):
    schema = SCHEMA + ", depth long, digest string, owner long, n long, length long, at long, value int, place int"
    more = (9, "x", 8, 7, 6, 5, 4, 3)
    check(spark, [(c, t, "r", f"{t * c % 3}") + more for c in range(12) for t in range(c % 5)], schema)
    assert conversations.conversation_trie(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("longest", [1, 5, 64])
def test_search_finds_the_last_unowned_depth(spark, longest):
    """Each conversation owns its path from one depth on; probes must find that depth wherever it is."""
    convs = spark.range(1, 2 + longest).select(F.col("id").alias("conv_id"), F.lit(longest).cast("long").alias("length"))
    paths = convs.select("conv_id", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("depth"))
    owned = F.col("depth") >= F.col("conv_id")  # conversation c owns the depths from c on
    paths = paths.withColumn("digest", F.when(owned, F.concat_ws("-", "conv_id", "depth")).otherwise(F.concat_ws("-", F.lit("0"), "depth")).cast("binary"))
    minima = paths.groupBy("digest").agg(F.min(F.when(owned, F.col("conv_id")).otherwise(0)).alias("owner"), F.min("depth").alias("depth"))
    got = conversations.last_unowned(convs, paths, minima, longest).collect()
    assert sorted((r["conv_id"], r["above"]) for r in got) == [(c, c - 1) for c in range(1, longest + 2)]
