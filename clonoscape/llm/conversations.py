"""The prefix trie of rebuilt conversations.

A node is a distinct sequence of first turns; its owner is the smallest of the
conversations that begin with it.  As a longer prefix has fewer conversations,
what a conversation owns is one chain of its own path, from some depth to its
end, so that a chain is told by that depth alone:

1. Turns are numbered and prefix digests summed by range of (conversation, place),
   so that a conversation of any length is spread over tasks.  Only digests of turns travel, never texts.
2. For each prefix digest the smallest conversation is found (one grouped minimum).
3. Each conversation searches its last unowned depth bit by bit: all
   conversations of a round probe one depth each, in one join against the minima.
   A round probes only depths whose lowest set bit is its own, so that each
   prefix takes part in one round.
4. Chains hang on the owner of the node above them.  Their totals are handed up,
   from the deepest place of attachment to the root, and each chain's nodes
   then take running sums from the end of the chain.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscape.operators.ordered import numbered, running

from .common import discard, looked_up, shared_folder, staged, table

#: A rebuilt conversation takes up to MOST_SHARED turns of the first conversation of its FAMILY.
FAMILY, MOST_SHARED = 5, 8
#: Conversation ids hashed as one row.
SEGMENT = 256
LANES = ("s1", "s2", "s3", "s4")
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_hash, bytes) of every rebuilt turn, and (conv_id, length) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(whole), 1, 16).alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes"))
    placed = staged(numbered(turns, [F.col("turn").asc_nulls_first(), F.col("turn_hash")], "at", 0, ["conv_id"]).drop("turn"), "turns")
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    of = own.select(F.col("conv_id").alias("family"), F.col("n").alias("n_family"))
    known = own.withColumn("family", family).withColumn("h", shared_turns(F.col("conv_id"))).join(of, "family", "left")
    begin = F.least("h", F.coalesce("n_family", F.lit(0)))
    length = F.when(F.col("conv_id") == F.col("family"), F.col("n")).otherwise(F.col("begin") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = staged(known.withColumn("begin", begin).withColumn("length", length).select("conv_id", "family", "h", "begin", "n", "length"), "conversations")
    kept = looked_up(placed, convs.select("conv_id", "family", "h", "begin", "n"), "conv_id", "n").where("conv_id = family or at >= h")
    mine = kept.select("conv_id", F.when(F.col("conv_id") == F.col("family"), F.col("at") + 1).otherwise(F.col("begin") + F.col("at") - F.col("h") + 1).alias("depth"), "turn_hash", "bytes")
    heads = placed.where(F.col("at") < MOST_SHARED).select(F.col("conv_id").alias("family"), "at", "turn_hash", "bytes")
    lent = convs.where("conv_id <> family").select("conv_id", "family", "h").join(heads, "family").where("at < h")
    return mine.unionByName(lent.select("conv_id", (F.col("at") + 1).alias("depth"), "turn_hash", "bytes")), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, bytes: digests of all prefixes, sums over their turns of a 128-bit hash of turn and depth."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.col("turn_hash")), 256)
    lane = {c: F.conv(F.substring("mixed", 8 * i + 1, 8), 16, 10).cast("long") for i, c in enumerate(LANES)}
    rows = turns.withColumn("mixed", mixed).withColumns({f"{c} here": x for c, x in lane.items()}).drop("mixed", "turn_hash")
    summed = running(rows, ["depth"], {c: F.col(f"{c} here") for c in LANES}, ["conv_id"])
    text = F.concat_ws(".", F.col("depth").cast("string"), *[(F.col(c) + F.col(f"{c} here")).cast("string") for c in LANES])
    return summed.select("conv_id", "depth", F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("digest"), "bytes")


def last_unowned(convs: DataFrame, paths: DataFrame, minima: DataFrame, longest: int) -> DataFrame:
    """conv_id, length, above, digest: the last depth whose node a smaller conversation owns (0 is the root), and its digest."""
    state = staged(convs.withColumns({"above": F.lit(0).cast("long"), "digest": F.lit(None).cast("binary")}), "searches")
    for bit in reversed(range(longest.bit_length())):
        step = 1 << bit
        turn = (F.col("depth").bitwiseAND(-F.col("depth"))) == step
        probed = state.where(F.col("above") + step <= F.col("length")).select("conv_id", (F.col("above") + step).alias("depth"))
        met = probed.join(paths.where(turn).select("conv_id", "depth", F.col("digest").alias("met")), ["conv_id", "depth"])
        owned = minima.where(turn).select(F.col("digest").alias("met"), F.col("owner").alias("conv_id"))  # the pair is a key: no hot digests
        others = met.join(owned, ["conv_id", "met"], "left_anti").select("conv_id", "depth", "met")
        found = state.join(others, "conv_id", "left").select("conv_id", "length", F.coalesce("depth", "above").alias("above"), F.coalesce("met", "digest").alias("digest"))
        last, state = state, staged(found, "searches")
        discard(last)
    return state


def handed_up(chains: DataFrame) -> DataFrame:
    """conv_id, depth, leaves, saved of each chain, at the node it hangs on; from the deepest place up.

    ``chains``: conv_id, above, parent, parent_above, leaves, saved of their own nodes.
    A round takes all chains that hang at one depth; what they hand on is written by the
    depth at which it will be read, so that each row is written and read once.
    """
    spark, at = chains.sparkSession, f"{shared_folder(chains.sparkSession)}/handed-{uuid.uuid4().hex}"
    schema = "conv_id long, depth long, leaves long, saved long, taken_at long"
    depths = sorted((r[0] for r in chains.where("parent is not null").select("above").distinct().collect()), reverse=True)  # a row a depth
    for k, depth in enumerate(depths):
        now = chains.where(F.col("above") == depth)
        if k:
            got = spark.read.schema(schema).parquet(at).where(F.col("taken_at") == depth).groupBy("conv_id").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
            now = now.join(got, "conv_id", "left")
        else:
            now = now.withColumns({"more": F.lit(0), "more_saved": F.lit(0)})
        total = now.select(F.col("parent").alias("conv_id"), F.col("above").alias("depth"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("parent_above").alias("taken_at"))
        total.write.mode("append").partitionBy("taken_at").parquet(at)
    return spark.read.schema(schema).parquet(at).drop("taken_at") if depths else spark.createDataFrame([], schema).drop("taken_at")


def ends_hashed(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of (conv_id, depth, member): the members' ids in ascending order, joined by commas.

    Members are packed, by range, into rows of up to SEGMENT ids; the task that
    hashes a node streams these and holds one batch of them.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            node = (b["conv_id"].diff().ne(0) | b["depth"].diff().ne(0)).cumsum()
            part = b.groupby([node, b.groupby(node).cumcount() // SEGMENT], sort=False)
            yield pd.DataFrame({"conv_id": part["conv_id"].first(), "depth": part["depth"].first(), "first": part["member"].first(), "ids": part["member"].agg(lambda m: ",".join(map(str, m)))})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for b in batches:
            out = []
            for c, d, ids in zip(b["conv_id"], b["depth"], b["ids"], strict=True):
                if node == (c, d):
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (c, d), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, sha.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    n = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = ["conv_id", "depth", "member"]
    segments = ends.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInPandas(packed, "conv_id long, depth long, first long, ids string")
    return segments.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInPandas(hashed, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), repeated turns by the hash of role and
    text; null roles and texts count as empty; texts of any length travel as digests. Rows
    without conv_id take no part; ``conv_id % 5`` has the sign of conv_id.
    Repeated rows are turns of their own. Other columns are ignored, and an empty
    table has no nodes, not even a root.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    paths = staged(prefixes(turns), "prefixes")
    extent = convs.agg(F.min("conv_id").alias("least"), F.max("length").alias("longest"), F.count("*").alias("n")).first()
    least = extent["least"]
    if least is None:
        return spark.createDataFrame([], NODES)
    minima = staged(paths.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("depth").alias("depth")), "minima")

    found = last_unowned(convs.where(F.col("conv_id") != least), paths, minima, extent["longest"])
    top = convs.where(F.col("conv_id") == least).select("conv_id", "length", F.lit(-1).cast("long").alias("above"), F.lit(None).cast("long").alias("parent"))
    under_root = found.where("above = 0").select("conv_id", "length", "above", F.lit(least).cast("long").alias("parent"))
    deeper = looked_up(found.where("above > 0"), minima.select("digest", F.col("owner").alias("parent"), "n_convs"), "digest", "n_convs")
    hung = staged(top.unionByName(under_root).unionByName(deeper.select("conv_id", "length", "above", "parent")), "hung")

    # chains: what they own themselves, and where they hang
    owning = hung.where("above < length")
    places = owning.where("parent is not null").groupBy("parent", "above").agg(F.count("*").alias("hang"))
    saved = minima.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    tip = places.select(F.col("parent").alias("conv_id"), F.col("above").alias("length"), F.lit(0).cast("long").alias("leaves"))
    told = owning.join(saved, "conv_id", "left").join(tip, ["conv_id", "length"], "left")
    own = staged(told.select("conv_id", "length", "above", "parent", F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")), "chains")
    hanging = places.groupBy("parent").agg(F.sum("hang").alias("hang"))
    parents = own.select(F.col("conv_id").alias("parent"), F.col("above").alias("parent_above")).join(hanging, "parent")
    chains = staged(looked_up(own.where("parent is not null"), parents, "parent", "hang"), "hanging")
    handed = handed_up(chains).groupBy("conv_id", "depth").agg(F.count("*").alias("hang"), F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))

    # nodes: sums from the end of their chain
    root = spark.createDataFrame([(least, 0, extent["n"], 0)], "conv_id long, depth long, n_convs long, bytes long")
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "bytes").unionByName(root)
    nodes = staged(nodes.join(handed, ["conv_id", "depth"], "left"), "nodes")
    owner = own.select("conv_id", "length", "above", "parent", "leaves", (F.col("length") - F.col("above")).alias("nodes"))
    rows = looked_up(nodes, owner, "conv_id", "nodes")
    last = F.col("depth") == F.col("length")
    here = {"n_leaves": F.coalesce("leaves_below", F.lit(0)) + F.when(last, F.col("leaves")).otherwise(0), "saved_tokens": F.coalesce("saved_below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")}
    kept = rows.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("above") + 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("hang", F.lit(0)) + F.when(last, 0).otherwise(1)).cast("long").alias("n_children"), *[x.cast("long").alias(f"{c} here") for c, x in here.items()],
    )
    summed = running(kept, [F.col("depth").desc()], {c: F.col(f"{c} here") for c in here}, ["conv_id"])
    ended = hung.select(F.when(F.col("above") < F.col("length"), F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.greatest("length", F.lit(0)).alias("depth"), F.col("conv_id").alias("member"))
    out = summed.join(ends_hashed(ended), ["conv_id", "depth"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *[(F.col(c) + F.col(f"{c} here")).alias(c) for c in here], F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: crc32 of a decimal id, byte by byte, from a table made by its polynomial.
_CRC = "crc as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)))"
SQL = f"""
with {_CRC},
o as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as place from conversations where conv_id is not null),
h as (select c, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substring(c::varchar, i::int, 1))::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 as h from (select distinct c from o), crc),
r as (select h.c, 0 as part, place, role, text from h join o on o.c = h.c - h.c % 5 and place < h union all select h.c, 1, place, role, text from h join o on o.c = h.c and place >= h),
d as (select c, row_number() over w as depth, sha256(string_agg(sha256(length(role) || ':' || role || text), ',') over w) as path, strlen(text) as bytes from r window w as (partition by c order by part, place rows unbounded preceding)),
p as (select c, depth, path, bytes from d union all select c, 0, '', 0 from h),
e as (select c, max(depth) as depth from p group by 1),
n as (select depth, path, min(c) as c, count(*) as n_convs, min(bytes) as bytes from p group by 1, 2),
k as (select n.depth, n.path, count(distinct q.path) as n_children from n join p x on x.path = n.path and x.depth = n.depth left join p q on q.c = x.c and q.depth = x.depth + 1 group by 1, 2),
b as (select p.depth, p.path, count(*) filter (k.n_children = 0) as n_leaves, sum((m.n_convs - 1) * m.bytes)::bigint as saved_tokens from n m join k on k.depth = m.depth and k.path = m.path join p on p.c = m.c and p.depth <= m.depth group by 1, 2),
s as (select p.depth, p.path, sha256(string_agg(p.c::varchar, ',' order by p.c)) as ends_sha256 from p join e on e.c = p.c and e.depth = p.depth group by 1, 2)
select n.c as conv_id, n.depth, u.c as parent_conv_id, n.n_convs, k.n_children, b.n_leaves, b.saved_tokens, coalesce(s.ends_sha256, sha256('')) as ends_sha256
from n join k on k.depth = n.depth and k.path = n.path join b on b.depth = n.depth and b.path = n.path left join s on s.depth = n.depth and s.path = n.path
left join p v on v.c = n.c and v.depth = n.depth - 1 left join n u on u.depth = v.depth and u.path = v.path
"""
