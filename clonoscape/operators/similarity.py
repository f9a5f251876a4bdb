"""Blocked self-joins between sequences and between vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscape.functions.alignment import local_score_slices, one_gap_slices
from clonoscape.functions.strings import col, dotted, hamming, kmers, trim_ends, wildcards

from . import pivots
from .graph import parts, staged
from .ordered import numbered
from .pivots import squared_distances  # noqa: F401


def one_mismatch_pairs(df: DataFrame, key: str, region: str, also: list[str] = ()) -> DataFrame:
    """Pairs a < b of rows whose regions have equal length and at most one substitution.

    Regions are collapsed first; two differ in one place when they share a
    pattern with that place masked, so the join is an equi-join on patterns and
    no two regions are compared that don't qualify.  ``also`` names columns that
    must be equal too.
    """
    regions = spread(df.select(col(region).alias("r"), *also).where(F.length("r") > 0).distinct(), "r")
    patterns = masked_at_varying(regions, "r", wildcards).select("r", *also, F.explode("masked").alias("p"))
    alike = patterns.groupBy("p", *also).agg(F.array_sort(F.collect_list("r")).alias("rs")).where(F.size("rs") > 1)  # different letters of one place: a row a letter of the alphabet at most
    after = lambda x, i: F.transform(F.slice("rs", i + 2, F.size("rs")), lambda y: F.struct(x.alias("r"), y.alias("s")))
    near = alike.select(*also, F.explode(F.flatten(F.transform("rs", after))).alias("x")).select("x.r", "x.s", *also)
    if isinstance(region, str) and key == region and not also:
        return near.select(F.col("r").alias("a"), F.col("s").alias("b"), F.lit(1).alias("d")).hint("merge")
    rows = df.select(F.col(key), col(region).alias("r"), *also)
    same = rows.select("r", F.col("r").alias("s"), *also).where(F.length("r") > 0).distinct()
    pairs = near.unionByName(same).hint("merge")  # different regions one way round only; their rows are put in order after the joins
    left, right = rows.withColumnRenamed(key, "a"), rows.select(F.col(key).alias("b"), F.col("r").alias("s"), *also).hint("merge")
    met = left.join(pairs, ["r", *also]).join(right, ["s", *also]).where("a < b or a > b and r <> s")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("r") != F.col("s")).cast("int").alias("d")).hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over several partitions a core, by keys: steps that make many rows of each one shouldn't run in the few tasks of a small table."""
    return df.repartition(parts(df.sparkSession), *keys)


def masked_at_varying(rows: DataFrame, seq: str, masks) -> DataFrame:
    """The rows with ``masked``, by ``masks(column, places)``; a place (from 1) at which all sequences of a length agree can't tell two apart and is left out."""
    letters = rows.select(F.length(seq).alias("n of"), F.posexplode(F.split(seq, "")).alias("at", "letter")).groupBy("n of", "at").agg(F.min("letter").alias("low"), F.max("letter").alias("high"))
    places = letters.groupBy("n of").agg(F.array_sort(F.collect_list(F.when(F.col("low") != F.col("high"), F.col("at") + 1))).alias("places"))  # a row a length
    return rows.join(F.broadcast(places), F.length(seq) == F.col("n of")).withColumn("masked", masks(seq, F.col("places"))).drop("n of", "places")


def interleaved(seq, m: int) -> Column:
    """m pieces of a sequence, piece i of the residues at places i, i + m, ...; what all sequences begin or end with is spread over all."""
    letters = F.split(col(seq), "")
    piece = lambda i: F.array_join(F.filter(letters, lambda _, at: at % m == i), "")
    return F.array(*[F.concat(F.lit(f"{i}:"), piece(i)) for i in range(m)])


def _candidates(asks: DataFrame, rows: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, x, b, y) of (k, s) that share one of ``radius`` + 1 interleaved pieces, as any two within the radius must."""
    keyed = lambda df: df.select("k", "s", F.length("s").alias("n"), F.explode(interleaved("s", radius + 1)).alias("piece"))
    x = keyed(asks).select(F.col("k").alias("a"), F.col("s").alias("x"), "n", "piece")
    return x.join(keyed(rows).select(F.col("k").alias("b"), F.col("s").alias("y"), "n", "piece"), ["n", "piece"])


#: Most patterns of a sequence; where more places vary, sequences meet by interleaved pieces instead.
MOST_MASKS = 256
#: Up to so many sequences that still ask are sent to all tasks.
FEW_ASKING = 20_000


def _varying(rows: DataFrame) -> dict[int, list[int]]:
    """Of each length of ``s``, the places (from 1) at which sequences differ: a row a length."""
    letters = rows.select(F.length("s").alias("n"), F.posexplode(F.split("s", "")).alias("at", "letter")).groupBy("n", "at").agg(F.min("letter").alias("low"), F.max("letter").alias("high"))
    places = letters.groupBy("n").agg(F.array_sort(F.collect_list(F.when(F.col("low") != F.col("high"), F.col("at") + 1))).alias("places")).collect()
    return {r["n"]: r["places"] for r in places}


def _masks(spark, places: dict[int, list[int]], most: int) -> DataFrame | None:
    """n, masks: of each length the ways to leave out ``most`` varying places; None if these are too many.

    A mask is its number, its places, and for each whether it and all varying places before it are the first of the mask.
    """
    if any(comb(len(at), most) > MOST_MASKS for at in places.values()):
        return None
    out = []
    for n, at in places.items():
        some = [list(c) for c in combinations(range(len(at)), min(most, len(at)))]
        fill = lambda c, x: c + [x] * (most - len(c))
        out.append((n, [(i, fill([at[r] for r in c], n + 1), fill([r == k for k, r in enumerate(c)], True)) for i, c in enumerate(some)]))
    return spark.createDataFrame(out, "n int, masks array<struct<mask: int, places: array<int>, first: array<boolean>>>")


def _masked(rows: DataFrame, masks: DataFrame, most: int) -> DataFrame:
    """k, s, n, mask, places, first, p: rows of ``k`` and ``s`` once for each mask of their length, with the pattern that it leaves."""
    x = spread(rows.select("k", "s"), "k").join(F.broadcast(masks), F.length("s") == F.col("n")).select("k", "s", "n", F.explode("masks").alias("m")).select("k", "s", "n", "m.*")  # a row a length
    p = F.concat("s", F.lit(" "))  # the last place stands for none
    for t in range(most):
        p = F.overlay(p, F.lit("*"), F.element_at("places", t + 1))
    return x.withColumn("p", p)


def hamming_pairs(df: DataFrame, key: str, seq: str, most: int | None = None) -> DataFrame:
    """Pairs a < b of equal length with their Hamming distance; up to ``most`` if given.

    For one substitution use one_mismatch_pairs.  For more, sequences are joined on
    the patterns that are left when ``most`` of the places that vary are masked, so
    that only pairs of the result meet; of the masks that a pair shares, the first
    one tells of it.  Where too many places vary, they meet by ``most + 1``
    interleaved pieces, one of which two close sequences must share.  Without a
    bound, all pairs of a length are a matrix that grows with its square (for the
    nearest only, see nearest_hamming).
    """
    rows = df.select(F.col(key).alias("k"), F.col(seq).alias("s"))
    if most is None:
        sized = rows.withColumn("n", F.length("s"))
        x, y = sized.alias("x"), sized.alias("y")
        pairs = x.join(y, (F.col("x.n") == F.col("y.n")) & (F.col("x.k") < F.col("y.k")))
        return pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), hamming("x.s", "y.s").alias("d"))
    rows = rows.where("s is not null")
    masks = _masks(df.sparkSession, _varying(rows), most)
    if masks is None:
        pairs = _candidates(rows, rows, most).where("a < b").select("a", "b", hamming("x", "y").alias("d"))
        return pairs.where(F.col("d") <= most).distinct()
    told = _masked(rows, masks, most)
    x = told.select("n", "mask", "p", "places", "first", F.col("k").alias("a"), F.col("s").alias("x"))
    met = x.join(told.select("n", "mask", "p", F.col("k").alias("b"), F.col("s").alias("y")).hint("merge"), ["n", "mask", "p"]).where("a < b")
    differ = [F.substring("x", F.element_at("places", t + 1), F.lit(1)) != F.substring("y", F.element_at("places", t + 1), F.lit(1)) for t in range(most)]
    d, first = F.lit(0), F.lit(True)
    for t, x in enumerate(differ):
        d, first = d + x.cast("int"), first & (x | F.element_at("first", t + 1))
    return met.where(first).select("a", "b", d.alias("d"))


def nearest_hamming(df: DataFrame, key: str, seq: str) -> DataFrame:
    """key, d: each sequence's distance to the nearest other of equal length; those alone in their length are left out.

    Sequences look within radius 0, 1, 2 and so on; only those without a hit go on. A
    hit is a pattern, with so many places masked, that another one has too: no pairs are made.
    """
    rows = df.select(F.col(key).alias("k"), F.col(seq).alias("s")).where("s is not null")
    sizes = rows.groupBy(F.length("s").alias("n")).agg(F.count("*").alias("count")).where("count > 1")
    rows = staged(rows.join(F.broadcast(sizes.select("n")), F.length("s") == F.col("n"), "left_semi"), "rows")  # a row for each length
    asks, places = rows, _varying(rows)
    longest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    done, radius, left = None, -1, rows.count()
    while radius < longest and left:
        radius += 1
        masks = _masks(df.sparkSession, places, radius)
        if masks is None:
            near = _candidates(asks, rows, radius).where("a <> b").select("a", hamming("x", "y").alias("d")).where(F.col("d") <= radius).groupBy("a").agg(F.min("d").alias("d"))
        else:
            on = ["n", "mask", "p"]
            asking, every = _masked(asks, masks, radius).select("k", *on), _masked(rows, masks, radius).select("k", *on)
            if done is not None:
                wanted = asking.select(*on).distinct()
                every = every.join(F.broadcast(wanted) if left <= FEW_ASKING else wanted.hint("merge"), on, "left_semi")
            met = every.groupBy(*on).agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select(*on)
            near = asking.join(met.hint("merge"), on, "left_semi").select(F.col("k").alias("a")).distinct().withColumn("d", F.lit(radius))
        found = staged(near, "nearest")
        done = found if done is None else done.unionByName(found)
        asks = staged(asks.join(found.select(F.col("a").alias("k")), "k", "left_anti"), "asking")
        left = asks.count()
    out = rows.select("k", F.lit(0).alias("d")).limit(0) if done is None else done.withColumnRenamed("a", "k")
    return out.select(F.col("k").alias(key), "d")


def distance_histogram(nearest: DataFrame) -> DataFrame:
    return nearest.groupBy("d").agg(F.count("*").alias("n"))


def motif_pairs(df: DataFrame, key: str, region: str, motifs: DataFrame, positional: bool = False, also: list[str] = ()) -> DataFrame:
    """Pairs a < b of rows that both hold a selected motif (``motif`` column; a dot stands for any residue).

    With ``positional`` the first place of the motif must agree.  Of the motifs that
    two rows share the first one tells of the pair, so that pairs are not shuffled.
    """
    held = motif_members(df, key, region, motifs, also)
    on = ["motif", *also] + (["at"] if positional else [])
    every = held.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*on))).alias("every"))
    each = staged(every.select(key, F.posexplode("every").alias("place", "on"), "every").select(key, "on", F.slice("every", F.lit(1), F.col("place")).alias("before")), "motifs")
    x, y = each.select("on", F.col(key).alias("a"), F.col("before").alias("x")), each.select("on", F.col(key).alias("b"), F.col("before").alias("y"))
    return x.join(y.hint("merge"), "on").where("a < b").where(~F.arrays_overlap("x", "y")).select("a", "b")


def motif_members(df: DataFrame, key: str, region: str, motifs: DataFrame, also: list[str] = ()) -> DataFrame:
    """motif, key, at (first place) of every row that holds the motif."""
    rows = df.select(key, col(region).alias("r"), *also)
    plain = motifs.where(~F.col("motif").contains(".")).select("motif").distinct()
    lengths = [r[0] for r in plain.select(F.length("motif")).distinct().collect()]  # a few lengths
    found = None
    for k in sorted(lengths):
        one = rows.select(key, *also, F.posexplode(kmers("r", k)).alias("at", "motif")).join(plain, "motif")
        found = one if found is None else found.unionByName(one)
    gapped = motifs.where(F.col("motif").contains(".")).select("motif").distinct()
    for k in sorted(r[0] for r in gapped.select(F.length("motif")).distinct().collect()):
        for j in range(2, k):
            masked = rows.select(key, *also, F.posexplode(F.transform(kmers("r", k), dotted(j))).alias("at", "motif")).join(gapped, "motif")
            found = masked if found is None else found.unionByName(masked)
    if found is None:
        return rows.select(F.lit("").alias("motif"), key, F.lit(0).alias("at"), *also).where(F.lit(False))
    return found.groupBy("motif", key, *also).agg((F.min("at") + 1).alias("at"))


def same_group_pairs(pairs: DataFrame, members: DataFrame, node: str, group: str) -> DataFrame:
    """Pairs whose nodes share a group (a donor, a V gene) in (node, group)."""
    m = members.select(node, group).distinct()
    x = pairs.join(m.select(F.col(node).alias("a"), group), "a")
    return x.join(m.select(F.col(node).alias("b"), group), ["b", group]).select(*pairs.columns).distinct()


def records_of_pairs(pairs: DataFrame, records: DataFrame, node: str, record: str) -> DataFrame:
    """Every pair of records of each pair of nodes."""
    r = records.select(node, record)
    return pairs.join(r.select(F.col(node).alias("a"), F.col(record).alias("record_a")), "a").join(r.select(F.col(node).alias("b"), F.col(record).alias("record_b")), "b")


def shared_kmer_pairs(df: DataFrame, key: str, seq: str, k: int = 5, least: int = 1, mismatches: int = 1, trim: tuple[int, int] = (3, 2)) -> DataFrame:
    """Pairs a < b of equal length with so many k-mers in common, each up to so many substitutions.

    A k-mer of one row counts if the other has one that agrees with it.  A row of so
    many k-mers can spare all but ``least`` - 1 of them: only its rarest others,
    by how many share their patterns, look for partners, and k-mers are counted where
    two rows meet, at the first pattern that they share.
    """
    region = trim_ends(seq, *trim)
    some = df.select(F.col(key).alias("k"), F.length(seq).alias("n"), region.alias("r"))
    rows = staged(spread(some, "k").where(F.length("r") >= k).withColumn("ms", F.array_distinct(kmers("r", k))), "k-mers")  # lengths are asked for: the filter goes to the few tasks that read
    masks = [[F.lit(j + 1) for j in c] for c in combinations(range(k), min(mismatches, k))]

    def patterns(m: Column) -> Column:
        """The masked k-mer for each mask, as a hash: k-mers are counted afterwards, so that rows that meet by chance are told apart."""
        out = []
        for i, c in enumerate(masks):
            p = m
            for at in c:
                p = F.overlay(p, F.lit("*"), at)
            out.append(F.xxhash64("n", F.lit(i), p))
        return F.array(*out)

    each = rows.select("n", F.explode("ms").alias("m")).groupBy("n", "m").agg(F.count("*").alias("c"))
    shares = staged(each.select("n", "m", "c", F.explode(patterns(F.col("m"))).alias("p")), "patterns")
    mass = shares.join(shares.groupBy("p").agg(F.sum("c").alias("c_p")).hint("merge"), "p").groupBy("n", "m").agg(F.sum("c_p").alias("mass"))
    told = rows.where(F.size("ms") >= least).select("k", "n", "r", (F.size("ms") - max(0, least - 1)).alias("kept"), F.explode("ms").alias("m")).join(mass.hint("merge"), ["n", "m"])
    ranked = told.groupBy("k", "n", "r", "kept").agg(F.array_sort(F.collect_list(F.struct("mass", "m"))).alias("by"))  # the k-mers of a row
    rarest = F.slice("by", F.lit(1), F.greatest(F.col("kept"), F.lit(1)))["m"]
    own = ranked.select("k", "n", "r", rarest.alias("ms")).withColumn("told", F.transform(kmers("r", k), lambda m: F.when(F.array_contains("ms", m), "1").otherwise("0")))
    asked = F.flatten(F.transform(kmers("r", k), lambda m, i: F.when(F.array_contains("ms", m), F.transform(patterns(m), lambda p, c: F.struct(p.alias("p"), (i * len(masks) + c).alias("at")))).otherwise(F.array().cast("array<struct<p: bigint, at: int>>"))))
    looking = own.select(F.col("k").alias("a"), F.col("r").alias("x"), F.array_join("told", "").alias("told"), F.explode(asked).alias("one")).select("a", "x", "told", "one.p", "one.at")
    held = rows.select(F.col("k").alias("b"), F.col("r").alias("y"), F.explode(F.array_distinct(F.flatten(F.transform("ms", patterns)))).alias("p"))
    met = looking.join(held.hint("merge"), "p").where("a < b").where(F.length("x") == F.length("y"))
    return met.select("a", "b", shared_kmers(k, mismatches)("x", "y", "told", "at").alias("shared")).where(F.col("shared") >= max(1, least))


def shared_kmers(k: int, mismatches: int):
    """A pandas UDF: how many distinct k-mers of the first text the second one has, up to so many substitutions, if the pair is told of here; else 0.

    Texts are of equal length.  ``told`` marks the places (0 or 1 each) whose k-mers look for partners, and
    ``at`` is the place times the number of masks, plus the mask, by which the two have met:
    a pair is told of at the first of these that it shares, so that pairs are not shuffled.
    """
    masks = [sum(1 << t for t in c) for c in combinations(range(k), min(mismatches, k))]
    tables = []  # for each way to differ, the masks (up to 32 a table) that leave nothing of it
    for begin in range(0, len(masks), 32):
        tables.append(np.array([sum(1 << i for i, c in enumerate(masks[begin : begin + 32]) if not d & ~c) for d in range(1 << k)], np.uint32))

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series, told: pd.Series, at: pd.Series) -> pd.Series:
        out = np.zeros(len(a), np.int64)
        sizes, place = a.str.len().to_numpy(), at.to_numpy()
        for size in np.unique(sizes[sizes >= k]):
            some = np.flatnonzero(sizes == size)
            x, y = (np.frombuffer("".join(t.iloc[some]).encode("utf-32-le"), np.uint32).reshape(len(some), -1).T.copy() for t in (a, b))
            asks = np.frombuffer("".join(told.iloc[some]).encode(), np.uint8).reshape(len(some), -1).T == ord("1")
            places = range(size - k + 1)
            unlike = [[p != q for q in y] for p in x]
            number, first, missing = np.zeros(len(some), np.int64), np.full(len(some), -1), np.ones(len(some), bool)
            for i in places:
                fresh = np.ones(len(some), bool)
                for j in range(i):
                    fresh &= (x[i : i + k] != x[j : j + k]).any(0)
                ways = [np.zeros(len(some), np.uint32) for _ in tables]
                for j in places:
                    d = np.zeros(len(some), np.int32)
                    for t in range(k):
                        d |= unlike[i + t][j + t].astype(np.int32) << t
                    for w, table in zip(ways, tables, strict=True):
                        w |= table[d]
                hit = np.zeros(len(some), bool)
                for n, w in enumerate(ways):
                    hit |= w > 0
                    mine = missing & asks[i] & (w > 0)
                    lowest = np.log2((w[mine] & (~w[mine] + np.uint32(1))).astype(float)).astype(np.int64)
                    first[mine] = i * len(masks) + n * 32 + lowest
                    missing &= ~mine
                number += fresh & hit
            out[some] = np.where(first == place[some], number, 0)
        return pd.Series(out)

    return run


#: Least and most rows of a block of vectors, and least blocks of larger tables: a row travels once for each block. A cell compares two blocks within one task, SLICE rows at a time.
BLOCK_ROWS, MOST_BLOCK_ROWS, LEAST_BLOCKS, SLICE = 8192, 65536, 16, 256


def vector_cells(asks: DataFrame, rows: DataFrame, within: list[str], run, schema: str, keep: str | None = None) -> DataFrame:
    """Meets every block of ``asks`` (a, x) with every block of ``rows`` (b, y) of the same group.

    ``run(a, x, b, y)`` gets ids and matrices of a slice of asks and of the rows of one cell and
    returns columns of ``schema``.  Blocks are bounded whatever the size of the tables; a row is
    sent once for each block that it meets.  ``keep`` names a group column that the
    result has too.
    """
    n_rows, n_asks = rows.count(), asks.count()
    size = lambda n: min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, -(-n // LEAST_BLOCKS)))
    nb, na = max(1, -(-n_rows // size(n_rows))), max(1, -(-n_asks // size(n_asks)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select(*within, block("a", na).alias("ba"), every(nb).alias("bb"), F.col("a").alias("id"), F.col("x").cast("array<double>").alias("v"), F.lit(True).alias("asks"))
    right = rows.select(*within, every(na).alias("ba"), block("b", nb).alias("bb"), F.col("b").alias("id"), F.col("y").cast("array<double>").alias("v"), F.lit(False).alias("asks"))

    def cell(t: pd.DataFrame) -> pd.DataFrame:
        asking = t["asks"].to_numpy(bool)
        v, ids = np.array(t["v"].tolist(), float).reshape(len(t), -1), t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        left, right = order[asking[order]], order[~asking[order]]
        if not len(left) or not len(right):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        every = [run(ids[some], v[some], ids[right], v[right]) for some in np.array_split(left, -(-len(left) // SLICE))]
        out = pd.concat(every)
        return out if keep is None else out.assign(**{keep: t[keep].iloc[0]})

    return left.unionByName(right).groupBy(*within, "ba", "bb").applyInPandas(cell, schema)


def _vectors(df: DataFrame, key: str, vector: str, within: list[str]) -> DataFrame:
    v = F.col(vector) if dict(df.dtypes)[vector] == "binary" else F.col(vector).cast("array<double>")  # bytes as ``decode`` takes them, or numbers
    return df.select(*[F.col(c).alias(f"group {i}") for i, c in enumerate(within)], F.col(key).cast("long").alias("id"), v.alias("v"))


def nearest_vectors(df: DataFrame, key: str, vector: str, k: int = 1, within: list[str] = (), queries: DataFrame | None = None, decode=pivots.matrix, **sizes: int) -> DataFrame:
    """Exact k nearest rows of the same ``within`` group: a, b, d (squared distance), rank; ties to the smaller key.

    With ``queries`` only those ask.  Rows meet by cells around pivots (``pivots``);
    rows without a vector or a group take no part.  ``decode`` makes vectors of the
    column where they are compared, if it holds something shorter (as bytes).
    """
    groups = [f"group {i}" for i in range(len(within))]
    return pivots.nearest(_vectors(df, key, vector, within), None if queries is None else _vectors(queries, key, vector, within), k, groups, decode=decode, **sizes)


def vectors_within(df: DataFrame, key: str, vector: str, radius: float, within: list[str] = (), **sizes: int) -> DataFrame:
    """Pairs a < b of a group whose squared distance d is below the radius, met by cells around pivots."""
    return pivots.near_pairs(_vectors(df, key, vector, within), radius, [f"group {i}" for i in range(len(within))], **sizes)


def core_links(df: DataFrame, key: str, vector: str, radius: float, least: int, within: list[str] = (), **sizes: int) -> tuple[DataFrame, DataFrame] | None:
    """Core rows and their links (``pivots.near_counts_and_links``) for squared distances below the radius."""
    return pivots.near_counts_and_links(_vectors(df, key, vector, within), radius, least, [f"group {i}" for i in range(len(within))], **sizes)


def submatrix(distances: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Long distances with both ends among the ids."""
    some = ids.select(key).distinct()
    return distances.join(some.withColumnRenamed(key, "i"), "i", "left_semi").join(some.withColumnRenamed(key, "j"), "j", "left_semi")


def combined_distance(first: DataFrame, second: DataFrame, w1: float = 0.5, w2: float = 0.5) -> DataFrame:
    """Weighted sum of two long matrices (i, j, d)."""
    return first.select("i", "j", F.col("d").alias("d1")).join(second.select("i", "j", F.col("d").alias("d2")), ["i", "j"]).select("i", "j", (F.col("d1") * w1 + F.col("d2") * w2).alias("d"))


def mean_pair_distance(distances: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Mean distance of the pairs of each label (each pair once in i < j)."""
    m = labels.select(key, label)
    x = distances.join(m.select(F.col(key).alias("i"), label), "i").join(m.select(F.col(key).alias("j"), label), ["j", label])
    return x.groupBy(label).agg((F.sum("d") / F.count("*")).alias("mean_distance"), F.count("*").alias("pairs"))


def meeting(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of ``own`` once for each of the blocks (``other``), by pair of blocks: row <= column. Pairs of blocks are work, not bytes, so they are dealt out by number."""
    met = rows.crossJoin(F.broadcast(blocks))  # a row for each block of rows
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.withColumns({"row": F.least("own", "other"), "column": F.greatest("own", "other")}).drop("other").repartition(n, "row", "column")


def pair_alignments(members: DataFrame, cluster: str, key: str, seq: str, match: int = 3, mismatch: int = -3, gap: int = -2, block: int = 512) -> DataFrame:
    """ca, cb, i, j, score: local alignment of all pairs of sequences, within and between clusters, ca <= cb.

    Sequences are numbered by cluster and key and cut into blocks; two blocks meet in
    one group, each pair of blocks once, so that a block is sent once a row and column of the triangle.
    """
    rows = staged(numbered(members.select(F.col(cluster).alias("c"), F.col(key).alias("k"), F.col(seq).alias("s")).where("s is not null"), ["c", "k"], "at", 0), "sequences")
    met = rows.withColumn("own", F.floor(F.col("at") / block))
    kinds = dict(members.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches)).sort_values("at")
        left, right = t[t["own"] == t["row"]], t[t["own"] == t["column"]]
        for some, scores in local_score_slices(left["s"].tolist(), right["s"].tolist(), match, mismatch, gap):
            own = left.iloc[some]
            i, j = np.nonzero(own["at"].to_numpy()[:, None] < right["at"].to_numpy()[None, :])
            x, y = own.iloc[i], right.iloc[j]
            yield pd.DataFrame({"ca": x["c"].to_numpy(), "cb": y["c"].to_numpy(), "i": x["k"].to_numpy(), "j": y["k"].to_numpy(), "score": scores[i, j].astype(np.int64)})

    return meeting(met, met.select(F.col("own").alias("other")).distinct()).groupBy("row", "column").applyInPandas(run, f"ca {kinds[cluster]}, cb {kinds[cluster]}, i {kinds[key]}, j {kinds[key]}, score long")


#: Least and most sequences of a block of cluster_alignments, and least blocks of larger tables.
LEAST_ALIGNED, MOST_ALIGNED, ALIGNED_BLOCKS = 512, 4096, 32


def cluster_alignments(members: DataFrame, cluster: str = "cluster", seq: str = "cdr3", match: int = 3, mismatch: int = -3, gap: int = -2) -> DataFrame:
    """Mean local alignment score of each pair of clusters (own pairs too), ca <= cb.

    Sequences are numbered by cluster, and a block holds whole clusters, so that two
    blocks that meet know all about their pairs of clusters: scores are summed where
    they are, and neither they nor the sums are shuffled.  Clusters of more
    sequences than a block has are cut; the sums of their pairs alone are added up over blocks.
    """
    k = F.col("id") if "id" in members.columns else F.xxhash64(seq)
    rows = staged(numbered(members.select(F.col(cluster).alias("c"), k.alias("k"), F.col(seq).alias("s")).where("s is not null"), ["c", "k"], "at", 0).drop("k"), "sequences")
    size = min(MOST_ALIGNED, max(LEAST_ALIGNED, -(-rows.count() // ALIGNED_BLOCKS)))
    clusters = rows.groupBy(F.col("c").alias("c_")).agg(F.min("at").alias("first"), (F.count("*") > size).alias("wide"))
    told = rows.join(clusters.hint("merge"), F.col("c").eqNullSafe(F.col("c_"))).drop("c_")
    block = F.floor(F.when(F.col("wide"), F.col("at")).otherwise(F.col("first")) / size)
    told = staged(told.select("c", "s", "at", "first", (block * 2 + F.col("wide").cast("long")).alias("own")), "sequences")  # odd: parts of clusters
    kind = dict(members.dtypes)[cluster]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches)).sort_values("at")
        home = t["row"].iloc[0] == t["column"].iloc[0]
        left, right = t[t["own"] == t["row"]], t[t["own"] == t["column"]]
        if not len(left) or not len(right):
            return
        names = t.drop_duplicates("first")
        known, names = names["first"].to_numpy(), names["c"].to_numpy()
        name = lambda first: names[np.searchsorted(known, first)]
        begins = lambda f: np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        to, columns = right["at"].to_numpy(), begins(right["first"].to_numpy())
        other = right["first"].to_numpy()[columns]

        def table(one: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
            i, j = np.nonzero(counts)
            low, high = np.minimum(one[i], other[j]), np.maximum(one[i], other[j])
            return pd.DataFrame({"ca": name(low), "cb": name(high), "total": sums[i, j], "pairs": counts[i, j]})

        kept = None
        for some, scores in local_score_slices(left["s"].tolist(), right["s"].tolist(), match, mismatch, gap):
            first = left["first"].to_numpy()[some]
            met = left["at"].to_numpy()[some, None] < to[None, :] if home else np.ones(scores.shape, bool)
            at = begins(first)
            sums, counts = (np.add.reduceat(np.add.reduceat(x, columns, 1, np.int64), at, 0) for x in (scores * met, met))
            own = first[at]
            if kept is not None and kept[0][-1] == own[0]:  # the last cluster of the slice before goes on
                sums[0] += kept[1][-1]
                counts[0] += kept[2][-1]
                kept = tuple(x[:-1] for x in kept)
            if kept is not None and len(kept[0]):
                yield table(*kept)
            kept = own, sums, counts
        yield table(*kept)

    met = meeting(told, told.select(F.col("own").alias("other")).distinct())
    scored = lambda some: met.where(some).groupBy("row", "column").applyInPandas(run, f"ca {kind}, cb {kind}, total long, pairs long")
    cut = (F.col("row") % 2 == 1) | (F.col("column") % 2 == 1)
    out = scored(~cut)
    if not told.where("own % 2 = 1").isEmpty():
        out = out.unionByName(scored(cut).groupBy("ca", "cb").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs")))
    return out.select("ca", "cb", (F.col("total") / F.col("pairs")).alias("mean_score"), "pairs")


#: Sequences of a block of one_gap_pairs.
GAP_BLOCK = 4096


def one_gap_pairs(df: DataFrame, seq: str, gap: int = -6) -> DataFrame:
    """x, y, score: all pairs of sequences of which x is longer by one, and their best gapless score after one gap in y (``one_gap_score``).

    Blocks of bounded size of two lengths meet in one task each, and hand on their pairs a slice at a time.
    """
    rows = staged(df.select(F.col(seq).alias("s")).where(F.col(seq).isNotNull()), "sequences")
    blocks = max(1, -(-rows.count() // GAP_BLOCK))
    own, every = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(F.length("s").alias("n"), own.alias("row"), every.alias("column"), "s", F.lit(True).alias("long"))
    right = rows.select((F.length("s") + 1).alias("n"), every.alias("row"), own.alias("column"), "s", F.lit(False).alias("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches))
        long = t["long"].to_numpy(bool)
        x, y = t["s"][long].to_numpy(), t["s"][~long].to_numpy()
        if len(x) and len(y):
            for some, scores in one_gap_slices(x.tolist(), y.tolist(), gap):
                yield pd.DataFrame({"x": np.repeat(x[some], len(y)), "y": np.tile(y, len(scores)), "score": pd.Series(scores.data.ravel(), dtype="Int64").mask(np.ma.getmaskarray(scores).ravel())})

    return spread(left.unionByName(right), "n", "row", "column").groupBy("n", "row", "column").applyInPandas(run, "x string, y string, score long")


def prefix_annotations(clones: DataFrame, annotations: DataFrame, clone: str, annotated: str, exact: bool = True) -> DataFrame:
    """Records of each clone: of equal sequence, or of any that begins with it."""
    if exact:
        return clones.join(annotations, F.col(clone) == F.col(annotated))
    lengths = clones.select(F.length(clone).alias("len_")).distinct()
    cut = annotations.join(F.broadcast(lengths)).where(F.length(annotated) >= F.col("len_")).withColumn("head_", F.substring(annotated, F.lit(1), F.col("len_")))
    return clones.join(cut, F.col(clone) == F.col("head_")).drop("head_", "len_")


def gene_pair_scores(genes: DataFrame, score: Column) -> DataFrame:
    """Scores of all pairs v1 <= v2 of a gene table (a reference of some hundred genes)."""
    x, y = genes.alias("x"), genes.alias("y")
    return x.join(y, F.col("x.name") <= F.col("y.name")).select(F.col("x.name").alias("v1"), F.col("y.name").alias("v2"), score.alias("score"))
