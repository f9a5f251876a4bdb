"""Negatives, splits and draws by hashed order, so that they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscape.functions.strings import joined_key

from .graph import staged
from .ordered import numbered, running


def bucket(*cols, seed: str = "", of: int = 100) -> Column:
    """A number from 0 to ``of`` - 1 from the md5 of the columns."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols])), 1, 8), 16, 10).cast("long"), F.lit(of))


def split(df: DataFrame, key: str | list[str], percents: dict[str, int], seed: str = "") -> DataFrame:
    """Adds ``part`` by hash bucket; a list of keys keeps equal keys together."""
    b, at, part = bucket(*([key] if isinstance(key, str) else key), seed=seed), 0, None
    for name, percent in percents.items():
        hit = (b >= at) & (b < at + percent)
        part = F.when(hit, name) if part is None else part.when(hit, name)
        at += percent
    return df.withColumn("part", part)


def stratified_split(df: DataFrame, key: str, stratum: str, test_share: float = 0.2, seed: str = "") -> DataFrame:
    """Adds ``part``: the first rows of each stratum in hashed order are test. A stratum may hold any share of the rows."""
    order = [F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    placed = numbered(df, order, "place_", 1, [stratum])
    sizes = df.groupBy(F.col(stratum).alias("stratum_")).agg(F.round(F.count("*") * test_share).alias("tests_"))
    joined = placed.join(sizes, F.col(stratum).eqNullSafe(F.col("stratum_")))
    return joined.withColumn("part", F.when(F.col("place_") <= F.col("tests_"), "test").otherwise("train")).select(*df.columns, "part")


def shuffled(df: DataFrame, key: str, seed: str = "") -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)


def subset(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows, the first in hashed order."""
    return shuffled(df, key, seed).limit(n)


def drawn_numbers(n: Column, per: int, key, seed: str = "") -> Column:
    """``per`` different numbers from 0 to n - 1 (all, if there are no more) from the md5 of key and draw: Floyd's sampling."""
    k = F.least(n, F.lit(per).cast("long"))
    text = lambda i: F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))
    number = lambda i: F.conv(F.substring(F.md5(text(i)), 1, 15), 16, 10).cast("long")

    def draw(drawn: Column, i: Column) -> Column:
        last = n - k + i
        at = F.pmod(number(i), last + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, at), last).otherwise(at)))

    steps = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(per - 1).cast("long")), lambda i: i < k)
    return F.aggregate(steps, F.array().cast("array<long>"), draw)


def negatives(positives: DataFrame, key: str, epitope: str, chains: tuple[str, str], per: int = 5, seed: str = "") -> DataFrame:
    """key, epitope, donor, rank: for each positive ``per`` donors neither of whose chains binds its epitope; all there are, if fewer.

    Donors need both chains; a positive needs none of its own.  Donors are numbered in
    the order of their chains, so that those an epitope forbids are a few runs: one for
    each first chain that binds it, and one for each pair of chains of whose only the
    second does.  What is left is numbered through (the runs before a number tell how
    far to shift it), and a positive draws its numbers by hash, without meeting a
    donor.  Chains and epitopes may be held by any share of the rows.
    """
    a, b = chains
    donors = positives.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).alias("donor"), F.col(a).alias("a_"), F.col(b).alias("b_"))
    placed = staged(numbered(donors, ["a_", "b_", "donor"], "at_", 0), "donors")
    total = placed.count()
    binds = lambda c, name: positives.select(F.col(epitope).alias("e_"), F.col(c).alias(name)).where(F.col(name).isNotNull()).distinct()
    first, second = binds(a, "a_"), binds(b, "b_")
    run = [F.min("at_").alias("from_"), F.count("*").alias("long_")]
    by_first = first.join(placed.groupBy("a_").agg(*run), "a_").select("e_", "from_", "long_")
    by_second = second.join(placed.groupBy("a_", "b_").agg(*run), "b_").join(first, ["e_", "a_"], "left_anti").select("e_", "from_", "long_")
    runs = staged(by_first.unionByName(by_second), "runs")
    shifts = running(runs, ["from_"], {"gone_": F.col("long_")}, ["e_"]).select("e_", (F.col("from_") - F.col("gone_")).alias("place_"), F.col("long_").alias("shift_"))
    left = positives.select(F.col(epitope).alias("e_")).where("e_ is not null").distinct().join(runs.groupBy("e_").agg(F.sum("long_").alias("gone_")), "e_", "left")
    asked = positives.select(F.col(key).alias("key_"), F.col(epitope).alias("e_")).join(left.select("e_", (F.lit(total) - F.coalesce("gone_", F.lit(0))).alias("left_")), "e_")
    drawn = asked.select("key_", "e_", F.posexplode(drawn_numbers(F.col("left_"), per, F.col("key_"), seed)).alias("rank", "place_"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    events = drawn.select("key_", "e_", "rank", "place_", F.lit(0).cast("long").alias("shift_")).unionByName(shifts.select(none("key_", dict(positives.dtypes)[key]), "e_", none("rank", "int"), "place_", "shift_"))
    moved = running(events, ["place_", F.col("rank").asc_nulls_first()], {"by_": F.col("shift_")}, ["e_"]).where("rank is not null")
    found = moved.select("key_", "e_", (F.col("rank") + 1).alias("rank"), (F.col("place_") + F.col("by_")).alias("at_")).join(placed.select("at_", "donor"), "at_")
    return found.select(F.col("key_").alias(key), F.col("e_").alias(epitope), "donor", "rank")


def shortfall(positives: DataFrame, drawn: DataFrame, key: str, per: int = 5) -> DataFrame:
    """Positives that got fewer negatives than asked for."""
    n = drawn.groupBy(key).agg(F.count("*").alias("n"))
    return positives.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < per)


def permuted(df: DataFrame, key: str, column: str, seed: str = "") -> DataFrame:
    """key and the column's values, shuffled among the rows by hashed order."""
    by = lambda s: [F.md5(F.concat_ws("|", F.lit(s), F.col(key).cast("string"))), F.col(key)]
    ids, values = numbered(df.select(key), by("")), numbered(df.select(key, column), by(seed or column))
    return ids.join(values.select("at", column), "at").select(key, column)


def permuted_columns(df: DataFrame, key: str, columns: list[str], times: int = 5, seed: str = "") -> DataFrame:
    """Negatives by shuffling each column on its own, so many times over: key, time, and the columns."""
    out = None
    for i in range(times):
        rows = df.select(key)
        for c in columns:
            rows = rows.join(permuted(df, key, c, f"{seed}{i}{c}"), key)
        rows = rows.select(key, F.lit(i).alias("time"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def group_split(df: DataFrame, columns: list[str], percents: dict[str, int], seed: str = "") -> DataFrame:
    """A split in which rows that agree on the columns stay together."""
    keyed = df.withColumn("group_", joined_key(*columns))
    return split(keyed, "group_", percents, seed).drop("group_")
