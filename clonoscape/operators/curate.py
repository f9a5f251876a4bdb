"""Flags, filters, pairing and reshaping of chain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscape.functions.residues import ALPHABET
from clonoscape.functions.strings import col, numbers

from .ordered import numbered


# flags and filters


def alpha_cdr3_valid(gene="gene", cdr3="cdr3") -> Column:
    """0 for alpha chains that don't begin with C and end with F or W, else 1."""
    return F.when((col(gene) == "TRA") & ~F.coalesce(col(cdr3).rlike("^C.*[FW]$"), F.lit(False)), 0).otherwise(1)


def mhc_a_valid(mhc="mhc_a") -> Column:
    return F.when(F.coalesce(col(mhc).startswith("HLA-"), F.lit(False)), 1).otherwise(0)


def mhc_class_known(mhc_class="mhc_class") -> Column:
    return F.coalesce(col(mhc_class).isin("MHCI", "MHCII"), F.lit(False))


def with_validity(df: DataFrame) -> DataFrame:
    """Adds is_cdr3_alpha_valid and is_mhc_a_valid."""
    return df.withColumn("is_cdr3_alpha_valid", alpha_cdr3_valid()).withColumn("is_mhc_a_valid", mhc_a_valid())


def validity_counts(df: DataFrame) -> DataFrame:
    """Counts of rows that fail each check; a null V gene isn't counted."""
    return df.agg(
        F.count_if(alpha_cdr3_valid() == 0).alias("invalid_cdr3_alpha"),
        F.count_if((F.col("gene") == "TRA") & ~F.col("v_segm").startswith("TRAV")).alias("invalid_v_alpha"),
        F.count_if(mhc_a_valid() == 0).alias("invalid_mhc_a"),
        F.count_if(~mhc_class_known()).alias("invalid_mhc_class"),
    )


def quality_filter(df: DataFrame, not_null: list[str], flags: list[str] = (), min_score: int | None = None, score: str = "vdjdb_score", complex_id: str | None = None, equal: dict | None = None) -> DataFrame:
    """Rows whose columns aren't null, whose flags are 1, with a score and a complex, and of the given species."""
    keep = F.lit(True)
    for c in not_null:
        keep = keep & col(c).isNotNull()
    for c in flags:
        keep = keep & (col(c) == 1)
    if min_score is not None:
        keep = keep & (col(score) >= min_score)
    if complex_id:
        keep = keep & (col(complex_id) != 0)
    for c, v in (equal or {}).items():
        keep = keep & (col(c) == v)
    return df.where(keep)


def unpaired(df: DataFrame, complex_id: str = "complex_id") -> DataFrame:
    return df.where(col(complex_id) == 0)


def in_alphabet(c="cdr3") -> Column:
    return F.coalesce(col(c).rlike(f"^[{ALPHABET}]+$"), F.lit(False))


def unambiguous(c="cdr3") -> Column:
    return ~col(c).rlike(r"[*_]")


def gated_sequences(df: DataFrame, c: str = "cdr3", low: int = 10, high: int = 24) -> DataFrame:
    """Rows whose sequence has only the 20 residues and a length within bounds."""
    return df.where(in_alphabet(c) & F.length(c).between(low, high))


def gated_unique(df: DataFrame, c: str = "cdr3", gate: str = "^C.*F$", least: int = 8) -> DataFrame:
    """Distinct sequences that pass the gate and are long enough."""
    return df.where(in_alphabet(c) & col(c).rlike(gate) & (F.length(c) >= least)).select(c).distinct()


def top_values(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.where(col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def keep_top(df: DataFrame, c: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent."""
    return df.join(F.broadcast(top_values(df, c, k).select(c)), c, "left_semi")  # at most k rows


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in the columns (all, if none are named)."""
    return df.na.drop(subset=columns)


def parsed_vectors(df: DataFrame, c: str, out: str = "vector") -> DataFrame:
    """Numbers in a text as an array; rows in which there are none are dropped."""
    return df.withColumn(out, numbers(c)).where(F.size(out) > 0)


def reordered(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns only, in that order, under their new names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def copied(df: DataFrame, source: str, target: str) -> DataFrame:
    """A column's values, trimmed, in place of another's."""
    return df.withColumn(target, F.trim(source))


def pair_text(df: DataFrame, a: str, b: str, out: str = "pair") -> DataFrame:
    """Two columns as one text "a,b", without brackets and quotes."""
    bare = lambda c: F.trim(F.regexp_replace(F.col(c).cast("string"), r"""[\[\]()'"]""", ""))
    return df.withColumn(out, F.concat_ws(",", bare(a), bare(b)))


def by_number_in(df: DataFrame, c: str, place: int = 0) -> DataFrame:
    """Rows in the order of a number in a text; texts without one last, ties by the text."""
    n = F.get(numbers(c), F.lit(place))
    return df.orderBy(n.asc_nulls_last(), c)


def exploded_labels(df: DataFrame, c: str, sep: str = " ") -> DataFrame:
    """A row for each of the labels that a text holds; rows without any are dropped."""
    return df.withColumn(c, F.explode(F.split(c, sep))).where(F.col(c) != "")


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def drop_named(df: DataFrame, pattern: str = "^Unnamed") -> DataFrame:
    import re

    return df.select(*[f"`{c}`" for c in df.columns if not re.search(pattern, c)])


def fill_counts(df: DataFrame, c: str = "counts") -> DataFrame:
    """Counts that aren't numbers become 1."""
    return df.withColumn(c, F.coalesce(F.col(c).try_cast("int"), F.lit(1)))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's mean."""
    means = df.agg(*[F.avg(c).alias(f"{c} mean") for c in columns])
    return df.join(F.broadcast(means)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"{c} mean")).alias(c) if c in columns else F.col(c) for c in df.columns])  # one row


# pairing and joins


def pair_chains(df: DataFrame, order: str, key: str = "complex_id", gene: str = "gene", keep: list[str] = ("cdr3", "v_segm", "j_segm"), where: Column | None = None) -> DataFrame:
    """Each beta row with the first alpha row (by ``order``) of its complex.

    Columns: key, order, <kept>_b, <kept>_a.  Complex 0 and null mean unpaired.
    """
    rows = (df if where is None else df.where(where)).where(col(key) != 0)
    first = Window.partitionBy(key).orderBy(order)
    alpha = rows.where(col(gene) == "TRA").withColumn("at", F.row_number().over(first)).where("at = 1").select(key, *[F.col(c).alias(f"{c}_a") for c in keep])
    beta = rows.where(col(gene) == "TRB").select(key, order, *[F.col(c).alias(f"{c}_b") for c in keep])
    return beta.join(alpha, key)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Left join of a value by key; of repeated keys the last by ``order`` counts."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(value))
    return df.join(last, key, "left")


def zip_rows(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns side by side, by an explicit row id."""
    return left.join(right, row_id)


def pivot_chains(df: DataFrame, key: str, by: str, values: list[str], columns: list[str]) -> DataFrame:
    """One row a key with the columns of each chain; raises, when run, on a key with several rows of one chain."""
    once = F.when(F.count("*") <= 1, F.lit(0)).otherwise(F.raise_error(F.lit("a key has several rows of one chain")).cast("int"))
    checked = df.groupBy(key, by).agg(*[F.first(c).alias(c) for c in columns], once.alias("checked"))
    wide = checked.groupBy(key).pivot(by, values).agg(*[F.first(c).alias(c) for c in columns], F.max("checked").alias("checked"))
    wide = wide.where(" + ".join(f"coalesce(`{v}_checked`, 0)" for v in values) + " = 0")  # so that the check runs
    return wide.select(key, *[F.col(f"{v}_{c}") for v in values for c in columns])


def split_membership(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among the ids, and the others."""
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")


# aggregates


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """name, kind, nulls, null_percent, kinds (distinct values) of every column, in one pass."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(F.count("*").alias("rows"), *[x for i, c in enumerate(df.columns) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), distinct(F.col(f"`{c}`")).alias(f"d{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("nulls"), (F.col(f"n{i}") * 100.0 / F.col("rows")).alias("null_percent"), F.col(f"d{i}").alias("distinct_values")) for i, (c, k) in enumerate(df.dtypes)])
    return one.select(F.inline(rows))


def label_sets(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Sorted distinct labels of each key."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def cross_reactive(df: DataFrame, keys: list[str], label: str, more_than: int = 1) -> DataFrame:
    """Keys with more distinct labels than that."""
    return label_sets(df, keys, label).where(F.size("labels") > more_than)


def collapse_identical(df: DataFrame, keys: list[str], info: str) -> DataFrame:
    """Each distinct key with its infos and how many records it has beyond the first."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(info)).alias("infos"), (F.count("*") - 1).alias("extra"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("at = 1").drop("at")


def missing_ids(df: DataFrame, c: str, low: int, high: int) -> DataFrame:
    """Numbers of [low, high) that don't occur."""
    return df.sparkSession.range(low, high).withColumnRenamed("id", c).join(df.select(F.col(c).cast("long").alias(c)).distinct(), c, "left_anti")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; 0 for a constant column."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c} mean"), F.stddev_pop(c).alias(f"{c} dev"))])
    wide = df.join(F.broadcast(stats))  # one row
    return wide.select(*[F.when(F.col(f"{c} dev") > 0, (F.col(c) - F.col(f"{c} mean")) / F.col(f"{c} dev")).otherwise(0.0).alias(c) if c in columns else F.col(c) for c in df.columns])


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """Mean of ``value`` by row and column, the columns given."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def middle_ranked(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """The k groups of middling size, by size and name."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    ranked = numbered(sizes, ["n", group]).join(F.broadcast(sizes.agg(F.count("*").alias("all"))))  # one row
    start = F.greatest(F.floor(F.col("all") / 2) - k // 2, F.lit(0))
    return ranked.where((F.col("at") > start) & (F.col("at") <= start + k)).select(group, "n")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both sides."""
    return a.intersect(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only."""
    return a.subtract(b).unionByName(b.subtract(a))


def merge_reference(query: DataFrame, reference: DataFrame, key: list[str], cluster: str = "cluster") -> DataFrame:
    """Query clusters and every reference cluster that shares a key with one of them."""
    hit = reference.join(query.select(*key).distinct(), key, "left_semi").select(cluster).distinct()
    whole = reference.join(hit, cluster, "left_semi")
    return query.unionByName(whole.select(*query.columns)).distinct()
