"""Encoders of sequences and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoscape.functions.residues import ALPHABET, residue_vectors
from clonoscape.functions.strings import col, kmers, trim_ends

from .ordered import numbered

#: Block that a residue's vector is added to, by (length - place + 1) mod 6: the sixth-order cyclic map applied so often (fixed values).
BLOCKS = (0, 4, 2, 3, 1, 5)


def vector_map(vectors: dict[str, list[float]]) -> Column:
    return F.create_map(*[x for a, v in sorted(vectors.items()) for x in (F.lit(a), F.array(*[F.lit(float(y)) for y in v]))])


def _sum_arrays(rows: Column, dimensions: int) -> Column:
    zero = F.array_repeat(F.lit(0.0), dimensions)
    return F.aggregate(rows, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def in_block(n: Column, step: int):
    return lambda i: (n - i + 1) % 6 == step


def isometric(c, vectors: dict[str, list[float]] | None = None, trim: tuple[int, int] = (3, 2)) -> Column:
    """The isometric encoding of a sequence: six blocks, each the sum of the vectors of its residues.

    Equal to applying the cyclic map after every residue, in closed form, so it
    stays a JVM expression.  Null for letters without a vector.
    """
    vectors = vectors or residue_vectors()
    d = len(next(iter(vectors.values())))
    s = trim_ends(c, *trim) if trim != (0, 0) else col(c)
    n, lookup = F.length(s), vector_map(vectors)
    at = F.sequence(F.lit(1), n)
    parts = []
    for block in range(6):
        mine = F.filter(at, in_block(n, BLOCKS.index(block)))
        parts.append(_sum_arrays(F.transform(mine, lambda i: F.element_at(lookup, F.substring(s, i, F.lit(1)))), d))
    known = s.rlike(f"^[{''.join(sorted(vectors))}]+$")
    return F.when(known, F.concat(*parts))


def isometric_regions(c, vectors: dict[str, list[float]] | None = None, trim: tuple[int, int] = (3, 2)) -> Column:
    """The letters that ``isometric`` encodes, as bytes; null where it is null. ``isometric_vectors`` makes vectors of them."""
    s = trim_ends(c, *trim) if trim != (0, 0) else col(c)
    return F.when(s.rlike(f"^[{''.join(sorted(vectors or residue_vectors()))}]+$"), F.encode(s, "UTF-8"))


def isometric_vectors(vectors: dict[str, list[float]] | None = None):
    """A function from a series of ``isometric_regions`` to a matrix of encodings: rows of one length at once, place by place.

    A region is a tenth of its vector at most, so regions are what should travel.
    """
    vectors = vectors or residue_vectors()
    table = np.zeros((256, len(next(iter(vectors.values())))))
    for a, v in vectors.items():
        table[ord(a)] = v

    def decode(regions: pd.Series) -> np.ndarray:
        out = np.zeros((len(regions), 6, table.shape[1]))
        sizes = regions.str.len().to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            letters = np.frombuffer(b"".join(regions.iloc[at]), np.uint8).reshape(len(at), n)
            total = np.zeros((len(at), 6, table.shape[1]))
            for i in range(n):
                total[:, BLOCKS[(n - i) % 6]] += table[letters[:, i]]
            out[at] = total
        return out.reshape(len(regions), -1)

    return decode


def additive(c, vectors: dict[str, list[float]] | None = None) -> Column:
    """Sum of the residue vectors, whatever their order, without the zeros that end it."""
    vectors = vectors or residue_vectors()
    d = len(next(iter(vectors.values())))
    lookup, s = vector_map(vectors), col(c)
    rows = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.element_at(lookup, F.substring(s, i, F.lit(1))))
    total = _sum_arrays(rows, d)
    kept = F.array_max(F.transform(total, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.when(s.rlike(f"^[{''.join(sorted(vectors))}]+$"), F.slice(total, F.lit(1), kept))


def paired(*parts: Column) -> Column:
    """Features side by side: chains, genes, classes, clusters, each an array of numbers; null with a null."""
    return F.concat(*[p.cast("array<double>") for p in parts])


def one_hot(c, length: int, alphabet: str = ALPHABET) -> Column:
    """0/1 for each place up to ``length`` and each letter of the alphabet; places beyond are left out (see ``longest``).

    Letters are split off once: an expression named in a lambda is worked out anew for each element.
    """
    letters = F.split(F.rpad(F.substring(col(c), 1, length), length, "\0"), "")
    rows = F.array(*[F.array(*[F.lit(int(a == b)) for b in alphabet]) for a in ["", *alphabet]])  # none of the alphabet's letters, and each
    none = F.array(*[F.lit(None).cast("int")] * (length * len(alphabet)))
    return F.coalesce(F.flatten(F.transform(letters, lambda a: F.element_at(rows, F.call_function("locate", a, F.lit(alphabet)) + 1))), none)


def longest(df: DataFrame, *columns: str) -> dict[str, int]:
    """The length of the longest text of each column (0 without any): how many places ``one_hot`` needs to leave nothing out."""
    found = df.agg(*[F.max(F.length(c)).alias(c) for c in columns]).first()
    return {c: found[c] or 0 for c in columns}


def label_codes(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Codes from 0 in the order of the labels."""
    ranked = numbered(df.where(col(label).isNotNull()).select(label).distinct(), [label], code, 0).withColumn(code, F.col(code).cast("int"))
    return df.join(ranked, label, "left")


def first_seen_codes(df: DataFrame, label: str, order: str, code: str = "code", offset: int = 0) -> DataFrame:
    """Codes in the order in which labels first occur."""
    first = df.where(col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("at"))
    ranked = numbered(first, ["at", label], code, offset).select(label, F.col(code).cast("int").alias(code))
    return df.join(ranked, label, "left")


def category_columns(df: DataFrame, c: str, values: list) -> DataFrame:
    """A 0/1 column for each value."""
    return df.select("*", *[F.coalesce((col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in values])


def indicators(labels, classes: list) -> Column:
    """0/1 for each class, from an array of labels."""
    return F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains(col(labels), c).cast("int"))


def kmer_counts_by_row(df: DataFrame, key: str, c: str, k: int) -> DataFrame:
    """Long k-mer counts of each row."""
    return df.select(key, F.explode(kmers(c, k)).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))


def wide_totals(df: DataFrame, key: list[str], label: str, sums: list[str] = (), firsts: list[str] = (), order: str | None = None) -> DataFrame:
    """One row a key: its sorted distinct labels, the sum of some columns and the first value (by ``order``) of others."""
    first = F.min_by if order else None
    return df.groupBy(*key).agg(
        F.array_sort(F.collect_set(label)).alias("labels"), *[F.sum(c).alias(c) for c in sums], *[(first(c, order) if first else F.min(c)).alias(c) for c in firsts]
    )


def embed(df: DataFrame, fn, c: str = "cdr3", out: str = "embedding") -> DataFrame:
    """Vectors of sequences by a function from a list of texts to a list of lists, called on Arrow batches."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield b.assign(**{out: pd.Series(fn(b[c].tolist()), index=b.index, dtype=object)})

    return df.mapInPandas(run, df.selectExpr("*", f"cast(null as array<double>) as {out}").schema)
