"""Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import col


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def mean(a) -> Column:
    return _sum(F.transform(col(a), lambda x: x.cast("double"))) / F.size(col(a))


def correlation(a, b) -> Column:
    """Pearson correlation of two arrays; null if either is constant."""
    centre = lambda x: F.transform(col(x), lambda v: v.cast("double") - mean(x))
    x, y = centre(a), centre(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def correlation_distance(a, b) -> Column:
    return F.sqrt(F.greatest(1.0 - correlation(a, b), F.lit(0.0)))


def cosine_distance(a, b) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1.0 - dot(a, b) / norm)


def midpoint(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: (x + y) / 2.0)


def masked_mean(rows, begin: Column, n: Column) -> Column:
    """Column means of ``n`` rows of an array of arrays from ``begin`` (1-based)."""
    part = F.slice(col(rows), begin, n)
    zero = F.transform(part[0], lambda x: x * 0.0)
    return F.transform(F.aggregate(part, zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y)), lambda x: x / n)


def pooled(rows) -> Column:
    """First row, column maxima, column means, and column sums over sqrt(n), joined."""
    r = col(rows)
    n = F.size(r).cast("double")
    total = F.aggregate(r, F.transform(r[0], lambda x: x * 0.0), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    most = F.aggregate(r, r[0], lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y)))
    return F.concat(r[0], most, F.transform(total, lambda x: x / n), F.transform(total, lambda x: x / F.sqrt(n)))
