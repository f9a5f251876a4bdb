"""Column expressions over sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def starts_or_ends(c, prefix: str = "", suffixes: tuple[str, ...] = ()) -> Column:
    """Begins with ``prefix`` and ends with one of ``suffixes``."""
    out = col(c).startswith(prefix)
    if suffixes:
        end = F.lit(False)
        for s in suffixes:
            end = end | col(c).endswith(s)
        out = out & end
    return out


def spaced(c) -> Column:
    """Characters separated by spaces."""
    return F.array_join(F.filter(F.split(col(c), ""), lambda x: x != ""), " ")


def mask_rare(c, rare: str = "UZOB", mask: str = "X") -> Column:
    """Rare residues replaced by the mask."""
    return F.translate(col(c), rare, mask * len(rare))


def trim_ends(c, left: int = 3, right: int | None = None) -> Column:
    """Without ``left`` residues in front and ``right`` behind; empty if nothing is left."""
    right = left if right is None else right
    return F.substring(col(c), F.lit(left + 1), F.greatest(F.length(col(c)) - left - right, F.lit(0)))


def middle(c, width: int = 6) -> Column:
    """The middle ``width`` residues; null for shorter sequences."""
    at = F.floor(F.length(col(c)) / 2).cast("int") - (width // 2 - 1)
    return F.when(F.length(col(c)) >= width, F.substring(col(c), at, F.lit(width)))


def crop_around(c, motif, context: int) -> Column:
    """The first occurrence of ``motif`` with up to ``context`` residues on both sides; null if absent."""
    at = F.instr(col(c), col(motif))
    begin = F.greatest(at - context, F.lit(1))
    return F.when(at > 0, F.substring(col(c), begin, at - begin + F.length(col(motif)) + context))


def kmers(c, k: int) -> Column:
    """Overlapping k-mers in order; empty for shorter sequences."""
    n = F.length(col(c)) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(col(c), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def dotted(place: int):
    """A function that puts a dot at one place."""
    return lambda m: F.overlay(m, F.lit("."), F.lit(place))


def masked_kmers(c, k: int) -> Column:
    """k-mers with each inner position in turn replaced by a dot."""
    masks = [F.transform(kmers(c, k), dotted(j)) for j in range(2, k)]
    return F.flatten(F.array(*masks)) if masks else F.array().cast("array<string>")


def wildcards(c, places: Column | None = None, pattern: str = "*") -> Column:
    """The sequence with each position (of ``places``, from 1, if given) in turn replaced: equal patterns mean one substitution at most."""
    every = F.sequence(F.lit(1), F.length(col(c))) if places is None else places
    return F.transform(every, lambda i: F.overlay(col(c), F.lit(pattern), i))


def hamming(a, b) -> Column:
    """Differing positions; null for sequences of unequal length."""
    a, b = col(a), col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def contact_distance(a, b, trim: int = 3) -> Column:
    """Hamming distance of the trimmed upper-case letters, over their common length; 0 if nothing can be aligned."""
    letters = lambda c: F.regexp_replace(F.upper(trim_ends(c, trim)), "[^A-Z]", "")
    x, y = letters(a), letters(b)
    n = F.least(F.length(x), F.length(y))
    return F.coalesce(hamming(F.substring(x, F.lit(1), n), F.substring(y, F.lit(1), n)), F.lit(0))


def truncate(c, digits: int = 3) -> Column:
    """Cut, not rounded, after so many digits."""
    return F.floor(col(c) * float(10**digits)) / float(10**digits)


def numbers(c) -> Column:
    """All numbers in a text as an array of doubles."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"([-+]?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?)"), 1), lambda x: x.cast("double"))


def joined_key(*cols, sep: str = "__") -> Column:
    """A key of several columns."""
    return F.concat_ws(sep, *[col(c) for c in cols])


def ln_factorial(n) -> Column:
    """ln(n!) of a whole number of any size: Stirling's series of n + 9, less the logarithms up to there."""
    z = col(n).cast("double") + 1
    up = z + 8
    product = z
    for i in range(1, 8):
        product = product * (z + i)
    w = 1 / (up * up)
    series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / up  # Bernoulli numbers over 2k(2k - 1)
    return F.when(col(n) < 2, F.lit(0.0)).otherwise((up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - F.ln(product))


def ln_choose(n, k) -> Column:
    """ln of the binomial coefficient; null where k is outside 0..n."""
    n, k = col(n), col(k)
    return F.when((k >= 0) & (k <= n), ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k))


def normal_tail(z) -> Column:
    """Upper tail of the standard normal distribution: a power series near 0, a continued fraction beyond 3."""
    z = col(z).cast("double")
    x = F.abs(z)
    terms = F.sequence(F.lit(1), F.lit(40))
    step = lambda s, i: F.struct((s["term"] * x * x / (2 * i + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * i + 1)).alias("sum"))
    near = 0.5 - F.aggregate(terms, F.struct(x.alias("term"), x.alias("sum")), step, lambda s: s["sum"]) * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    far = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda s, i: x + i / s)
    tail = F.when(x < 3, near).otherwise(far)
    return F.when(z >= 0, tail).otherwise(1 - tail)
