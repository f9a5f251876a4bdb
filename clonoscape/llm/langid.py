"""Language identification by interpolated Kneser-Ney character models.

One model a language, of order 4 over letters (lower case; anything else is one
separator).  The n-grams of all languages lie in one sorted array of hashes per
order, beside the finished interpolated log-probabilities of every language and
the back-off weights, so a text is scored by binary searches.  The language
with the lowest cross-entropy per symbol wins; a text is rejected when that
cross-entropy is far above what held-back texts of the language have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, table
from .textbatch import U64, slices

ORDER = 4
#: Documented bounds of the training sample: documents a language for the model and for the calibration, each read whole.
MODEL_DOCS, CALIBRATION_DOCS = 400, 200
#: Characters counted or scored at once when fitting (a longer text by itself).
PIECE = 1_000_000
#: Rejected when the cross-entropy is above the language's calibrated limit by this many deviations of so short a text.
REJECT_Z = 6.0
#: The calibrated limit is the largest excess over the mean among held-back texts, widened by this factor, and at least one nat.
WIDEN, LEAST_EXCESS = 1.25, 1.0
DISCOUNT = 0.75
_COEF = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U64)

_symbol: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Symbol of each code point: its lower-case letter, 0 for anything that isn't a letter."""
    if not _symbol:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _symbol.append(out)
    return _symbol[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and the three before each (0 before the start), their document, and whether documents have a letter."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    s = symbols()[points]
    first = np.zeros(len(s), bool)
    first[np.concatenate([[0], np.cumsum(size)[:-1]])] = True
    before = np.concatenate([[0], s[:-1]])
    before[first] = 0
    keep = (s != 0) | (before != 0)  # runs of separators become one; none leads a text
    s, doc = s[keep], doc[keep]
    rank = np.arange(len(s)) - np.searchsorted(doc, np.arange(len(texts)))[doc] if len(s) else np.zeros(0, np.int64)
    x = np.zeros((ORDER, len(s)), U64)
    x[0] = s
    for j in range(1, ORDER):
        x[j, j:] = s[:-j]
        x[j][rank < j] = 0
    letters = np.bincount(doc[s != 0], minlength=len(texts)) > 0
    return x, doc, letters


def keys(x: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Hashes of the n symbols that end ``skip`` symbols back; the order is part of the hash."""
    out = np.full(x.shape[1], U64(n * 0xA24BAED4963EE407 % 2**64))
    for j in range(n):
        out += (x[j + skip] + U64(1)) * _COEF[j]
    return out


@dataclass
class Table:
    """A sorted hash array with a row of values (one a language) for each hash."""

    hashes: np.ndarray
    values: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at[self.hashes[at] != h] = -1
        return at


@dataclass
class Models:
    langs: list[str]
    prob: list[Table] = field(default_factory=list)  # by order - 1: log-probabilities of the last symbol
    backoff: list[Table] = field(default_factory=list)  # by context length - 1: log of the weight of the shorter context
    floor: np.ndarray | None = None  # of a symbol never seen
    mean: np.ndarray | None = None
    dev: np.ndarray | None = None
    limit: np.ndarray | None = None

    def of_symbols(self, x: np.ndarray) -> np.ndarray:
        """Log-probability (symbol, language) of each symbol after the three before it, the columns of x."""
        value = np.zeros((x.shape[1], len(self.langs)), np.float32)
        rest = np.arange(x.shape[1])  # symbols whose n-gram isn't found yet, with the weights so far in value
        for n in range(ORDER, 0, -1):
            part = x[:, rest]
            at = self.prob[n - 1].find(keys(part, n))
            hit = at >= 0
            value[rest[hit]] += self.prob[n - 1].values[at[hit]]
            rest, part = rest[~hit], part[:, ~hit]
            if not len(rest):
                break
            if n > 1:
                at = self.backoff[n - 2].find(keys(part, n - 1, skip=1))
                hit = at >= 0
                value[rest[hit]] += self.backoff[n - 2].values[at[hit]]
            else:
                value[rest] += self.floor
        return value

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability (document, language), symbols of each document, whether it has a letter."""
        x, doc, letters = ngrams(texts)
        value = self.of_symbols(x)
        size = np.bincount(doc, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(size)
        if len(some):
            total[some] = np.add.reduceat(value.astype(np.float64), np.searchsorted(doc, some), axis=0)
        return total, size, letters


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different columns of symbols, as rows, and the count of each; told apart by their hashes."""
    _, first, count = np.unique(keys(x, len(x)), return_index=True, return_counts=True)
    return np.ascontiguousarray(x[:, first].T), count


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of up to about PIECE characters."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > PIECE:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of the highest order and the count of each."""
    parts = [distinct(ngrams(run)[0][:ORDER]) for run in pieces(texts)]
    rows, count = np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])
    _, first, at = np.unique(keys(rows.T, ORDER), return_index=True, return_inverse=True)
    return np.ascontiguousarray(rows[first]), np.bincount(at, count, len(first)).astype(np.int64)


def fit_models(texts: dict[str, list[str]]) -> Models:
    """Interpolated Kneser-Ney of order 4 for each language."""
    langs = sorted(texts)
    m = Models(langs)
    per: list[dict] = []
    for lang in langs:
        levels = {ORDER: counted(texts[lang])}  # per order: unique n-grams (rows of symbols), counts
        for n in range(ORDER - 1, 0, -1):  # lower orders count the different symbols before
            levels[n] = distinct(levels[n + 1][0][:, :n].T)
        per.append(levels)
    alphabet = max(2, len(np.unique(np.concatenate([p[1][0][:, 0] for p in per]))) + 1)
    m.floor = np.zeros(len(langs), np.float32)
    lower: list = [None] * len(langs)  # log-probabilities found so far are looked up in the merged tables
    for n in range(1, ORDER + 1):
        all_rows, _ = distinct(np.concatenate([p[n][0] for p in per]).T)
        h = keys(all_rows.T, n)
        order = np.argsort(h)
        all_rows, h = all_rows[order], h[order]
        prob = np.zeros((len(h), len(langs)))
        if n > 1:
            ch = np.unique(keys(all_rows[:, 1:].T, n - 1))
            back = np.zeros((len(ch), len(langs)))
        for k in range(len(langs)):
            rows, count = per[k][n]
            if n == 1:
                total = max(1, count.sum())
                p0 = DISCOUNT * max(1, len(count)) / total / alphabet if len(count) else 1 / alphabet
                seen = np.zeros(len(h))
                seen[np.searchsorted(h, keys(rows.T, 1))] = np.maximum(count - DISCOUNT, 0) / total
                prob[:, k] = seen + p0
                m.floor[k] = np.log(p0)
                continue
            own = keys(rows[:, 1:].T, n - 1) if len(rows) else np.zeros(0, U64)
            at = np.searchsorted(ch, own)
            total = np.bincount(at, count, minlength=len(ch))
            kinds = np.bincount(at, minlength=len(ch))
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            back[:, k] = weight
            seen = np.zeros(len(h))
            seen[np.searchsorted(h, keys(rows.T, n))] = np.maximum(count - DISCOUNT, 0) / np.maximum(total[at], 1)
            inside = np.searchsorted(ch, keys(all_rows[:, 1:].T, n - 1))
            prob[:, k] = seen + weight[inside] * lower[k](all_rows[:, : n - 1])
        m.prob.append(Table(h, np.log(prob).astype(np.float32)))
        if n > 1:
            m.backoff.append(Table(ch, np.log(back).astype(np.float32)))
        for k in range(len(langs)):
            lower[k] = lambda rows, k=k, h=h, prob=prob, n=n: prob[np.searchsorted(h, keys(rows.T, n)), k]  # every suffix of an n-gram is in the order below
    return m


def calibrate(m: Models, texts: dict[str, list[str]]) -> None:
    """Of each language's held-back texts: mean cross-entropy, its deviation scaled by the root of the length, and the largest excess."""
    m.mean, m.dev, m.limit = np.zeros(len(m.langs)), np.ones(len(m.langs)), np.full(len(m.langs), LEAST_EXCESS)
    for k, lang in enumerate(m.langs):
        total, size = (np.concatenate(x) for x in zip(*(m.score(run)[:2] for run in pieces(texts.get(lang) or [""])), strict=True))
        ok = size > 0
        if ok.sum() >= 5:
            entropy = -total[ok, k] / size[ok]
            m.mean[k] = np.median(entropy)
            z = np.sort(np.abs(entropy - m.mean[k]) * np.sqrt(np.minimum(size[ok], 400)))
            m.dev[k] = max(1.0, z[int(0.9 * (len(z) - 1))] / 1.645)  # robust against odd texts in the sample
            m.limit[k] = max(LEAST_EXCESS, WIDEN * float((entropy - m.mean[k]).max()))
        else:
            m.mean[k], m.dev[k] = 2.5, 10.0


def identify(m: Models, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score in 0..1 and rejection of each text; without letters ``und``, 0 and rejected.

    The score, not the language, takes a text for at most 60 symbols long, as
    evidence of neighbouring symbols isn't independent and would soon read 1.
    """
    total, size, letters = m.score([t or "" for t in texts])
    entropy = -total / np.maximum(size, 1)[:, None]
    best = entropy.argmin(axis=1)
    gap = entropy - entropy[np.arange(len(best)), best][:, None]
    score = 1 / np.exp(-np.minimum(gap * np.minimum(size, 60)[:, None], 50)).sum(axis=1)
    excess = entropy[np.arange(len(best)), best] - m.mean[best]
    rejected = ~letters | (excess > m.limit[best] + REJECT_Z * m.dev[best] / np.sqrt(np.maximum(size, 1)))
    return [m.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0), rejected


def sample(docs: DataFrame, training: Column) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Bounded samples for the model and its calibration: the first documents of each language by a hash of the id.

    Texts are taken whole, however long.
    """
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(5)).alias("h")
    fit = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", h)
    n = MODEL_DOCS + CALIBRATION_DOCS
    by, part = Window.partitionBy("lang").orderBy("h", "doc_id"), Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    few = fit.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n).drop("rank")  # so that a common language isn't ranked in one task
    chosen = few.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).groupBy("lang", "doc_id").agg(F.min("rank").alias("rank"))
    keyed = docs.where(training).select("lang", "doc_id", "text")
    chosen = chosen.select(F.col("lang").alias("of"), F.col("doc_id").alias("id"), "rank")
    rows = keyed.join(F.broadcast(chosen), (keyed["lang"] == chosen["of"]) & keyed["doc_id"].eqNullSafe(chosen["id"])).groupBy("lang", "doc_id").agg(F.min("rank").alias("rank"), F.min("text").alias("text")).collect()  # at most n rows a language
    model: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        (model if r["rank"] <= MODEL_DOCS else held).setdefault(r["lang"], []).append(r["text"])
    return model, held


def train(docs: DataFrame, training: Column) -> Models:
    """Models of the languages seen among the training rows (documented bounds above); with none, every text is ``und``."""
    model, held = sample(docs, training)
    m = fit_models(model) if model else Models(["und"], [Table(np.zeros(0, U64), np.zeros((0, 1), np.float32))] * ORDER, [Table(np.zeros(0, U64), np.zeros((0, 1), np.float32))] * (ORDER - 1), np.zeros(1, np.float32))
    calibrate(m, {k: held.get(k) or model[k] for k in model})
    return m


def predict_language(docs: DataFrame, m: Models, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, rejected of every whole text.

    Null texts and texts without a letter are ``und`` with score 0 and rejected;
    between languages of equal cross-entropy the first by name wins; repeated
    rows are predicted each; an empty table gives no rows.  Very long texts are
    scored whole, in about 50 bytes of memory a character.  Other columns, whatever
    their names, are not read.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(m)  # bounded by the training sample
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches, "text_", most_bytes=1 << 19):
            lang, score, rejected = identify(m, b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, rejected boolean"
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text_")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, m: Models) -> DataFrame:
    """The documents that identification doesn't reject, with all their columns.

    Null and empty texts and texts without a letter are rejected; repeated rows
    are kept or dropped alike; an empty table stays empty.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(m), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", most_bytes=1 << 19):
            yield b.filter(pa.array(~identify(sent.value, b.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)


def op5_kneser_ney_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = predict_language(docs, train(docs, fold(F.col("doc_id"), 4) != 2))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
