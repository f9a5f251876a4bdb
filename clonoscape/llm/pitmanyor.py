"""Language-model scores from a hierarchical Pitman-Yor process.

Three levels: a restaurant for each context (the previous word), one restaurant
of single words that is the parent they share, and a uniform base over the
vocabulary and one unknown word.  The customers of a context restaurant are the
training bigrams; each of its tables sends one customer to the parent.  Seating
is sampled by Gibbs sweeps.  A sweep reseats all customers of every bigram type,
then all customers of every word at the parent, from the distribution of their
number of tables given the others; that number is all that scores need.  Scores
average the predictive probabilities of several sampled seatings.

Distribution.  Texts are tokenised once, into chunks: the sorted words of a
bounded number of tokens, and their order.  Three kinds of groups exchange packed
columns of integers, and all of them hold a bounded share of the corpus:

* a chunk asks for its distinct words and bigrams, each once, so that a word or
  pair that fills a third of the corpus is one entry of each chunk;
* a shard of words numbers them and holds their counts, the tables and customers
  of their context restaurants, and their seats at the parent;
* a bucket of bigrams (by hash) holds the seats of those with more than one
  customer; one customer has one table.

Shards and buckets grow in number with the bytes of text, never with the settings
of the session, and random numbers hang on a bigram's or word's number and the
sweep, so that scores are the same on any cluster.  Within a sweep the totals of
the one before stand still, as usual when Gibbs sampling is distributed.  The
driver holds one number for each shard, and sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, fold, shares, staged, table
from .textbatch import U64, buffers, mix, slices, words

#: Sweeps before the first sample, samples, and sweeps for each of them.
SWEEPS = (6, 3, 2)
THETA_CONTEXT, THETA_ROOT = 1.0, 1.0
#: Tokens after which a chunk ends (with its document), and bytes of text that are hashed at once.
CHUNK_TOKENS, SLICE = 800_000, 1 << 20
#: Bytes of text for each shard of words and each bucket of bigrams.
SHARE = 16 << 20
#: Up to so many customers the number of tables is drawn exactly, above that by so many Metropolis steps.
EXACT, MOVES = 512, 20
END, START = U64(0x0E4D0E4D0E4D0E4D), U64(0x57A257A257A257A2)
LOW = U64(0xFFFFFFFF)

#: Rows that are exchanged: a kind, the group they go to, the one they come from, packed columns, and numbers to sum.
ROWS = "kind int, key long, other long, v binary, a long, b long, c long, d long"
CHUNK, WORDS, NUMBERS, ANSWER, BIGRAMS, SEATS, SINGLE, TABLES = range(8)
Row = tuple[int, int, int, bytes, int, int, int, int]


# packed columns


@lru_cache(1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers: all lowest bytes, then the next ones, as few as are needed, compressed."""
    out = [bytes([len(columns)])]
    for x in columns:
        top = int(x.max()) if len(x) else 0
        width = next(w for w in (1, 2, 4, 8) if top >> (8 * w) == 0)
        out += [bytes([width]), len(x).to_bytes(8, "little"), np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()]
    return _zstd()[0].compress(b"".join(out))


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The columns again, as 64-bit integers (words' hashes unsigned)."""
    raw = _zstd()[1].decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        at += 9
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(f"<u{width}")[:, 0] if n else np.zeros(0, np.uint8)
        out.append(x.astype(U64 if width == 8 else np.int64))
        at += width * n
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    """A rising column by its differences."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def rows_of(t: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(other, v) of the rows of one kind, in order."""
    t = t.filter(pc.equal(t.column("kind"), kind))
    return sorted(zip(t.column("other").to_pylist(), t.column("v").to_pylist(), strict=True))


def arrow_rows(rows: list[Row]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    columns = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in ROWS.split(", ")])


def exchanged(frame: DataFrame, group: Callable[[int, pa.Table], Iterator[Row]]) -> DataFrame:
    """The rows that each group makes of those that were sent to it."""

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([arrow_rows(list(group(t.column("key")[0].as_py(), t)))])

    return frame.select("kind", "key", "other", "v").groupBy("key").applyInArrow(run, ROWS)


def summed(frame: DataFrame, name: str) -> tuple[DataFrame, list[int]]:
    """The frame, staged, and the sums of its numbers."""
    seen = Observation()
    out = staged(frame.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcd"]), name)
    return out, [int(seen.get[c]) for c in "abcd"]


# chunks


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and how many tokens each text has."""
    w = words(*buffers(texts))
    size = np.diff(w.first) + 1
    ends = np.cumsum(size) - 1
    out = np.empty(int(size.sum()), U64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = w.hashes
    out[ends] = END
    return out, size


def chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk of id_, text_, train_: its documents, its sorted words and its tokens by place among them."""

    def blob(held: list) -> bytes:
        word, size, ids, null, train = (np.concatenate(x) for x in zip(*held, strict=True))
        names, place = np.unique(np.append(word, START), return_inverse=True)
        return packed(names, place, size, ids.view(U64), null, train)  # the last place is that of the start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches, "text_", SLICE):
            word, size = tokens(b.column(1))
            ids, train = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            held.append((word, size, ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), train))
            n += len(word)
            if n >= CHUNK_TOKENS:
                yield arrow_rows([(CHUNK, at, 0, blob(held), 0, 0, 0, 0)])
                at, held, n = at + 1, [], 0
        if held:
            yield arrow_rows([(CHUNK, at, 0, blob(held), 0, 0, 0, 0)])

    return docs.select("id_", "text_", "train_").mapInArrow(run, ROWS)


class Chunk:
    def __init__(self, blob: bytes):
        self.names, place, self.size, ids, null, train = unpacked(blob)
        self.names = self.names.astype(U64)
        self.ids, self.null, self.train = ids.view(np.int64), null.astype(bool), train.astype(bool)
        self.word = place[:-1]
        self.first = np.cumsum(self.size) - self.size
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.first] = place[-1]
        self.learnt = np.repeat(self.train, self.size)

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of words by shard, and where each shard begins in it."""
        shard = (self.names % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def bigrams(self, numbers: list[tuple[int, bytes]], at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams by bucket: their keys, where each bucket begins, the local (context, word) of each; and the bigram of each token."""
        order, _ = self.by_shard(len(at) - 1)
        number = np.empty(len(order), np.int64)
        number[order] = np.concatenate([at[s] + np.cumsum(unpacked(v)[0]) for s, v in numbers])
        local, place = np.unique(self.context.astype(U64) << U64(32) | self.word.astype(U64), return_inverse=True)
        pair = np.stack([(local >> U64(32)).astype(np.int64), (local & LOW).astype(np.int64)])
        key = number[pair[0]].astype(U64) << U64(32) | number[pair[1]].astype(U64)
        bucket = (mix(key) % U64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return key[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), pair[:, order], rank[place]


# seats


def gammaln(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * z * z)) / (z * z)) / z - np.log(low)


@lru_cache(4)
def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [customers, tables] up to ``most``."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + s[c, 1:], -np.inf)
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay)
    return s


def seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers for many customers, less what depends on c alone.

    The number is c! / (t! d**t) times the chance that t Sibuya variables sum to
    c.  For few tables that chance is its alternating series, which then cancels
    little; for more, where many tables share the customers, its saddle point.
    """
    c, t = c.astype(float), t.astype(float)
    spread = np.exp((np.log(t) - d * np.log(c)) / (1 - d))
    out = np.empty(len(c))
    few = (1 - d) * spread <= 12
    for i in np.array_split(np.flatnonzero(few), max(1, few.sum() // 256)):
        if not len(i):
            continue
        k = np.arange(1, int(min(t[i].max(), 60 + 5 * spread[i].max())) + 1)[:, None]
        ci, ti = c[i], t[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            size = np.where(k <= ti, gammaln(ti + 1) - gammaln(k + 1.0) - gammaln(np.maximum(ti - k, 0) + 1) + gammaln(1 + k * d) + gammaln(np.maximum(ci - k * d, 0.5)) - gammaln(ci + 1), -np.inf)
            most = size.max(axis=0)
            total = (np.where(k % 2 == 1, 1, -1) * np.sin(np.pi * k * d) * np.exp(size - most)).sum(axis=0) / np.pi
            out[i] = np.log(np.maximum(total, 1e-300)) + most
    i = np.flatnonzero(~few)
    if len(i):
        ci, ti = c[i], t[i]
        low, high = np.full(len(i), np.log(1e-9)), np.full(len(i), np.log(600.0))
        slope = lambda y: -np.expm1(y) * d * np.exp((d - 1) * y) / -np.expm1(d * y)  # noqa: E731  mean of a table, y = log(1 - x)
        for _ in range(50):
            mid = (low + high) / 2
            over = slope(-np.exp(mid)) > ci / ti
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        y = -np.exp((low + high) / 2)
        x, m = -np.expm1(y), slope(y)
        variance = ti * (m + x * (1 - d) * np.exp(-y) * m - m * m)
        out[i] = ti * np.log(-np.expm1(d * y)) - ci * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(variance, 1e-9))
    return np.where(t == c, t * np.log(d), out) - gammaln(t + 1) - t * np.log(d)


def uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each key and draw."""
    return ((mix(mix(key.astype(U64) + U64(1)) + U64(draw * 0x9E3779B97F4A7C15 % 2**64)) >> U64(12)).astype(float) + 0.5) * 2.0**-52


def moved(c: np.ndarray, tables: np.ndarray, theta: np.ndarray, p: np.ndarray, d: float, key: np.ndarray, draw: int) -> np.ndarray:
    """Tables of many customers after MOVES Metropolis steps, each of which proposes a seating of all at another number of tables."""
    weight = lambda t: t * np.log(p) + t * np.log(d) + gammaln(theta / d + t) - gammaln(theta / d) + seatings(c, t, d)
    t = np.clip(tables, 1, c).astype(np.int64)
    scale = 1 + 2 * np.sqrt(np.minimum(1 + theta / d * p / np.maximum(1 - p, 1e-3), c / 4))
    now = weight(t)
    for k in range(draw + 1, draw + 1 + 3 * MOVES, 3):
        normal = np.sqrt(-2 * np.log(uniform(key, k))) * np.cos(2 * np.pi * uniform(key, k + 1))
        new = t + np.rint(scale * normal).astype(np.int64)
        fits = (new >= 1) & (new <= c)
        then = weight(np.where(fits, new, t))
        take = fits & (np.log(uniform(key, k + 2)) < then - now)
        t, now = np.where(take, new, t), np.where(take, then, now)
    return t


def reseat(c: np.ndarray, theta: np.ndarray, p: np.ndarray, d: float, key: np.ndarray, sweep: int, tables: np.ndarray | None = None) -> np.ndarray:
    """Tables of c customers each after all of them left and sat down again.

    The weight of t tables is p ** t * prod(theta + d * j for j < t) times the
    seatings of c customers at t tables, where theta counts the other tables of
    the restaurant and p is the parent's probability.  ``tables`` are those
    before, from which the Metropolis steps of many customers start.
    """
    out = np.minimum(c, 1).astype(np.int64)
    theta, p = np.broadcast_to(theta, c.shape).astype(float), np.broadcast_to(p, c.shape).astype(float)
    draw = sweep * (3 * MOVES + 1)
    exact = np.flatnonzero((c > 1) & (c <= EXACT))
    if len(exact):
        known = stirling(d, EXACT)
        exact = exact[np.argsort(c[exact], kind="stable")]
        u = uniform(key[exact], draw)
        sizes, first = np.unique(c[exact], return_index=True)
        for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(exact)], strict=True):
            much = max(1, 1_000_000 // size)
            for at in range(a, b, much):
                i = exact[at : min(b, at + much)]
                if size == 2:  # one table, or two
                    out[i] = 1 + (u[at : at + len(i)] * (1 - d + (theta[i] + d) * p[i]) >= 1 - d)
                    continue
                w = np.cumsum(np.log((theta[i, None] + d * np.arange(size)) * p[i, None]), axis=1) + known[size, 1 : size + 1]
                w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                out[i] = 1 + np.minimum((w < u[at : at + len(i), None] * w[:, -1:]).sum(axis=1), size - 1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        out[large] = moved(c[large].astype(np.int64), out[large] if tables is None else tables[large], theta[large], p[large], d, key[large], draw)
    return out


@dataclass(frozen=True)
class Model:
    """What the driver knows: sums and where each shard's words begin."""

    at: np.ndarray  # first number of each shard's words
    buckets: int
    n: int  # training tokens
    vocabulary: int
    discount: float = 0.5  # of contexts
    discount_root: float = 0.5
    roots: tuple[tuple[int, int], ...] = ()  # customers and tables of the parent, after each sweep
    sweeps: tuple[int, int, int] = SWEEPS

    def is_sample(self, sweep: int) -> bool:
        burn_in, _, apart = self.sweeps
        return sweep > burn_in and (sweep - burn_in) % apart == 0

    def parent(self, customers: np.ndarray, tables: np.ndarray, root: tuple[int, int]) -> np.ndarray:
        """Probability of words at the parent."""
        return (np.maximum(customers - self.discount_root * tables, 0) + (THETA_ROOT + self.discount_root * root[1]) / (self.vocabulary + 1)) / (THETA_ROOT + root[0])


def by_number(m: Model, kind: int, own: int, context: tuple, word: tuple) -> Iterator[Row]:
    """Columns of contexts and of words, each led by their rising numbers, cut by shard."""
    cuts = [np.searchsorted(x[0], m.at) for x in (context, word)]
    for s in range(len(m.at) - 1):
        parts = [[x[a:b] for x in xs] for xs, c in zip((context, word), cuts, strict=True) for a, b in [(c[s], c[s + 1])]]
        if any(len(p[0]) for p in parts):
            yield kind, s, own, packed(*[y for numbers, *rest in parts for y in (steps(numbers - m.at[s]), *rest)]), 0, 0, 0, 0


def sums_by(numbers: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and the sum of the values of each."""
    names, place = np.unique(numbers, return_inverse=True)
    return names, np.bincount(place, values, minlength=len(names)).astype(np.int64)


def numbered(store: DataFrame, shards: int) -> tuple[DataFrame, np.ndarray, int, int]:
    """WORDS of each shard (counts as word and as context) and NUMBERS of each chunk's words; first numbers, training tokens, vocabulary."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Chunk(v)
                order, cuts = c.by_shard(shards)
                seen = [np.bincount(x[c.learnt], minlength=len(order))[order] for x in (c.word, c.context)]
                hashes = c.names[order]
                yield arrow_rows([(WORDS, s, key, packed(hashes[a:b], *[x[a:b] for x in seen]), 0, 0, 0, 0) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

    def count(shard: int, t: pa.Table) -> Iterator[Row]:
        asked = rows_of(t, WORDS)
        parts = [unpacked(v) for _, v in asked]
        names, place = np.unique(np.concatenate([p[0].astype(U64) for p in parts]), return_inverse=True)
        word, context = (np.bincount(place, np.concatenate([p[k] for p in parts]), minlength=len(names)).astype(np.int64) for k in (1, 2))
        yield WORDS, shard, 0, packed(word, context), int(word.sum()), int((word > 0).sum()), len(names), 0
        at = 0
        for (chunk, _), p in zip(asked, parts, strict=True):
            yield NUMBERS, chunk, shard, packed(steps(place[at : at + len(p[0])])), 0, 0, 0, 0
            at += len(p[0])

    frame, (n, vocabulary, _, _) = summed(exchanged(store.select("key", "v").mapInArrow(ask, ROWS), count), "words")
    size = np.zeros(shards, np.int64)
    for r in frame.where(f"kind = {WORDS}").select("key", "c").collect():  # a number for each shard
        size[r["key"]] = r["c"]
    at = np.concatenate([[0], np.cumsum(size)])
    if at[-1] > 1 << 32:
        raise OverflowError(f"{at[-1]} distinct words; numbers of words have 32 bits")
    return frame, at, n, vocabulary


def counted(store: DataFrame, frame: DataFrame, m: Model) -> tuple[DataFrame, list[int]]:
    """SEATS of each bucket, its BIGRAMS of each chunk, and for shards the SINGLE tables and the first other TABLES; bigrams once and twice seen."""

    def ask(chunk: int, t: pa.Table) -> Iterator[Row]:
        c = Chunk(rows_of(t, CHUNK)[0][1])
        key, cuts, _, place = c.bigrams(rows_of(t, NUMBERS), m.at, m.buckets)
        seen = np.bincount(place[c.learnt], minlength=len(key))
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if y > x:
                yield BIGRAMS, b, chunk, packed(steps(key[x:y]), seen[x:y]), 0, 0, 0, 0

    def count(bucket: int, t: pa.Table) -> Iterator[Row]:
        asked = rows_of(t, BIGRAMS)
        parts = [unpacked(v) for _, v in asked]
        keys = [np.cumsum(p[0].astype(U64), dtype=U64) for p in parts]
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(key)).astype(np.int64)
        code = np.minimum(seen, 2)
        many = np.flatnonzero(code == 2)
        index = np.cumsum(code == 2) - 1
        at = 0
        for (chunk, _), k in zip(asked, keys, strict=True):
            mine = place[at : at + len(k)]
            yield BIGRAMS, bucket, chunk, packed(code[mine], steps(index[mine[code[mine] == 2]])), 0, 0, 0, 0
            at += len(k)
        one = seen == 1
        yield SEATS, bucket, 0, packed(steps(key[many]), seen[many], np.ones(len(many), np.int64), np.zeros(len(many), np.int64)), int(one.sum()), int((seen == 2).sum()), 0, 0
        for kind, which in ((SINGLE, one), (TABLES, many)):
            ones = np.ones(len(key[which]), np.int64)
            yield from by_number(m, kind, bucket, sums_by((key[which] >> U64(32)).astype(np.int64), ones), sums_by((key[which] & LOW).astype(np.int64), ones))

    both = store.unionByName(frame.where(f"kind = {NUMBERS}"))
    return summed(exchanged(exchanged(both, ask), count), "bigrams")


def shard_pass(m: Model, sweep: int) -> Callable[[int, pa.Table], Iterator[Row]]:
    """Sums the tables of a shard's words and contexts, reseats the words at the parent, and answers the buckets that sent them.

    WORDS holds word and context counts, single tables by context and by word,
    tables at the parent; then context tables, customers and tables at the parent
    of each sample.
    """

    def run(shard: int, t: pa.Table) -> Iterator[Row]:
        held = unpacked(rows_of(t, WORDS)[0][1])
        n = len(held[0])
        if sweep == 0:
            held += [np.zeros(n, np.int64) for _ in range(3)]
            for _, v in rows_of(t, SINGLE):
                x = unpacked(v)
                for k in (0, 1):
                    held[2 + k][np.cumsum(x[2 * k])] += x[2 * k + 1]
        context, word = held[2].astype(np.int64), held[3].astype(np.int64)
        sent = [(b, unpacked(v)) for b, v in rows_of(t, TABLES)]
        for _, x in sent:
            context[np.cumsum(x[0])] += x[1]
            word[np.cumsum(x[2])] += x[3]
        if sweep == 0:
            held[4] = np.minimum(word, 1)
        else:
            theta = THETA_ROOT + m.discount_root * np.maximum(m.roots[-1][1] - held[4].astype(np.int64), 0)
            held[4] = reseat(word, theta, 1 / (m.vocabulary + 1), m.discount_root, np.arange(m.at[shard], m.at[shard] + n).astype(U64) << U64(32) | LOW, sweep, held[4].astype(np.int64))
        if m.is_sample(sweep):
            held += [context, word, held[4]]
        yield WORDS, shard, 0, packed(*held), int(word.sum()), int(held[4].sum()), int((word == 1).sum()), int((word == 2).sum())
        for b, x in sent:
            w = np.cumsum(x[2])
            yield ANSWER, b, shard, packed(context[np.cumsum(x[0])], word[w], held[4][w]), 0, 0, 0, 0

    return run


def bucket_pass(m: Model, sweep: int) -> Callable[[int, pa.Table], Iterator[Row]]:
    """Reseats all customers of a bucket's bigrams, given the totals of the sweep before, and sends their tables to shards."""

    def run(bucket: int, t: pa.Table) -> Iterator[Row]:
        key, c, tables, total = (x.astype(np.int64) for x in unpacked(rows_of(t, SEATS)[0][1]))
        key = np.cumsum(key.astype(U64), dtype=U64)
        contexts, context = np.unique((key >> U64(32)).astype(np.int64), return_inverse=True)
        names, word = np.unique((key & LOW).astype(np.int64), return_inverse=True)
        if len(key):
            got = [unpacked(v) for _, v in rows_of(t, ANSWER)]
            there, customers, seats = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(3))
            others = np.maximum(there[context] - tables, 0)
            tables = reseat(c, THETA_CONTEXT + m.discount * others, m.parent(customers, seats, m.roots[-1])[word], m.discount, key, sweep, tables)
        if m.is_sample(sweep):
            total = total + tables
        yield SEATS, bucket, 0, packed(steps(key), c, tables, total), 0, 0, 0, 0
        yield from by_number(m, TABLES, bucket, (contexts, np.bincount(context, tables).astype(np.int64)), (names, np.bincount(word, tables).astype(np.int64)))

    return run


def estimated(once: int, twice: int) -> float:
    """A discount, by the usual estimate from what was seen once and twice."""
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))


def sampled(frame: DataFrame, bigrams: DataFrame, seen: list[int], m: Model) -> tuple[DataFrame, DataFrame, Model]:
    """WORDS and SEATS after all sweeps."""
    spark = frame.sparkSession
    m = replace(m, discount=estimated(*seen[:2]))
    shards, (customers, tables, once, twice) = summed(exchanged(frame.where(f"kind = {WORDS}").unionByName(bigrams.where(f"kind in ({SINGLE}, {TABLES})")), shard_pass(m, 0)), "shards")
    m = replace(m, discount_root=estimated(once, twice), roots=((customers, tables),))
    buckets = bigrams
    for sweep in range(1, m.sweeps[0] + m.sweeps[1] * m.sweeps[2] + 1):
        seats = staged(exchanged(buckets.where(f"kind = {SEATS}").unionByName(shards.where(f"kind = {ANSWER}")), bucket_pass(m, sweep)), "buckets")
        after, (customers, tables, _, _) = summed(exchanged(shards.where(f"kind = {WORDS}").unionByName(seats.where(f"kind = {TABLES}")), shard_pass(m, sweep)), "shards")
        if buckets is not bigrams:
            discard(buckets)
        discard(shards)
        buckets, shards = seats, after
        m = replace(m, roots=(*m.roots, (customers, tables)))
        spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of sweeps that are over
    return shards, buckets, m


def scored(store: DataFrame, frame: DataFrame, bigrams: DataFrame, shards: DataFrame, buckets: DataFrame, m: Model) -> DataFrame:
    """One row for each document of the chunks."""
    roots = [r for s, r in enumerate(m.roots) if m.is_sample(s)]
    samples = len(roots)

    def answer_words(shard: int, t: pa.Table) -> Iterator[Row]:
        held = [x for k, x in enumerate(unpacked(rows_of(t, WORDS)[0][1])) if k not in (2, 3, 4)]
        for chunk, v in rows_of(t, NUMBERS):
            i = np.cumsum(unpacked(v)[0])
            yield WORDS, chunk, shard, packed(*[x[i] for x in held]), 0, 0, 0, 0

    def answer_bigrams(bucket: int, t: pa.Table) -> Iterator[Row]:
        _, c, _, total = unpacked(rows_of(t, SEATS)[0][1])
        for chunk, v in rows_of(t, BIGRAMS):
            code, index = unpacked(v)
            index = np.cumsum(index)
            yield SEATS, chunk, bucket, packed(code, c[index], total[index]), 0, 0, 0, 0

    def score(t: pa.Table) -> pa.Table:
        c = Chunk(rows_of(t, CHUNK)[0][1])
        _, _, (context, word), place = c.bigrams(rows_of(t, NUMBERS), m.at, m.buckets)
        got = [unpacked(v) for _, v in rows_of(t, WORDS)]
        order, _ = c.by_shard(len(m.at) - 1)
        held = np.empty((2 + 3 * samples, len(order)))
        for k in range(len(held)):
            held[k, order] = np.concatenate([g[k] for g in got])
        got = [unpacked(v) for _, v in rows_of(t, SEATS)]
        code = np.concatenate([g[0] for g in got])
        p = (1 - m.discount) * (code == 1).astype(float)
        p[code == 2] = np.concatenate([g[1] - m.discount / samples * g[2].astype(float) for g in got])
        for s, root in enumerate(roots):
            tables, customers, seats = held[2 + 3 * s : 5 + 3 * s]
            p += (THETA_CONTEXT + m.discount * tables)[context] * m.parent(customers, seats, root)[word] / samples
        model = np.log10(p / (THETA_CONTEXT + held[1][context]))[place]
        base = np.log10((held[0] + 0.5) / (m.n + 0.5 * (m.vocabulary + 1)))[c.word]
        add = lambda x: np.add.reduceat(x, c.first)  # noqa: E731  no text is without its end
        return pa.table({"doc_id": pa.array(c.ids, mask=c.null), "held_out": ~c.train, "n_tokens": c.size.astype(np.int64), "n_known": add((held[0] > 0)[c.word].astype(np.int64)), "train_tokens": np.full(len(c.ids), m.n), "base_score": add(base), "score": add(model)})

    numbers = frame.where(f"kind = {NUMBERS}")
    asked = numbers.selectExpr("kind", "other as key", "key as other", "v", "a", "b", "c", "d")
    words = exchanged(shards.where(f"kind = {WORDS}").unionByName(asked), answer_words)
    pairs = exchanged(buckets.where(f"kind = {SEATS}").unionByName(bigrams.where(f"kind = {BIGRAMS}")), answer_bigrams)
    every = store.unionByName(numbers).unionByName(words).unionByName(pairs).select("kind", "key", "other", "v")
    return every.groupBy("key").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def pitman_yor_scores(docs: DataFrame, training, text_col: str = "text", share: int = SHARE, sweeps: tuple[int, int, int] = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text.

    Learns from the rows for which ``training`` holds (null: not).  ``share`` is
    the bytes of text for each shard and bucket; ``sweeps`` are those before the
    first sample, the samples, and the sweeps for each of them.  A null text reads as empty, that
    is one end token.  Repeated rows are scored, and counted, each; with no
    training rows every probability is the uniform one over the unknown word; an
    empty table gives no rows.  Other columns are ignored.  A very long text is
    never cut: it makes a chunk of its own, of some 60 bytes of memory a token.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("id_"), F.col(text_col).alias("text_"), F.coalesce(training, F.lit(False)).alias("train_"))
    shards = shares(source, "text_", share)
    store = staged(chunks(source), "chunks")
    frame, at, n, vocabulary = numbered(store, shards)
    m = Model(at, shards, n, vocabulary, sweeps=sweeps)
    bigrams, seen = counted(store, frame, m)
    spark.sparkContext._jvm.System.gc()  # the shuffle files of the bigrams can go
    words, seats, m = sampled(frame, bigrams, seen, m)
    return scored(store, frame, bigrams, words, seats, m)


def op3_pitman_yor_scores(spark, sf_dir):
    return pitman_yor_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)
