"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item (10 consecutive words, or the whole of a shorter item)
is a set of word shingles.  Shingles are ordered by their rarity in the whole
corpus.  As a window must be contained wholly, its rarest shingle alone is a
necessary prefix; documents are joined on these prefix shingles by position,
the window is laid over the place found (it must fit into the document: length
and positional bounds), and then compared word by word.

The windows are broadcast in blocks of bounded size; a larger benchmark takes
more passes over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textbatch import _COEF, ALNUM, U64, Words, buffers, mix, slices, window_hashes, words

WINDOW, SHINGLE = 10, 3
#: Windows broadcast at once (some 100 bytes each).
BLOCK_WINDOWS = 500_000


@dataclass
class Windows:
    """Distinct windows of a block of items, with the place of each one's shingles."""

    items: list[str]
    length: np.ndarray  # words of each window
    full: np.ndarray  # hash of the whole window
    text: list[bytes]  # its words, joined by a byte that no word holds
    of_item: list[np.ndarray]  # items that hold the window
    shingle: np.ndarray  # distinct shingle hashes, sorted
    width: np.ndarray  # words of each
    held: np.ndarray  # (window, offset, shingle) rows


def run_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """window_hashes at chosen places."""
    out = np.zeros(len(at), U64)
    for j in range(k):
        out += hashes[at + j] * _COEF[j]
    return mix(out + U64(k))


def item_windows(rows: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE) -> Windows:
    w = words(*buffers(pa.array([t for _, t in rows], pa.large_string())), ALNUM)
    items = sorted({i for i, _ in rows})
    place = {x: k for k, x in enumerate(items)}
    seen: dict[tuple[int, int], int] = {}
    length, full, text, of_item, held = [], [], [], [], []
    for r, (item, _) in enumerate(rows):
        a, b = int(w.first[r]), int(w.first[r + 1])
        n = min(window, b - a)
        if not n:
            continue
        hashes = window_hashes(w.hashes[a:b], n)
        size = min(shingle, n)
        small = window_hashes(w.hashes[a:b], size)
        for k, h in enumerate(hashes.tolist()):
            at = seen.get((n, h))
            if at is None:
                at = seen[n, h] = len(length)
                length.append(n)
                full.append(h)
                text.append(b" ".join(w.text(i) for i in range(a + k, a + k + n)))
                of_item.append(set())
                held += [(at, o, int(small[k + o]), size) for o in range(n - size + 1)]
            of_item[at].add(place[item])
    keys = np.array([(h[2]) for h in held], U64)
    distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    width = np.array([held[i][3] for i in first], np.int64)
    rows_ = np.array([(h[0], h[1]) for h in held], np.int64).reshape(-1, 2)
    return Windows(items, np.array(length, np.int64), np.array(full, U64), text, [np.array(sorted(s)) for s in of_item], distinct, width, np.column_stack([rows_, inverse]))


def places(w: Words, keys: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, key index) wherever a shingle of the documents is among the sorted keys."""
    at, found = [], []
    for k in np.unique(width):
        h = window_hashes(w.hashes, int(k))
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        p = np.flatnonzero((keys[i] == h) & (width[i] == k))
        at.append(p)
        found.append(i[p])
    return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def rarity(docs: DataFrame, win: Windows, text_col: str) -> np.ndarray:
    """Occurrences of each benchmark shingle in all documents (runs that cross documents do no harm to an order)."""
    sent = docs.sparkSession.sparkContext.broadcast((win.shingle, win.width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, width = sent.value
        total = np.zeros(len(keys), np.int64)
        for b in slices(batches, "text_"):
            total += np.bincount(places(words(*buffers(b.column(0)), ALNUM), keys, width)[1], minlength=len(keys))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    counts = docs.selectExpr(f"`{text_col}` as text_").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most one row a shingle of the block
    out = np.zeros(len(win.shingle), np.int64)
    for k, n in counts:
        out[k] = n
    return out


def prefixes(win: Windows, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingle of each window: sorted keys, their widths, and (window, offset) rows grouped by key."""
    window, offset, k = win.held.T
    order = np.lexsort((offset, k, count[k], window))
    first = order[np.concatenate([[True], np.diff(window[order]) > 0])] if len(order) else order
    by = first[np.argsort(k[first], kind="stable")]
    used, start = np.unique(k[by], return_index=True)
    return win.shingle[used], win.width[used], np.column_stack([window[by], offset[by]]), np.append(start, len(by))


def hits(w: Words, win: Windows, keys, width, rows, start) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every exact occurrence of a window."""
    at, key = places(w, keys, width)
    n = start[key + 1] - start[key]
    at, row = np.repeat(at, n), np.repeat(start[key], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    window, begin = rows[row, 0], at - rows[row, 1]
    doc = np.searchsorted(w.first, at, "right") - 1
    fits = (begin >= w.first[doc]) & (begin + win.length[window] <= w.first[doc + 1])
    window, begin = window[fits], begin[fits]
    same = np.zeros(len(window), bool)
    for k in np.unique(win.length[window]):
        m = win.length[window] == k
        same[m] = run_hash(w.hashes, begin[m], int(k)) == win.full[window[m]]
    window, begin = window[same], begin[same]
    exact = [b" ".join(w.text(i) for i in range(p, p + win.length[v])) == win.text[v] for p, v in zip(begin, window, strict=True)]
    exact = np.array(exact, bool)
    return begin[exact], window[exact]


OUT = "doc_id {0}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurring window), n_items, items_sha256, contaminated.

    Null or empty texts have no words and no hits; items with a null id or no
    words take no part; repeated items count once by id; repeated documents are
    reported each; an empty benchmark hits nothing and an empty corpus gives no
    rows.  Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    items = benchmark.where("item_id is not null").selectExpr("cast(item_id as string) as item", "coalesce(text, '') as text")
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # more than its words
    n_blocks = max(1, int(-(-total // block_windows)))
    source = docs.selectExpr("doc_id", f"`{text_col}` as text_")
    if n_blocks == 1:
        return _pass(source, items.collect(), window, "text_", final=True, kind=kind)  # bounded by block_windows
    merged = None
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).collect()
        one = _pass(source, rows, window, "text_", final=False, kind=kind)
        merged = one if merged is None else merged.unionByName(one)
    per = merged.groupBy("doc_id", "h").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / n_blocks).cast("int").alias("copies")
    )
    step = lambda a, s: F.struct(F.greatest(a["e"], s["e"]).alias("e"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["e"] - F.greatest(a["e"], s["b"]))).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate("spans", zero, step, lambda a: a["n"])
    return per.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), "copies")).alias("c_")).drop("c_")


def _pass(source: DataFrame, rows: list, window: int, text_col: str, final: bool, kind: str) -> DataFrame:
    win = item_windows([(r[0], r[1]) for r in rows], window)
    sc = source.sparkSession.sparkContext
    count = rarity(source, win, text_col) if len(win.shingle) else np.zeros(0, np.int64)
    sent = sc.broadcast((win, *prefixes(win, count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, keys, width, by_key, start = sent.value
        for b in slices(batches, "text_"):
            w = words(*buffers(b.column(1)), ALNUM)
            n = b.num_rows
            at, window_of = hits(w, win, keys, width, by_key, start) if len(keys) else (np.zeros(0, np.int64),) * 2
            edge = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + win.length[window_of], -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            n_hit = covered[w.first[1:]] - covered[w.first[:-1]]
            doc = np.searchsorted(w.first, at, "right") - 1
            found: list[set] = [set() for _ in range(n)]
            for d, v in {(int(d), int(v)) for d, v in zip(doc, window_of, strict=True)}:
                found[d].update(win.of_item[v].tolist())
            names = [sorted(win.items[i] for i in f) for f in found]
            head = [b.column(0), pa.array(w.counts)]
            if final:
                yield pa.RecordBatch.from_arrays([*head, pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([digest(x) for x in names], pa.string()), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            else:
                spans: list[list] = [[] for _ in range(n)]
                for d, p, v in zip(doc, at, window_of, strict=True):
                    begin = int(p - w.first[d])
                    spans[d].append({"b": begin, "e": begin + int(win.length[v])})
                yield pa.RecordBatch.from_arrays([*head, pa.array(spans, pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))), pa.array(names, pa.list_(pa.string())), b.column(2)], ["doc_id", "n_words", "spans", "items", "h"])

    if final:
        return source.mapInArrow(run, OUT.format(kind))
    return source.withColumn("h", F.xxhash64("text_")).mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<b:long,e:long>>, items array<string>, h long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    Null and empty texts have no words and stay; repeated rows go or stay alike; very
    long texts are read whole.  Items without an id are left out, those without words
    have no window: a benchmark of such items, or an empty one, drops nothing.
    """
    items = benchmark.where("item_id is not null").selectExpr("cast(item_id as string) as item", "coalesce(text, '') as text")
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n_blocks = max(1, int(-(-total // block_windows)))
    at = docs.columns.index("text")
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).collect()
        win = item_windows([(r[0], r[1]) for r in rows], window)
        if not len(win.shingle):
            continue
        sent = docs.sparkSession.sparkContext.broadcast((win, *prefixes(win, rarity(docs, win, "text"))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                w = words(*buffers(b.column(at)), ALNUM)
                clean = np.ones(b.num_rows, bool)
                clean[np.searchsorted(w.first, hits(w, *sent.value)[0], "right") - 1] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_prefix_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
), win as (
  select distinct item, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as t
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bw where len(w) > 0)
), sizes as (select distinct k from win),
pos as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as t
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, sizes where len(w) >= k)
), hit as (select doc_id, item, i, pos.k from pos join win using (k, t)),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hit group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join cov using (doc_id) left join its using (doc_id)
"""
