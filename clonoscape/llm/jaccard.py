"""Near-duplicate documents: a Jaccard join of word-shingle sets by PartEnum.

1. Every document's set of hashed shingles is named by a hash of the set (its
   node), so that equal sets are one node from the start.
2. PartEnum signatures go to buckets in packed blobs; nodes that share one form
   a list, and equal lists are kept once.
3. A parity sketch bounds from below how much two sets differ.  First each
   list's smallest node meets the others of the list; pairs that the sketch
   lets pass are verified on the whole sets, and links joined into components.
4. Then each node of a list meets the one of another component whose sketch is
   nearest to its own; these pairs are verified likewise.
5. At last the nodes that had such a partner get finer sketches; all their pairs
   in one list that these let pass and that still lie in different components
   are verified, and the components completed.

Steps 3 and 4 give at most one pair for each node of a list, and join nearly all
of a large group of near copies; step 5 makes sure that no link between
different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoscape.operators.graph import connected_components

from . import partenum as pe
from .common import discard, staged, table
from .textbatch import U64, buffers, mix, slices, window_hashes, words

SHINGLE = 5
#: Bytes of text that a task looks at together.
SLICE = 1 << 19
#: Nodes of a list that one task compares; longer lists are cut into blocks that meet in pairs.
LIST_BLOCK = 2048
#: Shingles for each bucket of signatures; signatures a task gathers before it writes blobs, and groups the lists are dealt to for each shuffle partition.
SHARE, FLUSH, LIST_GROUPS = 4_000_000, 1_000_000, 4
#: Bits an element and bits in all of the finer sketches.
FINE_EACH, FINE_MOST = 16, 1 << 17
#: Candidate nodes up to this count (8 bytes each) are broadcast to the scan that fetches their texts; beyond it they are shuffled.
BROADCAST_NODES = 1_000_000


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer than k words are one shingle, none give an empty set."""
    w = words(*buffers(texts))
    whole = window_hashes(w.hashes, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(window_hashes(w.hashes[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def node_of(elements: np.ndarray) -> int:
    """Name of a set: a 63-bit hash of all its elements and its size."""
    total = mix(elements ^ U64(0x6A09E667F3BCC909)).sum(dtype=U64) + U64(len(elements))
    return int(mix(np.array([total], U64))[0] >> U64(1))


def sketch_of(elements: np.ndarray, each: int = 2, most: int = 1 << 16) -> bytes:
    """Parity of the elements on a power of two of bits, at least ``each`` times the set's size, from 64 to ``most``."""
    bits = 64
    while bits < min(each * len(elements), most):
        bits *= 2
    at = (mix(elements ^ U64(0x2545F4914F6CDD1D)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold_to(sketch: np.ndarray, n: int) -> np.ndarray:
    """The sketches (rows of 64-bit words) on fewer bits: parities of the halves combine by XOR."""
    while sketch.shape[1] > n:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def document_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), sketch of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text_", SLICE):
            sets = shingle_sets(b.column(1), k)
            node = [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "node", "sketch"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").alias("text_")).mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, sketch binary")


def band_buckets(nodes: DataFrame, share: int) -> dict[int, tuple[int, int]]:
    """First bucket and number of buckets of each band: one for every ``share`` shingles of the sets that sign in it.

    There are at most some 70 bands, so this is small at any size of the input.
    """
    edges = pe.EDGES.tolist()
    size = F.col("n_shingles")
    own = sum((F.when(size >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))
    above = F.element_at(F.array(*map(F.lit, edges)), own + 2)
    bands = F.when(F.floor(size * pe.DEN / pe.NUM) >= above, F.array(own, own + 1)).otherwise(F.array(own))
    weights = nodes.select("n_shingles", F.explode(bands).alias("band")).groupBy("band").agg(F.sum("n_shingles").alias("n")).collect()
    out, start = {}, 0
    for band, n in sorted(weights):
        out[band] = start, 1 + n // share
        start += out[band][1]
    return out


def signature_blobs(docs: DataFrame, buckets: dict[int, tuple[int, int]], k: int = SHINGLE) -> DataFrame:
    """Signatures in blobs by bucket: the nodes, how many signatures each has, and 40 bits of every signature.

    A band has its own buckets, so that a node is named in few of them.  Sets of
    equal nodes are signed once a task.  Cut signatures can only add candidates,
    which are verified anyway.
    """

    def blobs(nodes: list[tuple[int, int]], sigs: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        sig = np.concatenate(sigs)
        name, start, n = (np.repeat(np.array(c), [len(s) for s in sigs]) for c in zip(*((node, *buckets[band]) for node, band in nodes), strict=True))
        bucket = start + (sig % n.astype(U64)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, node = bucket[order], name[order]
        cut = np.ascontiguousarray(sig[order]).view(np.uint8).reshape(-1, 8)[:, 3:]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first = np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))
            first = np.unique(np.concatenate([first, np.arange(0, b - a, 255)]))  # a count fits a byte; a node may be named again
            count = np.diff(np.append(first, b - a)).astype(np.uint8)
            yield int(bucket[a]), np.array([len(first)], "<u4").tobytes() + node[a:b][first].astype("<i8").tobytes() + count.tobytes() + cut[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes: list[tuple[int, int]] = []
        sigs: list[np.ndarray] = []
        held = 0
        for b in slices(batches, "text_", SLICE):
            for s in shingle_sets(b.column(0), k):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                for band, sig in pe.banded_signatures(s):
                    nodes.append((node, band))
                    sigs.append(sig)
                    held += len(sig)
            if held >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blobs(nodes, sigs), strict=True)], ["bucket", "blob"])
                nodes, sigs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blobs(nodes, sigs), strict=True)], ["bucket", "blob"])

    return docs.select(F.col("text").alias("text_")).mapInArrow(run, "bucket long, blob binary")


def shared_lists(blobs: DataFrame) -> DataFrame:
    """Lists of two or more nodes that share a signature: list (a hash), nodes; equal lists of a bucket once."""

    def run(t: pa.Table) -> pa.Table:
        sigs, nodes = [], []
        for blob in t.column("blob").to_pylist():
            n = int(np.frombuffer(blob, "<u4", 1)[0])
            name, count = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, np.uint8, n, 4 + 8 * n)
            raw = np.frombuffer(blob, np.uint8, offset=4 + 9 * n).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            sigs.append(wide.view("<u8")[:, 0])
            nodes.append(np.repeat(name, count))
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        order = np.argsort(sig)
        sig = sig[order]
        shared = np.zeros(len(sig), bool)
        same = sig[1:] == sig[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        sig, node = sig[shared], node[order][shared]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(sig)))
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return pa.table({"list": pa.array([], pa.int64()), "nodes": pa.array([], pa.list_(pa.int64()))})
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(node.astype(U64)))])
        name = mix(total[start + size] - total[start] + size.astype(U64)).astype(np.int64)
        name, first = np.unique(name, return_index=True)
        start, size = start[first], size[first]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.table({"list": pa.array(name), "nodes": pa.ListArray.from_arrays(pa.array(offs), pa.array(node[at]))})

    return blobs.groupBy("bucket").applyInArrow(run, "list long, nodes array<long>")


def listed_nodes(lists: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each node of a list, and for each pair of blocks it takes part in if the list is long: (list, block, node).

    Long lists whose nodes already are in one component (``found``: node, component) are left out, before their blocks are paired.
    """
    each = lists.select("list", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node"))
    short = each.where(f"n <= {2 * LIST_BLOCK}").select("list", F.lit("").alias("block"), "node")
    many = each.where(f"n > {2 * LIST_BLOCK}")
    placed = many.select("list", "node").join(found, "node", "left").select("list", F.coalesce("component", "node").alias("component"))
    open_ = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("list")
    own = F.floor(F.col("pos") / LIST_BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LIST_BLOCK)))
    long = many.join(open_, "list", "left_semi").select("list", own.alias("own"), other.alias("other"), "node").where("own <> other")
    return short.unionByName(long.select("list", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node"))


class Sketches:
    """Sketches of one list's nodes, by width."""

    def __init__(self, size: np.ndarray, sketch: list[bytes]):
        self.size, self.width = size, np.array([len(s) // 8 for s in sketch])
        self.rows = {w: np.flatnonzero(self.width == w) for w in np.unique(self.width).tolist()}
        self.place = np.zeros(len(size), np.int64)
        self.bits = {}
        for w, rows in self.rows.items():
            self.place[rows] = np.arange(len(rows))
            self.bits[w] = np.frombuffer(b"".join(sketch[i] for i in rows), U64).reshape(-1, w)

    def may_link(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``others`` whose size and sketch allow a link with node i, and in how many bits their sketches differ."""
        a, b = self.size[i], self.size[others]
        others = others[(np.minimum(a, b) * pe.DEN >= np.maximum(a, b) * pe.NUM)]
        out, apart = [others[:0]], [others[:0]]
        for w in np.unique(self.width[others]).tolist():
            some = others[self.width[others] == w]
            n = min(w, int(self.width[i]))
            mine = fold_to(self.bits[int(self.width[i])][self.place[i]][None, :], n)
            theirs = fold_to(self.bits[w][self.place[some]], n)
            differ = np.bitwise_count(mine ^ theirs).sum(axis=1, dtype=np.int64)
            keep = differ <= pe.difference_bound(a, self.size[some])
            out.append(some[keep])
            apart.append(differ[keep])
        return np.concatenate(out), np.concatenate(apart)


def across(s: Sketches, component: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may link and lie in different components: all of them, or each node's with its nearest other."""
    n = len(s.size)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    best, least = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        others = others[component[others] != component[i]]
        if not len(others):
            continue
        others, apart = s.may_link(i, others)
        if not len(others):
            continue
        if nearest:
            at = int(apart.argmin())
            if apart[at] < least[i]:
                best[i], least[i] = others[at], apart[at]
            closer = apart < least[others]
            best[others[closer]], least[others[closer]] = i, apart[closer]
        else:
            first.append(np.full(len(others), i))
            second.append(others)
    if nearest:
        some = np.flatnonzero(best >= 0)
        return np.minimum(some, best[some]), np.maximum(some, best[some])
    return np.concatenate(first), np.concatenate(second)


def star_pairs(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs of each list's first node with its others, where sizes and sketches allow a link.

    The first node is the smallest, so that lists of one group of copies mostly
    agree on it.  ``nodes``: node, n_shingles, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(i).to_numpy() for i in (2, 3))
            keep = np.minimum(a, c) * pe.DEN >= np.maximum(a, c) * pe.NUM
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            wide = np.array([[len(p) // 8, len(q) // 8] for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
            for w in np.unique(wide[keep], axis=0):
                i = np.flatnonzero(keep & (wide == w).all(axis=1))
                n = int(w.min())
                p, q = (fold_to(np.frombuffer(b"".join(z[k] for k in i), U64).reshape(len(i), -1), n) for z in (x, y))
                keep[i] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= pe.difference_bound(a[i], c[i])
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["src", "dst"]).filter(pa.array(keep))

    star = lists.select(F.col("nodes")[0].alias("src"), F.explode(F.slice("nodes", F.lit(2), F.size("nodes"))).alias("dst")).distinct()
    of_src = nodes.select(F.col("node").alias("src"), F.col("n_shingles").alias("a"), F.col("sketch").alias("x"))
    of_dst = nodes.select(F.col("node").alias("dst"), F.col("n_shingles").alias("c"), F.col("sketch").alias("y"))
    both = star.join(of_dst, "dst").join(of_src, "src").select("src", "dst", "a", "c", "x", "y")
    return both.mapInArrow(run, "src long, dst long")


def cross_pairs(listed: DataFrame, nodes: DataFrame, groups: int, nearest: bool) -> DataFrame:
    """Pairs (src < dst) of one list (list, block) in different components that may link: all, or each node's with its nearest other.

    ``nodes``: node, n_shingles, sketch, component.  A pair comes once from each task, in the first of its lists there.
    """

    def run(t: pa.Table) -> pa.Table:
        lists, block = t.column("list").to_numpy(), t.column("block").combine_chunks().dictionary_encode()
        block = block.chunk(0) if isinstance(block, pa.ChunkedArray) else block
        name, block = block.dictionary, block.indices.to_numpy(zero_copy_only=False)
        node, size, component = (t.column(c).to_numpy() for c in ("node", "n_shingles", "component"))
        order = np.lexsort((node, block, lists))
        sketch = t.column("sketch").to_pylist()
        lists, block, node, size, component = lists[order], block[order], node[order], size[order], component[order]
        edge = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (block[1:] != block[:-1]), [True]]))
        rows = [np.zeros((0, 4), np.int64)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if (component[a:b] == component[a]).all():
                continue
            i, j = across(Sketches(size[a:b], [sketch[k] for k in order[a:b]]), component[a:b], nearest)
            rows.append(np.column_stack([node[a + i], node[a + j], np.full(len(i), lists[a]), np.full(len(i), block[a])]))
        rows = np.concatenate(rows)
        if not nearest:
            rows = rows[np.unique(rows[:, :2], axis=0, return_index=True)[1]]
        return pa.table({"src": rows[:, 0], "dst": rows[:, 1], "list": rows[:, 2], "block": name.take(pa.array(rows[:, 3]))})

    rows = listed.join(nodes, "node").withColumn("group", F.pmod(F.xxhash64("list", "block"), F.lit(groups)))
    return rows.groupBy("group").applyInArrow(run, "src long, dst long, list long, block string")


def whole_sets(wanted: DataFrame, docs: DataFrame, info: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node, elements of the wanted nodes; their texts are read again."""
    few = wanted.count() <= BROADCAST_NODES
    holder = info.join(F.broadcast(wanted) if few else wanted, "node").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).getField("doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text_", SLICE):
            sets = shingle_sets(b.column(0), k)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) if len(s) else -1 for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "elements"])

    # A document that holds the node fetches it; documents that share an id, or have none, are told apart by the node itself.
    ids = holder.select("doc_id").distinct()
    texts = docs.select("doc_id", F.col("text").alias("text_"))
    texts = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = texts.select("text_").mapInArrow(run, "node long, elements binary").join(wanted, "node").groupBy("node").agg(F.first("elements").alias("elements"))
    return staged(sets, "sets")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """node, n_shingles and the finer sketch of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            elements = [np.frombuffer(x, U64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in elements], pa.int64()), pa.array([sketch_of(x, FINE_EACH, FINE_MOST) for x in elements], pa.binary())], ["node", "n_shingles", "sketch"])

    return sets.select("node", "elements").mapInArrow(run, "node long, n_shingles long, sketch binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (src, dst of nodes) whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                link.append(bool(pe.similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["src", "dst"]).filter(pa.array(link, pa.bool_()))

    of_dst = sets.select(F.col("node").alias("dst"), F.col("elements").alias("y"))
    of_src = sets.select(F.col("node").alias("src"), F.col("elements").alias("x"))
    return pairs.join(of_dst, "dst").join(of_src, "src").select("src", "dst", "x", "y").mapInArrow(check, "src long, dst long")


def linked_nodes(docs: DataFrame, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of every document, and (node, doc_id, root): each node's smallest doc_id and its component."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    info = staged(document_sets(docs, k), "sets-of-documents")
    nodes = staged(info.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id")), "nodes")
    lists = staged(shared_lists(signature_blobs(docs, band_buckets(nodes, SHARE), k)).groupBy("list").agg(F.first("nodes").alias("nodes")), "lists")
    slim = info.select("doc_id", "node")

    def ends(pairs: DataFrame) -> DataFrame:
        return staged(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "wanted")

    def linked(pairs: DataFrame) -> DataFrame:
        sets = whole_sets(ends(pairs), docs, slim, k)
        out = staged(verified(pairs, sets), "links")
        discard(sets)
        return out

    def placed(sketched: DataFrame) -> DataFrame:
        return sketched.join(found, "node", "left").select("node", "n_shingles", "sketch", F.coalesce("component", "node").alias("component"))

    first = staged(star_pairs(lists, nodes), "pairs")
    links = linked(first)
    found = staged(connected_components(links), "components")

    met = staged(cross_pairs(listed_nodes(lists, found), placed(nodes), parts * LIST_GROUPS, nearest=True), "met")
    second = staged(met.select("src", "dst").distinct().join(first, ["src", "dst"], "left_anti"), "pairs")
    more = linked(second)
    discard(lists)
    links = links.unionByName(more)
    if more.limit(1).count():
        found = staged(connected_components(links), "components")

    # Nodes without a nearest other have no pair left in that list.
    left = staged(met.select("list", "block", F.explode(F.array("src", "dst")).alias("node")).distinct(), "listed")
    sets = whole_sets(staged(left.select("node").distinct(), "wanted"), docs, slim, k)
    rest = cross_pairs(left, placed(fine_sketches(sets)), parts * LIST_GROUPS, nearest=False).select("src", "dst").distinct()
    more = staged(verified(rest.join(first.unionByName(second), ["src", "dst"], "left_anti"), sets), "links")
    discard(sets)
    if more.limit(1).count():
        found = staged(connected_components(links.unionByName(more)), "components")

    named = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    return info.select("doc_id", "n_shingles", "node"), named.select("node", "doc_id", "root")


def near_duplicate_groups(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest doc_id reachable over links.

    Documents link when their sets of k-word shingles have a Jaccard similarity
    of at least 3/4.  Null and empty texts have no shingles and link with
    nothing: their component is their own id, as is that of any single
    document.  Repeated rows and equal texts share a component; a null doc_id
    never names a component unless it stands alone.  An empty table gives no
    rows; other columns are ignored.  A very long text is read whole, in about 40
    bytes of memory a character.
    """
    info, named = linked_nodes(docs, k)
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(lowest, "root").select("node", "component_id")
    return info.join(by_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates, and every row without words.

    Of a group the row of the smallest doc_id stays (null ids come last), of rows
    that share that id and the set of shingles the one of the smallest text.  Rows
    are told apart by their texts, not by their ids: rows of one id and different
    texts stay or go by themselves.  An empty table stays empty; very long texts are read whole.
    """
    names = [f"own {c}" for c in docs.columns]
    kinds = ", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "own text", SLICE):
            node = [node_of(s) if len(s) else None for s in shingle_sets(b.column(at), k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node, pa.int64())], [*names, "node"])

    _, named = linked_nodes(docs, k)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    keepers = named.groupBy("root").agg(first).select(F.col("first.node").alias("kept node"), F.col("first.doc_id").alias("kept id"))
    same = (F.col("node") == F.col("kept node")) & F.col("own doc_id").eqNullSafe(F.col("kept id"))  # both are keys of the join: many copies of one text meet in many tasks
    rows = staged(docs.toDF(*names).mapInArrow(run, f"{kinds}, node long").join(keepers, same, "left_semi"), "kept")
    again = staged(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "again")
    one = rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    if not again.isEmpty():  # rows that repeat the smallest id of their group
        order = F.struct("own text", *[n for n in names if n != "own text"])
        least = rows.join(again, "node", "left_semi").groupBy("node").agg(F.min(order).alias("row")).select("row.*")
        one = rows.join(again, "node", "left_anti").select(*names).unionByName(least.select(*names)).toDF(*docs.columns)
    return one.unionByName(docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))


def op7_partenum_jaccard(spark, sf_dir):
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as t
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)
), both_ways as (select a, b from e union all select b, a from e),
r as (
  select doc_id, doc_id as c from documents
  union
  select b, c from r join both_ways on a = doc_id
)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.c as component_id
from documents d left join n using (doc_id) join (select doc_id, min(c) as c from r group by doc_id) m using (doc_id)
"""
