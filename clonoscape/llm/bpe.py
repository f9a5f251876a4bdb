"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

For each short word two arrays are held: the part boundaries (as part ids) and
the merge ranks of adjacent parts.  The minimum rank is scanned for, the
boundary at its place deleted, and the two neighbouring ranks refreshed, until
no adjacent pair has a rank.  Words of one length are worked on together as the
rows of a matrix: each live row loses one boundary per step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkCache
from .textbatch import slices

#: The byte-level pre-tokenisation pattern of the public tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 64
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """Letter of each byte in a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class RankArrayBpe:
    """A tokenizer file's vocabulary, merge ranks and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            if token not in special:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(size)]
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.rank_of_key = size, keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.find = regex.compile(PATTERN).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.cache = ChunkCache(self.encode_chunks)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NONE)

    def encode_same_length(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of part ids, one word a row, all of one length."""
        out: list[np.ndarray] = [None] * len(ids)
        row = np.arange(len(ids))
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            n = ids.shape[1]
            at = rank.argmin(axis=1) if n > 1 else np.zeros(len(ids), np.int64)
            low = rank[np.arange(len(ids)), at] if n > 1 else np.full(len(ids), NONE)
            live = low != NONE
            for r, parts in zip(row[~live], ids[~live], strict=True):
                out[r] = parts
            if not live.any():
                return out
            row, ids, rank, at, low = row[live], ids[live], rank[live], at[live], low[live]
            k = np.arange(len(ids))
            ids[k, at] = self.merged[low]
            kept = np.arange(n - 1)
            ids = np.take_along_axis(ids, kept + (kept > at[:, None]), axis=1)  # the boundary after the pair goes
            kept = np.arange(n - 2)
            rank = np.take_along_axis(rank, kept + (kept >= at[:, None]), axis=1)
            left, right = at > 0, at < n - 2
            rank[k[left], at[left] - 1] = self.ranks(ids[k[left], at[left] - 1], ids[k[left], at[left]])
            rank[k[right], at[right]] = self.ranks(ids[k[right], at[right]], ids[k[right], at[right] + 1])

    def encode_long(self, ids: np.ndarray) -> np.ndarray:
        """One long word: all places of the lowest rank at once, from the left, since a merge only makes higher ranks."""
        rank = self.ranks(ids[:-1], ids[1:])
        while len(ids) > 1 and (low := rank.min()) != NONE:
            at = np.flatnonzero(rank == low)
            if len(at) > 1:  # of overlapping places in a run, every second one from its start
                begins = np.concatenate([[True], np.diff(at) > 1])
                start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            ids = ids.copy()
            ids[at] = self.merged[low]
            ids = np.delete(ids, at + 1)
            rank = np.delete(rank, at)
            new = at - np.arange(len(at))
            for side in (new - 1, new):
                side = side[(side >= 0) & (side < len(ids) - 1)]
                rank[side] = self.ranks(ids[side], ids[side + 1])
        return ids

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        by_length: dict[int, list[bytes]] = {}
        for w in set(words):
            by_length.setdefault(len(w), []).append(w)
        out: dict[bytes, bytes] = {}
        for n, group in by_length.items():
            if n > SHORT:
                for w in group:
                    out[w] = self.encode_long(self.byte_id[np.frombuffer(w, np.uint8)]).tobytes()
            else:
                ids = self.byte_id[np.frombuffer(b"".join(group), np.uint8)].reshape(len(group), n)
                out.update(zip(group, (x.tobytes() for x in self.encode_same_length(ids)), strict=True))
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        pieces: list[list] = []
        for c in chunks:
            if self.cut and self.cut.search(c):
                pieces.append([p for s in self.cut.split(c) if s for p in ([s] if s in self.special else [w.encode() for w in self.find(s)])])
            else:
                pieces.append([w.encode() for w in self.find(c)])
        known = self.encode_words([w for p in pieces for w in p if isinstance(w, bytes)])
        return [b"".join(known[w] if isinstance(w, bytes) else np.int32(self.special[w]).tobytes() for w in p) for p in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.int32) for x in self.cache.ids(texts)]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, RankArrayBpe] = {}


def tokenizer(path: str) -> RankArrayBpe:
    if path not in _loaded:
        _loaded[path] = RankArrayBpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Token ids of every whole text: ``id_col``, ids array<int>. A null text has no ids; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in slices(batches, "text_"):
            ids = bpe.encode([t or "" for t in b.column(1).to_pylist()])
            offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offs), flat)], [id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as text_").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Texts of ids: ``id_col``, text. Null ids give an empty text, bytes that aren't UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    kind = dict(tokens.dtypes)[id_col]
    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def bpe_digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", release: bool = False) -> DataFrame:
    """Encode every whole text, decode its ids again, and return digests of both.

    Columns ``id_col``, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 (UTF-8).  A null text reads as empty: no ids, the digest of
    the empty string.  Repeated rows are encoded each, very long texts whole; an
    empty table gives no rows; other columns are not read; no shuffle.  With
    ``release`` a task drops the cache of chunks at its end, for workers that go
    on to other work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in slices(batches, "text_"):
            n, ids_sha, text_sha = [], [], []
            for x in bpe.encode([t or "" for t in b.column(1).to_pylist()]):
                ids = x.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        if release:
            bpe.cache.held = {}

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as text_").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_rank_array_bpe(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
