"""Vectorised word splitting and hashing over Arrow text columns.

A batch of texts is one UTF-8 byte buffer plus document offsets.  Words are
found with byte tables and hashed with a polynomial over random byte values
(mod 2**64), so no Python object is made per word.  Equal words always hash
alike; two of n different words collide with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_COEF = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of the shingle contracts: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words of the benchmark contract: digits, lower-case letters, non-ASCII bytes.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), U64(base))
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so it adds no collisions."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x % 2**64], U64))[0])


@dataclass
class Words:
    """Words of a batch: byte ranges in ``data``, hashes, and per document the first word's index."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len = documents + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Split every document of the buffer into words and hash them."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(offs), np.int64))
    low = LOWER[data] if lower else data
    inside = word_bytes[low]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[low] * _power("up", _MULT, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power("down", _INV, n)[starts])
    return Words(low, starts, ends, hashes, np.searchsorted(starts, offs))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, by the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += hashes[j : j + n] * _COEF[j]
    return mix(out + U64(k))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
