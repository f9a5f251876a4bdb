"""Splitting of texts into chunks that byte-level BPE treats independently.

No token of the byte-level pattern runs from a non-space character into white
space, so a text may be cut before every white-space run and the chunks encoded
alone.  Chunks repeat far more often than documents, which makes a bounded
cache of chunk -> ids worthwhile.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .textbatch import buffers

#: Characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACE = WHITE_SPACE[:6]
_ASCII = re.compile("[\t\n\x0b\x0c\r ]*[^\t\n\x0b\x0c\r ]+|[\t\n\x0b\x0c\r ]+")
_ANY = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_WIDE = re.compile(f"[{WHITE_SPACE[6:]}]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in ASCII_SPACE]] = True


def split(text: str) -> list[str]:
    """Chunks of a text: a white-space run with the characters that follow it."""
    return (_ANY if _WIDE.search(text) else _ASCII).findall(text)


class ChunkCache:
    """Little-endian uint32 ids of chunks (as text, or as UTF-8 where a whole column is looked up); ``encode`` gets the chunks not yet held.

    At most ``most`` short chunks are held; longer chunks are encoded each time.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 400_000, longest: int = 48):
        self.encode, self.most, self.longest, self.held = encode, most, longest, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [split(t) for t in texts]
        wanted: set[str] = set()
        for p in parts:
            wanted.update(p)
        if len(self.held) + len(wanted) > self.most:
            self.held = {}
        missing = [c for c in wanted if c not in self.held]
        self.held.update(zip(missing, self.encode(missing), strict=True))
        get = self.held.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for c in missing:
            if len(c) > self.longest:
                del self.held[c]
        return out

    def column_ids(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column (null as empty), as ``ids`` gives them.

        Chunks are cut and told apart for the whole column at once; only different
        ones are looked up.  Texts with white space beyond ASCII go through ``ids``.
        """
        wide = np.array([t is not None and _WIDE.search(t) is not None for t in column.to_pylist()], bool)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
        at = np.flatnonzero(wide)
        for k, raw in zip(at.tolist(), self.ids(column.take(pa.array(at)).to_pylist()) if len(at) else [], strict=True):
            out[k] = np.frombuffer(raw, np.uint32)
        rest = np.flatnonzero(~wide)
        data, offs = buffers(column.take(pa.array(rest)) if len(at) else column)
        space = _IS_SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offs[:-1][np.diff(offs) > 0]] = True
        first = np.flatnonzero(begins)
        if not len(first):
            return out
        ends = np.append(first, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        which = chunks.indices.to_numpy()
        different = chunks.dictionary.to_pylist()
        if len(self.held) + len(different) > self.most:
            self.held = {}
        missing = [c for c in different if c not in self.held]
        self.held.update(zip(missing, self.encode([c.decode() for c in missing]), strict=True))
        raws = list(map(self.held.__getitem__, different))
        for c in missing:
            if len(c) > self.longest:
                del self.held[c]
        size = np.fromiter(map(len, raws), np.int32, len(raws)) // 4
        flat, begin = np.frombuffer(b"".join(raws), np.uint32), np.cumsum(size, dtype=np.int32) - size
        tokens = size[which]
        upto = np.cumsum(tokens, dtype=np.int32)
        ids = flat[np.repeat(begin[which] - (upto - tokens), tokens) + np.arange(upto[-1], dtype=np.int32)]
        cut = np.concatenate([[0], upto])[np.searchsorted(first, offs)]
        for k, a, b in zip(rest.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out
