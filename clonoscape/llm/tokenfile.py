"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, each with the ids of some
whole documents, then two skippable frames: an index of the documents (id,
length in tokens, frame) and, last, a seek table as in zstandard's public
seekable format: per frame its compressed size, its size and the low 32 bits of
XXH64 of its content.  A reader takes the two tables from the end of the file
and decompresses only the frames of the documents it is asked for.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ASCII_SPACE, WHITE_SPACE, ChunkCache
from .common import shared_folder, staged
from .textbatch import slices

#: Magic numbers of the seekable format and the largest number of tokens gathered in a frame (fixed values).
SKIPPABLE, DOC_INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_TOKENS = 1 << 15
LEVEL = 3
#: A file is ended, and the next one of the task begun, after so many tokens or documents.
FILE_TOKENS, FILE_DOCS = 1 << 26, 1 << 18
#: Documents that a reader hands on at once.
READ_DOCS = 1 << 15


class FileWriter:
    """Appends documents to one file; ``width`` is 2 or 4 bytes an id."""

    def __init__(self, out, width: int = 4):
        self.out, self.kind = out, np.dtype(f"<u{width}")
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.held_tokens = 0
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []  # id, 1 if the id is null, tokens, frame

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held_tokens + len(ids) > FRAME_TOKENS:
            self.flush()
        self.docs.append((doc_id or 0, int(doc_id is None), len(ids), len(self.seek)))
        self.held.append(ids)
        self.held_tokens += len(ids)

    def flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.held).astype(self.kind).tobytes()
            frame = self.zstd.compress(raw)
            self.out.write(frame)
            self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.held_tokens = [], 0

    def finish(self) -> None:
        self.flush()
        index = self.zstd.compress(struct.pack("<I", self.kind.itemsize) + np.array(self.docs, "<i8").tobytes())
        self.out.write(struct.pack("<II", DOC_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *s) for s in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FileReader:
    """Reads single documents, or all of them in order."""

    def __init__(self, src):
        self.src, size = src, src.size()
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - 12 * frames
        self.seek = np.frombuffer(self._at(table_at, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        index = self._at(int(self.begin[-1]), table_at - 8 - int(self.begin[-1]))
        if struct.unpack("<I", index[:4])[0] != DOC_INDEX:
            raise ValueError("no document index before the seek table")
        self.zstd = zstandard.ZstdDecompressor()
        raw = self.zstd.decompress(index[8:])
        self.kind = np.dtype(f"<u{struct.unpack('<I', raw[:4])[0]}")
        self.docs = np.frombuffer(raw, "<i8", offset=4).reshape(-1, 4)

    def _at(self, at: int, n: int) -> bytes:
        self.src.seek(at)
        return self.src.read(n)

    def frame(self, k: int) -> np.ndarray:
        raw = self.zstd.decompress(self._at(int(self.begin[k]), int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
        if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"checksum of frame {k} differs")
        return np.frombuffer(raw, self.kind)

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of the documents at these places of the index, or of all."""
        rows = np.arange(len(self.docs)) if rows is None else np.sort(rows)
        length, frame_of = self.docs[:, 2], self.docs[:, 3]
        before = np.concatenate([[0], np.cumsum(length)])
        held, ids = -1, None
        for r in rows:
            k = int(frame_of[r])
            if k != held:
                held, ids = k, self.frame(k)
                first = before[np.searchsorted(frame_of, k)]
            at = before[r] - first
            yield (None if self.docs[r, 1] else int(self.docs[r, 0])), ids[at : at + length[r]]


_encoders: dict[str, tuple[ChunkCache, int]] = {}


def library_encoder(path: str) -> tuple[ChunkCache, int]:
    """The tokenizers library behind a bounded cache of chunks, and the bytes an id needs; one for each worker process."""
    if path not in _encoders:
        _encoders[path] = _library_encoder(path)
    return _encoders[path]


def _library_encoder(path: str) -> tuple[ChunkCache, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    size = np.zeros(tok.get_vocab_size(), np.int64)  # bytes of each token
    for token, i in tok.get_vocab().items():
        size[i] = len(token)

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list[str]) -> list[bytes]:
        """Chunks that begin with white space may stand in one text: no token crosses into them, and token sizes tell them apart."""
        out: list[bytes] = [b""] * len(chunks)
        joined = [k for k, c in enumerate(chunks) if c[0] in ASCII_SPACE and c[-1] not in WHITE_SPACE]
        alone = sorted(set(range(len(chunks))).difference(joined))
        for k, ids in zip(alone, ids_of([chunks[k] for k in alone]), strict=True):
            out[k] = ids.tobytes()
        groups = [joined[k : k + 256] for k in range(0, len(joined), 256)]
        for group, ids in zip(groups, ids_of(["".join([chunks[k] for k in g]) for g in groups]), strict=True):
            ends = np.cumsum([len(chunks[k].encode()) for k in group])
            cut = (np.searchsorted(np.cumsum(size[ids]), ends) + 1) * 4
            raw, at = ids.tobytes(), 0
            for k, to in zip(group, cut.tolist(), strict=True):
                out[k], at = raw[at:to], to
        return out

    return ChunkCache(encode, most=1_000_000), 2 if tok.get_vocab_size() <= 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", file_tokens: int = FILE_TOKENS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode all documents and write them in ascending id order, each range of ids as files of bounded size.

    Returns the manifest (shard, piece, path, documents, tokens), one row a file, in the
    order of the ids.  A null text holds only the end id; null ids come first;
    documents of one id are ordered by their text; repeated rows are written each; a very long
    text is one document, which a file holds whole; an empty table gives no
    documents; other columns are not read.  A retried task writes files
    of its own; only the files of the manifest count.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, width = library_encoder(path)
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], np.uint32)
        out, writer, name, piece, total = None, None, "", 0, 0

        def ended() -> pa.RecordBatch:
            writer.finish()
            out.close()
            row = [pa.array([task.partitionId()], pa.int32()), pa.array([piece], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([total], pa.int64())]
            return pa.RecordBatch.from_arrays(row, ["shard", "piece", "path", "documents", "tokens"])

        for b in slices(batches, "text_"):
            for doc_id, own in zip(b.column(0).to_pylist(), cache.column_ids(b.column(1)), strict=True):
                ids = np.concatenate([own, end])
                if out is not None and (total + len(ids) > file_tokens or len(writer.docs) >= file_docs):
                    yield ended()
                    out, piece, total = None, piece + 1, 0
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{piece:06d}.zst"
                    out = fs.open_output_stream(name, compression=None)
                    writer = FileWriter(out, width if end_id < 1 << 16 else 4)
                writer.add(doc_id, ids)
                total += len(ids)
        if out is not None:
            yield ended()

    keyed = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"), F.xxhash64(text_col).alias("h_"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "id_", "h_").sortWithinPartitions("id_", "h_", "text_").select("id_", "text_")
    return staged(ordered.mapInArrow(run, "shard int, piece int, path string, documents long, tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian uint32).

    Null ids, repeated and empty documents come back as they were written; a manifest
    without files gives no rows.  A task holds a frame, a file's index and READ_DOCS results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [id_col, "start", "n_tokens", "ids_crc32"])
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(name) as src:
                    rows = []
                    for doc_id, ids in FileReader(src).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == READ_DOCS:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("start"))  # one row a file
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(files, "path").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def op10_seekable_tokens(spark, sf_dir):
    import public_tokenizers

    from .common import table

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest, folder)
