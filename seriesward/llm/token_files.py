"""Token ids of documents in seekable binary files.

A file is a sequence of independent zstandard frames of ids (2 or 4 bytes each, little-endian), then two skippable
frames: the documents (ids and lengths) and, last, a seek table in the public seekable layout: compressed size, size and
the low 32 bits of an XXH64 checksum per frame. A reader fetches the tail, then only the frames of the documents it wants.

Rows: a null text is an empty document (the end id alone); a null doc_id is kept and sorts first; rows that repeat a
doc_id are separate documents, ordered by their text. An empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import text as tx
from .encode import encoder

SKIPPABLE, SEEKABLE, DOCUMENTS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
FRAME_BYTES = 1 << 18
NO_ID = -(1 << 63)  # stands for a null doc_id in a file
MANIFEST = "shard int, file string, n_docs long, n_tokens long"
SLICE_BYTES = 1 << 20  # pieces, places and ids of a slice take many times its size
TASK_IDS = 4_000_000  # files are read back together up to about so many ids a task


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Writer:
    """Appends documents; a frame is closed once it holds ``frame_bytes``, and a long document spans several."""

    def __init__(self, sink, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes // width * width
        self._zstd, self._held, self._frames, self._docs = zstandard.ZstdCompressor(level=level), bytearray(), [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((NO_ID if doc_id is None else doc_id, len(ids)))
        self._held += ids.astype(f"<u{self.width}").tobytes()
        while len(self._held) >= self.frame_bytes:
            self._frame(bytes(self._held[: self.frame_bytes]))
            del self._held[: self.frame_bytes]

    def _frame(self, raw: bytes) -> None:
        packed = self._zstd.compress(raw)
        self.sink.write(packed)
        self._frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        """The number of documents and of ids."""
        if self._held:
            self._frame(bytes(self._held))
        docs = np.array(self._docs, dtype="<i8").reshape(-1, 2)
        body = docs.tobytes() + struct.pack("<QB", len(docs), self.width)
        body += struct.pack("<I", zlib.crc32(body))
        self.sink.write(struct.pack("<II", DOCUMENTS, len(body)) + body)
        table = b"".join(struct.pack("<III", *x) for x in self._frames) + struct.pack("<IBI", len(self._frames), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return len(docs), int(docs[:, 1].sum())


class Reader:
    """Documents of one file by their place in it. Only frames that hold wanted ids are read; each is verified."""

    def __init__(self, path: str):
        system, name = filesystem(path)
        self.file, size = system.open_input_file(name), system.get_file_info(name).size
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        start = size - 17 - 12 * n
        table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(-1, 3)
        self.packed, self.raw, self.sums = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        self.place = np.concatenate([[0], np.cumsum(self.packed)])
        self.begin = np.concatenate([[0], np.cumsum(self.raw)])
        body = self._at(int(self.place[-1]) + 8, start - int(self.place[-1]) - 8)
        if struct.unpack("<I", body[-4:])[0] != zlib.crc32(body[:-4]):
            raise ValueError(f"{path}: damaged document index")
        m, self.width = struct.unpack("<QB", body[-13:-4])
        docs = np.frombuffer(body[: 16 * m], "<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = docs[:, 0], docs[:, 1]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._zstd, self._last, self.frames_read = zstandard.ZstdDecompressor(), (-1, b""), 0

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = self._zstd.decompress(self._at(int(self.place[k]), int(self.packed[k])), max_output_size=int(self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.sums[k]):
                raise ValueError(f"frame {k} is damaged")
            self._last, self.frames_read = (k, raw), self.frames_read + 1
        return self._last[1]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of this file."""
        a, b = int(self.starts[k]) * self.width, int(self.starts[k + 1]) * self.width
        parts, f = [], int(np.searchsorted(self.begin, a, side="right")) - 1
        while a < b:
            base = int(self.begin[f])
            parts.append(self._frame(f)[a - base : b - base])
            a, f = int(self.begin[f + 1]), f + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Documents by id, in the file's order."""
        for k in np.flatnonzero(np.isin(self.doc_ids, list(doc_ids))):
            yield int(self.doc_ids[k]), self.ids(int(k))

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, pieces: str = "whole", end_id: int | None = None, width: int = 2) -> DataFrame:
    """Encode ``text`` of all rows into files below ``folder`` (shared by all executors) in ascending order of doc_id.
    Returns the manifest, one row per file; files of failed attempts are not in it. ``width`` 2 needs ids below 65536."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, sink = encoder(tokenizer, pieces), None, None
        part = TaskContext.get().partitionId()
        for batch in tx.slices(batches, "text", SLICE_BYTES):
            if writer is None:
                system, base = filesystem(folder)
                system.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                sink = system.open_output_stream(f"{base}/{name}", compression=None)
                writer = Writer(sink, width)
            ids, at = encode(batch.column("text"))
            if width == 2 and len(ids) and ids.max() > 0xFFFF:
                raise ValueError("ids over 65535 need width 4")
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[at[k] : at[k + 1]]
                writer.add(doc_id, own if end_id is None else np.append(own, np.uint32(end_id)))
            pa.default_memory_pool().release_unused()  # Arrow would keep what a slice took
        if writer:
            n_docs, n_tokens = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    # One row per file; the table of them is one part, not a small file from each task.
    return materialise(rows.mapInArrow(write, MANIFEST).repartition(1))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    32-bit integers). The driver sees one row per file. Small files are read several in a task."""
    files, start = [], 0
    for r in manifest.orderBy("shard").collect():
        files.append((r.file, start))
        start += r.n_tokens
    tasks = min(len(files), max(spark.sparkContext.defaultParallelism, -(-start // TASK_IDS)))
    listed = spark.createDataFrame(files, "file string, start long").repartition(max(1, tasks))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                reader = Reader(file)
                for low in range(0, len(reader.doc_ids), 10_000):
                    some = range(low, min(low + 10_000, len(reader.doc_ids)))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if (d := int(reader.doc_ids[k])) == NO_ID else d for k in some], pa.int64()),
                            "start": pa.array(begin + reader.starts[some.start : some.stop], pa.int64()),
                            "n_tokens": pa.array(reader.lengths[some.start : some.stop].astype(np.int64)),
                            "ids_crc32": pa.array([zlib.crc32(reader.ids(k).tobytes()) for k in some], pa.int64()),
                        }
                    )
                reader.close()

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
