"""Sum-of-squares packing of documents into sequences of a fixed length.

A piece goes where the sum, over all residual gaps, of the squared count of open bins with that gap becomes smallest;
equal choices take the smallest gap, and a new bin opens only where no open one has room. Pieces are dealt evenly into
groups of bounded size, which pack on their own in descending length; a group can waste about one bin.

Rows: a null text is an empty document (the end id alone). Rows that repeat a doc_id are separate documents; their pieces
then share (doc_id, piece). A null doc_id is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_batches, materialise
from . import text as tx
from .encode import encoder

CAPACITY, GROUP_PIECES = 2048, 20_000
SLICE_BYTES = 2 << 20  # pieces, places and ids of a slice take many times its size
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, pieces: str = "whole", end_id: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; only documents longer than ``capacity`` are cut, and their first piece is the short one."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pieces)
        for batch in tx.slices(batches, "text", SLICE_BYTES):
            ids, at = encode(batch.column("text"))
            rows: list[tuple] = []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[at[k] : at[k + 1]].astype("<u4")
                if end_id is not None:
                    own = np.append(own, np.uint32(end_id))
                n = len(own)
                begin, end = 0, (n % capacity or min(n, capacity))
                for piece in range(max(1, -(-n // capacity))):
                    rows.append((doc_id, piece, begin, end - begin, zlib.crc32(own[begin:end].tobytes())))
                    begin, end = end, end + capacity
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))
            pa.default_memory_pool().release_unused()  # Arrow would keep what a slice took
        encode.rest()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the fill of each bin. Sizes are placed in descending order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; neither full nor new ones
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    never = np.iinfo(np.int64).max
    for k in order:
        s = int(sizes[k])
        # From gap g to gap g - s: 2 (N[g - s] - N[g]) + 2, or 1 - 2 N[s] if the bin is then full.
        source, target = count[s:capacity], count[: capacity - s]
        change = np.where(source > 0, 2 * (target - source) + 2, never)
        if s < capacity and source[0] > 0:
            change[0] = 1 - 2 * source[0]
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < never:
            gap = s + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, np.array(fills, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces (one row each, with ``length``) with sequence_id and offset. Reads ``pieces`` twice: pass a stored table."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            bins, offsets, _ = sum_of_squares(table["length"].to_numpy(), capacity)
            ids = bins + (TaskContext.get().partitionId() << 32)
            yield from table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).to_batches()

    return pieces.repartition(groups).mapInArrow(place, T.StructType([*pieces.schema.fields, *map(T.StructField, ("sequence_id", "offset"), (T.LongType(),) * 2)]))


def pack_documents(docs: DataFrame, tokenizer: str, pieces: str = "whole", end_id: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    with bounded_batches(docs.sparkSession):
        stored = materialise(pieces_of(docs, tokenizer, pieces, end_id, capacity))
    return pack(stored, capacity)
