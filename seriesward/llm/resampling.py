"""Importance resampling towards a target: documents drawn by how much more often their n-grams occur in the target.

N-grams are counted in hashed buckets, over all documents and over the target; a bucket's gain is the log ratio of its
smoothed shares in thousandths. A document's weight is the sum of its n-grams' gains; a Gumbel number from a hash of its
doc_id is added and the highest scores are drawn, which is sampling without replacement in proportion to the weights.

In a task, the n-grams of a batch are interned in an open-addressed table of NumPy arrays: XXH64 keys, linear probing,
equal keys accepted only for equal bytes. A slot stores its n-gram's bucket and count, so that the bucket's checksum is
taken once per distinct n-gram; each occurrence keeps its slot, by which it gathers the gain.

Rows: a null text has no words. A null doc_id has a weight, but no score, is never drawn and isn't among the documents that
the share is taken of. Rows that repeat a doc_id are drawn each for itself, equal scores in any order. An empty table gives
no rows; an empty target gives every bucket the gains of its smoothing. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import ngrams
from . import text as tx

BUCKETS = 10_000


class Interned:
    """The distinct n-grams among ranges of a buffer. ``slot``: of each occurrence; ``owner``: of each slot the first
    occurrence that took it, or -1; ``bucket`` and ``count`` of each slot."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int):
        self.buffer, self.starts, self.lengths = buffer, starts, lengths
        capacity = 1 << max(4, (2 * len(starts)).bit_length())
        self._lanes = np.ndarray(len(buffer) - 7, "<u8", buffer=buffer, strides=(1,))
        keys = ngrams.xxh64(buffer, starts, lengths)
        self.owner, self.slot = np.full(capacity, -1, np.int64), np.empty(len(starts), np.int64)
        place, pending = (keys & np.uint64(capacity - 1)).astype(np.int64), np.arange(len(starts))
        while len(pending):
            at = place[pending]
            free = self.owner[at] < 0
            self.owner[at[free]] = pending[free]  # of several that want one slot, one gets it
            holder = self.owner[at]
            same = keys[holder] == keys[pending]
            same[same] = self._equal(holder[same], pending[same])
            self.slot[pending[same]] = at[same]
            pending = pending[~same]
            place[pending] = (place[pending] + 1) & (capacity - 1)
        self.count = np.bincount(self.slot, minlength=capacity)
        self.taken = np.flatnonzero(self.owner >= 0)
        raw, who = memoryview(buffer), self.owner[self.taken]
        self.bucket = np.zeros(capacity, np.int64)
        self.bucket[self.taken] = [zlib.crc32(raw[a : a + n]) % buckets for a, n in zip(starts[who].tolist(), lengths[who].tolist())]

    def _equal(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the ranges hold the same bytes, eight at a time."""
        same = self.lengths[left] == self.lengths[right]
        open_ = np.flatnonzero(same & (left != right))
        done = 0
        while len(open_):
            a, b = self.starts[left[open_]] + done, self.starts[right[open_]] + done
            rest = self.lengths[left[open_]] - done
            differ = self._lanes[a] ^ self._lanes[b]
            tail = np.uint64(8) * np.clip(rest, 0, 8).astype(np.uint64)
            differ &= np.where(tail < 64, (np.uint64(1) << (tail & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
            same[open_[differ != 0]] = False
            done += 8
            open_ = open_[(differ == 0) & (rest > 8)]
        return same

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket[self.taken], weights=self.count[self.taken], minlength=buckets).astype(np.int64)


def _occurrences(texts: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, lengths, text, words per text) of all runs of 1 to ``longest`` words."""
    buffer, starts, ends, at = ngrams.packed_words(texts, tx.ALNUM)
    first, last, text = [], [], []
    for width in range(1, longest + 1):
        a, b, cuts = ngrams.runs(at, width, short=False)
        first.append(a)
        last.append(b)
        text.append(np.repeat(np.arange(len(at) - 1), np.diff(cuts)))
    first, last = np.concatenate(first), np.concatenate(last)
    return buffer, starts[first], ends[last] - starts[first], np.concatenate(text), np.diff(at)


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of n-grams in each bucket; each task sends one row per bucket at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in tx.slices(batches, "text"):
            buffer, starts, lengths, _, _ = _occurrences(batch.column("text"), longest)
            total += Interned(buffer, starts, lengths, buckets).counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    buckets = len(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            buffer, starts, lengths, text, words = _occurrences(batch.column("text"), longest)
            table = Interned(buffer, starts, lengths, buckets)
            each = gain[table.bucket][table.slot]
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, text, each)
            features = np.bincount(text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row. Drawn are ``percent`` of the rows with ``least_words`` or more,
    those of the highest scores, ranked from 1 on; the rank of all others is null."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = weighed(docs, gain, longest).withColumn("score", (F.col("weight") + noise).cast("long"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    fits = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = rows.where(fits).count() * percent // 100
    # One total order over all partitions, however many rows share a score; the place follows from rows per partition.
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    ordered = rows.where(fits).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ordered = materialise(ordered.select("doc_id", "n_features", "weight", "score", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")))
    before, starts = 0, []
    for r in sorted(ordered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, before long"))  # a row per partition
    rank = F.col("before") + F.col("place") + 1
    top = ordered.join(offsets, "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = rows.where(~fits).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return top.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, all columns."""
    name = tx.spare(docs, "_drawn")
    drawn = ranked(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias(name))
    return docs.join(drawn, docs["doc_id"].cast("long") == F.col(name), "left_semi")
