"""Exact top-k inner products of integer vectors by term-at-a-time accumulation over blocks.

A component is a term. A block of candidates holds a posting list per term: vectors and weights. Each query row walks its
non-zero terms and adds weight times weights into a dense array of scores over the block; long lists are kept as dense
rows, whose zeros add nothing. The block's k best come out by partition selection and meet in a merge per query.

Candidates and queries are dealt to blocks of bounded size by a hash of the id, rows of packed bytes in the narrowest
type that holds them. Blocks form groups, and every group of queries meets every group of candidates in a task, which
takes the candidates block by block and keeps the k best of its queries so far. Blocks are stored once, not once per
pair, and there are about ``MOST_TASKS`` tasks for any number of rows, so the driver's share doesn't grow with the pairs;
from 4 * ``MOST_TASKS`` blocks of queries on there is a task per ``HELD`` of them. Rows: a null id, a null vector or one with null
or non-finite components takes no part; rows that repeat an id count once, with the smallest of their vectors; a missing
component counts as zero, so that an empty vector scores 0 with every other; ties go to the smaller id. Components so
large that a score could leave 64 bits raise an error. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, materialise

BLOCK, DENSE_SHARE = 16_384, 0.25
#: Tasks for a small grid; the most for a large one; groups of candidates, each of which yields k rows per query; blocks of
#: queries whose best a worker holds.
TASKS, MOST_TASKS, GROUPS, HELD = 24, 1024, 16, 4
NONE = np.iinfo(np.int64).min  # below every score
_HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, column: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); one row per id."""
    x = F.col(column).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.transform(x, lambda c: F.floor(c * scale))).alias("v"))
    return rows.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))


class Postings:
    """The lists of one block; vectors are in ascending order of id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.most, self.lists = ids, max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))), []
        self.columns = np.ascontiguousarray(rows.T)
        for weights in self.columns:
            where = np.flatnonzero(weights)
            dense = len(where) > DENSE_SHARE * len(ids)
            self.lists.append(None if dense else (where, weights[where]))
        self._scores, self._buffer = {}, {}

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The query's dense score array, in 32 bits where no sum can leave them."""
        most = self.most * max(abs(int(query.max(initial=0))), abs(int(query.min(initial=0)))) * max(1, len(self.lists))
        if most >= 1 << 63:
            raise OverflowError("inner products leave 64 bits")
        wide = most >= 1 << 31
        kind = np.int64 if wide else np.int32
        if kind not in self._scores:
            self._scores[kind], self._buffer[kind] = np.empty(len(self.ids), kind), np.empty(len(self.ids), kind)
            self.narrow = self.columns.astype(kind)
        scores, buffer = self._scores[kind], self._buffer[kind]
        scores[:] = 0
        columns = self.columns if wide else self.narrow
        for term in np.flatnonzero(query[: len(self.lists)]):
            weight, listed = kind(query[term]), self.lists[term]
            if listed is None:
                np.multiply(columns[term], weight, out=buffer)
                scores += buffer
            else:
                scores[listed[0]] += (listed[1] * weight).astype(kind)
        return scores

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.scores(query)
        own = np.searchsorted(self.ids, query_id)
        own = own if own < len(self.ids) and self.ids[own] == query_id else -1
        n = len(scores) - (own >= 0)
        if own >= 0:
            scores[own] = np.iinfo(scores.dtype).min
        if n > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = np.flatnonzero(scores > least)
            some = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
        else:
            some = np.flatnonzero(np.arange(len(scores)) != own)
        return self.ids[some], scores[some].astype(np.int64)


class Best:
    """The k best of each query of a block so far; places not taken yet score ``NONE``."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.ids, self.scores = query_ids, np.zeros((len(query_ids), k), np.int64), np.full((len(query_ids), k), NONE)

    def meet(self, postings: Postings, queries: np.ndarray) -> None:
        k = self.ids.shape[1]
        ids, scores = np.zeros_like(self.ids), np.full_like(self.scores, NONE)
        for i, query in enumerate(queries):
            some, values = postings.best(int(self.query_ids[i]), query, k)
            ids[i, : len(some)], scores[i, : len(some)] = some, values
        ids, scores = np.concatenate([self.ids, ids], axis=1), np.concatenate([self.scores, scores], axis=1)
        order = np.lexsort((ids, ~scores))[:, :k]
        self.ids, self.scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def batches(self, most: int = 2048) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.query_ids), most):
            some = slice(low, low + most)
            there = self.scores[some] != NONE
            columns = [np.repeat(self.query_ids[some], there.sum(axis=1)), self.ids[some][there], self.scores[some][there]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _grid(n: int, q: int, block: int) -> tuple[int, int, int, int]:
    """Blocks and groups of candidates, blocks and groups of queries."""
    n_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-q // block))
    q_blocks = max(q_blocks, min(16, q, TASKS // n_blocks))  # smaller ones, so that a small grid has tasks enough
    q_groups = max(min(q_blocks, 32), -(-q_blocks // HELD))
    return n_blocks, min(n_blocks, max(GROUPS, 96 // q_groups), max(1, MOST_TASKS // q_groups)), q_blocks, q_groups


def _packed(rows: DataFrame, blocks: int, groups: int, side: str) -> DataFrame:
    """One row per block: ids and vectors as bytes. A block goes through one task, which bounds its size; a partition is a group."""

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("vec_id")
        width = max(map(len, frame["v"]))
        table = np.zeros((len(frame), width), "<i8")
        for k, v in enumerate(frame["v"]):
            table[k, : len(v)] = v
        least, most = table.min(initial=0), table.max(initial=0)
        size = next(x for x in (1, 2, 4, 8) if -(1 << 8 * x - 1) <= least and most < 1 << 8 * x - 1)
        return pd.DataFrame({"block": [key[0]], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "rows": [table.astype(f"<i{size}").tobytes()], "width": [width], "size": [size]})

    block = F.pmod(F.xxhash64("vec_id", F.lit(side)), F.lit(blocks)).alias("block")
    dealt = rows.select(block, "vec_id", "v").groupBy("block").applyInPandas(run, "block long, ids binary, rows binary, width int, size int")
    return dealt.repartitionById(groups, F.pmod("block", F.lit(groups)).cast("int"))


def _unpacked(ids: bytes, rows: bytes, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(rows, f"<i{size}").reshape(len(ids), width).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK) -> DataFrame:
    """For every row of ``vectors`` (vec_id, v) with ``is_query``: query_id, rank (from 1), vec_id, score of its k best."""
    rows = materialise(vectors)
    queries = rows.where(is_query)
    n_blocks, n_groups, q_blocks, q_groups = _grid(rows.count(), queries.count(), block)
    left, right = _packed(rows, n_blocks, n_groups, "candidate"), _packed(queries, q_blocks, q_groups, "query")
    # Candidates come one block after the other, the group of queries stays; neither is broadcast by the driver.
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right.toDF(*(f"q_{c}" for c in right.columns)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = {}, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda *names: [batch.column(c)[r].as_py() for c in names]  # noqa: E731, B023
                (this, other) = get("block", "q_block")
                if this != at:
                    postings, at = Postings(*_unpacked(*get("ids", "rows", "width", "size"))), this
                q_ids, q_rows = _unpacked(*get("q_ids", "q_rows", "q_width", "q_size"))
                if other not in best:
                    best[other] = Best(q_ids, k)
                best[other].meet(postings, q_rows)
        for held in best.values():
            yield from held.batches()

    with bounded_batches(rows.sparkSession):
        hits = materialise(pairs.mapInArrow(run, _HITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
