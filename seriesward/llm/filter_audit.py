"""What each of five text filters removes, in every order, from one pass over the documents.

A document fails some of the filters A to E. Its truth table is a 32-bit word: bit S is set if it survives all filters of
the subset S. Positional popcounts of these words, by a carry-save adder network over whole arrays, give the survivors of
every subset per part, and likewise of the documents labelled good or toxic. 32 counts a part hold all that the
120 orders ask: what a filter removes after others is the difference of two subsets.

Filters: A under ``least_words`` words; B fewer distinct words than half of the words; C capitals A-Z above 3 percent of the
code points; D any of # $ % & * |; E a text identical (same SHA-256) to that of a smaller doc_id anywhere in the table.

Rows: a null text is empty, a null lang the part ''. A null doc_id takes no part in E and has no labels. Rows that repeat a
doc_id are documents of their own; none is smaller than the other. Labels of one doc_id count if any row says so. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import text as tx

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
COMMON = 1_000  # a text of more than one in so many rows counts as hot; there are fewer such texts than this
_CAPITAL, _SIGN, _POINT = 1, 2, 4
#: What a byte counts as: a capital, one of D's signs, the first byte of a code point.
_KINDS = np.array([_CAPITAL * (65 <= b <= 90) + _SIGN * (chr(b) in "#$%&*|") + _POINT * (b & 0xC0 != 0x80) for b in range(256)], np.uint8)
#: The word of each combination of failed filters.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def failures(texts: pa.Array, least_words: int = 200) -> np.ndarray:
    """Filters A to D that each text fails, as bits."""
    column = tx.filled(texts)
    words, at = tx.split_words(column)
    n = np.diff(at)
    d = words.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(d.dictionary)) + codes)
    distinct = np.bincount(pairs // max(1, len(d.dictionary)), minlength=len(n))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    kinds = _KINDS[np.frombuffer(data, np.uint8)[: offsets[-1]]] if data is not None and data.size else np.empty(0, np.uint8)

    def count(kind: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum((kinds & kind) > 0)])[offsets])

    failed = (n < least_words, 100 * distinct < 50 * n, 100 * count(_CAPITAL) > 3 * count(_POINT), count(_SIGN) > 0)
    return sum(x.astype(np.int32) << k for k, x in enumerate(failed))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set. Three words of a weight become one of that weight and a carry of twice it,
    until two are left of each weight."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            m = len(words) // 3
            a, b, c = words[:m], words[m : 2 * m], words[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * m :]])
        counts += weight * ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        words, weight = (np.concatenate(carries) if carries else words[:0]), 2 * weight
    return counts


def judged(docs: DataFrame, least_words: int = 200) -> DataFrame:
    """doc_id, part and failed (bits of A to E) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            columns = [batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(failures(batch.column("text"), least_words))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "failed"])

    rows = materialise(rows.mapInArrow(run, "doc_id long, part string, digest binary, failed int"))
    same = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    # A share of the rows bounds the number of hot texts, whose rows stay where they are; the others' keys are small.
    hot = F.broadcast(same.where(F.col("n") > rows.count() / COMMON).select("digest", "least"))
    near = rows.join(hot, "digest")
    rest = rows.join(hot, "digest", "left_anti").join(same.select("digest", "least"), "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return near.unionByName(rest).select("doc_id", "part", F.col("failed").bitwiseOR(F.shiftleft(copy, 4)).alias("failed"))


def survivors(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, documents, good and toxic: arrays of the survivors of each subset of filters."""
    one = lambda c: F.max((F.col(c).cast("int") == 1).cast("int")).alias(c)
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality"), F.col("toxic")).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(one("quality"), one("toxic"))
    marked = rows.join(marks, "doc_id", "left").select("part", "failed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = WORDS[batch.column("failed").to_numpy()]
            masks = [np.ones(len(words), bool), *(batch.column(c).to_numpy() == 1 for c in ("quality", "toxic"))]
            part = batch.column("part").dictionary_encode()
            codes = part.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(part.dictionary) + 1))
            counts = [[positional_popcount(words[own[m[own]]]) for own in (order[a:b] for a, b in zip(cuts, cuts[1:]))] for m in masks]
            yield pa.RecordBatch.from_arrays([part.dictionary, *(pa.array(c, pa.list_(pa.int64())) for c in counts)], names=["part", "documents", "good", "toxic"])

    kinds = ("documents", "good", "toxic")
    counted = marked.mapInArrow(run, "part string, documents array<long>, good array<long>, toxic array<long>")
    sums = [F.sum(F.col(k)[s]).alias(f"{k}{s}") for k in kinds for s in range(SUBSETS)]
    return counted.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{k}{s}" for s in range(SUBSETS))).alias(k) for k in kinds))


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    n, whole = len(FILTERS), SUBSETS - 1
    orders = list(permutations(range(n)))
    steps = [(o, k, sum(1 << f for f in o[:k])) for o in orders for k in range(n)]
    own, before = np.array([o[k] for o, k, _ in steps]), np.array([b for _, _, b in steps])
    label, step = ["".join(FILTERS[f] for f in o) for o, _, _ in steps], np.array([k + 1 for _, k, _ in steps], np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                every, good, toxic = (np.array(batch.column(c)[r].as_py(), np.int64) for c in ("documents", "good", "toxic"))
                bit = 1 << own
                removed = every[before] - every[before | bit]
                shapley = np.array([sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(every[s] - every[s | 1 << f]) for s in range(SUBSETS) if not s >> f & 1) for f in range(n)], np.int64)
                columns = [every[before | bit], removed, every[0] - every[bit] - removed, every[whole & ~bit] - every[whole], good[before] - good[before | bit], toxic[before] - toxic[before | bit], shapley[own]]
                part = pa.array([batch.column("part")[r].as_py()] * len(steps), pa.string())
                yield pa.RecordBatch.from_arrays([part, pa.array(label), pa.array(step), *(pa.array(c) for c in columns)], names=["part", "filter_order", "step", *names])

    return counts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def audit(docs: DataFrame, labels: DataFrame, least_words: int = 200) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(survivors(judged(docs, least_words), labels))
