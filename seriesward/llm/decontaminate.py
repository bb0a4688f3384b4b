"""Which documents hold passages of benchmark items: a prefix-filtered join of word shingles, confirmed word by word.

An item is cut into windows of consecutive words. A document that holds a window holds all its shingles, so joining on one
of them is enough: the rarest over all documents (the prefix that containment needs). A match fixes where the window would
begin; windows that would reach over an end of the document are dropped, and the rest are compared word by word.

Items are dealt to slices of bounded size, long ones in parts that overlap by all but one word of a window; each slice's
index is shipped to the tasks, and documents pass once per slice, carrying what earlier slices found. Rows: a null or wordless text has no words; items without words or id take no part;
rows that repeat an item_id are one item; rows that repeat a doc_id are separate documents. An empty table gives no rows
(documents) or no hits (benchmark).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import text as tx

WINDOW, SHINGLE = 10, 3
SLICE_CHARS = 8_000_000
PART_WORDS = 100_000  # of an item in one slice
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FACTOR = -7046029254386353131  # of the shingle codes, odd; they wrap in 64 bits, and words are compared in the end
HITS = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string>"
_EMPTY = "named_struct('starts', array(), 'ends', array(), 'items', array())"
_FOUND = "struct<starts:array<int>,ends:array<int>,items:array<long>>"


class Index:
    """The windows of some items, and by shingle length the sorted shingle codes."""

    def __init__(self, items: list[tuple[int, str]], window: int, shingle: int):
        column = pa.array([t for _, t in items], pa.large_string())
        words, at = tx.split_words(tx.translated(column, tx.ALNUM))
        codes, self.words = tx.coded(words)
        self.vocabulary = {w: k + 1 for k, w in enumerate(self.words)}
        owners: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            own = (codes[at[k] : at[k + 1]] + 1).tolist()
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                owners.setdefault(tuple(own[i : i + size]), set()).add(item)
        self.windows = sorted(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        self.width = lambda w: min(shingle, len(w))
        self.shingles = {}
        for s in sorted({self.width(w) for w in self.windows}):
            self.shingles[s] = np.unique([self.code(w[i : i + s]) for w in self.windows if self.width(w) == s for i in range(len(w) - s + 1)])

    def code(self, words: Iterable[int]) -> int:
        out = 0
        for w in words:
            out = (out * _FACTOR + w) & 0xFFFFFFFFFFFFFFFF
        return out - (out >> 63 << 64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Every word's number in the vocabulary (0: none), and where each text's words begin."""
        words, at = tx.split_words(tx.translated(texts, tx.ALNUM))
        codes, distinct = tx.coded(words)
        known = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), np.int64, len(distinct))
        return (known[codes] if len(distinct) else np.empty(0, np.int64)), at

    def matches(self, ids: np.ndarray, at: np.ndarray, s: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle of ``s`` words begins that is ``among`` these sorted codes, and which it is."""
        if len(ids) < s or not len(among):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 0
        ok = known[: len(ids) - s + 1].copy()
        for j in range(1, s):
            ok &= known[j : len(ids) - s + 1 + j]
        where = np.flatnonzero(ok)
        text = np.searchsorted(at, where, side="right")
        where = where[where + s <= at[text]]
        code = np.zeros(len(where), np.int64)
        for j in range(s):
            code = code * _FACTOR + ids[where + j]
        place = np.minimum(np.searchsorted(among, code), len(among) - 1)
        hit = among[place] == code
        return where[hit], place[hit]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Order the shingles by rarity and take each window's rarest as its prefix."""
        chosen: dict[int, dict[int, list]] = {s: {} for s in self.shingles}
        for k, w in enumerate(self.windows):
            s = self.width(w)
            codes = [self.code(w[i : i + s]) for i in range(len(w) - s + 1)]
            o = min(range(len(codes)), key=lambda i: (counts[s][np.searchsorted(self.shingles[s], codes[i])], codes[i], i))
            chosen[s].setdefault(codes[o], []).append((k, o))
        self.prefix = {}
        for s, by_code in chosen.items():
            codes = np.array(sorted(by_code), np.int64)
            lists = [by_code[c] for c in codes.tolist()]
            flat = np.array([x for one in lists for x in one], np.int64).reshape(-1, 2)
            self.prefix[s] = codes, np.cumsum([0, *map(len, lists)]), flat[:, 0], flat[:, 1]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        longest = int(self.lengths.max()) if len(self.windows) else 0
        self.table = np.zeros((len(self.windows), longest), np.int64)
        for k, w in enumerate(self.windows):
            self.table[k, : len(w)] = w

    def occurrences(self, ids: np.ndarray, at: np.ndarray, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where windows begin, and which."""
        for s, (codes, ends, window, offset) in self.prefix.items():
            where, place = self.matches(ids, at, s, codes)
            many = np.diff(ends)[place]
            total, first = np.cumsum(many), 0
            while first < len(where):
                done = total[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(total, done + chunk, side="right")))
                some = tx.gather(ends[place[first:last]], many[first:last])
                w, start = window[some], np.repeat(where[first:last], many[first:last]) - offset[some]
                text = np.searchsorted(at, np.repeat(where[first:last], many[first:last]), side="right")
                size = self.lengths[w]
                inside = (start >= at[text - 1]) & (start + size <= at[text])
                w, start, size = w[inside], start[inside], size[inside]
                same = np.ones(len(w), bool)
                for j in range(self.table.shape[1]):
                    live = np.flatnonzero(same & (j < size))
                    same[live] = ids[start[live] + j] == self.table[w[live], j]
                yield start[same], w[same]
                first = last


_indexes: dict = {}


def _index(key: str, items, window: int, shingle: int, counts=None) -> Index:
    """The worker's index of this slice; one is kept."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items, window, shingle)
        if counts is not None:
            _indexes[key].choose(counts)
    return _indexes[key]


def _shingle_counts(docs: DataFrame, items: list, window: int, shingle: int, key: str) -> dict[int, np.ndarray]:
    """How often each shingle of the items occurs in all documents. One row per task and shingle that occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, items, window, shingle)
        totals = {s: np.zeros(len(c), np.int64) for s, c in index.shingles.items()}
        for batch in tx.slices(batches, "text"):
            ids, at = index.ids(batch.column("text"))
            for s, codes in index.shingles.items():
                totals[s] += np.bincount(index.matches(ids, at, s, codes)[1], minlength=len(codes))
        for s, n in totals.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"s": pa.array(np.full(len(k), s, np.int32)), "k": pa.array(k), "n": pa.array(n[k])})

    index = Index(items, window, shingle)
    counts = {s: np.zeros(len(c), np.int64) for s, c in index.shingles.items()}
    for r in docs.select("text").mapInArrow(run, "s int, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.s][r.k] = r.n
    return counts


def _step(docs: DataFrame, items: list, counts: dict, window: int, shingle: int, key: str, column: str, extra: str, final: bool) -> DataFrame:
    kind = T._parse_datatype_string(HITS if final else _FOUND)
    fields = [f for f in docs.schema.fields if f.name != column and not (final and f.name == extra != "text")]
    schema = T.StructType([*fields, T.StructField(column, kind)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, items, window, shingle, counts)
        for batch in tx.slices(batches, extra):
            ids, at = index.ids(batch.column(extra))
            starts, windows = map(np.concatenate, zip(*[(np.empty(0, np.int64),) * 2, *index.occurrences(ids, at)]))
            text = np.searchsorted(at, starts, side="right") - 1
            begins, ends, found = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for k, old in enumerate(batch.column(column).to_pylist()):
                begins[k], ends[k], found[k] = list(old["starts"]), list(old["ends"]), set(old["items"])
            for k, b, w in zip(text.tolist(), (starts - at[text]).tolist(), windows.tolist()):
                begins[k].append(b)
                ends[k].append(b + int(index.lengths[w]))
                found[k].update(index.items[w])
            rows = []
            for k, n in enumerate(np.diff(at).tolist()):
                if not final:
                    rows.append({"starts": begins[k], "ends": ends[k], "items": sorted(found[k])})
                    continue
                hit = 0
                if begins[k]:
                    turns = np.bincount(begins[k], minlength=n + 1) - np.bincount(ends[k], minlength=n + 1)
                    hit = int((np.cumsum(turns)[:n] > 0).sum())
                names = ",".join(sorted(map(str, found[k])))
                rows.append({"n_words": n, "n_hit": hit, "n_items": len(found[k]), "items_sha256": hashlib.sha256(names.encode()).hexdigest()})
            arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]) if final else pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, arrow)], names=[*(f.name for f in fields), column])

    return docs.mapInArrow(run, schema)


def _parts(items: DataFrame, window: int) -> DataFrame:
    """The items, those of more than ``PART_WORDS`` words in parts that hold every window between them."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.size("words") - (window - 1), F.lit(max(1, PART_WORDS - (window - 1))))
    parts = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, PART_WORDS)))
    cut = F.when(F.size("words") > max(PART_WORDS, window), parts).otherwise(F.array("text"))
    return items.withColumn("words", words).select("item_id", F.explode(cut).alias("text")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, column: str = "hits", window: int = WINDOW, shingle: int = SHINGLE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``docs`` with the struct ``column``: n_words, n_hit (words inside any occurrence of a window), n_items and
    items_sha256 (of the sorted ids of items with occurring windows, comma-joined). A column of that name is replaced."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    items = materialise(_parts(items, window))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_chars))
    docs, extra = tx.with_text(docs.drop(column), docs["text"])
    docs = docs.withColumn(column, F.expr(_EMPTY).cast(_FOUND))
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        own = [(r.item_id, r.text) for r in own]
        key = hashlib.sha256(repr((own, window, shingle)).encode()).hexdigest()
        counts = _shingle_counts(docs.select(F.col(extra).alias("text")), own, window, shingle, key)
        docs = _step(docs, own, counts, window, shingle, f"{key}-chosen", column, extra, k == slices - 1)
        if k < slices - 1:
            docs = materialise(docs)
    return docs


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without an occurrence of any window; all columns stay."""
    name = tx.spare(docs, "_hits")
    return hits(docs, benchmark, name, **options).where(F.col(name)["n_hit"] == 0).drop(name)
