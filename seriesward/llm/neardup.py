"""Near duplicates by word shingles: MinHash bands propose, odd sketches estimate, full sets decide.

Documents with the same set form one class, told by the set's fingerprint and numbered; all links are between classes,
whatever doc_ids their rows carry. Classes that share a band meet in cells of bounded size; there the XOR of their odd sketches (parity bitmaps of MinHash samples, then of the whole sets)
drops pairs that are surely too different. Surviving pairs are confirmed on full sets. Pairs inside one component need no
test, so a first round takes the nearest pairs that would join components (a spanning forest per cell), and a last round
takes every surviving pair between components that are still apart; no link between components is lost.

Rows: no words or a null text is an empty set, linked with nothing. A null doc_id is linked with nothing and kept. Rows
that repeat a doc_id each follow their own text; a link of one says nothing of the others. An empty table gives no rows.
Other columns are ignored. ``deduplicated`` leaves one of rows that repeat a doc_id and text, a null doc_id too; it drops a
text only for one that stays and is reached from it by links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import shingles as sh
from . import text as tx
from .components import components

BLOCK = 512
PAIRS_AT_ONCE = 200_000
SLICE_BYTES = 1 << 20  # of text; its hashes take many times that
FOREST_ROUNDS = 1
_SKETCHED = "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, bands array<long>, odd binary, parity binary"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of it."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """Hashes of the text, set size, set fingerprint, band keys and odd sketches of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text", SLICE_BYTES):
            sets, at = sh.shingle_sets(batch.column("text"), width)
            n, prints, mins = np.diff(at), sh.fingerprints(sets, at), sh.samples(sets, at)
            full = np.cumsum(n > 0) - 1
            place = pa.array(full, mask=n == 0)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1, dtype=np.int32) * sh.BANDS), pa.array(sh.bands(mins).ravel()))
            odd = pa.array([x.tobytes() for x in sh.odd_sketches(mins)], pa.binary())
            parity = pa.array(sh.parities(sets, at), pa.binary())
            columns = [*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), keys.take(place), odd.take(place), parity.take(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "bands", "odd", "parity"])

    return _texts(docs).select("doc_id", "t1", "t2", "text").mapInArrow(run, _SKETCHED)


def _surviving(cell, start, doc, comp, block, diagonal, size, odd, parity, most, similarity):
    """Batches of index pairs of rows in one cell and different components whose sketches allow a link, nearest first.
    ``comp`` may change in between."""
    before = np.arange(len(cell)) - start
    ends, first = np.cumsum(before), 0
    while first < len(cell):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
        left = np.repeat(np.arange(first, last), before[first:last])
        right = tx.gather(start[first:last], before[first:last])
        first = last
        fits = (comp[left] != comp[right]) & (diagonal[left] | (block[left] != block[right]))
        fits &= np.minimum(size[left], size[right]) >= similarity * np.maximum(size[left], size[right])
        left, right = left[fits], right[fits]
        near = np.bitwise_count(odd[left] ^ odd[right]).sum(axis=1) <= most
        left, right = left[near], right[near]
        apart, bits = sh.parity_distances(parity, left, right)
        total = size[left] + size[right]
        allowed = apart <= sh.most_parity(total, bits, similarity)
        left, right, apart = left[allowed], right[allowed], (apart / np.maximum(total, 1))[allowed]
        order = np.lexsort((right, left, apart))
        yield left[order], right[order]


def _forest(batches, comp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of these pairs, those that join components not joined before; ``comp`` (numbers from 0 on) follows."""
    parent = np.arange(int(comp.max(initial=-1)) + 1)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for left, right in batches:
        while len(left):
            for a, b in zip(left[:2048].tolist(), right[:2048].tolist()):
                x, y = root(int(comp[a])), root(int(comp[b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    yield a, b
            while not np.array_equal(flat := parent[parent], parent):
                parent[:] = flat
            comp[:] = parent[comp]
            apart = comp[left] != comp[right]
            left, right = left[apart], right[apart]


def _pairs(cells: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Pairs (a, b) to confirm, from rows sorted by cell."""
    most = sh.most_odd_bits(similarity)

    def found(rows: pa.Table) -> pa.RecordBatch:
        get = lambda c: rows[c].to_numpy()
        key, i, j, doc = get("key"), get("i"), get("j"), get("doc_id")
        comp = np.unique(get("comp"), return_inverse=True)[1]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        cell = np.cumsum(new) - 1
        start = np.flatnonzero(new)[cell]
        odd = np.frombuffer(b"".join(rows["odd"].to_pylist()), np.uint64).reshape(len(cell), -1)
        pairs = _surviving(cell, start, doc, comp, get("block"), i == j, get("n_shingles"), odd, rows["parity"].to_pylist(), most, similarity)
        if forest:
            chosen = list(_forest(pairs, comp))
        else:
            chosen = [x for left, right in pairs for x in zip(left.tolist(), right.tolist())]
        out = {(max(int(doc[a]), int(doc[b])), min(int(doc[a]), int(doc[b]))) for a, b in chosen}
        a, b = zip(*sorted(out)) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            last = tuple(rows[c][-1].as_py() for c in ("key", "i", "j"))
            same = (rows["key"].to_numpy() == last[0]) & (rows["i"].to_numpy() == last[1]) & (rows["j"].to_numpy() == last[2])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = rows.slice(cut)
            if cut:
                yield found(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield found(held)

    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "doc_id")
    return cells.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach ``percent`` of intersection over union. A class's text is that of
    its first row (rep, t1, t2)."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = materialise(classes.join(ends, "id", "left_semi").select("id", F.col("rep").alias("doc_id"), "t1", "t2"))
    texts = materialise(_texts(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))  # few ids, one column
    texts = materialise(texts.join(wanted, ["doc_id", "t1", "t2"]).select("id", "text"))
    many = materialise(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not many.isEmpty():  # rows that repeat a doc_id and text
        one = texts.join(many, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
        texts = materialise(texts.join(many, "id", "left_anti").unionByName(one))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "left", SLICE_BYTES):
            one, at = sh.shingle_sets(batch.column("left"), width)
            two, to = sh.shingle_sets(batch.column("right"), width)
            keep = []
            for k in range(batch.num_rows):
                x, y = one[at[k] : at[k + 1]], two[to[k] : to[k + 1]]
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, root (the group's number, null without a set or doc_id), least (its smallest doc_id)."""
    rows = materialise(sketched(docs, width))
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("first"))
    classes = classes.select("s1", "s2", F.col("first.doc_id").alias("rep"), "first.t1", "first.t2", F.monotonically_increasing_id().alias("id"))
    classes = materialise(classes)
    own = ["s1", "s2", "rep", "t1", "t2"]  # of the join and of what is unique, so that rows move once
    reps = sets.withColumnRenamed("doc_id", "rep").join(classes, own).dropDuplicates(own)
    reps = materialise(reps.drop("rep", "t1", "t2").withColumnRenamed("id", "doc_id"))
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = materialise(keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    sketches = materialise(reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "odd", "parity"))

    roots = None
    found = None
    for step in range(FOREST_ROUNDS + 1):
        if roots is None:
            apart = members.withColumn("comp", F.col("doc_id"))
        else:
            labelled = materialise(members.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root"))
            mixed = materialise(labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key"))
            apart = labelled.join(mixed, "key")
        block = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")
        cells = apart.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("key", F.greatest("block", "other").alias("i"), F.least("block", "other").alias("j"), "block", "doc_id", "comp")
        pairs = materialise(_pairs(cells.join(sketches, "doc_id"), percent / 100, step < FOREST_ROUNDS))
        if pairs.isEmpty():
            break
        new = materialise(confirmed(pairs, classes, docs, width, percent))
        found = new if found is None else found.unionByName(new)
        roots = components(found)

    if roots is None:
        classes = classes.select("s1", "s2", F.col("id").alias("root"), F.col("rep").alias("least"))
    else:
        classes = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = classes.groupBy("root").agg(F.min("rep").alias("least"))
        classes = classes.join(least, "root").select("s1", "s2", "root", "least")
    out = rows.select("doc_id", "t1", "t2", "n_shingles", "s1", "s2").join(materialise(classes), ["s1", "s2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "t1", "t2", "n_shingles", F.when(linked, F.col("root")).alias("root"), F.when(linked, F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept."""
    component = F.coalesce("least", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of ``docs``, that of the smallest doc_id (then hash of the text); of rows that repeat a doc_id
    and text, or a text without doc_id, one stays. All columns stay."""
    rows = materialise(_grouped(docs, width, percent).where("root is not null").select("root", "doc_id", "t1", "t2"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("first"))
    names = {c: tx.spare(docs, "_" + c) for c in ("doc_id", "t1", "t2")}
    gone = rows.join(first, "root").where(F.struct("doc_id", "t1", "t2") != F.col("first"))
    gone = materialise(gone.select(*(F.col(c).alias(n) for c, n in names.items())).distinct())
    docs = _without_repeats(docs)
    text = docs["text"].cast("string")
    same = (docs["doc_id"].cast("long") == gone[names["doc_id"]]) & (F.xxhash64(text) == gone[names["t1"]]) & (F.xxhash64(F.lit(1), text) == gone[names["t2"]])
    return docs.join(gone, same, "left_anti")


def _without_repeats(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text, nulls being equal: the one whose columns have the smallest hash. Only rows that
    are repeated are moved, and merged where they are before that."""
    text = docs["text"].cast("string")
    key = {tx.spare(docs, c): x for c, x in (("_d", docs["doc_id"].cast("long")), ("_t1", F.xxhash64(text)), ("_t2", F.xxhash64(F.lit(1), text)))}
    keyed = docs.select("*", *(x.alias(c) for c, x in key.items()))
    many = keyed.select(*key).groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    many = materialise(many.toDF("d", "t1", "t2"))
    if many.isEmpty():
        return docs
    same = [keyed[c].eqNullSafe(many[m]) for c, m in zip(key, many.columns)]
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("_row")
    one = keyed.join(many, same, "left_semi").groupBy(*key).agg(first).select("_row.*")
    return keyed.join(many, same, "left_anti").select(*docs.columns).unionByName(one)
