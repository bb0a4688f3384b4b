"""Near duplicates by SimHash under the generalised pigeonhole principle.

A fingerprint has 64 bits; each is the majority of that bit over the XXH64 of all word shingles. Fingerprints at most
``distance`` bits apart are linked. Documents with one fingerprint form a class; the search runs over distinct ones.

Bits are dealt to m parts so that correlated bits share a part. Two fingerprints within the distance are within t_i in
some part i, whatever whole numbers t_i (-1: not looked at) sum to distance - m + 1. Each fingerprint gets thresholds of
its own: dynamic programming over the parts takes those of the fewest candidates, estimated from histograms of pieces of
the parts, so that parts in which it has many neighbours are skipped or matched exactly and rare ones take the slack. It
looks itself up under every value of part i within t_i; all are indexed under their own values. Rows that meet in a
bucket are verified on all bits, and a bucket yields a spanning forest of its links. A bucket of more than ``LARGE`` rows
is dealt to cells of about that size, each of which also gets a few leaders, the same in all; that joins a dense group
without comparing all its pairs. What then lies outside the bucket's largest component meets every row of the bucket, cell
by cell, so no link between components is lost and no task holds a larger group.

Rows: a null or empty text, or one without words, has fingerprint zero, linked like any other; fewer words than the
width are one shingle. A null doc_id has a fingerprint, is linked with nothing and has no component. Rows that repeat a
doc_id each follow their own text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import ngrams
from . import text as tx
from .components import components

BITS = 64
LARGE = 2_048
LEADERS = 64  # of a large bucket, in each of its cells
PIECE = 11  # bits of a histogram's values at most
PROBE = 4.0  # cost of one look-up in verified candidates
PAIRS_AT_ONCE = 200_000
ROWS_AT_ONCE = 100_000
_ONES = np.uint64(0x0101010101010101)


def fingerprints(texts: pa.Array, width: int, seed: int) -> np.ndarray:
    """One fingerprint per text. Counts of eight bits at a time stand in the bytes of a word, 255 shingles at most each."""
    buffer, starts, ends, words_at = ngrams.packed_words(texts, ngrams.SPACED)
    first, last, at = ngrams.runs(words_at, width, short=True)
    m = np.diff(at)
    counts = np.zeros((len(m), 8, 8), np.int64)  # text, bit within a byte, byte
    groups = -(-m // 255)
    begin = np.repeat(at[:-1], groups) + 255 * tx.gather(np.zeros(len(m), np.int64), groups)
    text = np.repeat(np.arange(len(m)), groups)
    for low in range(0, len(begin), 4096):
        some = begin[low : low + 4096]
        stop = begin[low + 4096] if low + 4096 < len(begin) else at[-1]
        part = slice(int(some[0]), int(stop))
        hashes = ngrams.xxh64(buffer, starts[first[part]], ends[last[part]] - starts[first[part]], seed)
        for bit in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(bit)) & _ONES, some - some[0])
            np.add.at(counts[:, bit], text[low : low + 4096], sums.astype("<u8").view(np.uint8).reshape(-1, 8))
    major = 2 * counts > m[:, None, None]
    return np.packbits(major.transpose(0, 2, 1).reshape(len(m), BITS), axis=1, bitorder="little").view("<u8").ravel()


def fingerprinted(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            fp = fingerprints(batch.column("text"), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _mapped(fps: DataFrame, f: Callable, names: list[str], schema: str) -> DataFrame:
    """``f`` on the fingerprints of each batch; it yields columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in f(batch.column("fp").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return fps.select("fp").mapInArrow(run, schema)


def correlations(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits: 64 x 64 sums over all fingerprints."""

    def sums(fp: np.ndarray):
        x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        yield [np.arange((BITS + 1) ** 2, dtype=np.int32), np.rint(x.T @ x).astype(np.int64).ravel()]

    both = np.zeros((BITS + 1) ** 2)
    for r in _mapped(fps, sums, ["k", "n"], "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        both[r.k] = r.n
    both = both.reshape(BITS + 1, BITS + 1)
    n, ones = both[-1, -1], both[-1, :-1]
    cov = both[:-1, :-1] * n - np.outer(ones, ones)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return np.abs(cov) / np.outer(spread, spread)


def grouped_bits(related: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of even size: each begins with the most related pair left and takes the bit that is most
    related to it on average."""
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        own = max(combinations(free, 2), key=lambda p: (round(related[p], 9), -p[0], -p[1]))
        own = list(own)[:size]
        free = [b for b in free if b not in own]
        while len(own) < size:
            best = max(free, key=lambda b: (round(related[b, own].mean(), 9), -b))
            own.append(best)
            free.remove(best)
        groups.append(sorted(own))
    return groups


def parts_for(n: int, distance: int) -> int:
    """The number of parts of the least expected cost per fingerprint, for n even ones. The result is the same for any."""

    def cost(m: int) -> float:
        total = 0.0
        for i in range(m):
            width, t = BITS // m, (distance + 1 - m) // m + (i < (distance + 1 - m) % m)
            values = sum(comb(width, e) for e in range(t + 1))
            total += values * (PROBE + n / 2.0**width)
        return total

    return min(range(2, max(2, distance + 1) + 1), key=cost)


class Layout:
    """Where the bits of each part lie, and what is known of their values."""

    def __init__(self, groups: list[list[int]], distance: int):
        self.distance, self.widths = distance, [len(g) for g in groups]
        self.order = [b for g in groups for b in g]
        self.lows = np.concatenate([[0], np.cumsum(self.widths)])[:-1].tolist()
        self.pieces = []  # of each part: (low, width)
        for low, width in zip(self.lows, self.widths):
            k = -(-width // PIECE)
            cut = [low + width * j // k for j in range(k + 1)]
            self.pieces.append([(a, b - a) for a, b in zip(cut, cut[1:])])
        self.n, self.shells = 0, {}

    def arranged(self, fp: np.ndarray) -> np.ndarray:
        """The bits in the order of the parts."""
        out = np.zeros(len(fp), np.uint64)
        for to, bit in enumerate(self.order):
            out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
        return out

    def restored(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for to, bit in enumerate(self.order):
            out |= ((x >> np.uint64(to)) & np.uint64(1)) << np.uint64(bit)
        return out

    def learn(self, fps: DataFrame) -> None:
        """A histogram of each piece's values, at most 2 ** PIECE each; then how many lie at each distance from a value."""
        every = [p for own in self.pieces for p in own]

        def count(fp: np.ndarray):
            x = self.arranged(fp)
            for k, (low, width) in enumerate(every):
                seen = np.bincount(((x >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
                some = np.flatnonzero(seen)
                yield [np.full(len(some), k, np.int32), some.astype(np.int32), seen[some]]

        histograms = [np.zeros(1 << width) for _, width in every]
        rows = _mapped(fps, count, ["k", "value", "n"], "k int, value int, n long").groupBy("k", "value").agg(F.sum("n").alias("n"))
        for r in rows.collect():
            histograms[r.k][r.value] = r.n
        self.n = float(histograms[0].sum())
        for piece, seen in zip(every, histograms):
            values, shells = np.arange(len(seen)), np.zeros((self.distance + 1, len(seen)))
            for e in range(min(self.distance, piece[1]) + 1):
                for bits in combinations(range(piece[1]), e):
                    shells[e] += seen[values ^ sum(1 << b for b in bits)]
            self.shells[piece] = shells / max(self.n, 1)

    def estimates(self, x: np.ndarray) -> np.ndarray:
        """[part, t + 1, row]: fingerprints within t of the row's value in the part, its pieces taken as independent."""
        out = np.zeros((len(self.widths), self.distance + 2, len(x)))
        for i, own in enumerate(self.pieces):
            shares = np.zeros((self.distance + 1, len(x)))
            shares[0] = 1
            for low, width in own:
                shell = self.shells[(low, width)][:, ((x >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)]
                shares = np.stack([sum(shares[d] * shell[e - d] for d in range(e + 1)) for e in range(self.distance + 1)])
            out[i, 1:] = self.n * np.cumsum(shares, axis=0)
        return out

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        """[part, row]: t_i of the least estimated cost that sum to distance - parts + 1."""
        top, m = self.distance + 1, len(self.widths)
        cost = self.estimates(x)
        for i, width in enumerate(self.widths):
            for t in range(self.distance + 1):
                cost[i, t + 1] += PROBE * sum(comb(width, e) for e in range(t + 1))
        # least[s]: cost of the parts so far whose t_i + 1 sum to s
        least, taken = np.full((top + 1, len(x)), np.inf), []
        least[0] = 0
        for i in range(m):
            options = np.full((top + 1, top + 1, len(x)), np.inf)  # sum, own share
            for s in range(top + 1):
                for own in range(s + 1):
                    options[s, own] = least[s - own] + cost[i, own]
            taken.append(options.argmin(axis=1))
            least = options.min(axis=1)
        out, s, rows = np.empty((m, len(x)), np.int64), np.full(len(x), top), np.arange(len(x))
        for i in reversed(range(m)):
            out[i] = taken[i][s, rows] - 1
            s = s - out[i] - 1
        return out


_BUCKETS = "key long, fp long, probe boolean"


def buckets(fps: DataFrame, layout: Layout) -> DataFrame:
    """key, fp (arranged) and probe (it looks itself up there, if only under its own value)."""

    def run(fp: np.ndarray):
        for low in range(0, len(fp), ROWS_AT_ONCE):
            x = layout.arranged(fp[low : low + ROWS_AT_ONCE])
            t = layout.thresholds(x)
            for i, (at, width) in enumerate(zip(layout.lows, layout.widths)):
                value = (x >> np.uint64(at)) & np.uint64((1 << width) - 1)
                for e in range(max(0, int(t[i].max(initial=0))) + 1):
                    some = np.flatnonzero(t[i] >= e) if e else np.arange(len(x))
                    masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(width), e)], np.uint64)
                    step = max(1, ROWS_AT_ONCE // len(masks))
                    for a in range(0, len(some), step):
                        own = some[a : a + step]
                        keys = (value[own][:, None] ^ masks).ravel() + (np.uint64(i + 1) << np.uint64(56))
                        yield [tx.mixed(keys).view(np.int64), np.repeat(x[own], len(masks)).view(np.int64), np.repeat(t[i, own] >= 0, len(masks))]

    return _mapped(fps, run, ["key", "fp", "probe"], _BUCKETS)


def _forest(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> Iterator[int]:
    """Places of pairs that join what ``root`` (by row, which follows) has apart; each step hooks every root onto a lower one."""
    while True:
        a, b = root[left], root[right]
        live = np.flatnonzero(a != b)
        if not len(live):
            return
        high, low = np.maximum(a[live], b[live]), np.minimum(a[live], b[live])
        hooked, place = np.unique(high, return_index=True)
        root[hooked] = low[place]
        while not np.array_equal(up := root[root], root):
            root[:] = up
        yield from live[place].tolist()


def _links(rows: DataFrame, distance: int, inner: bool) -> DataFrame:
    """Pairs (a, b) of linked fingerprints that connect what each cell (key, i, j) links across components (comp). Rows are
    compared with the cell's residents: visitors always, residents among themselves if ``inner``."""

    def found(table: pa.Table) -> pa.RecordBatch:
        get = lambda c: table[c].to_numpy()
        key, i, j, probe, visits = get("key"), get("i"), get("j"), get("probe"), get("visits")
        fp = get("fp").view(np.uint64)
        root = np.unique(get("comp"), return_inverse=True)[1]
        node, root = root, np.arange(int(root.max()) + 1)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        cell = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        residents = np.bincount(cell, weights=~visits, minlength=len(start)).astype(np.int64)
        before = np.where(visits, residents[cell], np.arange(len(key)) - start[cell] if inner else 0)
        ends, first, out = np.cumsum(before), 0, [(fp[:0], fp[:0])]
        while first < len(key):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
            left = np.repeat(np.arange(first, last), before[first:last])
            right = tx.gather(start[cell[first:last]], before[first:last])
            first = last
            near = (probe[left] | probe[right]) & (root[node[left]] != root[node[right]])
            left, right = left[near], right[near]
            near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
            left, right = left[near], right[near]
            chosen = list(_forest(node[left], node[right], root))
            out.append((fp[left[chosen]], fp[right[chosen]]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            same = np.logical_and.reduce([(x := table[c].to_numpy()) == x[-1] for c in ("key", "i", "j")])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = table.slice(cut)
            if cut:
                yield found(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield found(held)

    dealt = rows.select("key", "i", "j", "visits", "fp", "probe", "comp").repartition("key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j", "visits", "fp").mapInArrow(run, "a long, b long").distinct()


def _every(n: Column) -> Column:
    """One row for each number below n."""
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _met(rows: DataFrame, distance: int, large: int) -> DataFrame:
    """The links that connect what the buckets link, as pairs of arranged fingerprints."""
    none, alone = F.lit(0), {"visits": F.lit(False), "comp": F.col("fp")}
    many = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large))
    if many.isEmpty():
        return materialise(_links(rows.withColumns({"i": none, "j": none, **alone}), distance, True))
    small = rows.join(many, "key", "left_anti").withColumns({"i": none, "j": none, **alone})
    hot = rows.join(many, "key").withColumn("cells", F.ceil(F.col("n") / large).cast("int"))
    hot = materialise(hot.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")))
    leaders = hot.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.col("n")) < LEADERS).withColumn("to", _every(F.col("cells")))
    leaders = leaders.where("to != i").withColumn("i", F.col("to"))
    cells = hot.unionByName(leaders.drop("to")).withColumns({"j": none, **alone})
    columns = ["key", "i", "j", "visits", "fp", "probe", "comp"]
    first = materialise(_links(small.select(*columns).unionByName(cells.select(*columns)), distance, True))
    roots = components(first).select(F.col("id").alias("fp"), F.col("root"))
    known = materialise(hot.join(roots, "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root"))
    shares = known.groupBy("key", "comp").agg(F.count("*").alias("own")).groupBy("key").agg(F.max_by("comp", "own").alias("giant"), F.max("own").alias("most"), F.count("*").alias("comps"))
    mixed = materialise(known.join(shares.where("comps > 1"), "key").withColumn("crowds", F.ceil((F.col("n") - F.col("most")) / large).cast("int")))
    if mixed.isEmpty():
        return first
    strays = mixed.where("comp != giant").withColumn("j", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("crowds")).cast("int"))
    strays = strays.drop("i").withColumn("i", _every(F.col("cells"))).withColumn("visits", F.lit(True))
    residents = mixed.withColumn("j", _every(F.col("crowds"))).withColumn("visits", F.lit(False))
    second = _links(residents.select(*columns).unionByName(strays.select(*columns)), distance, False)
    return materialise(first.unionByName(second))


def linked(fps: DataFrame, distance: int = 3, parts: int | None = None, large: int | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) within ``distance`` that connect all that are linked."""
    groups = grouped_bits(correlations(fps), parts or parts_for(fps.count(), distance))
    layout = Layout(groups, distance)
    layout.learn(fps)
    links = _met(materialise(buckets(fps, layout)), distance, large or LARGE)

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [pa.array(layout.restored(batch.column(c).to_numpy().view(np.uint64)).view(np.int64)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return links.mapInArrow(back, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, seed: int = 42, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links, itself included)."""
    rows = materialise(fingerprinted(docs, width, seed))
    classes = materialise(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(linked(classes.select("fp"), distance, parts))
    known = classes.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialise(known.select("fp", "root").join(least, "root").select("fp", "component_id"))
    out = rows.join(known, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
