"""SimHash near duplicates, the filter audit and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesward.llm import filter_audit, ngrams, oracles, queries, resampling, simhash

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=120), max_size=30), st.integers(0, 2**32))
def test_xxh64_of_ranges(runs, seed):
    buffer = np.frombuffer(b"".join(runs) + bytes(8), np.uint8)
    lengths = np.array([len(x) for x in runs], np.int64)
    starts = np.cumsum(lengths) - lengths
    assert ngrams.xxh64(buffer, starts, lengths, seed).tolist() == [xxhash.xxh64_intdigest(x, seed) for x in runs]


def test_xxh64_of_long_ranges():
    raw = random.Random(1).randbytes(30_000)
    buffer, starts, lengths = np.frombuffer(raw + bytes(8), np.uint8), np.array([0, 3, 1, 9, 0]), np.array([4096, 4097, 20_000, 4095, 0])
    assert ngrams.xxh64(buffer, starts, lengths, 42).tolist() == [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(starts, lengths)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB7é \n\t.,", max_size=30)), max_size=8))
def test_packed_words(texts):
    buffer, starts, ends, at = ngrams.packed_words(pa.array(texts, pa.string()), ngrams.SPACED)
    got = [[buffer[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(at, at[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts]
    first, last, cuts = ngrams.runs(at, 2, short=True)
    pairs = [buffer[starts[a] : ends[b]].tobytes().decode() for a, b in zip(first, last)]
    assert pairs == [" ".join(w[k : k + 2]) for w in got for k in range(max(1, len(w) - 1)) if w]


def _table(spark, rows):
    """Documents with columns of clashing names."""
    rows = [(i, t, lang, "x", 1, 2) for i, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, part int, key int").repartition(3)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows, distance=3):
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows if i is not None}
    by = {}
    for i, fp in prints.items():
        by.setdefault(fp, []).append(i)
    root = {fp: fp for fp in by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(by, 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    least = {}
    for fp, ids in by.items():
        least[find(fp)] = min(least.get(find(fp), ids[0]), *ids)
    return {(i, f"{fp:016x}", least[find(fp)]) for i, fp in prints.items()}


def near_texts(seed=1):
    rng, rows = random.Random(seed), []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 400))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "Changed"
            rows.append(rng.choice((" ", "\t", "  ")).join(copy))
    rows += [None, "", " \n ", "a", "A", "a b", "É x", "é x", "long " * 3000, "w" * 50_000]
    return [(k, t, None) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("parts", "large"), [(None, None), (2, 8), (3, 4), (4, 4), (5, 16)])
def test_simhash(spark, monkeypatch, parts, large):
    monkeypatch.setattr(simhash, "LARGE", large or simhash.LARGE)
    rows = near_texts()
    got = simhash.near_duplicates(_table(spark, rows), parts=parts)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == brute_simhash(rows)


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_linked_in_a_dense_group_of_fingerprints(spark, distance):
    """Thousands around one centre, random ones, and chains that meet at the limit only."""
    rng = np.random.default_rng(distance)
    flips = np.array([1 << int(b) for b in rng.permutation(64)[:24]], np.uint64)
    chosen = rng.random((3000, 24)) < 0.12
    centre = np.bitwise_xor.reduce(np.where(chosen, flips, np.uint64(0)), axis=1) ^ np.uint64(0x9E3779B97F4A7C15)
    chain = np.cumsum(np.ones(12, np.int64)) * distance
    far = np.array([(1 << int(min(63, n))) - 1 for n in chain], np.uint64)
    fps = np.unique(np.concatenate([centre, rng.integers(0, 1 << 63, 500, dtype=np.uint64), far]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = np.array([tuple(r) for r in simhash.linked(table, distance, large=150).collect()], np.int64).reshape(-1, 2)
    assert (np.bitwise_count(links[:, 0].view(np.uint64).copy() ^ np.ascontiguousarray(links[:, 1]).view(np.uint64)) <= distance).all()

    def roots(pairs):
        root = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
    assert simhash.linked(table, distance).count() < min(len(near) + 1, 8 * len(fps))  # a forest per bucket, not every link
    assert roots(links) == roots(fps.view(np.int64)[near])


def test_thresholds_sum_to_the_pigeonhole_bound_and_avoid_common_values(spark):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    fps[:3000] &= ~np.uint64(0xFFFF)  # one value in the lowest bits holds three quarters
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    layout = simhash.Layout([list(range(16 * k, 16 * k + 16)) for k in range(4)], 3)
    layout.learn(table)
    t = layout.thresholds(layout.arranged(fps))
    assert (t.sum(axis=0) == 3 - 4 + 1).all() and t.min() >= -1
    assert (t[0, :3000] == -1).all() and (t[0, 3000:] >= 0).all()
    assert (layout.restored(layout.arranged(fps)) == fps).all()


def test_bits_that_move_together_share_a_part(spark):
    rng = np.random.default_rng(5)
    bits = rng.random((3000, 64)) < 0.5
    for k in range(8):
        bits[:, 63 - 7 * k] = bits[:, 1]
    fps = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
    groups = simhash.grouped_bits(simhash.correlations(spark.createDataFrame([(int(x),) for x in fps], "fp long")), 4)
    assert sorted(sum(groups, [])) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({1, *(63 - 7 * k for k in range(8))} <= set(g) for g in groups)
    assert [simhash.parts_for(n, 3) for n in (10, 10**5, 10**9, 10**12)] == [4, 4, 2, 2]  # more rows, wider parts


def test_simhash_of_odd_tables(spark):
    rows = [(None, "a b c d", None), (4, "a b c d", None), (4, "a b c d", None), (4, "other words here", None), (2, "other words here", None), (None, None, None)]
    got = simhash.near_duplicates(_table(spark, rows)).collect()
    known = f"{brute_fingerprint('a b c d'):016x}", f"{brute_fingerprint('other words here'):016x}"
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, known[0], None), (4, known[0], 4), (4, known[0], 4), (4, known[1], 2), (2, known[1], 2), (None, "0" * 16, None)]))
    assert simhash.near_duplicates(_table(spark, rows).where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_positional_popcount(words):
    got = filter_audit.positional_popcount(np.array(words, np.uint32))
    assert got.tolist() == [sum(w >> b & 1 for w in words) for b in range(32)]


def audit_rows(seed=2):
    rng, rows = random.Random(seed), []
    for k in range(150):
        words = [rng.choice(("word", "Other", "x", "é", f"n{rng.randrange(500)}")) for _ in range(rng.choice((0, 5, 150, 199, 200, 201, 400)))]
        text = rng.choice((" ", "\n", " \t")).join(words) + rng.choice(("", "", " $", "|", " AAAA BBBB"))
        rows.append((k, text, rng.choice(("de", "en", "", None))))
    rows += [(200 + k, rows[rng.randrange(150)][1], rng.choice(("de", "fr"))) for k in range(60)]
    rows += [(500, None, "en"), (501, "", None), (None, rows[3][1], "en"), (None, rows[3][1], "xx"), (3, rows[3][1], "en"), (7, "A b", "en"), (502, "é" * 200_000, "en")]
    labels = [(k, k % 3 % 2, k % 5 // 4) for k in range(0, 260, 2)] + [(4, 1, None), (None, 1, 1), (2, None, 1), (900, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    texts = [(i, t or "", lang or "") for i, t, lang in rows]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, part in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((part, {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                failing = [d for d in own if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, step + 1] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit(spark, monkeypatch):
    rows, labels = audit_rows()
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    for common in (1_000, 20, 1):  # with 1 no text is common enough to be hot
        monkeypatch.setattr(filter_audit, "COMMON", common)
        got = [tuple(r) for r in filter_audit.audit(_table(spark, rows), marks).collect()]
        assert set(got) == brute_audit(rows, labels) and len(got) == len(set(got)) == 600 * 5
    assert filter_audit.audit(_table(spark, rows).where("false"), marks).count() == 0
    without = filter_audit.audit(_table(spark, rows), marks.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(without) == (0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=60))
def test_interned(runs):
    runs = runs + runs[:5] + [b"x" * 30, b"x" * 31, b"x" * 30]
    buffer = np.frombuffer(b"".join(runs) + bytes(8), np.uint8)
    lengths = np.array([len(x) for x in runs], np.int64)
    table = resampling.Interned(buffer, np.cumsum(lengths) - lengths, lengths, 100)
    slots = {}
    for run, slot in zip(runs, table.slot.tolist()):
        assert slots.setdefault(run, slot) == slot and table.bucket[slot] == zlib.crc32(run) % 100 and table.count[slot] == runs.count(run)
    assert len(set(slots.values())) == len(slots) == len(table.taken)


def test_equal_keys_need_equal_bytes(monkeypatch):
    """Every key the same: probing and the comparison of bytes still tell the n-grams apart."""
    monkeypatch.setattr(ngrams, "xxh64", lambda buffer, starts, lengths: np.zeros(len(starts), np.uint64))
    runs = [b"abcdefgh", b"abcdefgi", b"abcdefgh", b"", b"abcdefghi", b"abcdefgh2", b"abcdefghi"]
    lengths = np.array([len(x) for x in runs], np.int64)
    table = resampling.Interned(np.frombuffer(b"".join(runs) + bytes(8), np.uint8), np.cumsum(lengths) - lengths, lengths, 50)
    assert len(set(table.slot.tolist())) == len(set(runs)) and table.slot[0] == table.slot[2] and table.slot[4] == table.slot[6]


def brute_ranked(rows, target, longest, buckets, percent, least):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x[1] for x in rows]), (t, target)):
        for text in texts:
            for b in grams(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, fits = [], []
    for i, text, *_ in rows:
        n, found = grams(text)
        weight, score = sum(gain[b] for b in found), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                fits.append((-score, i))
        out.append((i, len(found), weight, score))
    rank = {x: k + 1 for k, x in enumerate(sorted(fits)[: percent * len(fits) // 100])}
    return sorted((str((*x, rank.get((-x[3], x[0])) if x[3] is not None and x[1] >= least else None)) for x in out))


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 35)])
def test_ranked(spark, longest, percent):
    rng = random.Random(6)
    rows = [(k, rng.choice((" ", "-", ". ")).join(rng.choice(("Alpha", "beta", "É", "7up", f"q{rng.randrange(60)}")) for _ in range(rng.choice((0, 19, 20, 40, 90)))), None) for k in range(300)]
    rows += [(400, None, None), (401, "", None), (402, "... ", None), (None, "beta " * 30, None), (403, "beta " * 20_000, None), (404, "b" * 30_000 + " x" * 25, None)]
    target = ["beta Q7 q8 q9", "q7 alpha", None, ""]
    aims = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, weight int")
    got = resampling.ranked(_table(spark, rows), aims, longest=longest, buckets=97, percent=percent)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_ranked(rows, target, longest, 97, percent, 20)


def test_resampling_of_odd_tables(spark):
    rows = [(5, "one two " * 20, None)] * 40 + [(6, "three four " * 20, None)] * 40
    aims = spark.createDataFrame([("three",)], "text string")
    got = resampling.ranked(_table(spark, rows), aims).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 9)) and {r.doc_id for r in got if r.rank} == {6}
    drawn = resampling.resampled(_table(spark, rows), aims)
    assert drawn.columns == ["doc_id", "text", "lang", "fp", "part", "key"] and drawn.count() == 40
    assert resampling.ranked(_table(spark, rows).where("false"), aims).count() == 0
    plain = resampling.ranked(_table(spark, rows), aims.where("false")).collect()
    assert len(plain) == 80 and sum(r.rank is not None for r in plain) == 8


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_importance_resampling"])
def test_queries_equal_their_sql(spark, name):
    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, data), con.execute(oracles.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_op11_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_simhash_pigeonhole"](spark, "/root/testdata/sf0.01")
    assert {tuple(r) for r in got.collect()} == brute_simhash(rows)
