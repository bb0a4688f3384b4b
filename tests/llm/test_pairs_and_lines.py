"""Near duplicates, decontamination, line dedup and top-k against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from seriesward.llm import components, decontaminate, line_dedup, neardup, oracles, shingles, topk


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, key string, _deleted long").repartition(3)


def _words(n, rng, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=3):
    """Copies edited more and more, exact copies, short and empty texts, capitals, repeats."""
    rng, rows = random.Random(seed), []
    for _ in range(12):
        base = _words(rng.randrange(30, 200), rng)
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = _words(1, rng)[0]
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0].upper(), "a b c", "A b\tc", "a b", "", None, " \n ", "é b c d", "É b c d", "same " * 5000]
    return list(enumerate(rows))


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {(i, len(sets[i]), root[i], root[i] == i) for i in sets}


@pytest.mark.parametrize(("width", "block"), [(4, 512), (5, 3)])
def test_near_duplicates(spark, monkeypatch, width, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies()
    got = {tuple(r) for r in neardup.near_duplicates(_docs(spark, rows), width, 80).collect()}
    assert got == brute_components(rows, width, 80)


def test_near_duplicates_without_the_forest_round_and_on_odd_tables(spark, monkeypatch):
    rows = near_copies(5)
    monkeypatch.setattr(neardup, "FOREST_ROUNDS", 0)
    assert {tuple(r) for r in neardup.near_duplicates(_docs(spark, rows), 4, 80).collect()} == brute_components(rows, 4, 80)
    assert neardup.near_duplicates(_docs(spark, rows).where("false")).count() == 0
    odd = neardup.near_duplicates(_docs(spark, [(None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six")])).collect()
    assert sorted((str(r.doc_id), r.kept) for r in odd) == [("4", True), ("4", True), ("None", True)]


def test_deduplicated_keeps_one_of_each_group_and_all_columns(spark):
    rows = near_copies(7)
    out = neardup.deduplicated(_docs(spark, rows), 5, 80)
    assert out.columns == ["doc_id", "text", "key", "_deleted"]
    assert {r.doc_id for r in out.collect()} == {i for i, _, _, kept in brute_components(rows, 5, 80) if kept}


def test_deduplicated_keeps_one_of_repeated_rows(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(4, a), (4, a), (4, a), (None, a), (None, a), (None, b), (7, None), (7, None), (None, None), (None, None), (8, ""), (8, ""), (9, b), (9, b), (10, b)]
    out = neardup.deduplicated(_docs(spark, rows).withColumn("more", F.create_map("key", "text")))
    assert out.columns == ["doc_id", "text", "key", "_deleted", "more"]
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, [(4, a), (None, a), (None, b), (7, None), (None, None), (8, ""), (9, b)]))


def test_no_text_is_dropped_without_a_chain_of_links_to_one_that_stays(spark):
    """Rows that share a doc_id say nothing of each other's texts."""
    base = [f"a{k}" for k in range(60)]
    one, near, two = " ".join(base), " ".join([*base[:-1], "z"]), " ".join(f"b{k}" for k in range(60))
    out = neardup.deduplicated(_docs(spark, [(5, one), (5, two), (3, near), (9, two)]))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, near), (5, two)]
    rng, rows = random.Random(11), near_copies(9)
    rows = [(rng.randrange(20), t) for _, t in rows for _ in range(rng.randrange(1, 3))]
    texts = sorted({t for _, t in rows if t and t.split()})
    root = {i: r for i, _, r, _ in brute_components(list(enumerate(texts)), 5, 80)}
    group = {t: root[i] for i, t in enumerate(texts)}
    kept = [r.text for r in neardup.deduplicated(_docs(spark, rows)).collect() if r.text and r.text.split()]
    assert sorted(group[t] for t in kept) == sorted(set(group.values()))
    marks = neardup.near_duplicates(_docs(spark, rows)).collect()
    assert len(marks) == len(rows) and all(r.component_id <= r.doc_id for r in marks)


def test_near_duplicates_in_a_band_of_hundreds(spark):
    """A band that many dissimilar documents share, among them a group of near copies."""
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(70)]
    rows = [" ".join([*shared, *_words(30, rng, 100_000)]) for _ in range(600)]
    rows += [" ".join([*shared, *[f"c{k}" for k in range(30)][: 30 - j], *_words(j, rng)]) for j in (0, 1, 2, 3) for _ in range(3)]
    rows = list(enumerate(rows))
    got = {tuple(r) for r in neardup.near_duplicates(_docs(spark, rows), 5, 80).collect()}
    assert got == brute_components(rows[600:], 5, 80) | {(i, 96, i, True) for i in range(600)}


def test_sketches_never_exclude_similar_sets():
    rng = np.random.default_rng(1)
    for size in (5, 40, 300, 3000):
        a = np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for _ in range(20):
            b = a.copy()
            b[rng.permutation(size)[: size // 9]] = rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)
            sets, at = np.concatenate([a, np.sort(b)]), np.array([0, size, 2 * size])
            odd = shingles.odd_sketches(shingles.samples(sets, at))
            assert np.unpackbits(odd[0] ^ odd[1]).sum() <= shingles.most_odd_bits(0.8)
            apart, bits = shingles.parity_distances(shingles.parities(sets, at), np.array([0]), np.array([1]))
            assert apart[0] <= shingles.most_parity(np.array([2 * size]), bits, 0.8)[0]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {x: x for link in links for x in link}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in links)}


def items_and_docs(seed=4):
    rng = random.Random(seed)
    items = [(k, " ".join(_words(rng.randrange(12, 40), rng, 60))) for k in range(25)] + [(30, "Só three, words!"), (31, "w1"), (32, ""), (33, None), (None, "w1 w2 w3"), (3, "w7 w8")]
    docs = []
    for k in range(60):
        words = _words(rng.randrange(0, 80), rng, 60)
        if k % 3 == 0 and words:
            other = items[rng.randrange(25)][1].split()
            at = rng.randrange(max(1, len(other) - 10))
            words[rng.randrange(len(words)) :] = other[at : at + rng.randrange(9, 14)]
        docs.append((k, rng.choice((" ", ", ", "\n")).join(words).upper() if k % 5 == 0 else " ".join(words)))
    return items, [*docs, (60, None), (61, ""), (62, "só THREE words"), (3, "w7 w8 w7 w8"), (None, "w1")]


def brute_hits(items, docs):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("slice_chars", "part_words"), [(8_000_000, 100_000), (900, 100_000), (400, 13)])
def test_decontamination(spark, monkeypatch, slice_chars, part_words):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    items, docs = items_and_docs()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = decontaminate.hits(table, benchmark, slice_chars=slice_chars).select("doc_id", "hits.*").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_hits(items, docs)
    assert decontaminate.hits(table.where("false"), benchmark).count() == 0
    assert decontaminate.hits(table, benchmark.where("false")).where("hits.n_hit > 0").count() == 0
    table = table.withColumn("_hits", F.lit(1)).withColumn("_text", F.lit(2))
    clean = decontaminate.decontaminated(table, benchmark)
    assert clean.columns == table.columns
    assert clean.count() == sum(", 0, 0, '" in x for x in brute_hits(items, docs))


def test_a_long_item_comes_in_parts(spark):
    """No slice holds more than its parts, and a passage from any place of the item is found."""
    words = [f"v{k}" for k in range(230_000)]
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, "w " * 12)], "item_id long, text string")
    parts = decontaminate._parts(benchmark, 10).collect()
    assert max(len(r.text.split()) for r in parts) <= decontaminate.PART_WORDS and len(parts) == 4
    rows = [(k, " ".join(["own", *words[at : at + 12], "words"])) for k, at in enumerate((0, 99_985, 99_990, 99_995, 150_000, 229_988))] + [(9, " ".join(words[5:14]))]
    got = decontaminate.hits(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).select("doc_id", "hits.n_hit", "hits.n_items").collect()
    assert sorted(map(tuple, got)) == [*((k, 12, 1) for k in range(6)), (9, 0, 0)]


def lines_of(seed):
    rng = random.Random(seed)
    pool = [" ".join(_words(rng.randrange(1, 9), rng)) for _ in range(14)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    docs = []
    for k in range(40):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            lines += rng.choice(([rng.choice(pool)], rng.choice(runs), ["", "  "], [" ".join(_words(6, rng))], [pool[0]] * rng.randrange(1, 12)))
        docs.append((k, "\n".join(lines)))
    return [*docs, (40, None), (41, ""), (42, docs[3][1]), (42, docs[3][1]), (43, docs[3][1] + "\nmore")]


def words(line):
    return len(regex.findall(r"[^\x09-\x0D\x85\p{Z}]+", line))


def brute_lines(docs, least):
    """A line goes if a run around it with enough words also begins at an earlier place."""
    seq = []
    for i, t in sorted({(i, t) for i, t in docs if t is not None}):
        seq.append((i, t, [(k, x) for k, x in enumerate(t.split("\n")) if words(x)]))
    first, gone = {}, {}
    for i, t, lines in seq:
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(words(x) for _, x in lines[a:b]) >= least:
                    run = tuple(x for _, x in lines[a:b])
                    if run in first:
                        gone.setdefault((i, t), set()).update(k for k, _ in lines[a:b])
                    else:
                        first[run] = (i, t, a)
    out = []
    for i, t in docs:
        cut = gone.get((i, t), set())
        out.append((i, t if t is None or not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut), len(cut)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("seed", "least"), [(1, 12), (2, 20), (3, 5)])
def test_line_dedup(spark, seed, least):
    docs = lines_of(seed)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = line_dedup.without_later_copies(table, least, "n").select("doc_id", "text", "n").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_lines(docs, least)


def test_line_dedup_counts_words_between_any_white_space(spark):
    words = [f"w{k}" for k in range(60)]
    tabs, nbsp, wide = "\t".join(words), "\u00a0".join(words), "\u3000 ".join(words[::-1])
    total, table, short = "Total" + " " * 60 + "12", "\n".join(f"row {k}" + " " * 30 + str(k) for k in range(12)), "  ".join(words[:26])
    lined = "\n \t\n".join("\t ".join(words[k : k + 10]) for k in range(0, 50, 10))  # blank lines divide no run
    repeated, stay = [tabs, nbsp, wide, lined], [total, table, short, "\t" * 70, "x" + "\t" * 70 + "y"]
    texts = [x for x in (*repeated, *stay) for _ in range(2)]
    rows = [(k, f"own {k}\n{x}\nmore {k}") for k, x in enumerate(texts)]
    got = {r.doc_id: (r.text, r.n) for r in line_dedup.without_later_copies(_docs(spark, rows), 50, "n").collect()}
    want = {i: (t, 0) for i, t in rows}
    for k, x in enumerate(repeated):
        left = "\n".join([f"own {2 * k + 1}", *[" \t"] * (4 if x is lined else 0), f"more {2 * k + 1}"])
        want[2 * k + 1] = left, 5 if x is lined else 1
    assert got == want
    con = duckdb.connect()
    con.register("rows", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    assert {i: (t, n) for i, t, n in con.execute(oracles.line_dedup(50, "rows")).fetchall()} == want
    assert brute_lines(rows, 50) == sorted(str((i, *x)) for i, x in want.items())
    out = line_dedup.line_deduplicated(_docs(spark, [(1, tabs), (2, tabs + "\n\t\u00a0"), (3, "\t")]))
    assert {r.doc_id for r in out.collect()} == {1, 3}


def test_line_dedup_drops_documents_left_without_lines(spark):
    text = "\n".join(f"line {k} of a passage with some words" for k in range(10))
    table = _docs(spark, [(1, text), (2, text), (3, ""), (4, None), (5, "own line\n" + text)])
    out = {r.doc_id: r.text for r in line_dedup.line_deduplicated(table).collect()}
    assert out == {1: text, 3: "", 4: None, 5: "own line"}
    assert line_dedup.line_deduplicated(table.where("false")).count() == 0


def test_line_dedup_plan_runs_no_python(spark):
    table = spark.createDataFrame(lines_of(1), "doc_id long, text string")
    plan = line_dedup.without_later_copies(table, 12)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in (rng.standard_normal(8) / 4).astype(np.float32)]) for k in range(300)]
    rows += [(k, rows[5][1]) for k in range(300, 340)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, rows[1][1]), (20, rows[20][1]), (420, [3e4] * 8), (440, [0.5])]
    table = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, score string")
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        dot = {i: int((v[: len(whole[q])] * whole[q][: len(v)]).sum()) for i, v in whole.items() if i != q}
        want += [(q, r + 1, i, dot[i]) for r, i in enumerate(sorted(dot, key=lambda i: (-dot[i], i))[:20])]
    for block in (16_384, 50):
        got = topk.top_k(topk.quantised(table), F.col("vec_id") % 20 == 0, 20, block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(topk.quantised(table.where("false")), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_empty_and_of_huge_vectors(spark):
    table = lambda rows: topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    empty = topk.top_k(table([(k, []) for k in range(0, 60, 10)]), F.col("vec_id") % 20 == 0, 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in empty) == [(0, 1, 10, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 10, 0), (40, 1, 0, 0), (40, 2, 10, 0)]
    some = topk.top_k(table([(0, []), (20, [1.0, 2.0]), (21, [-1.0])]), F.col("vec_id") % 20 == 0, 2).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in some) == [(0, 20, 0), (0, 21, 0), (20, 0, 0), (20, 21, -4096)]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(table([(0, [1e30]), (1, [1e30])]), F.col("vec_id") % 20 == 0, 2).collect()


def test_top_k_takes_many_blocks_in_few_tasks(spark):
    rng = np.random.default_rng(7)
    whole = {k: rng.integers(-9, 9, 4) for k in range(400)}
    # Blocks hold about one vector each, in a type of their own: these need one, two, four and eight bytes.
    whole |= {100: np.array([127, -128]), 200: np.array([128]), 201: np.array([-129]), 202: np.array([40_000]), 203: np.array([1 << 31]), 300: np.array([-32_769])}
    table = spark.createDataFrame([(k, v.tolist()) for k, v in whole.items()], "vec_id long, v array<long>")
    want = []
    for q in range(0, 400, 100):
        dot = {k: int((v[: len(whole[q])] * whole[q][: len(v)]).sum()) for k, v in whole.items() if k != q}
        want += [(q, r + 1, k, dot[k]) for r, k in enumerate(sorted(dot, key=lambda k: (-dot[k], k))[:20])]
    spark.sparkContext.setJobGroup("few tasks", "")
    try:
        got = topk.top_k(table, F.col("vec_id") % 100 == 0, 20, 1).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == want
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) <= 100  # 400 blocks times 4


def test_tasks_of_top_k_do_not_grow_with_the_pairs():
    for n, q in ((0, 0), (500, 25), (51_282, 2_565), (615_384, 30_780), (15_000_000, 750_000), (15_000_000, 15_000_000)):
        n_blocks, n_groups, q_blocks, q_groups = topk._grid(n, q, topk.BLOCK)
        assert n_blocks * topk.BLOCK >= n and q_blocks * topk.BLOCK >= q
        assert 1 <= n_groups <= n_blocks and 1 <= q_groups <= q_blocks <= q_groups * topk.HELD
        assert n_groups * q_groups <= topk.MOST_TASKS and n_groups <= 96


def test_sparse_postings_score_like_dense_ones():
    rng = np.random.default_rng(0)
    rows = np.where(rng.random((500, 20)) < 0.1, rng.integers(-9, 9, (500, 20)), 0).astype(np.int64)
    postings = topk.Postings(np.arange(500), rows)
    assert all(x is not None for x in postings.lists)
    assert (postings.scores(rows[7]) == rows @ rows[7]).all()


def test_shingles_of_words_that_meet_at_borders():
    sets, at = shingles.shingle_sets(pa.array(["a b c", "a b c d", "d", None, "a b", "c d"]), 3)
    assert np.diff(at).tolist() == [1, 2, 1, 0, 1, 1]
    assert sets[0] in sets[1:3]


def test_decontamination_sends_texts_once(spark):
    passage = " ".join(f"p{k}" for k in range(10))
    docs = _docs(spark, [(1, f"a {passage} b"), (2, "c d"), (3, None)])
    benchmark = spark.createDataFrame([(5, passage)], "item_id long, text string")
    rows = decontaminate.hits(docs, benchmark)
    assert "_text" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.columns == [*docs.columns, "hits"]
    assert {r.doc_id: (r.text, r.hits.n_hit) for r in rows.collect()} == {1: (f"a {passage} b", 10), 2: ("c d", 0), 3: (None, 0)}
    several = decontaminate.hits(docs, benchmark.union(spark.createDataFrame([(6, "c d")], "item_id long, text string")), slice_chars=20)
    assert {r.doc_id: (r.text, r.hits.n_items) for r in several.collect()} == {1: (f"a {passage} b", 1), 2: ("c d", 1), 3: (None, 0)}


def test_near_duplicates_hash_small_slices_of_text(monkeypatch):
    texts = [" ".join(_words(5_000, random.Random(k))) for k in range(120)]
    batch = pa.record_batch({"doc_id": pa.array(range(120)), "t1": pa.array([0] * 120), "t2": pa.array([0] * 120), "text": pa.array(texts)})

    class Rows:  # runs here what Spark would run in a worker
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run([batch]))

    monkeypatch.setattr(neardup, "_texts", lambda docs: Rows())
    parts = neardup.sketched(None, 5)
    assert sum(p.num_rows for p in parts) == 120
    assert max(sum(len(texts[d.as_py()]) for d in p.column("doc_id")) for p in parts) <= 1 << 20
