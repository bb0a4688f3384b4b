"""Encoding, token files and packing, against the tokenizer itself and exact round trips."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesward.llm import packing, token_files
from seriesward.llm.encode import Encoder, default_path
from seriesward.session import ARROW_BYTES, BATCH_BYTES, scratch

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
ENCODERS = {(p, m): Encoder(p, m) for p, m in ((WORD, "dropped"), (BYTE, "leading"), (WORD, "whole"), (BYTE, "whole"))}
ALPHABET = st.sampled_from(list("abzE ,.'\n\t<|>09éÉßİ×̈  \x00\x1c\u200b漢字!$") + ["<|endoftext|>", " the", "'s", "'S", "\r\n", "  "])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=6))
@pytest.mark.parametrize(("path", "mode"), [(WORD, "dropped"), (BYTE, "leading")])
def test_pieces_give_the_ids_of_whole_texts(path, mode, texts):
    ids, at = ENCODERS[path, mode](pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == ENCODERS[path, mode].tokenizer.encode(t, add_special_tokens=False).ids, t


def test_nulls_and_long_texts():
    texts = [None, "", "word, " * 50_000, "x" * 3000]
    for (path, mode), e in ENCODERS.items():
        ids, at = e(pa.array(texts))
        assert at[0] == at[1] == at[2] == 0
        assert len(ids) == sum(len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts)


DOCS = [(5, "Five words are in here."), (None, "no id"), (1, None), (3, ""), (5, "again five"), (2, "long text, " * 4000), (9, "x")]


def _docs(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, file string").repartition(3)


def test_files_round_trip(spark, tmp_path):
    manifest = token_files.write_token_files(_docs(spark), scratch(spark), WORD, "dropped", end_id=2)
    rows = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    e, start = ENCODERS[WORD, "dropped"].tokenizer, 0
    for (i, t), r in zip(sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")), rows, strict=True):
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_readers_touch_only_the_frames_they_need_and_notice_damage(tmp_path):
    path = str(tmp_path / "one.ids.zst")
    docs = [(k, np.arange(k * 7, k * 7 + n, dtype=np.uint32) % 5000) for k, n in enumerate((3, 0, 900, 40, 2000, 1))]
    with open(path, "wb") as f:
        w = token_files.Writer(f, frame_bytes=512)
        for d in docs:
            w.add(*d)
        assert w.close() == (6, 2944)
    reader = token_files.Reader(path)
    assert all((reader.ids(k) == ids).all() for k, (_, ids) in enumerate(docs))
    reader = token_files.Reader(path)
    assert [(i, ids.tolist()) for i, ids in reader.find([3, 1])] == [(1, []), (3, docs[3][1].tolist())]
    assert reader.frames_read <= 2
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.place[1]) + 12] ^= 255
    open(path, "wb").write(raw)
    damaged = token_files.Reader(path)
    with pytest.raises(Exception):  # noqa: B017, PT011
        damaged.ids(2)


def test_empty_tables(spark):
    empty = _docs(spark).where("false")
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, scratch(spark), WORD, "dropped", end_id=2)).count() == 0
    assert packing.pack_documents(empty, BYTE, "leading", end_id=0).count() == 0


def test_packing_keeps_every_id_and_fills_sequences(spark):
    rows = packing.pack_documents(_docs(spark), BYTE, "leading", end_id=0).collect()
    want = []
    for i, t in DOCS:
        ids = np.array([*ENCODERS[BYTE, "leading"].tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        n, at, end, piece = len(ids), 0, len(ids) % 2048 or min(len(ids), 2048), 0
        while at < n:
            want.append((i, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, end, piece = end, end + 2048, piece + 1
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_each_placement_has_the_smallest_sum_of_squares(sizes):
    """Against a plain replay: no open bin that has room gives a smaller sum than the one chosen."""
    capacity = 32
    bins, offsets, fills = packing.sum_of_squares(np.array(sizes, np.int64), capacity)
    state: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):

        def squares(change):
            open_ = [capacity - f for f in change if f < capacity]
            return sum(open_.count(g) ** 2 for g in set(open_))

        options = {b: squares([f + sizes[k] * (j == b) for j, f in enumerate(state)]) for b, f in enumerate(state) if f + sizes[k] <= capacity}
        if bins[k] == len(state):
            assert not options
            state.append(0)
        else:
            assert options[bins[k]] == min(options.values())
        assert offsets[k] == state[bins[k]]
        state[bins[k]] += sizes[k]
    assert state == fills.tolist()


def test_small_files_make_no_small_tables(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs, scratch(spark), WORD, "dropped", end_id=2)
        rows = token_files.read_token_files(spark, manifest)
        assert manifest.count() > 20 > rows.rdd.getNumPartitions()
        assert len(manifest.inputFiles()) == 1
        rows = rows.orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    start = 0
    for i, r in enumerate(rows):
        ids = np.array([*ENCODERS[WORD, "dropped"].tokenizer.encode(f"text {i}", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == 400


@pytest.mark.parametrize("path, mode", [(WORD, "dropped"), (BYTE, "leading")])
def test_cutting_takes_little_memory(path, mode):
    column = pa.array(["some words, and more of them " * 1000] * 35, pa.large_string())
    encode = ENCODERS[path, mode]
    tracemalloc.start()
    try:
        encode._cut(column)
        assert tracemalloc.get_traced_memory()[1] < 16 * column.nbytes
    finally:
        tracemalloc.stop()


def test_workers_at_rest_keep_no_pieces(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string")

    def kept(batches):
        list(cut(batches))
        yield pa.RecordBatch.from_pydict({"n": [len(packing.encoder(BYTE, "leading")._index)]})

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    cut = packing.pieces_of(Rows(), BYTE, "leading")
    assert {r.n for r in docs.mapInArrow(kept, "n long").collect()} == {0}


@pytest.mark.parametrize("own", [None, "16m"])
def test_packing_sends_texts_in_bounded_batches(spark, monkeypatch, own):
    docs = spark.range(6000, numPartitions=1).selectExpr("id doc_id", "repeat('word ', 1000) text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    seen = []

    def stored(pieces):
        seen.extend(r.n for r in docs.mapInArrow(sizes, "n long").collect())
        return pieces.limit(0)

    monkeypatch.setattr(packing, "materialise", stored)
    if own:
        spark.conf.set(ARROW_BYTES, own)
    try:
        assert packing.pack_documents(docs, BYTE, "leading", end_id=0).count() == 0
        assert max(seen) < (1.2 if not own else 2.4) * BATCH_BYTES and sum(seen) > 3 * BATCH_BYTES
        assert spark.conf.getAll.get(ARROW_BYTES) == own
    finally:
        spark.conf.unset(ARROW_BYTES)
