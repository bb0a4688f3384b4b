"""Every stage of the pipeline on its own input: SQL over that input, or what must hold of its output."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesward.llm import oracles
from seriesward.session import materialise

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage, as stored tables."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = materialise(stage(spark, docs, DATA))
        out[name] = docs, done
        docs = done
    return out


def duck(docs, sql):
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{DATA}/benchmark.parquet'")
    con.register("source", docs.toArrow())
    return con.execute(sql).fetchall()


def test_stages_keep_the_columns(steps):
    for before, after in list(steps.values())[:-1]:
        assert after.dtypes == before.dtypes and 0 < after.count() <= before.count()


def test_quality_keeps_what_labels_call_good(spark, steps):
    before, after = steps["quality classifier"]
    gone = before.join(after, "doc_id", "left_anti").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    assert gone.count() > 0 and gone.where("quality = 1").count() <= 1


def test_line_dedup(steps):
    before, after = steps["line dedup"]
    want = {i: t for i, t, n in duck(before, oracles.line_dedup(50, "source")) if not n or (t or "").strip("\n ")}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_dedup(steps):
    before, after = steps["MinHash near-dedup"]
    kept = {i for i, _, _, keep in duck(before, oracles.near_duplicates(5, 80, "source")) if keep}
    assert {r.doc_id for r in after.collect()} == kept


def test_decontamination(steps):
    before, after = steps["benchmark decontamination"]
    clean = {r[0] for r in duck(before, oracles.decontamination("source")) if not r[-1]}
    assert {r.doc_id for r in after.collect()} == clean


def test_packing_covers_every_document_once(steps):
    before, after = steps["best-fit packing"]
    spans = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end")).collect()
    assert len(spans) == before.count() and all(r.n == r.end for r in spans)
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end or n > 2048").count() == 0


def test_run_gives_the_last_stage(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = corpus_pipeline.run(spark, DATA).select(columns).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, steps["best-fit packing"][1].select(columns).collect()))
