"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from . import decontaminate, filter_audit, html_blocks, labelled, line_dedup, neardup, packing, quality, resampling, simhash, token_files, topk, toxicity, urls
from .encode import default_path

QUERIES: dict = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def _read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_token_files")
def op1(spark, sf_dir):
    manifest = token_files.write_token_files(_read(spark, sf_dir, "documents"), scratch(spark), default_path("word_bpe_49k.json"), "dropped", end_id=2)
    return token_files.read_token_files(spark, manifest)


@query("op2_term_at_a_time_top_k")
def op2(spark, sf_dir):
    return topk.top_k(topk.quantised(_read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


@query("op3_odd_sketch_near_duplicates")
def op3(spark, sf_dir):
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80)


@query("op5_prefix_filtered_decontamination")
def op5(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.hits(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


@query("op6_sum_of_squares_packing")
def op6(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), "leading", end_id=0)


@query("op10_suffix_array_line_dedup")
def op10(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_later_copies(docs, line_dedup.MIN_WORDS, "n_deleted")


def _judged(model, least: float, spark, sf_dir: str):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = model.score(docs, model.train(docs, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query("op7_ftrl_toxicity")
def op7(spark, sf_dir):
    return _judged(toxicity, 0.5, spark, sf_dir)


@query("op8_nbsvm_quality")
def op8(spark, sf_dir):
    return _judged(quality, quality.KEEP, spark, sf_dir)


@query("op9_recurrent_block_labeller")
def op9(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op4_markov_url_filter")
def op4(spark, sf_dir):
    return urls.judged(_read(spark, sf_dir, "pages"), RULES).drop("score")


@query("op11_simhash_pigeonhole")
def op11(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, distance=3, seed=42)


@query("op12_filter_audit")
def op12(spark, sf_dir):
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op13_importance_resampling")
def op13(spark, sf_dir):
    return resampling.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least_words=20)
