import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesward import schema as S
from seriesward.operators import alerts as al
from seriesward.operators.ensemble import score_metrics
from seriesward.plans import training
from seriesward.sources.store import read_stream
from seriesward.streaming import blocks
from seriesward.streaming.alerts import alert_stream
from seriesward.streaming.detect import dedup_metrics, score_stream
from seriesward.streaming.reports import downsample_stream, health_stream, run_to_end, totals
from tests.conftest import metric_rows
from tests.test_alerts import anomaly

COMPARED = ["metric_id", "stat_flag", "forest_flag", "sequence_flag", "is_anomaly", "votes"]
ROUNDED = ["mean", "std", "q1", "q3", "stat_score", "forest_score", "sequence_score", "ensemble_score"]


def comparable(df):
    return df.select(*COMPARED, *[F.round(F.col(c) + 3e-8, 6).alias(c) for c in ROUNDED])


def feed(spark, path, *parts, schema=S.METRIC):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, schema, files_per_batch=1)


def finish(spark, stream, base):
    query = run_to_end(stream, f"{base}/out", f"{base}/offsets")
    return query, spark.read.parquet(f"{base}/out")


def waves(n):
    rng = np.random.default_rng(3)
    x = 50 + 20 * np.sin(np.arange(n) / 8) + rng.normal(0, 0.5, n)
    x[n // 2] = 99.0
    return x


def test_stream_equals_batch(spark, tmp_path):
    """Rows out of order within the delay, over several batches."""
    rows = metric_rows(waves(400), host="a") + metric_rows(waves(260), host="b", metric_type="memory_usage")
    rng = np.random.default_rng(4)
    late = sorted(rows, key=lambda r: r[3].timestamp() + rng.uniform(0, 90))
    parts = [late[i : i + 150] for i in range(0, len(late), 150)]
    df = spark.createDataFrame(rows, S.METRIC)
    forest, sequence, _ = training.train_all(df, trees=20)
    stream = feed(spark, str(tmp_path / "in"), *parts)
    query, got = finish(spark, score_stream(stream, forest, sequence, delay="100 seconds"), tmp_path)
    newest = max(r[3] for r in rows)
    passed = score_metrics(df, forest, sequence).where(F.unix_micros("timestamp") <= F.unix_micros(F.lit(newest)) - 100_000_000)
    assert got.count() == passed.count() > 500
    assert comparable(got).exceptAll(comparable(passed)).count() == 0
    report = health_stream(spark, query, "detector", {"version": 1}).collect()
    assert report[-1]["details"]["rows_processed"] == "660" and report[-1]["status"] == "healthy"


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """What arrives before its time is settled still finds its place; afterwards it is late."""
    rows = metric_rows([50.0] * 100)
    stream = feed(spark, str(tmp_path / "in"), rows[50:], rows[:10], rows[10:20])
    query, got = finish(spark, score_stream(stream, delay="10 seconds"), tmp_path)
    assert sorted(r["metric_id"] for r in got.select("metric_id").collect()) == [r[0] for r in rows[:10] + rows[50:99]]
    assert got.where("count = 11").first()["metric_id"] == rows[50][0]
    dropped = [int(r["details"]["rows_dropped_late"]) for r in health_stream(spark, query, "d").collect()]
    assert sum(dropped) == 10


def test_dedup(spark, tmp_path):
    rows = metric_rows(range(30))
    stream = feed(spark, str(tmp_path / "in"), rows, rows[5:], rows)
    _, got = finish(spark, dedup_metrics(stream), tmp_path)
    assert got.count() == 30


def test_alert_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    minutes = np.cumsum(rng.choice([1, 2, 5, 12, 40], 80))
    rows = [anomaly(i, float(m), ("low", "medium", "high", "critical")[i % 4], host=f"h{i % 3}") for i, m in enumerate(minutes)]
    found = spark.createDataFrame(rows, S.ANOMALY)
    acted = found.where("severity = 'medium'").select(
        "host", "metric_type", al.alert_id_of().alias("alert_id"), F.lit("acknowledge").alias("action"), F.lit("ops").alias("user"),
        (F.col("timestamp") + F.expr("interval 3 minutes")).alias("ts"),
    )
    acted.coalesce(1).write.parquet(str(tmp_path / "acts"))
    stream = feed(spark, str(tmp_path / "in"), rows[:30], rows[30:], schema=S.ANOMALY)
    actions = spark.readStream.schema(acted.schema).parquet(str(tmp_path / "acts"))
    _, got = finish(spark, alert_stream(stream, actions, delay="0 seconds"), tmp_path)
    # The watermark of two streams is the smaller one.
    newest = min(found.agg(F.max("timestamp")).first()[0], acted.agg(F.max("ts")).first()[0])
    known = found.where(F.col("timestamp") <= F.lit(newest))
    want = al.process_anomalies(known, acted.drop("host", "metric_type").where(F.col("ts") <= F.lit(newest)), as_of=newest)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and want.select(got.columns).exceptAll(got).count() == 0


def test_downsample(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), metric_rows(range(90)))
    _, got = finish(spark, downsample_stream(stream, 300, "0 seconds"), tmp_path)
    assert [(r["average"], r["maximum"]) for r in got.orderBy("period_start").collect()] == [(14.5, 29.0), (44.5, 59.0)]


def test_blocks_do_not_depend_on_their_size():
    x = np.random.default_rng(6).normal(1e6, 1.0, 700)
    _, whole = blocks.advance(blocks.empty(), x)
    state, parts = blocks.empty(), []
    for piece in np.split(x, [1, 2, 31, 150, 151, 420]):
        state, out = blocks.advance(state, piece)
        parts.append(out)
    for name in whole:
        if name == "_recent":
            assert whole[name] == [r for p in parts for r in p[name]]
        else:
            np.testing.assert_allclose(np.concatenate([p[name] for p in parts]), whole[name], rtol=1e-9, atol=1e-6, err_msg=name)


class Kept:
    """A query that keeps some reports."""

    def __init__(self, first, last):
        self.recentProgress = [
            {"batchId": b, "timestamp": f"2024-01-01T00:{b // 60:02d}:{b % 60:02d}.000Z", "numInputRows": 10, "stateOperators": []} for b in range(first, last)
        ]

    def exception(self):
        return None


def test_health_totals_outlive_the_reports_a_query_keeps(spark):
    first = health_stream(spark, Kept(0, 100), "s")
    second = health_stream(spark, Kept(80, 180), "s", before=totals(first))
    rows = second.orderBy("uptime_seconds").collect()
    assert (len(rows), rows[-1]["details"]["rows_processed"], rows[-1]["uptime_seconds"]) == (80, "1800", 179.0)
    with pytest.raises(ValueError):
        health_stream(spark, Kept(80, 180), "s")
    assert totals(health_stream(spark, Kept(0, 0), "s"), totals(first))["rows_processed"] == 1000
