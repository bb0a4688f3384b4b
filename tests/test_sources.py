import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from seriesward import schema as S
from seriesward.functions import scalars as fn
from seriesward.sources import collect, records, store
from tests.conftest import at


def texts(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "json string")


POINT = {"metric_type": "cpu_usage", "value": 65.0, "timestamp": "2024-01-01T00:00:00+00:00", "host": "test-host", "service": "s", "tags": {"unit": "percent"}, "metric_id": "m1"}


def test_metric_json(spark):
    partial = {"metric_type": "cpu_usage", "value": 1.5, "timestamp": "2024-01-01T00:00:00+00:00"}
    good, bad = records.metric_from_json(texts(spark, POINT, partial, {**POINT, "colour": "red"}, "{not json", {**POINT, "value": "high"}))
    rows = {r["host"]: r for r in good.collect()}
    assert rows["test-host"]["value"] == 65.0 and rows["test-host"]["tags"] == {"unit": "percent"}
    assert rows["unknown"]["service"] == "unknown" and len(rows["unknown"]["metric_id"]) == 64
    assert len(rows) == 2 and bad.count() == 3


def test_records_need_their_fields(spark):
    good, bad = records.metric_from_json(texts(spark, {}, {"value": 1.0}, {"metric_type": "cpu_usage"}, {"metric_type": "cpu_usage", "value": 1.0}))
    row = good.first()
    assert (good.count(), bad.count()) == (1, 3) and row["timestamp"] is not None
    assert records.alert_from_json(texts(spark, {"severity": "high"}))[1].count() == 1
    assert records.anomaly_from_json(texts(spark, {"metric_type": "cpu_usage", "value": 1.0}))[1].count() == 1


def test_metric_round_trip(spark, metrics):
    df = metrics([1.25, 2.5])
    good, bad = records.metric_from_json(df.select(records.metric_to_json().alias("json")))
    order = sorted(good.columns)
    assert good.select(order).orderBy("metric_id").collect() == df.select(order).orderBy("metric_id").collect()
    assert bad.count() == 0


def test_anomaly_json(spark):
    text = {"metric_type": "cpu_usage", "value": 98.0, "expected_range": [30.0, 70.0], "anomaly_score": 0.95, "severity": "critical", "host": "h"}
    good, bad = records.anomaly_from_json(texts(spark, text))
    row = good.first()
    assert (row["expected_range"]["lower"], row["expected_range"]["upper"], row["model_used"]) == (30.0, 70.0, "unknown")
    again = json.loads(good.select(records.anomaly_to_json().alias("j")).first()["j"])
    assert again["expected_range"] == [30.0, 70.0] and bad.count() == 0


def test_alert_json(spark):
    good, _ = records.alert_from_json(texts(spark, {"anomaly_id": "a", "severity": "high", "title": "t", "description": "d", "metric_type": "cpu_usage"}))
    row = good.first()
    assert (row["status"], row["host"], row["resolved_at"]) == ("firing", "unknown", None)
    assert json.loads(good.select(records.alert_to_json().alias("j")).first()["j"])["acknowledged_by"] is None


def test_host_to_service(spark):
    hosts = ["web-server-01", "api-server-01", "db-primary", "cache-01", "worker-01", "other", "api-db"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [r["s"] for r in df.select(fn.host_to_service(F.col("host")).alias("s")).collect()]
    assert got == ["web", "api", "database", "cache", "worker", "unknown", "api"]


@pytest.mark.parametrize("kind, value, score, want", [
    ("cpu_usage", 95, 0.5, "critical"), ("cpu_usage", 91, 0.5, "high"), ("cpu_usage", 81, 0.5, "medium"), ("cpu_usage", 71, 0.5, "low"),
    ("cpu_usage", 10, 0.96, "critical"), ("network_in", 1e9, 0.85, "high"), ("network_in", 1e9, 0.7, "medium"), ("network_in", 1e9, 0.1, "low"),
])
def test_severity(spark, kind, value, score, want):
    col = fn.determine_severity(F.lit(kind), F.lit(float(value)), F.lit(score))
    assert spark.range(1).select(col.alias("s")).first()["s"] == want


def test_texts(spark):
    one = spark.range(1)
    up = [one.select(fn.format_uptime(F.lit(s)).alias("u")).first()["u"] for s in (0.0, 59.9, 61.0, 3725.0)]
    assert up == ["--", "59s", "1m 1s", "1h 2m"]
    assert one.select(fn.label(F.lit("cpu_usage")).alias("l")).first()["l"] == "CPU USAGE"
    two = [one.select(fn.decimals(F.lit(v), 2).alias("d")).first()["d"] for v in (2.675, 0.125, 1234567.891, -0.5)]
    assert two == [f"{v:.2f}" for v in (2.675, 0.125, 1234567.891, -0.5)]


def test_cloudwatch(spark):
    rows = [("AWS/EC2", "CPUUtilization", "i-1", 10.0, 20.0), ("AWS/RDS", "ReadLatency", None, None, 5.0), ("AWS/RDS", "WriteLatency", "d", None, None), ("AWS/RDS", "NetworkIn", "d", 1.0, 1.0)]
    df = spark.createDataFrame([(*r, at(0)) for r in rows], "namespace string, cw_metric string, dimension_value string, average double, maximum double, ts timestamp")
    got = {r["tags"]["cw_metric"]: r for r in collect.normalize_cloudwatch(df).collect()}
    assert set(got) == {"CPUUtilization", "ReadLatency", "WriteLatency"}
    assert [(got[k]["metric_type"], got[k]["value"], got[k]["host"], got[k]["tags"]["max"]) for k in sorted(got)] == [
        ("cpu_usage", 10.0, "i-1", "20.0"), ("request_latency", 5.0, "unknown", "5.0"), ("request_latency", 0.0, "d", "0.0"),
    ]


def test_counters(spark):
    mb = 1024.0**2
    rows = [("h", "disk_read", 0.0, at(0)), ("h", "disk_read", 10 * mb, at(0.5)), ("h", "disk_read", 11 * mb, at(0.5) + dt.timedelta(milliseconds=10)), ("h", "net_in", 5.0, at(0))]
    df = spark.createDataFrame(rows, "host string, counter string, value double, ts timestamp")
    got = [r["rate_mb"] for r in collect.counters_to_rate(df).orderBy("counter", "ts").collect()]
    assert got == [None, 0.33, 10.0, None]


def test_downsample(metrics):
    got = collect.downsample(metrics(range(90)), period=300, lookback_minutes=5).orderBy("period_start").collect()
    assert [(r["average"], r["maximum"]) for r in got] == [(59.0, 59.0), (74.5, 89.0)]


def test_metrics_table(spark, metrics, tmp_path):
    df = metrics({"values": range(20), "host": "history-host"}, {"values": range(20), "host": "b"}, {"values": [1.0], "host": "b", "first": 20000})
    path = str(tmp_path / "m")
    store.publish_metric(df, path)
    store.publish_metric(df.limit(0), path)
    table = store.read_metrics(spark, path)
    assert table.count() == 41
    history = store.metric_history(table, "history-host", "cpu_usage", 60, now="2024-01-01 00:30:00")
    assert [r["value"] for r in history.collect()] == [float(i) for i in range(20)]
    plan = spark._jvm.PythonSQLUtils.explainString(history._jdf.queryExecution(), "formatted")
    assert "EqualTo(host,history-host)" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert store.training_history(table, 72, now="2024-01-04 00:02:00").count() == 17
    follow = store.read_after(table, ("timestamp", "metric_id"), (at(0), "b-cpu_usage-0000000"), 3)
    assert [r["metric_id"] for r in follow.collect()] == ["history-host-cpu_usage-0000000", "b-cpu_usage-0000001", "history-host-cpu_usage-0000001"]


def test_alert_tables(spark, tmp_path):
    rows = spark.createDataFrame([("al", "an", s, "t", "d", "cpu_usage", "h", "s", "firing", at(0), None, None) for s in ("high", "critical")], S.ALERT)
    store.publish_alert(rows, str(tmp_path / "log"), str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == spark.read.parquet(str(tmp_path / "history")).count() == 2


def test_model_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    store.save_model_state(spark, path, "latest_training", {"n": 1}, "2024-01-01 00:00:00")
    store.save_model_state(spark, path, "latest_training", {"n": 2}, "2024-01-02 00:00:00")
    runs = spark.read.parquet(path)
    assert store.get_model_state(runs).first()["state"] == {"n": "2"}
    assert not store.should_retrain(runs, "2024-01-02 23:59:59") and store.should_retrain(runs, "2024-01-03 00:00:00")
    assert store.should_retrain(runs, "2024-01-02 00:00:00", name="other")


def test_retention(metrics):
    df = metrics({"values": range(500), "host": "a"}, {"values": range(50), "host": "b"})
    kept = store.retention_trim(df, hours=1, interval=36)
    assert {r["host"]: r["n"] for r in kept.groupBy("host").agg(F.count("*").alias("n")).collect()} == {"a": 100, "b": 50}
    assert kept.where("host = 'a'").agg(F.min("value")).first()[0] == 400.0
