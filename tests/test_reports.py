import datetime as dt

from seriesward import schema as S
from seriesward.plans import reports
from tests.conftest import at


def anomalies(spark, n):
    levels = ("low", "medium", "high", None)
    return spark.createDataFrame(
        [(f"a{i:03d}", "cpu_usage", 1.0, (0.0, 1.0), i / 100, levels[i % 4], at(i), "h", "s", "ensemble", "d") for i in range(n)], S.ANOMALY
    )


def health(spark, *rows):
    return spark.createDataFrame([(n, s, 100.0, at(m), {}) for n, s, m in rows], S.HEALTH)


def test_recent_and_counts(spark):
    df = anomalies(spark, 50)
    assert [r["anomaly_id"] for r in reports.recent_anomalies(df, 3).collect()] == ["a049", "a048", "a047"]
    assert {r["severity"]: r["n"] for r in reports.severity_counts(df).collect()} == {"low": 5, "medium": 5, "high": 5, "unknown": 5}
    plan = reports.recent_anomalies(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_pipeline_stats(spark, metrics):
    df = metrics({"values": range(5), "host": "stats-host"}, {"values": range(3), "host": "b"})
    got = {r["name"]: r["value"] for r in reports.pipeline_stats(df, anomalies(spark, 4), anomalies(spark, 2)).collect()}
    assert got == {
        "metrics_stream_length": 8, "total_metric_series": 2, "anomalies_stream_length": 4, "anomaly_history_count": 4,
        "alerts_stream_length": 2, "alert_history_count": 2,
    }


def test_health(spark):
    df = health(spark, ("detector", "healthy", 0), ("detector", "degraded", 10), ("collector", "healthy", 12), ("old", "healthy", 1))
    now = at(14).replace(tzinfo=None)
    assert {r["service_name"]: r["status"] for r in reports.health_latest(df, now).collect()} == {"detector": "degraded", "collector": "healthy"}
    row = reports.system_health(df, now).first()
    assert (row["status"], row["services"], row["services_fine"]) == ("degraded", 3, 1)
    assert reports.system_health(df.where("service_name = 'collector'"), now).first()["status"] == "healthy"
    assert reports.system_health(df.limit(0), now).first()["status"] == "degraded"
    assert reports.health_latest(df, at(12).replace(tzinfo=None) + dt.timedelta(seconds=300)).count() == 0


def test_summary_and_selectors(spark, metrics):
    df = metrics({"values": range(5), "host": "b"}, {"values": range(3), "host": "a", "metric_type": "error_rate"})
    parts = reports.dashboard_summary(df, anomalies(spark, 30), spark.createDataFrame([], S.ALERT), health(spark, ("x", "healthy", 0)), at(1).replace(tzinfo=None))
    assert parts["recent_anomalies"].count() == 10 and parts["recent_alerts"].count() == 0 and parts["services"].count() == 1
    assert [r["host"] for r in reports.host_selector(df).collect()] == ["a", "b"]
    assert [r["label"] for r in reports.metric_selector(df, "a").collect()] == ["ERROR RATE"]
    assert [(r["host"], r["points"], r["key"]) for r in reports.series_catalog(df).orderBy("host").collect()] == [("a", 3, "a:error_rate"), ("b", 5, "b:cpu_usage")]


def test_timeline(spark):
    rows = reports.anomaly_timeline(anomalies(spark, 100)).collect()
    assert rows[90]["score_pct"] == 90.0 and rows[90]["marker_size"] == 11.25 and rows[90]["over_line"]
    assert rows[0]["marker_size"] == 6.0 and rows[0]["color"] == "#6366f1" and rows[3]["color"] == "#8b8fa3"
