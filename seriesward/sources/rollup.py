"""Partial states of the dashboard, kept per micro-batch: what a dashboard asks is answered from them, without a look at
the metrics, anomalies or alerts themselves.

A batch of metrics leaves one row per series and day (points, newest time); a batch of anomalies or alerts one row per day
(rows) and its newest rows, of which any later answer needs no more than ``NEWEST``. All states merge by sums, maxima
and the newest of the newest. Each is written by ``sink.write_batch``, so a batch that comes again counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params
from ..plans import reports
from . import sink

NEWEST = 50
COUNTS = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("points", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
#: Of each kind of event: its time and what breaks ties among the newest.
EVENTS = {"anomalies": ("timestamp", "anomaly_id"), "alerts": ("event_time", "alert_id")}


def add_metrics(rows: DataFrame, root: str, batch: int) -> bool:
    """Count a batch of metrics into the rollup."""
    day = F.to_date("timestamp")
    counts = rows.groupBy(*params.KEY, day).agg(F.count("*").alias("points"), F.max("timestamp").alias("timestamp"))
    return sink.write_batch(counts.select(COUNTS.fieldNames()), "metrics", batch, f"{root}/ledger", f"{root}/metrics")


def add_events(rows: DataFrame, kind: str, root: str, batch: int) -> bool:
    """Count a batch of anomalies or alerts, and keep its newest rows."""
    time, tie = EVENTS[kind]
    counts = rows.groupBy(F.to_date(time)).agg(F.count("*").alias("points"), F.max(time).alias("timestamp"))
    counts = counts.select(F.lit(kind).alias("host"), F.lit("").alias("metric_type"), "points", "timestamp")
    new = sink.write_batch(counts, kind, batch, f"{root}/ledger", f"{root}/counts")
    newest = reports.recent(rows, NEWEST, time, tie)
    return sink.write_batch(newest, f"{kind}_newest", batch, f"{root}/ledger", f"{root}/newest_{kind}", time=time) or new


def counts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """host, metric_type, points, timestamp: the partial counts of all batches."""
    folder = "metrics" if kind == "metrics" else "counts"
    return sink.read_target(spark, f"{root}/{folder}", f"{root}/ledger", kind, COUNTS).select(COUNTS.fieldNames())


def newest(spark: SparkSession, root: str, kind: str, schema: T.StructType) -> DataFrame:
    """The newest ``NEWEST`` anomalies or alerts of all batches."""
    rows = sink.read_target(spark, f"{root}/newest_{kind}", f"{root}/ledger", f"{kind}_newest", schema)
    return reports.recent(rows.select(schema.fieldNames()), NEWEST, *EVENTS[kind])


def series_catalog(spark: SparkSession, root: str) -> DataFrame:
    """As ``reports.series_catalog`` of all metrics."""
    return counts(spark, root, "metrics").groupBy(*params.KEY).agg(F.sum("points").alias("points")).withColumn("key", reports.series_key())


def pipeline_stats(spark: SparkSession, root: str) -> DataFrame:
    """As ``reports.pipeline_stats`` of all metrics, anomalies and alerts."""
    series = series_catalog(spark, root).agg(F.coalesce(F.sum("points"), F.lit(0)).alias("n"), F.count("*").alias("s"))
    out = reports.unfolded(series, metrics_stream_length=F.col("n"), total_metric_series=F.col("s"))
    for name, kind in (("anomaly", "anomalies"), ("alert", "alerts")):
        total = counts(spark, root, kind).agg(F.coalesce(F.sum("points"), F.lit(0)).alias("n"))
        out = out.unionByName(reports.unfolded(total, **{f"{kind}_stream_length": F.col("n"), f"{name}_history_count": F.col("n")}))
    return out


def dashboard_summary(spark: SparkSession, root: str, anomalies: T.StructType, alerts: T.StructType, health: DataFrame, now) -> dict[str, DataFrame]:
    """As ``reports.dashboard_summary``."""
    found, raised = newest(spark, root, "anomalies", anomalies), newest(spark, root, "alerts", alerts)
    return {
        "stats": pipeline_stats(spark, root),
        "severity_counts": reports.severity_counts(found, 20),
        "alert_status_counts": reports.alert_status_counts(raised, 20),
        "recent_anomalies": reports.recent_anomalies(found, 10),
        "recent_alerts": reports.recent_alerts(raised, 10),
        "services": reports.health_latest(health, now),
    }
