"""Dashboard and operations queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.scalars import label, lookup, series_key
from ..operators.alerts import ACTION_ORDER, active_alerts, step_order


def series_catalog(metrics: DataFrame) -> DataFrame:
    """Every series with its display key and number of points."""
    return metrics.groupBy(*params.KEY).agg(F.count("*").alias("points")).withColumn("key", series_key())


def recent(df: DataFrame, count: int, time: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Newest rows first; a bounded top-k per task, never a full sort."""
    return df.orderBy(F.col(time).desc(), *([F.col(tie).desc()] if tie else [])).limit(count)


def recent_metrics(metrics: DataFrame, count: int = 100) -> DataFrame:
    return recent(metrics, count, tie="metric_id")


def recent_anomalies(anomalies: DataFrame, count: int = 50) -> DataFrame:
    return recent(anomalies, count, tie="anomaly_id")


def recent_alerts(alerts: DataFrame, count: int = 50) -> DataFrame:
    """Newest alert rows; an escalated alert shows once per change."""
    time = "event_time" if "event_time" in alerts.columns else "timestamp"
    return recent(alerts, count, time, tie="alert_id")


def severity_counts(anomalies: DataFrame, newest: int = 20) -> DataFrame:
    return recent_anomalies(anomalies, newest).groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count("*").alias("n"))


def alert_status_counts(alerts: DataFrame, newest: int = 20) -> DataFrame:
    return recent_alerts(alerts, newest).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def unfolded(df: DataFrame, **values) -> DataFrame:
    """Columns of a single row as rows of name and value."""
    pairs = [F.struct(F.lit(name).alias("name"), value.cast("long").alias("value")) for name, value in values.items()]
    return df.select(F.inline(F.array(*pairs)))


def pipeline_stats(metrics: DataFrame, anomalies: DataFrame, alerts: DataFrame, cap: int | None = None) -> DataFrame:
    """Lengths of the logs and the number of series, as name and value. ``cap`` bounds what is shown, for stores that
    keep no more. Each input is counted once and its row then unfolded."""
    shown = lambda n: F.coalesce(F.col(n), F.lit(0)) if cap is None else F.least(F.coalesce(F.col(n), F.lit(0)), F.lit(cap))

    series = metrics.groupBy(*params.KEY).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("s"))
    out = unfolded(series, metrics_stream_length=shown("n"), total_metric_series=F.col("s"))
    for name, plural, df in (("anomaly", "anomalies", anomalies), ("alert", "alerts", alerts)):
        total = df.agg(F.count("*").alias("n"))
        out = out.unionByName(unfolded(total, **{f"{plural}_stream_length": shown("n"), f"{name}_history_count": shown("n")}))
    return out


def detector_stats(scored: DataFrame) -> DataFrame:
    """Rows checked, anomalies, rate and series, from one pre-aggregated pass."""
    flagged = F.sum(F.col("is_anomaly").cast("long"))
    per_series = scored.groupBy(*params.KEY).agg(F.count("*").alias("n"), flagged.alias("a"))
    n, a = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))
    return per_series.agg(
        n.alias("total_checked"),
        a.alias("anomalies_detected"),
        F.round(a / F.greatest(n, F.lit(1)), 4).alias("anomaly_rate"),
        F.count("*").alias("metric_series_tracked"),
    )


def buffer_sizes(metrics: DataFrame, series: int | None = 10, cap: int | None = None) -> DataFrame:
    """Rows per series, for the ``series`` that appeared first (None: all); ``cap`` bounds what is shown."""
    rows = metrics.groupBy(*params.KEY).agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))
    if series is not None:
        rows = rows.orderBy("first", *params.KEY).limit(series)
    return rows.select(series_key().alias("key"), (F.col("n") if cap is None else F.least("n", F.lit(cap))).alias("size"))


def alert_stats(log: DataFrame) -> DataFrame:
    """Active, created and suppressed alerts of a lifecycle log."""
    counted = ("created", "suppressed")
    newest = F.struct("timestamp", *step_order())
    # One aggregate per series, combined before the shuffle, then one over the series.
    changes = F.col("action").isin(*ACTION_ORDER)
    series = log.groupBy(*params.KEY).agg(
        *(F.sum((F.col("action") == a).cast("long")).alias(a) for a in counted),
        F.max_by(F.when(changes, F.col("status")), F.when(changes, newest)).alias("status"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return series.agg(
        total("created").alias("alerts_created_total"),
        total("suppressed").alias("alerts_suppressed_total"),
        total((F.col("status").isNotNull() & (F.col("status") != "resolved")).cast("long")).alias("active_alerts"),
    )


def active_alert_details(log: DataFrame) -> DataFrame:
    return active_alerts(log).select(F.col("alert_id").alias("id"), "severity", "host", F.col("metric_type").alias("metric"), "status")


def training_report(spark, results: dict) -> DataFrame:
    """Rows of model, key and value of training results."""
    rows = [(model, str(k), str(v)) for model, stats in results.items() for k, v in stats.items()]
    return spark.createDataFrame(rows, "model string, key string, value string")


def detection_quality(scored: DataFrame, label_column: str = "label", flag: str = "is_anomaly") -> DataFrame:
    """Confusion counts and rates against a truth label."""
    t, p = F.col(label_column), F.col(flag)

    def n(cond):
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0))

    return scored.agg(
        n(t & p).alias("true_positives"),
        n(~t & p).alias("false_positives"),
        n(t & ~p).alias("false_negatives"),
        n(~t & ~p).alias("true_negatives"),
        F.round(F.avg(F.when(~t, p.cast("double"))), 6).alias("false_positive_rate"),
        F.round(F.avg(F.when(t, p.cast("double"))), 6).alias("detection_rate"),
    )


def health_latest(health: DataFrame, now, ttl: int = params.HEALTH_TTL_SECONDS) -> DataFrame:
    """Latest health of every service that reported within ``ttl`` seconds."""
    latest = health.groupBy("service_name").agg(F.max_by(F.struct(*health.columns), "last_check").alias("r")).select("r.*")
    at = F.lit(now).cast("timestamp")
    return latest.where(F.unix_micros("last_check") > F.unix_micros(at) - ttl * 1_000_000)


def system_health(health: DataFrame, now, ttl: int = params.HEALTH_TTL_SECONDS) -> DataFrame:
    """``healthy`` when every known service reported in time as healthy, else ``degraded``."""
    latest = health.groupBy("service_name").agg(F.max("last_check").alias("seen"), F.max_by("status", "last_check").alias("status"))
    at = F.lit(now).cast("timestamp")
    fine = (F.unix_micros("seen") > F.unix_micros(at) - ttl * 1_000_000) & (F.col("status") == "healthy")
    return latest.agg(
        F.when(F.coalesce(F.min(fine), F.lit(False)), "healthy").otherwise("degraded").alias("status"),
        F.count("*").alias("services"),
        F.coalesce(F.sum(fine.cast("long")), F.lit(0)).alias("services_fine"),
    )


def dashboard_summary(metrics, anomalies, alerts, health, now) -> dict[str, DataFrame]:
    """The parts of the dashboard, each a query of its own."""
    return {
        "stats": pipeline_stats(metrics, anomalies, alerts),
        "severity_counts": severity_counts(anomalies, 20),
        "alert_status_counts": alert_status_counts(alerts, 20),
        "recent_anomalies": recent_anomalies(anomalies, 10),
        "recent_alerts": recent_alerts(alerts, 10),
        "services": health_latest(health, now),
    }


def host_selector(metrics: DataFrame) -> DataFrame:
    return metrics.select("host").distinct().orderBy("host")


def metric_selector(metrics: DataFrame, host: str) -> DataFrame:
    kinds = metrics.where(F.col("host") == host).select("metric_type").distinct()
    return kinds.withColumn("label", label(F.col("metric_type"))).orderBy("metric_type")


def anomaly_timeline(anomalies: DataFrame) -> DataFrame:
    """Points of the timeline chart: time, percent, marker size, colour and mark above the 85 line."""
    pct = F.coalesce("anomaly_score", F.lit(0.0)) * 100
    return anomalies.select(
        "timestamp",
        "host",
        "metric_type",
        pct.alias("score_pct"),
        F.greatest(F.lit(6.0), pct / 8).alias("marker_size"),
        lookup(F.col("severity"), params.TIMELINE_COLOR, params.DEFAULT_TIMELINE_COLOR).alias("color"),
        (pct > 85).alias("over_line"),
    ).orderBy("timestamp", "host", "metric_type")
