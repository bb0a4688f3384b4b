"""Registered queries: every operator on the test tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import given, params
from .functions import scalars as fn
from .operators import alerts as al
from .operators import features as ft
from .operators import forest as fo
from .operators import sequence as sq
from .operators import stats as st
from .operators.ensemble import anomalies_of, detect_batch, ensemble_vote, score_metrics
from .operators.notify import route_notifications
from .operators.percentile import exact_percentile
from .operators.series import arrange
from .plans import reports as rp
from .plans import training as tr
from .session import materialise, scratch
from .sources import collect as co
from .sources import records as rc
from .sources import registry, rollup, sink, store
from .streaming.alerts import alert_stream
from .streaming.detect import dedup_metrics, detect_stream, detect_versions, publish_stream
from .streaming.reports import downsample_stream, health_stream, run_to_end

QUERIES: dict = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def _text(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _slim(metrics: DataFrame) -> DataFrame:
    return metrics.select("metric_id", "metric_type", "value", "timestamp", "host", "service")


def near(col, places: int = 4):
    """Rounded for comparison. Sums added up in another order differ in their last bits, so decimal
    ties are first moved off the edge; the SQL twins do the same."""
    return F.round(col + F.lit(0.0037 * 10**-places), places)


def _r(*names: str, places: int = 4):
    return [near(F.col(n), places).alias(n) for n in names]


IDS = ("metric_id", "host", "metric_type")


# ---- running statistics and the statistical check ------------------------


@query("w1_running_stats")
def running_stats(spark, sf_dir):
    sf = arrange(_slim(co.load_metrics(spark, sf_dir)), frame=1)
    return st.running_stats(sf).rows().select(*IDS, "count", *_r("mean", "std", "min", "max", places=6))


@query("w2_recent_quartiles")
def recent_quartiles(spark, sf_dir):
    sf = arrange(_slim(co.load_metrics(spark, sf_dir)))
    return st.recent_quartiles(sf).rows().select(*IDS, *_r("q1", "q3"))


def _checked(spark, sf_dir, **options):
    sf = arrange(_slim(co.load_metrics(spark, sf_dir)))
    return st.statistical_check(st.recent_quartiles(st.running_stats(sf)).rows(), **options)


@query("d1_statistical_check")
def statistical_check(spark, sf_dir):
    return _checked(spark, sf_dir).select(*IDS, "stat_flag", "iqr_flag", "abs_flag", *_r("stat_score"))


def dirty(metrics: DataFrame) -> DataFrame:
    """Every seventh point without a finite value."""
    n = F.col("metric_id").cast("long")
    lost = F.when(n % 21 == 3, F.lit(float("nan"))).when(n % 21 == 10, F.lit(float("inf")))
    return metrics.withColumn("value", F.when(n % 7 == 3, lost).otherwise(F.col("value")))


@query("d1_dirty_values")
def dirty_values(spark, sf_dir):
    sf = arrange(_slim(dirty(co.load_metrics(spark, sf_dir))))
    checked = st.statistical_check(st.recent_quartiles(st.running_stats(sf)).rows())
    return checked.select(*IDS, "stat_flag", "iqr_flag", "abs_flag", *_r("stat_score"))


@query("d1_statistical_check_mean_std")
def statistical_check_mean_std(spark, sf_dir):
    return _checked(spark, sf_dir, iqr_warmup="mean_std").select(*IDS, "stat_flag", "iqr_flag", *_r("stat_score"))


@query("flagged_per_series")
def flagged_per_series(spark, sf_dir):
    flag = F.col("stat_flag").cast("long")
    return (
        _checked(spark, sf_dir)
        .groupBy(*params.KEY)
        .agg(F.count("*").alias("points"), F.sum(flag).alias("flagged"), near(F.max("stat_score")).alias("top_score"))
    )


# ---- inputs derived from the events table ---------------------------------


def _events(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def cloudwatch_points(spark, sf_dir):
    """Events as exported cloud datapoints."""
    names = {
        "click": "CPUUtilization", "signup": "FreeableMemory", "view": "ReadLatency",
        "error": "HTTPCode_Target_5XX_Count", "purchase": "NetworkIn",
    }
    spaces = {0: "AWS/EC2", 1: "AWS/RDS", 2: "AWS/ApplicationELB"}
    return _events(spark, sf_dir).select(
        fn.lookup(F.col("user_id") % 3, spaces).alias("namespace"),
        fn.lookup(F.col("event_type"), names).alias("cw_metric"),
        F.when(F.col("user_id") > 0, F.concat(F.lit("i-"), F.col("user_id").cast("string"))).alias("dimension_value"),
        F.when(F.col("value") >= 20, F.col("value")).alias("average"),
        F.when(F.col("value") >= 10, F.col("value") * 1.5).alias("maximum"),
        "ts",
    )


def counter_rows(spark, sf_dir):
    """Events as readings of cumulative byte counters."""
    names = {"click": "disk_read", "signup": "disk_write", "view": "net_in", "error": "net_out", "purchase": "net_drop"}
    return _events(spark, sf_dir).select(
        F.concat(F.lit("host-"), (F.col("user_id") % 4).cast("string")).alias("host"),
        fn.lookup(F.col("event_type"), names).alias("counter"),
        (F.col("event_id") * 123456789.0).alias("value"),
        "ts",
    )


def health_rows(spark, sf_dir):
    """Events as health reports of five services."""
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("service_name"),
        F.when(F.col("value") > 60, "degraded").otherwise("healthy").alias("status"),
        (F.unix_micros("ts") / 1e6 - 1704067200.0).alias("uptime_seconds"),
        F.col("ts").alias("last_check"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("details"),
    )


SQUEEZE = 60  # time divisor that makes the month of events dense enough for cooldowns
ORIGIN = 1704067200000000


def stat_anomalies(spark, sf_dir, squeeze: int = SQUEEZE):
    """Rows flagged by the statistical check, as anomalies, on squeezed time."""
    scored = score_metrics(co.load_metrics(spark, sf_dir))
    rows = anomalies_of(scored, "stat_flag", "stat_score")
    at = F.floor((F.unix_micros("timestamp") - ORIGIN) / squeeze) + ORIGIN
    return rows.withColumn("timestamp", F.timestamp_micros(at.cast("long")))


def user_actions(anomalies: DataFrame) -> DataFrame:
    """Users acknowledge what began as high after 3 minutes and resolve what began as medium after 7."""
    wait = F.when(F.col("severity") == "high", 3).otherwise(7) * al.MINUTE
    return anomalies.where(F.col("severity").isin("high", "medium")).select(
        al.alert_id_of().alias("alert_id"),
        F.when(F.col("severity") == "high", "acknowledge").otherwise("resolve").alias("action"),
        F.concat(F.lit("user-"), F.col("host")).alias("user"),
        F.timestamp_micros(F.unix_micros("timestamp") + wait).alias("ts"),
    )


def lifecycle(spark, sf_dir, actions: bool = False, **options):
    found = stat_anomalies(spark, sf_dir)
    found = materialise(found) if actions else found
    return al.process_anomalies(found, user_actions(found) if actions else None, **options)


# ---- sources and sinks ------------------------------------------------------


@query("s1_metric_from_json")
def metric_from_json(spark, sf_dir):
    texts = co.load_metrics(spark, sf_dir).select(rc.metric_to_json().alias("json"))
    good, _ = rc.metric_from_json(texts)
    return good.select(*IDS, "service", _text("timestamp").alias("ts"), *_r("value"), F.col("tags")["k"].alias("tag_k"))


@query("s1_metric_quarantine")
def metric_quarantine(spark, sf_dir):
    """Errors arrive as their bare properties, which is not a metric record."""
    metrics = co.load_metrics(spark, sf_dir)
    text = F.when(F.col("metric_type") == "error_rate", F.to_json("tags")).otherwise(rc.metric_to_json())
    good, bad = rc.metric_from_json(metrics.select(text.alias("json")))
    return good.groupBy(F.col("metric_type").alias("outcome")).agg(F.count("*").alias("n")).unionByName(
        bad.groupBy(F.lit("quarantine").alias("outcome")).agg(F.count("*").alias("n"))
    )


@query("s1_missing_fields")
def missing_fields(spark, sf_dir):
    """One kind of records without a value, one without a type."""
    kind = F.col("metric_type")
    metrics = co.load_metrics(spark, sf_dir)
    text = F.when(kind == "cpu_usage", rc.metric_to_json(["metric_type", "host", "timestamp"]))
    text = text.when(kind == "error_rate", rc.metric_to_json(["value", "host", "timestamp"])).otherwise(rc.metric_to_json())
    good, bad = rc.metric_from_json(metrics.select(text.alias("json")))
    return good.groupBy(F.col("metric_type").alias("outcome")).agg(F.count("*").alias("n")).unionByName(
        bad.groupBy(F.lit("quarantine").alias("outcome")).agg(F.count("*").alias("n"))
    )


@query("s2_anomaly_json")
def anomaly_json(spark, sf_dir):
    texts = stat_anomalies(spark, sf_dir).select(rc.anomaly_to_json().alias("json"))
    good, _ = rc.anomaly_from_json(texts)
    pair = rc.range_to_list(F.col("expected_range"))
    return good.select(
        "anomaly_id", "severity", fn.micros(F.col("timestamp")).alias("at_us"),
        near(pair[0], 2).alias("lower"), near(pair[1], 2).alias("upper"),
    )


@query("s3_alert_json")
def alert_json(spark, sf_dir):
    texts = al.alert_rows(lifecycle(spark, sf_dir)).select(rc.alert_to_json().alias("json"))
    good, _ = rc.alert_from_json(texts)
    return good.select(
        "alert_id", "severity", "status", "title", fn.micros(F.col("timestamp")).alias("at_us"),
        fn.micros(F.col("resolved_at")).alias("resolved"),
    )


@query("s3_health_json")
def health_json(spark, sf_dir):
    text = health_rows(spark, sf_dir).select(rc.health_to_json().alias("json"))
    return text.select(
        F.get_json_object("json", "$.service_name").alias("service_name"),
        F.get_json_object("json", "$.status").alias("status"),
        F.get_json_object("json", "$.details.user").alias("user"),
    ).groupBy("service_name", "status", "user").agg(F.count("*").alias("n"))


@query("s8_normalize_cloudwatch")
def normalize_cloudwatch(spark, sf_dir):
    rows = co.normalize_cloudwatch(cloudwatch_points(spark, sf_dir))
    return rows.select(
        "metric_type", "host", "service", _text("timestamp").alias("ts"), *_r("value"),
        F.col("tags")["cw_metric"].alias("cw_metric"), near(F.col("tags")["max"].cast("double"), 4).alias("max_value"),
    )


@query("s9_downsample")
def downsample(spark, sf_dir):
    rows = co.downsample(_slim(co.load_metrics(spark, sf_dir)), period=300, lookback_minutes=None)
    return rows.select("host", "metric_type", _text("period_start").alias("period_start"), *_r("average", "maximum"))


@query("s9_downsample_lookback")
def downsample_lookback(spark, sf_dir):
    rows = co.downsample(_slim(co.load_metrics(spark, sf_dir)), period=300, lookback_minutes=600)
    return rows.select("host", "metric_type", _text("period_start").alias("period_start"), *_r("average", "maximum"))


@query("s10_counters_to_rate")
def counters_to_rate(spark, sf_dir):
    rows = co.counters_to_rate(counter_rows(spark, sf_dir))
    return rows.select("host", "counter", _text("ts").alias("ts"), near(F.col("rate_mb"), 4).alias("rate_mb"))


# ---- projections, lookups, joins --------------------------------------------


@query("p1_series_key")
def series_key(spark, sf_dir):
    return co.load_metrics(spark, sf_dir).select("metric_id", fn.series_key().alias("key"))


@query("p2_host_to_service")
def host_to_service(spark, sf_dir):
    """Hosts named after the rule parts, in turns."""
    parts = F.array(*[F.lit(x) for x in ("web", "api", "db", "cache", "worker", "edge", "api-db", "cache-web")])
    host = F.concat(F.get(parts, (F.col("user_id") % 8).cast("int")), F.lit("-"), F.col("user_id").cast("string"))
    return _events(spark, sf_dir).select("event_id", host.alias("host"), fn.host_to_service(host).alias("service"))


@query("p3_clamp_value")
def clamp_value(spark, sf_dir):
    wide = (F.col("value") - 40) * 3
    return co.load_metrics(spark, sf_dir).select(*IDS, near(fn.clamp_value(F.col("metric_type"), wide), 4).alias("value"))


@query("p4_metric_history")
def metric_history(spark, sf_dir):
    metrics = co.load_metrics(spark, sf_dir)
    rows = store.metric_history(metrics, "host-1", "cpu_usage", minutes=60 * 24 * 7, now="2024-01-31 00:00:00")
    return rows.select("metric_id", _text("timestamp").alias("ts"), *_r("value"))


@query("p5_training_history")
def training_history(spark, sf_dir):
    rows = store.training_history(co.load_metrics(spark, sf_dir), hours=24 * 15, now="2024-01-31 00:00:00")
    return rows.groupBy(*params.KEY).agg(F.count("*").alias("n"), near(F.sum("value"), 2).alias("total"))


def _published(spark, sf_dir):
    """The metrics as a table with a folder per day."""
    path = scratch(spark)
    store.publish_metric(co.load_metrics(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("p4_published_history")
def published_history(spark, sf_dir):
    rows = store.metric_history(_published(spark, sf_dir), "host-1", "cpu_usage", minutes=60 * 24 * 7, now="2024-01-31 00:00:00")
    return rows.select("metric_id", _text("timestamp").alias("ts"), *_r("value"))


@query("p5_published_history")
def published_training_history(spark, sf_dir):
    rows = store.training_history(_published(spark, sf_dir), hours=24 * 15, now="2024-01-31 00:00:00")
    return rows.groupBy(*params.KEY).agg(F.count("*").alias("n"), near(F.sum("value"), 2).alias("total"))


@query("p6_clean_matrix")
def clean_matrix(spark, sf_dir):
    """Values with the NaN and infinities a division leaves."""
    v = F.col("value")
    odd = F.when(v < 1, float("nan")).when(v < 2, float("inf")).when(v < 3, float("-inf")).otherwise(v)
    return co.load_metrics(spark, sf_dir).select(
        "metric_id", near(fn.clean_number(odd), 3).alias("forest_value"),
        near(fn.clean_number(F.when(v < 1, float("nan")).otherwise(v), None), 3).alias("sequence_value"),
    )


@query("p7_threshold_lookup")
def threshold_lookup(spark, sf_dir):
    kind = F.col("metric_type")
    return co.load_metrics(spark, sf_dir).select("metric_id", *[fn.threshold(kind, s).alias(s) for s in params.SEVERITIES])


@query("j2_align_metrics_by_index")
def align_metrics(spark, sf_dir):
    metrics = _slim(co.load_metrics(spark, sf_dir))
    lengths = metrics.groupBy(*params.KEY).agg(F.count("*").alias("n"))
    sf = ft.training_features(arrange(metrics, frame=31))
    rows = ft.align_by_index(sf.rows(keep_position=True), lengths)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.select("host", "i", F.size("features").alias("width"), near(F.get("features", F.lit(0)), 3).alias("first_value"), near(total, 2).alias("total"))


@query("j4_anomalies_with_alerts")
def anomalies_with_alerts(spark, sf_dir):
    found = stat_anomalies(spark, sf_dir)
    created = al.alert_rows(al.process_anomalies(found)).where(F.col("action") == "created")
    rows = al.alerts_of_anomalies(found, created)
    return rows.select("alert_id", "anomaly_id", "severity", "anomaly_severity", *_r("value", "anomaly_score"))


@query("j5_union_sources")
def union_sources(spark, sf_dir):
    a = co.load_metrics(spark, sf_dir)
    b = co.normalize_cloudwatch(cloudwatch_points(spark, sf_dir)).drop("tags")
    both = co.union_sources(a, b)
    return both.groupBy("service", "metric_type").agg(
        F.count("*").alias("n"), F.count("tags").alias("tagged"), near(F.sum("value"), 2).alias("total")
    )


# ---- windows ------------------------------------------------------------------


@query("w3_w11_extract_features")
def extract_features(spark, sf_dir):
    sf = ft.extract_features(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=30))
    return sf.rows().select(*IDS, *_r(*params.FEATURES, places=3))


@query("w12_training_features")
def training_features(spark, sf_dir):
    sf = ft.training_features(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=31))
    return sf.rows().select(*IDS, *_r(*params.FEATURES, places=3))


@query("w13_rolling_bands")
def rolling_bands(spark, sf_dir):
    sf = ft.rolling_bands(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=10))
    return sf.rows().select(*IDS, *_r("rolling_mean", "upper_band", "lower_band"), "outside")


@query("w14_sequences")
def sequences(spark, sf_dir):
    sf = ft.sequences(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=30))
    rows = sf.rows().where(F.col("sequence").isNotNull())
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        *IDS, F.size("sequence").alias("length"), near(F.get("sequence", F.lit(0)), 3).alias("first_value"), near(total, 3).alias("total")
    )


@query("w15_expected_range")
def expected_range(spark, sf_dir):
    sf = st.running_stats(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=1))
    r = st.expected_range(sf.rows())
    return r.select(*IDS, near(F.col("expected_range.lower"), 2).alias("lower"), near(F.col("expected_range.upper"), 2).alias("upper"))


@query("w16_retention_trim")
def retention_trim(spark, sf_dir):
    rows = store.retention_trim(co.load_metrics(spark, sf_dir), hours=1, interval=36)
    return rows.select(*IDS, *_r("value"))


@query("w16_compacted_table")
def compacted_table(spark, sf_dir):
    """The published table after day-level compaction."""
    path = scratch(spark)
    store.publish_metric(co.load_metrics(spark, sf_dir), path)
    store.compact(spark, path, 100)
    return store.read_metrics(spark, path).select(*IDS, *_r("value"))


@query("w17_buffer_cap")
def buffer_cap(spark, sf_dir):
    return store.buffer_cap(co.load_metrics(spark, sf_dir), 200).select(*IDS, *_r("value"))


# ---- severity, description, lifecycle --------------------------------------------


@query("d8_determine_severity")
def determine_severity(spark, sf_dir):
    score = F.col("value") / 100
    return co.load_metrics(spark, sf_dir).select(
        *IDS, fn.determine_severity(F.col("metric_type"), F.col("value"), score).alias("severity")
    )


@query("d9_describe_anomaly")
def describe_anomaly(spark, sf_dir):
    return stat_anomalies(spark, sf_dir).select("anomaly_id", "host", "metric_type", "severity", "description")


LOG = ("host", "metric_type", "action", "trigger_id", "anomaly_count", "alert_id", "severity", "status", "acknowledged_by")


def _log(log):
    return log.select(*LOG, fn.micros(F.col("event_time")).alias("at_us"))


@query("l1_process_anomaly")
def process_anomaly(spark, sf_dir):
    return _log(lifecycle(spark, sf_dir))


@query("l6_l7_actions")
def lifecycle_with_actions(spark, sf_dir):
    return _log(lifecycle(spark, sf_dir, actions=True))


@query("l8_auto_resolve")
def auto_resolve(spark, sf_dir):
    log = lifecycle(spark, sf_dir, as_of="2024-01-01 11:30:00")
    return _log(log.where(F.col("action") == "auto_resolved"))


@query("l2_cooldown")
def cooldown(spark, sf_dir):
    """When each alert's cooldown ends."""
    rows = al.alert_rows(lifecycle(spark, sf_dir)).where(F.col("action") == "created")
    end = fn.micros(F.col("timestamp")) + fn.cooldown_minutes(F.col("severity")) * al.MINUTE
    return rows.select("alert_id", "severity", end.alias("cool_until"))


@query("l5_next_severity")
def next_severity(spark, sf_dir):
    found = stat_anomalies(spark, sf_dir)
    s = F.col("severity")
    return found.select(
        "anomaly_id", "severity", fn.next_severity(s).alias("raised"), fn.severity_rank(s).cast("long").alias("rank"),
        fn.next_severity(F.concat(s, F.lit("?"))).alias("unknown_stays"),
    )


@query("l9_active_alerts")
def active_alerts(spark, sf_dir):
    rows = al.active_alerts(lifecycle(spark, sf_dir, actions=True))
    return rows.select("host", "metric_type", "alert_id", "severity", "status", "acknowledged_by")


@query("l10_alert_title")
def alert_title(spark, sf_dir):
    rows = al.alert_rows(lifecycle(spark, sf_dir))
    return rows.select("alert_id", "action", "title", "description", fn.micros(F.col("event_time")).alias("at_us"))


@query("l11_route_notifications")
def notifications(spark, sf_dir):
    rows = al.alert_rows(lifecycle(spark, sf_dir)).where(F.col("action").isin("created", "escalated"))
    out = route_notifications(rows)
    return out.select("alert_id", "severity", "host", "channel", "subject", "payload")


# ---- aggregates and reports --------------------------------------------------------


@query("a1_series_catalog")
def series_catalog(spark, sf_dir):
    return rp.series_catalog(co.load_metrics(spark, sf_dir))


@query("a2_severity_counts")
def severity_counts(spark, sf_dir):
    return rp.severity_counts(stat_anomalies(spark, sf_dir), 20)


@query("a3_alert_status_counts")
def alert_status_counts(spark, sf_dir):
    return rp.alert_status_counts(al.alert_rows(lifecycle(spark, sf_dir)), 20)


@query("a4_pipeline_stats")
def pipeline_stats(spark, sf_dir):
    found = materialise(stat_anomalies(spark, sf_dir))
    alerts = al.alert_rows(al.process_anomalies(found)).where(F.col("action").isin("created", "escalated"))
    return rp.pipeline_stats(co.load_metrics(spark, sf_dir), found, alerts)


@query("a5_detector_stats")
def detector_stats(spark, sf_dir):
    return rp.detector_stats(score_metrics(co.load_metrics(spark, sf_dir)).withColumn("is_anomaly", F.col("stat_flag")))


@query("a5_buffer_sizes")
def buffer_sizes(spark, sf_dir):
    return rp.buffer_sizes(co.load_metrics(spark, sf_dir))


@query("a6_alert_stats")
def alert_stats(spark, sf_dir):
    return rp.alert_stats(lifecycle(spark, sf_dir, actions=True))


@query("a6_active_alert_details")
def active_alert_details(spark, sf_dir):
    return rp.active_alert_details(lifecycle(spark, sf_dir, actions=True))


@query("a10_standard_scale")
def standard_scale(spark, sf_dir):
    metrics = co.load_metrics(spark, sf_dir).withColumn("one", F.lit(1.0))
    return fo.standard_scale(metrics, ["value", "one"]).select(*IDS, *_r("value", "one"))


@query("a11_detection_quality")
def detection_quality(spark, sf_dir):
    """Truth: the tag of the event is in its top tenth."""
    truth = co.load_metrics(spark, sf_dir).select("metric_id", (F.col("tags")["k"].cast("int") >= 90).alias("label"))
    return rp.detection_quality(_checked(spark, sf_dir).join(truth, "metric_id"), flag="stat_flag")


NOW = "2024-01-31 00:00:00"


@query("a12_health_latest")
def health_latest(spark, sf_dir):
    rows = rp.health_latest(health_rows(spark, sf_dir), NOW, ttl=1800)
    return rows.select("service_name", "status", fn.micros(F.col("last_check")).alias("at_us"), fn.format_uptime(F.col("uptime_seconds")).alias("uptime"))


def _summary(parts):
    """The countable parts of the summary in one long table."""
    named = [
        parts["stats"].select(F.lit("stats").alias("part"), "name", "value"),
        parts["severity_counts"].select(F.lit("severity").alias("part"), F.col("severity").alias("name"), F.col("n").alias("value")),
        parts["alert_status_counts"].select(F.lit("status").alias("part"), F.col("status").alias("name"), F.col("n").alias("value")),
        parts["recent_anomalies"].select(F.lit("anomaly").alias("part"), F.col("anomaly_id").alias("name"), fn.micros(F.col("timestamp")).alias("value")),
        parts["recent_alerts"].select(F.lit("alert").alias("part"), F.col("alert_id").alias("name"), fn.micros(F.col("event_time")).alias("value")),
        parts["services"].select(F.lit("service").alias("part"), F.col("service_name").alias("name"), fn.micros(F.col("last_check")).alias("value")),
    ]
    return co.union_sources(*named)


def _raised(found):
    return materialise(al.alert_rows(al.process_anomalies(found)).where(F.col("action").isin("created", "escalated")))


@query("a13_dashboard_summary")
def dashboard_summary(spark, sf_dir):
    found = materialise(stat_anomalies(spark, sf_dir))
    return _summary(rp.dashboard_summary(co.load_metrics(spark, sf_dir), found, _raised(found), health_rows(spark, sf_dir), NOW))


def _rolled_up(spark, sf_dir):
    """Rollups kept over three batches of metrics, anomalies and alerts, the second of which comes twice."""
    root, metrics, found = scratch(spark), co.load_metrics(spark, sf_dir), materialise(stat_anomalies(spark, sf_dir))
    alerts, third = _raised(found), F.pmod(F.xxhash64("host", "metric_type"), F.lit(3))
    for batch in (0, 1, 1, 2):
        rollup.add_metrics(metrics.where(F.col("metric_id").cast("long") % 3 == batch), root, batch)
        rollup.add_events(found.where(third == batch), "anomalies", root, batch)
        rollup.add_events(alerts.where(third == batch), "alerts", root, batch)
    return root, found.schema, alerts.schema


@query("a1_catalog_from_rollup")
def catalog_from_rollup(spark, sf_dir):
    return rollup.series_catalog(spark, _rolled_up(spark, sf_dir)[0])


@query("a4_stats_from_rollup")
def stats_from_rollup(spark, sf_dir):
    return rollup.pipeline_stats(spark, _rolled_up(spark, sf_dir)[0])


@query("a13_summary_from_rollup")
def summary_from_rollup(spark, sf_dir):
    root, anomalies, alerts = _rolled_up(spark, sf_dir)
    return _summary(rollup.dashboard_summary(spark, root, anomalies, alerts, health_rows(spark, sf_dir), NOW))


@query("a14_system_health")
def system_health(spark, sf_dir):
    return rp.system_health(health_rows(spark, sf_dir), NOW, ttl=1800)


@query("t1_recent_metrics")
def recent_metrics(spark, sf_dir):
    return rp.recent_metrics(co.load_metrics(spark, sf_dir), 200).select(*IDS, *_r("value"))


@query("t2_recent_anomalies")
def recent_anomalies(spark, sf_dir):
    return rp.recent_anomalies(stat_anomalies(spark, sf_dir), 50).select("anomaly_id", "host", "metric_type", "severity", *_r("value", "anomaly_score"))


@query("t3_recent_alerts")
def recent_alerts(spark, sf_dir):
    rows = al.alert_rows(lifecycle(spark, sf_dir)).where(F.col("action").isin("created", "escalated"))
    return rp.recent_alerts(rows, 50).select("alert_id", "severity", "action", "title")


@query("t3_latest_per_alert")
def latest_per_alert(spark, sf_dir):
    rows = al.latest_per_alert(al.alert_rows(lifecycle(spark, sf_dir)))
    return rows.select("alert_id", "severity", "action", "status")


@query("t4_cap_history")
def cap_history(spark, sf_dir):
    metrics = co.load_metrics(spark, sf_dir)
    return store.cap_history(metrics, 777, tie="metric_id").select(*IDS, *_r("value"))


@query("t5_host_selector")
def host_selector(spark, sf_dir):
    return rp.host_selector(co.load_metrics(spark, sf_dir))


@query("t5_metric_selector")
def metric_selector(spark, sf_dir):
    return rp.metric_selector(co.load_metrics(spark, sf_dir), "host-2")


@query("t6_anomaly_timeline")
def anomaly_timeline(spark, sf_dir):
    rows = rp.anomaly_timeline(stat_anomalies(spark, sf_dir))
    return rows.select("host", "metric_type", fn.micros(F.col("timestamp")).alias("at_us"), *_r("score_pct", "marker_size", places=3), "color", "over_line")


@query("scalar_text")
def scalar_text(spark, sf_dir):
    """Labels, uptime texts and ages."""
    ts = F.col("ts")
    since = fn.minutes_between(F.lit(NOW).cast("timestamp"), ts)
    return _events(spark, sf_dir).select(
        "event_id",
        fn.label(fn.lookup(F.col("event_type"), co.EVENT_METRICS)).alias("label"),
        fn.format_uptime(F.col("value") * 60).alias("uptime"),
        near(since, 3).alias("age_minutes"),
        fn.iso_time(F.date_trunc("second", ts)).alias("iso"),
    )


# ---- tables written and read back ---------------------------------------------------


@query("s4_publish_metric")
def publish_metric(spark, sf_dir):
    path = scratch(spark)
    store.publish_metric(co.load_metrics(spark, sf_dir), path)
    rows = store.read_metrics(spark, path)
    return rows.groupBy("host", "metric_type", F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("n"), near(F.sum("value"), 2).alias("total")
    )


@query("s5_publish_anomaly")
def publish_anomaly(spark, sf_dir):
    log, history = (f"{scratch(spark)}/{n}" for n in ("log", "history"))
    store.publish_anomaly(stat_anomalies(spark, sf_dir), log, history)
    both = spark.read.parquet(log).withColumn("target", F.lit("log")).unionByName(
        spark.read.parquet(history).withColumn("target", F.lit("history"))
    )
    return both.groupBy("target", "severity").agg(F.count("*").alias("n"))


@query("s6_publish_alert")
def publish_alert(spark, sf_dir):
    path = scratch(spark)
    rows = al.alert_rows(lifecycle(spark, sf_dir)).where(F.col("action").isin("created", "escalated"))
    store.publish_alert(rows, path)
    return spark.read.parquet(path).groupBy("alert_id").agg(F.count("*").alias("times"))


@query("s7_read_after")
def read_after(spark, sf_dir):
    metrics = co.load_metrics(spark, sf_dir)
    last = (pd.Timestamp("2024-01-15 12:00:00", tz="UTC").to_pydatetime(), "0")
    return store.read_after(metrics, params.ORDER, last, 100).select(*IDS, _text("timestamp").alias("ts"))


@query("s7_read_stream")
def read_stream(spark, sf_dir):
    """The published table, consumed continuously in bounded batches."""
    path = scratch(spark)
    store.publish_metric(co.load_metrics(spark, sf_dir), f"{path}/metrics")
    schema = spark.read.parquet(f"{path}/metrics").schema
    stream = store.read_stream(spark, f"{path}/metrics", schema, files_per_batch=10)
    run_to_end(stream, f"{path}/out", f"{path}/offsets")
    return spark.read.parquet(f"{path}/out").groupBy("host", "metric_type").agg(F.count("*").alias("n"))


def model_runs(spark, sf_dir):
    """Events as training runs of five models."""
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("name"), "ts",
        F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("user"), F.col("user_id").cast("string")).alias("state"),
    )


@query("s12_model_state")
def model_state(spark, sf_dir):
    rows = store.get_model_state(model_runs(spark, sf_dir))
    return rows.select("name", fn.micros(F.col("ts")).alias("at_us"), F.col("state")["user"].alias("user"), F.col("state")["value"].alias("value"))


@query("s12_save_model_state")
def save_model_state(spark, sf_dir):
    """A state per metric type written, then a second run of some, and the latest read back."""
    path = scratch(spark)
    counts = co.load_metrics(spark, sf_dir).groupBy("metric_type").agg(F.count("*").alias("n")).collect()
    for at, share in (("2024-01-01", 1), ("2024-01-02", 2)):
        for r in counts:
            if share == 1 or r.metric_type < "m":
                store.save_model_state(spark, path, r.metric_type, {"points": r.n * share}, at)
    rows = store.get_model_state(spark.read.parquet(path))
    return rows.select("name", F.col("state")["points"].cast("long").alias("points"))


@query("d11_should_retrain")
def should_retrain(spark, sf_dir):
    rows = store.retrain_due(model_runs(spark, sf_dir), "2024-01-31 23:45:00", names=("view", "never_run"))
    return rows.select("name", fn.micros(F.col("last_run")).alias("at_us"), "due")


# ---- models -----------------------------------------------------------------------------

_TRAINED: dict = {}


def _train(spark, sf_dir):
    """Models of a data folder, trained once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = tr.train_all(co.load_metrics(spark, sf_dir))
    return _TRAINED[key]


@query("d2_isolation_forest_fit")
def isolation_forest_fit(spark, sf_dir):
    """Shape of the grown trees."""
    forest = tr.train_forest(co.load_metrics(spark, sf_dir))
    nodes = spark.createDataFrame(forest.nodes, fo.NODES)
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.count("*").alias("nodes"), F.sum(F.when(leaf, F.col("size")).otherwise(0)).alias("rows"), F.max("depth").alias("depth")
    )


@query("d2_forest_bounds")
def forest_bounds(spark, sf_dir):
    """What holds for every tree whatever its random splits: its rows, one leaf more than splits, a bounded depth."""
    forest = tr.train_forest(co.load_metrics(spark, sf_dir))
    leaf = F.col("feature") < 0
    return spark.createDataFrame(forest.nodes, fo.NODES).groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("size")).otherwise(0)).alias("rows"),
        (F.count(F.when(leaf, 1)) - F.count(F.when(~leaf, 1))).alias("more_leaves"),
        (F.max("depth") <= 8).alias("depth_bounded"),
    )


@query("d3_isolation_forest_predict")
def isolation_forest_predict(spark, sf_dir):
    rows = fo.isolation_forest_predict(tr.forest_training_rows(co.load_metrics(spark, sf_dir)), _train(spark, sf_dir)[0])
    return rows.select(*IDS, "forest_label", *_r("forest_decision"))


@query("d4_isolation_forest_score")
def isolation_forest_score(spark, sf_dir):
    """The score of a prediction; here the decision is derived from the value."""
    decision = (F.col("value") - 50) / 100
    rows = co.load_metrics(spark, sf_dir).withColumn("forest_decision", F.when(F.col("value") > 1, decision))
    rows = rows.withColumn("forest_label", F.when(F.col("forest_decision") < 0, -1).when(F.col("forest_decision").isNotNull(), 1))
    return fo.isolation_forest_score(rows).select(*IDS, "forest_flag", *_r("forest_score"))


@query("d5_sequence_fit")
def sequence_fit(spark, sf_dir):
    model = sq.sequence_fit(co.load_metrics(spark, sf_dir))
    return rp.training_report(spark, model.stats)


@query("d5_sequence_counts")
def sequence_counts(spark, sf_dir):
    """What each fit was made of, with the normalisation of its type."""
    model = sq.sequence_fit(co.load_metrics(spark, sf_dir))
    rows = []
    for kind, stats in model.stats.items():
        own = model.types.get(kind)
        rows.append((kind, stats["status"], stats["samples"], stats.get("sequences"), own and float(own["mean"]), own and float(own["std"])))
    rows = spark.createDataFrame(rows, "metric_type string, status string, samples long, sequences long, mean double, std double")
    return rows.select("metric_type", "status", "samples", "sequences", *_r("mean", "std"))


@query("d6_sequence_predict")
def sequence_predict(spark, sf_dir):
    sf = ft.sequences(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=30))
    rows = sq.sequence_predict(sf.rows(), _train(spark, sf_dir)[1])
    return rows.select(*IDS, "sequence_flag", *_r("sequence_score", "sequence_mse"))


@query("j3_model_by_metric_type")
def model_by_metric_type(spark, sf_dir):
    """Rows that have a model for their type; others score (false, 0)."""
    model = _train(spark, sf_dir)[1]
    sf = ft.sequences(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=30))
    kept = sq.SequenceModel(model.length, {k: m for k, m in model.types.items() if k != "error_rate"})
    rows = sq.sequence_predict(sf.rows(), kept)
    return rows.groupBy("metric_type").agg(F.count("*").alias("n"), F.count("sequence_mse").alias("with_model"))


@query("d7_ensemble_vote")
def vote(spark, sf_dir):
    """The vote over the statistical check and two flags and scores derived from it."""
    rows = _checked(spark, sf_dir)
    rows = rows.withColumn("forest_flag", F.col("iqr_flag")).withColumn("forest_score", F.least(F.lit(1.0), F.col("value") / 100))
    rows = rows.withColumn("sequence_flag", F.col("abs_flag")).withColumn("sequence_score", F.col("stat_score"))
    return ensemble_vote(rows).select(*IDS, "votes", "is_anomaly", near(F.col("anomaly_score"), 3).alias("score"))


@query("d10_detect_batch")
def detect(spark, sf_dir):
    forest, sequence, _ = _train(spark, sf_dir)
    rows = detect_batch(co.load_metrics(spark, sf_dir), forest, sequence)
    return rows.select("anomaly_id", "host", "metric_type", "severity", *_r("value", "anomaly_score"), "description")


@query("d12_train_all")
def train_all(spark, sf_dir):
    """Also the report of A7, A8 and A9."""
    return rp.training_report(spark, _train(spark, sf_dir)[2])


@query("d12_training_status")
def training_status(spark, sf_dir):
    """The exact part of the training report: status, samples and share flagged of the forest, status per type."""
    results = _train(spark, sf_dir)[2]
    rows = [(model, stats["status"], stats["samples"]) for model, stats in results.items()]
    return spark.createDataFrame(rows, "model string, status string, samples long")


# ---- given models, which SQL evaluates too -----------------------------------------------


@query("d3_given_forest")
def given_forest(spark, sf_dir):
    rows = fo.isolation_forest_predict(tr.forest_training_rows(co.load_metrics(spark, sf_dir)), given.forest(1))
    return rows.select(*IDS, "forest_label", *_r("forest_decision"))


def _windows(spark, sf_dir):
    return ft.sequences(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=30)).rows()


@query("d6_given_sequence")
def given_sequence(spark, sf_dir):
    rows = sq.sequence_predict(_windows(spark, sf_dir), given.sequence(1))
    return rows.select(*IDS, "sequence_flag", *_r("sequence_score", "sequence_mse"))


@query("d10_given_ensemble")
def given_ensemble(spark, sf_dir):
    """The whole detection: statistics, forest, sequence model, vote, severity and text."""
    rows = detect_batch(co.load_metrics(spark, sf_dir), given.forest(1), given.sequence(1))
    return rows.select("anomaly_id", "host", "metric_type", "severity", *_r("value", "anomaly_score"), "description")


@query("a11_ensemble_quality")
def ensemble_quality(spark, sf_dir):
    """False positives and detections of the whole ensemble, against the same truth as ``a11_detection_quality``."""
    metrics = co.load_metrics(spark, sf_dir)
    truth = metrics.select("metric_id", (F.col("tags")["k"].cast("int") >= 90).alias("label"))
    return rp.detection_quality(score_metrics(metrics, given.forest(1), given.sequence(1)).join(truth, "metric_id"))


def _forest_stats(spark, sf_dir) -> dict:
    """The training report of the given forest, its offset being the contamination quantile of its scores."""
    rows = tr.forest_training_rows(co.load_metrics(spark, sf_dir))
    scored = materialise(rows.select(fo.forest_score_samples(spark, given.forest(1)).alias("score")))
    offset = exact_percentile(scored, "score", params.CONTAMINATION)[()]
    return fo.training_stats(scored, offset, scored.count(), len(params.FEATURES))


def _sequence_stats(spark, sf_dir) -> dict:
    """The training reports of the given basis; every tenth id is held out."""
    rows = _windows(spark, sf_dir).where("sequence is not null")
    error = sq.reconstruction_error(spark, given.sequence(1), F.col("sequence"), F.col("metric_type"))
    held = F.col("metric_id").cast("long") % 10 == 0
    errors = materialise(rows.select("metric_type", held.alias("held"), error.alias("mse")).where("mse is not null"))
    return sq.training_stats(errors)


@query("a7_training_stats_forest")
def forest_stats(spark, sf_dir):
    stats = _forest_stats(spark, sf_dir)
    rows = spark.createDataFrame([tuple(stats.values())], "status string, samples long, features long, anomalies long, rate double, mean double, std double")
    return rows.select("status", "samples", "features", "anomalies", *_r("rate", "mean", "std"))


@query("a8_training_stats_sequence")
def sequence_stats(spark, sf_dir):
    rows = [(k, *v.values()) for k, v in _sequence_stats(spark, sf_dir).items()]
    rows = spark.createDataFrame(rows, "metric_type string, sequences long, loss double, val_loss double, threshold double, mse_mean double, mse_std double")
    return rows.select("metric_type", "sequences", *_r("loss", "val_loss", "threshold", "mse_mean", "mse_std"))


@query("a9_training_report")
def training_report(spark, sf_dir):
    """The long table of both reports; numbers as numbers."""
    results = {"isolation_forest": _forest_stats(spark, sf_dir)} | {f"lstm_{k}": v for k, v in _sequence_stats(spark, sf_dir).items()}
    report, number = rp.training_report(spark, results), F.expr("try_cast(value as double)")
    return report.select("model", "key", near(number).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


RETRAINED = ("2024-01-25 00:00:00", "2024-01-25 12:00:00", "2024-01-26 00:00:00", "2024-01-27 06:00:00")


@query("d11_retrain_job")
def retrain_job(spark, sf_dir):
    """The periodic job at four times, of which one comes too early: the committed runs."""
    metrics, root = materialise(co.load_metrics(spark, sf_dir)), f"{scratch(spark)}/models"
    for now in RETRAINED:
        tr.retrain(metrics, root, now, retention=600, trees=8)
    runs = registry.runs(spark, root).where(F.col("name") != registry.LATEST_RUN)
    return runs.select(_text("ts").alias("at"), F.col("name").alias("model"), F.col("state")["status"].alias("status"), F.col("state")["samples"].cast("long").alias("samples"))


@query("a8_exact_percentile")
def percentile(spark, sf_dir):
    """The percentile that sets thresholds, per metric type."""
    metrics = co.load_metrics(spark, sf_dir)
    found = exact_percentile(metrics, "value", params.SEQUENCE_QUANTILE, by=("metric_type",))
    return spark.createDataFrame([(k[0], v) for k, v in found.items()], "metric_type string, p double").select(
        "metric_type", near(F.col("p"), 6).alias("p")
    )


@query("s11_save_and_load_model")
def save_and_load(spark, sf_dir):
    """Largest difference between the scores of the models and of their reloaded copies."""
    forest, sequence, _ = _train(spark, sf_dir)
    path = scratch(spark)
    store.save_forest(spark, forest, f"{path}/forest")
    store.save_sequence(spark, sequence, f"{path}/sequence")
    again, seq2 = store.load_forest(spark, f"{path}/forest"), store.load_sequence(spark, f"{path}/sequence")
    rows = tr.forest_training_rows(co.load_metrics(spark, sf_dir))
    gap = fo.forest_score_samples(spark, forest) - fo.forest_score_samples(spark, again)
    sf = ft.sequences(arrange(_slim(co.load_metrics(spark, sf_dir)), frame=30))
    kind = F.col("metric_type")
    gap2 = sq.reconstruction_error(spark, sequence, F.col("sequence"), kind) - sq.reconstruction_error(spark, seq2, F.col("sequence"), kind)

    def widest(df, col, name):
        return df.select(F.abs(col).alias("gap")).agg(F.lit(name).alias("model"), near(F.max("gap"), 6).alias("widest_gap"))

    return widest(rows, gap, "forest").unionByName(widest(sf.rows(), gap2, "sequence"))


# ---- streams, run to the end of what the folder holds ---------------------------------------


def metric_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return co.metrics_from_events(raw)


def _run(spark, stream):
    path = scratch(spark)
    query_ = run_to_end(stream, f"{path}/out", f"{path}/offsets")
    return query_, spark.read.parquet(f"{path}/out")


@query("x1_detect_stream")
def stream_detection(spark, sf_dir):
    _, rows = _run(spark, detect_stream(metric_stream(spark, sf_dir), delay="0 seconds", flag="stat_flag", score="stat_score"))
    return rows.select("anomaly_id", "host", "metric_type", "severity", *_r("value", "anomaly_score"))


FILES = 4  # of a micro-batch


def _fed(spark, *parts, path: str | None = None):
    """A stream of tables that arrive one after the other, each in a micro-batch of its own and in as many files."""
    path = path or scratch(spark)
    for part in parts:
        spread = part.count() >= 100 * FILES
        (part.repartition(FILES) if spread else part.coalesce(1)).write.mode("append").parquet(path)
        for _ in range(0 if spread else FILES - 1):
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    return store.read_stream(spark, path, parts[0].schema, files_per_batch=FILES)


@query("x1_detect_batches")
def stream_detection_in_batches(spark, sf_dir):
    """The same points in three micro-batches by time."""
    metrics, day = co.load_metrics(spark, sf_dir), F.dayofmonth("timestamp")
    stream = _fed(spark, metrics.where(day <= 8), metrics.where((day > 8) & (day <= 17)), metrics.where(day > 17))
    _, rows = _run(spark, detect_stream(stream, delay="0 seconds", flag="stat_flag", score="stat_score"))
    return rows.select("anomaly_id", "host", "metric_type", "severity", *_r("value", "anomaly_score"))


@query("x1_versioned_detection")
def versioned_detection(spark, sf_dir):
    """The whole detection over four micro-batches, with another version of the models after the second; anomalies go to
    two targets, of which the copy is read, with the version that scored them."""
    metrics, day, base = co.load_metrics(spark, sf_dir), F.dayofmonth("timestamp"), scratch(spark)
    weeks = [metrics.where((day > a) & (day <= b)) for a, b in ((0, 8), (8, 16), (16, 24), (24, 31))]
    targets = (f"{base}/log", f"{base}/history")
    for version, parts, at in ((1, weeks[:2], "2024-01-01"), (2, weeks[2:], "2024-01-17")):
        registry.commit(spark, f"{base}/models", given.forest(version), given.sequence(version), {}, at)
        stream = _fed(spark, *parts, path=f"{base}/in")
        detect_versions(stream, f"{base}/models", f"{base}/ledger", targets, f"{base}/offsets", delay="0 seconds")
    schema = anomalies_of(score_metrics(metrics.limit(0), given.forest(1), given.sequence(1))).schema
    rows = sink.read_target(spark, targets[1], f"{base}/ledger", "detector", schema)
    return rows.select("anomaly_id", "host", "metric_type", "severity", *_r("value", "anomaly_score"), "description", F.substring("sink_note", 1, 8).alias("version"))


@query("s5_stream_to_two_targets")
def stream_to_two_targets(spark, sf_dir):
    """Anomalies that arrive in three micro-batches, written once to log and history; then the first and the last batch
    come again, one of them with its ledger row and one without."""
    found, base, hour = materialise(stat_anomalies(spark, sf_dir)), scratch(spark), F.hour("timestamp")
    stream = _fed(spark, found.where(hour < 4), found.where((hour >= 4) & (hour < 8)), found.where(hour >= 8))
    targets = (f"{base}/log", f"{base}/history")

    def each(rows, number):
        sink.write_batch(rows, "anomalies", number, f"{base}/ledger", *targets)
        if number == 0:
            sink.write_batch(rows, "anomalies", number, f"{base}/ledger", *targets)
        if number == 2:
            sink.write_batch(rows, "anomalies", number, f"{base}/lost", *targets)

    sink.run_batches(stream, each, f"{base}/offsets")
    rows = [sink.read_target(spark, t, f"{base}/ledger", "anomalies", found.schema).select(F.lit(n).alias("target"), "severity") for t, n in zip(targets, ("log", "history"))]
    return co.union_sources(*rows).groupBy("target", "severity").agg(F.count("*").alias("n"))


@query("x4_late_rows")
def late_rows(spark, sf_dir):
    """Every fifth point comes two batches later, when the watermark of the first has closed most periods: it counts
    only where its period is still open."""
    metrics, late = co.load_metrics(spark, sf_dir), F.col("metric_id").cast("long") % 5 == 0
    stream = _fed(spark, metrics.where(~late), metrics.limit(0), metrics.where(late), metrics.limit(0))
    _, rows = _run(spark, downsample_stream(stream, period=86_400, delay="0 seconds"))
    return rows.select("host", "metric_type", _text("period_start").alias("period_start"), *_r("average", "maximum"))


@query("x2_alert_stream")
def stream_alerts(spark, sf_dir):
    path = scratch(spark)
    store.publish_anomaly(stat_anomalies(spark, sf_dir), path)
    stream = store.read_stream(spark, path, spark.read.parquet(path).schema)
    _, log = _run(spark, alert_stream(stream, delay="0 seconds"))
    return _log(log)


@query("x2_alert_actions")
def stream_alerts_with_actions(spark, sf_dir):
    """Two streams, anomalies and what users did, in three micro-batches by time."""
    found, hour = materialise(stat_anomalies(spark, sf_dir)), F.hour("timestamp")
    acted = user_actions(found).join(found.select(al.alert_id_of().alias("alert_id"), *params.KEY), "alert_id")
    done = F.hour("ts")
    streams = [
        _fed(spark, rows.where(h < 4), rows.where((h >= 4) & (h < 8)), rows.where(h >= 8))
        for rows, h in ((found, hour), (acted, done))
    ]
    _, log = _run(spark, alert_stream(*streams, delay="0 seconds"))
    return _log(log)


@query("x3_dedup_metrics")
def stream_dedup(spark, sf_dir):
    """Two replicas of the stream, each row kept once."""
    once = metric_stream(spark, sf_dir)
    _, rows = _run(spark, dedup_metrics(once.union(metric_stream(spark, sf_dir)), "1 minute"))
    return rows.groupBy("host", "metric_type").agg(F.count("*").alias("n"), F.countDistinct("metric_id").alias("ids"))


@query("x3_restart")
def stream_restart(spark, sf_dir):
    """The published table after a run to the end, and another from the beginning without the first one's checkpoint."""
    path = scratch(spark)
    for run in ("first", "second"):
        publish_stream(metric_stream(spark, sf_dir), f"{path}/metrics", f"{path}/{run}")
    rows = store.read_metrics(spark, f"{path}/metrics")
    return rows.groupBy("host", "metric_type").agg(F.count("*").alias("n"), F.countDistinct("metric_id").alias("ids"))


@query("x5_downsample_stream")
def stream_downsample(spark, sf_dir):
    _, rows = _run(spark, downsample_stream(metric_stream(spark, sf_dir), delay="0 seconds"))
    return rows.select("host", "metric_type", _text("period_start").alias("period_start"), *_r("average", "maximum"))


@query("x6_health_stream")
def stream_health(spark, sf_dir):
    query_, rows = _run(spark, downsample_stream(metric_stream(spark, sf_dir)))
    latest = rp.health_latest(health_stream(spark, query_, "downsampler"), "2000-01-01 00:00:00")
    return latest.select("service_name", "status", F.col("details")["rows_processed"].cast("long").alias("rows_processed"))
