"""Collected inputs brought to metric rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.scalars import host_to_service, lookup, stable_id
from ..operators.series import arrange

# Rendering of the test tables' events as metrics; 20 series.
EVENT_METRICS = {
    "click": "cpu_usage",
    "signup": "memory_usage",
    "view": "request_latency",
    "error": "error_rate",
    "purchase": "network_in",
}


def metrics_from_events(events: DataFrame) -> DataFrame:
    """Metric rows from the ``events`` table."""
    kind = lookup(F.col("event_type"), EVENT_METRICS, "unknown")
    value = (
        F.when(F.col("event_type").isin("click", "signup"), F.least(F.col("value") / 2, F.lit(100.0)))
        .when(F.col("event_type") == "view", F.col("value") * 5)
        .when(F.col("event_type") == "error", F.col("value") / 20)
        .otherwise(F.col("value"))
    )
    host = F.concat(F.lit("host-"), (F.col("user_id") % 4).cast("string"))
    return events.select(
        F.col("event_id").cast("string").alias("metric_id"),
        kind.alias("metric_type"),
        value.alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        host.alias("host"),
        host_to_service(host).alias("service"),
        F.from_json("props", "map<string,string>").alias("tags"),
    )


def load_metrics(spark, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return metrics_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All collected sources together; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def normalize_cloudwatch(points: DataFrame) -> DataFrame:
    """Exported datapoints (namespace, cw_metric, dimension_value, average, maximum, ts) as metrics.
    Metrics that are not mapped are left out."""
    pair = F.concat_ws("/", "namespace", "cw_metric")
    kind = lookup(pair, {"/".join(k): v for k, v in params.CLOUDWATCH_METRICS.items()})
    host = F.coalesce("dimension_value", F.lit("unknown"))
    top = F.coalesce("maximum", F.lit(0.0))
    return points.withColumn("metric_type", kind).where(F.col("metric_type").isNotNull()).select(
        stable_id(F.col("namespace"), F.col("cw_metric"), host, F.col("ts").cast("string")).alias("metric_id"),
        "metric_type",
        F.coalesce("average", "maximum", F.lit(0.0)).alias("value"),
        F.col("ts").alias("timestamp"),
        host.alias("host"),
        F.col("namespace").alias("service"),
        F.create_map(
            F.lit("source"), F.lit("cloudwatch"), F.lit("cw_metric"), F.col("cw_metric"), F.lit("max"), top.cast("string")
        ).alias("tags"),
    )


def downsample(metrics: DataFrame, period: int = 300, lookback_minutes: int | None = 10, as_of=None) -> DataFrame:
    """Mean and maximum per series and period, over the last minutes before ``as_of`` (default:
    the newest row); ``lookback_minutes=None`` takes everything."""
    if lookback_minutes is not None:
        if as_of is None:
            as_of = metrics.agg(F.max("timestamp")).first()[0]
        end = F.lit(as_of)
        begin = end - F.expr(f"interval {int(lookback_minutes)} minutes")
        metrics = metrics.where((F.col("timestamp") >= begin) & (F.col("timestamp") <= end))
    return (
        metrics.groupBy(F.window("timestamp", f"{period} seconds").alias("w"), *params.KEY)
        .agg(F.avg("value").alias("average"), F.max("value").alias("maximum"))
        .select("host", "metric_type", F.col("w.start").alias("period_start"), "average", "maximum")
    )


def counters_to_rate(counters: DataFrame) -> DataFrame:
    """Rates in MB/s of cumulative byte counters (host, counter, value, ts); null on the first row.
    Disk rates have 2 decimals, network rates 4."""
    sf = arrange(counters, frame=2, key=("host", "counter"), order=("ts", "value"))
    w = sf.ordered()
    elapsed = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / F.lit(1e6)
    rate = (F.col("value") - F.lag("value").over(w)) / F.greatest(elapsed, F.lit(0.1)) / (1024.0 * 1024.0)
    return sf.with_df(sf.df.withColumn("_rate", rate)).rows().select(
        "host",
        "counter",
        "ts",
        F.when(F.col("counter").startswith("disk"), F.round("_rate", 2)).otherwise(F.round("_rate", 4)).alias("rate_mb"),
    )
