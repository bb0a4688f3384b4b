"""Row types of the data model."""

from pyspark.sql import types as T

METRIC = T.StructType(
    [
        T.StructField("metric_id", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("host", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)

RANGE = T.StructType(
    [
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
    ]
)

ANOMALY = T.StructType(
    [
        T.StructField("anomaly_id", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("expected_range", RANGE),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("host", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("anomaly_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("acknowledged_by", T.StringType()),
        T.StructField("resolved_at", T.TimestampType()),
    ]
)

HEALTH = T.StructType(
    [
        T.StructField("service_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("uptime_seconds", T.DoubleType()),
        T.StructField("last_check", T.TimestampType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)

# A user's action on an alert: acknowledge or resolve.
ACTION = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# One row per step of the alert lifecycle (see operators.alerts).
LIFECYCLE = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("trigger_id", T.StringType()),
        T.StructField("anomaly_count", T.LongType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("anomaly_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("acknowledged_by", T.StringType()),
        T.StructField("resolved_at", T.TimestampType()),
    ]
)
