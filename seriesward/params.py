"""Defaults of the operators. Everything below the marked line is a fixed value:
results are only comparable when these agree."""

# ---- fixed values -------------------------------------------------------

SEVERITIES = ("low", "medium", "high", "critical")

# severity -> what it is raised to
RAISED = {"low": "medium", "medium": "high", "high": "critical", "critical": "critical"}

# texts of alerts
TITLE = "[{severity}] {metric} anomaly on {host} (score: {score})"
ESCALATED = "ESCALATED from {old} to {new}. {description}"

METRIC_TYPES = (
    "cpu_usage",
    "memory_usage",
    "disk_usage",
    "network_in",
    "network_out",
    "request_latency",
    "error_rate",
    "request_count",
    "disk_io_read",
    "disk_io_write",
)

# metric type -> value at which each severity begins
THRESHOLDS = {
    "cpu_usage": {"low": 70, "medium": 80, "high": 90, "critical": 95},
    "memory_usage": {"low": 75, "medium": 85, "high": 92, "critical": 97},
    "disk_usage": {"low": 80, "medium": 88, "high": 94, "critical": 98},
    "error_rate": {"low": 1, "medium": 5, "high": 10, "critical": 25},
    "request_latency": {"low": 500, "medium": 1000, "high": 2000, "critical": 5000},
}

# ensemble score at which each severity begins when no threshold applies
SCORE_SEVERITY = {"critical": 0.95, "high": 0.85, "medium": 0.70}

# metric type -> (min, max) of plausible values
PROFILES = {
    "cpu_usage": (0.0, 100.0),
    "memory_usage": (0.0, 100.0),
    "disk_usage": (0.0, 100.0),
    "network_in": (0.0, 500.0),
    "network_out": (0.0, 500.0),
    "request_latency": (1.0, 5000.0),
    "error_rate": (0.0, 100.0),
    "request_count": (0.0, 10000.0),
}

# (namespace, exported metric) -> metric type
CLOUDWATCH_METRICS = {
    ("AWS/EC2", "CPUUtilization"): "cpu_usage",
    ("AWS/EC2", "NetworkIn"): "network_in",
    ("AWS/EC2", "NetworkOut"): "network_out",
    ("AWS/EC2", "DiskReadBytes"): "disk_io_read",
    ("AWS/EC2", "DiskWriteBytes"): "disk_io_write",
    ("AWS/RDS", "CPUUtilization"): "cpu_usage",
    ("AWS/RDS", "FreeableMemory"): "memory_usage",
    ("AWS/RDS", "ReadLatency"): "request_latency",
    ("AWS/RDS", "WriteLatency"): "request_latency",
    ("AWS/ApplicationELB", "TargetResponseTime"): "request_latency",
    ("AWS/ApplicationELB", "HTTPCode_Target_5XX_Count"): "error_rate",
    ("AWS/ApplicationELB", "RequestCount"): "request_count",
}

# host name part -> service, first match wins
HOST_SERVICES = (
    ("web", "web"),
    ("api", "api"),
    ("db", "database"),
    ("cache", "cache"),
    ("worker", "worker"),
)

COOLDOWN_MINUTES = {"low": 30, "medium": 15, "high": 10, "critical": 5}
DEFAULT_COOLDOWN_MINUTES = 15

SEVERITY_EMOJI = {"low": "🟡", "medium": "🟠", "high": "🔴", "critical": "🚨"}
DEFAULT_EMOJI = "⚠️"
SEVERITY_COLOR = {
    "low": "#FFC107",
    "medium": "#FF9800",
    "high": "#F44336",
    "critical": "#B71C1C",
}
DEFAULT_COLOR = "#757575"
TIMELINE_COLOR = {
    "low": "#6366f1",
    "medium": "#f59e0b",
    "high": "#ef4444",
    "critical": "#dc2626",
}
DEFAULT_TIMELINE_COLOR = "#8b8fa3"
SUBJECT_LENGTH = 100

# order of the feature vector
FEATURES = (
    "current",
    "mean_5",
    "mean_15",
    "mean_30",
    "std_5",
    "std_15",
    "std_30",
    "rate_of_change",
    "acceleration",
    "z_score",
    "min_30",
    "max_30",
    "range_position",
    "percentile",
    "dev_5",
    "dev_15",
)

# ---- defaults -----------------------------------------------------------

MIN_POINTS = 30
QUARTILE_MIN_POINTS = 100
QUARTILE_WINDOW = 200
STD_FLOOR = 1e-10
BUFFER_ROWS = 5000

STAT_WEIGHT, FOREST_WEIGHT, SEQUENCE_WEIGHT = 0.25, 0.40, 0.35
ANOMALY_THRESHOLD = 0.85
VOTES = 2

FOREST_TREES = 200
FOREST_SAMPLES = 256
FOREST_MIN_ROWS = 50
CONTAMINATION = 0.05
SEED = 42

SEQUENCE_LENGTH = 30
SEQUENCE_EXTRA = 50
SEQUENCE_COMPONENTS = 8
SEQUENCE_QUANTILE = 0.95

ESCALATION_COUNT = 5
STALE_MINUTES = 30
RETRAIN_HOURS = 24
RETENTION_HOURS = 72
INTERVAL_SECONDS = 10
METRIC_CAP = 100_000
HISTORY_CAP = 10_000
HEALTH_TTL_SECONDS = 300

KEY = ("host", "metric_type")
ORDER = ("timestamp", "metric_id")

# Rows of one series that a single task may hold; longer series are cut into
# overlapping chunks (see operators.series).
ROWS_PER_TASK = 1_000_000
ROWS_PER_TASK_CONF = "spark.seriesward.rowsPerTask"
