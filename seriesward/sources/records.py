"""JSON records to typed rows and back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

CORRUPT = "_corrupt_record"


#: Fields without which a record is none.
METRIC_NEEDS = ("metric_type", "value")
ANOMALY_NEEDS = ("metric_type", "value", "expected_range", "anomaly_score", "severity")
ALERT_NEEDS = ("anomaly_id", "severity", "title", "description", "metric_type")


def _parse(df: DataFrame, column: str, schema: T.StructType, needs: tuple):
    """Parsed rows and quarantined texts. A text that is not JSON of the schema, that has an unknown field or lacks a
    needed one, goes to quarantine. A record without a time gets the time of the query."""
    read = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    record = F.from_json(column, read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    unknown = F.size(F.array_except(F.coalesce(F.json_object_keys(column), F.array()), known)) > 0
    # As a generator, for expressions are otherwise copied to wherever a field is used, and the text read again at each.
    parsed = df.select("*", F.explode(F.array(F.struct(record.alias("_r"), unknown.alias("_unknown")))).alias("_p")).select(
        *[df[c] for c in df.columns], "_p.*"
    )
    bad = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull() | F.col("_unknown")
    for name in needs:
        bad = bad | F.col(f"_r.{name}").isNull()
    good = parsed.where(~bad).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return good.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp())), parsed.where(bad).select(column)


def _or_unknown(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit("unknown")) for n in names})


def metric_from_json(df: DataFrame, column: str = "json"):
    """Metric rows and quarantine; the identifier is derived when the record has none."""
    good, bad = _parse(df, column, S.METRIC, METRIC_NEEDS)
    good = _or_unknown(good, "host", "service")
    made = F.sha2(F.concat_ws("|", "host", "metric_type", F.col("timestamp").cast("string"), F.col("value").cast("string")), 256)
    return good.withColumn("metric_id", F.coalesce("metric_id", made)), bad


def metric_to_json(columns=None) -> Column:
    return F.to_json(F.struct(*(columns or S.METRIC.fieldNames())), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def anomaly_from_json(df: DataFrame, column: str = "json"):
    """Anomaly rows and quarantine; the range arrives as a two-element list."""
    wire = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == "expected_range" else f.dataType) for f in S.ANOMALY.fields]
    )
    good, bad = _parse(df, column, wire, ANOMALY_NEEDS)
    good = good.withColumn("expected_range", range_from_list(F.col("expected_range")))
    return _or_unknown(good, "host", "service", "model_used"), bad


def range_from_list(pair: Column) -> Column:
    return F.struct(F.try_element_at(pair, F.lit(1)).alias("lower"), F.try_element_at(pair, F.lit(2)).alias("upper"))


def range_to_list(pair: Column) -> Column:
    return F.array(pair["lower"], pair["upper"])


def anomaly_to_json() -> Column:
    cols = [range_to_list(F.col(n)).alias(n) if n == "expected_range" else F.col(n) for n in S.ANOMALY.fieldNames()]
    return F.to_json(F.struct(*cols), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def alert_from_json(df: DataFrame, column: str = "json"):
    good, bad = _parse(df, column, S.ALERT, ALERT_NEEDS)
    good = _or_unknown(good, "host", "service")
    return good.withColumn("status", F.coalesce("status", F.lit("firing"))), bad


def alert_to_json() -> Column:
    opts = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    return F.to_json(F.struct(*S.ALERT.fieldNames()), opts)


def health_to_json() -> Column:
    return F.to_json(F.struct(*S.HEALTH.fieldNames()), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
