"""Tables that hold metrics, anomalies, alerts, model runs and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params
from ..operators.forest import NODES, ForestModel
from ..operators.percentile import cut_from_top
from ..operators.sequence import SequenceModel
from ..session import exists, materialise, remove


def _day(ts: str = "timestamp"):
    return F.to_date(ts)


def publish_metric(metrics: DataFrame, path: str) -> None:
    """Append to the metrics table: one folder per day, rows laid out by series and time so that
    file and row-group statistics prune a history read. Range partitioning splits hot series."""
    full = metrics.withColumns(
        {c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("host", "metric_type")}
    ).withColumn("day", _day())
    (
        full.repartitionByRange("day", "host", "metric_type", "timestamp", "metric_id")
        .sortWithinPartitions("day", "host", "metric_type", "timestamp", "metric_id")
        .write.mode("append").partitionBy("day").parquet(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def publish_anomaly(anomalies: DataFrame, *paths: str) -> None:
    """Append the same rows to every target (log and history)."""
    _append(anomalies, paths)


def publish_alert(alerts: DataFrame, *paths: str) -> None:
    """Append alert rows; an escalated alert arrives again under its id."""
    _append(alerts, paths)


def _append(df: DataFrame, paths) -> None:
    """The rows are computed once, whatever the number of targets, and laid out by day and time."""
    rows = df.withColumn("day", _day()).repartitionByRange("day", "timestamp")
    rows = materialise(rows) if len(paths) > 1 else rows
    for path in paths:
        rows.write.mode("append").partitionBy("day").parquet(path)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100):
    """Continuous read of appended files in bounded batches; the offset is the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_after(df: DataFrame, order: tuple, last: tuple | None, count: int = 100) -> DataFrame:
    """The ``count`` rows that follow position ``last`` in ``order``, in order."""
    if last is not None:
        later = None
        for i in range(len(order)):
            step = F.col(order[i]) > F.lit(last[i])
            for name, val in zip(order[:i], last[:i]):
                step = step & (F.col(name) == F.lit(val))
            later = step if later is None else later | step
        # The bound on the first column alone reaches the scan and prunes files.
        df = df.where((F.col(order[0]) >= F.lit(last[0])) & later)
    return df.orderBy(*order).limit(count)


def metric_history(metrics: DataFrame, host: str, metric_type: str, minutes: int = 60, now=None) -> DataFrame:
    """Rows of one series of the last ``minutes``, oldest first."""
    end = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    begin = end - F.expr(f"interval {int(minutes)} minutes")
    rows = metrics.where((F.col("host") == host) & (F.col("metric_type") == metric_type) & (F.col("timestamp") >= begin))
    if "day" in metrics.columns:
        rows = rows.where(F.col("day") >= F.to_date(begin))
    return rows.orderBy("timestamp", "metric_id")


def training_history(metrics: DataFrame, hours: int = params.RETENTION_HOURS, now=None) -> DataFrame:
    """All series over the retention range; a missing value counts as 0."""
    end = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    begin = end - F.expr(f"interval {int(hours)} hours")
    rows = metrics.where(F.col("timestamp") >= begin)
    if "day" in metrics.columns:
        rows = rows.where(F.col("day") >= F.to_date(begin))
    return rows.withColumn("value", F.coalesce("value", F.lit(0.0)))


def publish_new_metrics(metrics: DataFrame, path: str) -> None:
    """Append the rows whose metric_id is not in the table yet, each once. Only the days that the rows fall on are looked
    at in the table, and of them two columns."""
    spark = metrics.sparkSession
    rows = materialise(metrics.withColumn("day", _day()).dropDuplicates(["metric_id", "day"]))
    days = [r.day for r in rows.select("day").distinct().collect()]  # a row per day
    if exists(spark, path) and days:
        known = spark.read.parquet(path).where(F.col("day").isin(days)).select("metric_id", "day")
        rows = rows.join(known, ["metric_id", "day"], "left_anti")
    publish_metric(rows.drop("day"), path)


def compact(spark: SparkSession, path: str, keep: int) -> dict:
    """Keep the newest ``keep`` rows of every series in a published table, in place. Rows per series and day tell each
    series' boundary day; days before all boundaries are dropped as folders, days after all of them stay as they are, and
    only days on which some series loses rows are read and written anew. Returns how many days went which way."""
    table = spark.read.parquet(path)
    sizes = materialise(table.groupBy("day", *params.KEY).agg(F.count("*").alias("n")))  # a row per series and day
    later = Window.partitionBy(*params.KEY).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(keep) - F.coalesce(F.sum("n").over(later), F.lit(0))
    sizes = materialise(sizes.withColumn("left", F.greatest(room, F.lit(0))))
    fate = sizes.groupBy("day").agg(F.max("left").alias("most"), F.max(F.col("n") > F.col("left")).alias("loses"))
    days = fate.collect()  # a row per day
    gone, cut = [r.day for r in days if r.most == 0], [r.day for r in days if r.most and r.loses]
    if cut:
        rows = table.where(F.col("day").isin(cut)).join(sizes.where(F.col("left") > 0), ["day", *params.KEY])
        place = F.row_number().over(Window.partitionBy("day", *params.KEY).orderBy(*(F.col(c).desc() for c in params.ORDER)))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= F.col("left")).select(*table.columns)
        rows = materialise(rows).repartitionByRange("day", *params.KEY, *params.ORDER).sortWithinPartitions("day", *params.KEY, *params.ORDER)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in gone:
        remove(spark, f"{path}/day={day}")
    return {"dropped": len(gone), "rewritten": len(cut), "kept": len(days) - len(gone) - len(cut)}


def newest_per_series(metrics: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` rows of every series. Spark drops rows beyond each task's own ``keep`` before the exchange, so
    a hot series sends no more than that from each task; its optimizer does so up to a threshold, raised here."""
    conf, name = metrics.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    conf.set(name, str(max(keep, int(conf.get(name, "1000")))))  # read when the plan is made, which is later
    newest = F.row_number().over(Window.partitionBy(*params.KEY).orderBy(*(F.col(c).desc() for c in params.ORDER)))
    return metrics.withColumn("_newest", newest).where(F.col("_newest") <= keep).drop("_newest")


def retention_trim(
    metrics: DataFrame, hours: int = params.RETENTION_HOURS, interval: int = params.INTERVAL_SECONDS
) -> DataFrame:
    return newest_per_series(metrics, hours * 3600 // max(interval, 1))


def buffer_cap(metrics: DataFrame, rows: int = params.BUFFER_ROWS) -> DataFrame:
    return newest_per_series(metrics, rows)


def cap_history(df: DataFrame, keep: int = params.HISTORY_CAP, time: str = "timestamp", tie: str = "anomaly_id") -> DataFrame:
    """The newest ``keep`` rows. The time of the oldest kept row is found by counting, so the rows
    themselves are filtered in place instead of being sorted into one task."""
    at = F.unix_micros(time)
    found = cut_from_top(df.select(at.cast("double").alias("v")), "v", keep)
    if found is None:
        return df
    cut, newer = int(found[0]), found[1]
    ties = df.where(at == cut).orderBy(F.col(tie).desc()).limit(keep - newer)
    return df.where(at > cut).unionByName(ties)


def save_model_state(spark: SparkSession, path: str, name: str, state: dict, at) -> None:
    """Append one model run; ``state`` is a flat dict."""
    row = [(name, pd.Timestamp(at).to_pydatetime(), {k: str(v) for k, v in state.items()})]
    spark.createDataFrame(row, "name string, ts timestamp, state map<string,string>").write.mode("append").parquet(path)


def get_model_state(runs: DataFrame) -> DataFrame:
    """Latest state per model name."""
    return runs.groupBy("name").agg(F.max("ts").alias("ts"), F.max_by("state", "ts").alias("state"))


def retrain_due(runs: DataFrame, now, hours: int = params.RETRAIN_HOURS, names: tuple = ()) -> DataFrame:
    """Per model name, its last run and whether that is ``hours`` old. ``names`` adds models that must exist; one that
    never ran is due."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_run")
    last = runs.groupBy("name").agg(F.max("ts").alias("last_run"))
    if names:
        wanted = runs.sparkSession.createDataFrame([(n,) for n in names], "name string")
        last = last.join(wanted, "name", "full_outer")
    return last.withColumn("due", F.coalesce(age >= hours * 3_600_000_000, F.lit(True)))


def should_retrain(runs: DataFrame, now, name: str = "latest_training", hours: int = params.RETRAIN_HOURS) -> bool:
    """Whether the last run of ``name`` is ``hours`` old, or there is none."""
    row = retrain_due(runs.where(F.col("name") == name), now, hours).first()
    return row is None or row["due"]


def save_forest(spark: SparkSession, model: ForestModel, path: str) -> None:
    spark.createDataFrame(model.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    scaler = [(i, n, float(m), float(s)) for i, (n, m, s) in enumerate(zip(model.features, model.mean, model.std))]
    spark.createDataFrame(scaler, "i int, feature string, mean double, std double").coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    meta = [(float(model.offset), float(model.contamination), int(model.samples), int(model.max_samples))]
    spark.createDataFrame(meta, "offset double, contamination double, samples long, max_samples int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    scaler = spark.read.parquet(f"{path}/scaler").orderBy("i").collect()
    meta = spark.read.parquet(f"{path}/meta").first()
    nodes = spark.read.parquet(f"{path}/trees").toPandas()
    return ForestModel(
        tuple(r["feature"] for r in scaler), [r["mean"] for r in scaler], [r["std"] for r in scaler],
        nodes, meta["offset"], meta["contamination"], meta["samples"], meta["max_samples"],
    )


def save_sequence(spark: SparkSession, model: SequenceModel, path: str) -> None:
    rows = [
        (k, model.length, float(m["mean"]), float(m["std"]), m["center"].tolist(), m["components"].ravel().tolist(), float(m["threshold"]))
        for k, m in model.types.items()
    ]
    schema = "metric_type string, length int, mean double, std double, center array<double>, components array<double>, threshold double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_sequence(spark: SparkSession, path: str) -> SequenceModel:
    rows = spark.read.parquet(path).collect()
    model = SequenceModel(rows[0]["length"] if rows else params.SEQUENCE_LENGTH)
    for r in rows:
        model.types[r["metric_type"]] = {
            "mean": r["mean"], "std": r["std"], "threshold": r["threshold"], "center": np.array(r["center"]),
            "components": np.array(r["components"]).reshape(len(r["center"]), -1),
        }
    return model

