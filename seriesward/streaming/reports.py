"""Streaming aggregates and health rows of running queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..schema import HEALTH


def downsample_stream(stream: DataFrame, period: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Mean and maximum per series and closed period."""
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", f"{period} seconds").alias("w"), *params.KEY)
        .agg(F.avg("value").alias("average"), F.max("value").alias("maximum"))
        .select("host", "metric_type", F.col("w.start").alias("period_start"), "average", "maximum")
    )


def health_stream(spark, query, service: str, stats: dict | None = None, before: dict | None = None) -> DataFrame:
    """Health rows of a streaming query, one per progress report since ``before``, with its counters and the service's
    own statistics as details. A query keeps its last reports only (``spark.sql.streaming.numRecentProgressUpdates``);
    a service that outlives them calls this in between and passes ``totals`` of the rows so far. Lost reports raise."""
    before = before or {"batch": -1, "rows_processed": 0, "begin": None}
    rows, total, begin, last = [], before["rows_processed"], before["begin"], before["batch"]
    kept, most = list(query.recentProgress), int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(kept) >= most and kept[0]["batchId"] > last + 1:
        raise ValueError(f"the reports of batches {last + 1} to {kept[0]['batchId'] - 1} are gone; pass the totals before them")
    for progress in kept:
        batch = progress["batchId"]
        if batch <= before["batch"]:
            continue
        at = pd.Timestamp(progress["timestamp"]).tz_localize(None)
        begin, last = (begin if begin is not None else at), batch
        total += progress["numInputRows"]
        states = progress["stateOperators"]
        details = {
            "batch": batch,
            "rows_processed": total,
            "rows_dropped_late": sum(s["numRowsDroppedByWatermark"] for s in states),
            "rows_in_state": sum(s["numRowsTotal"] for s in states),
            **(stats or {}),
        }
        status = "healthy" if query.exception() is None else "unhealthy"
        rows.append((service, status, (at - begin).total_seconds(), at.to_pydatetime(), {k: str(v) for k, v in details.items()}))
    return spark.createDataFrame(rows, HEALTH)


def totals(health: DataFrame, before: dict | None = None) -> dict:
    """What ``health_stream`` needs to go on after these rows."""
    rows = health.selectExpr("cast(details['batch'] as long) as batch", "cast(details['rows_processed'] as long) as rows", "last_check", "uptime_seconds").collect()
    if not rows:
        return before or {"batch": -1, "rows_processed": 0, "begin": None}
    last = max(rows, key=lambda r: (r.batch, r.rows))
    return {"batch": last.batch, "rows_processed": last.rows, "begin": pd.Timestamp(last.last_check) - pd.Timedelta(seconds=last.uptime_seconds)}


def run_to_end(stream: DataFrame, path: str, checkpoint: str):
    """Process everything a stream has now into parquet; returns the finished query."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
