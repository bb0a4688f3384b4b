"""Continuous detection. The stateful operator only keeps series state and adds the window columns;
checks, models, vote and severity are the batch expressions.

Rows wait in state until the watermark has passed them and are then taken in time order, so the
result does not depend on arrival order within the watermark delay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import params
from ..functions.scalars import finite
from ..operators.ensemble import anomalies_of, score_rows, with_vectors
from ..session import materialise
from ..sources import registry, sink, store
from . import blocks
from .pending import Pending, slices

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ROW = T.StructType(
    [
        T.StructField("metric_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("at", T.LongType()),
        T.StructField("service", T.StringType()),
    ]
)
STATE = "pos long, mean double, m2 double, lo double, hi double, recent array<double>"
LAST = "at long, metric_id string"  # of the newest settled row
STATISTICS = ("mean", "std", "min", "max", "q1", "q3")
NUMBERS = (*STATISTICS, *[f"_{m}_{k}" for k in (5, 15, 30) for m in ("mean", "std")], "_min_30", "_max_30", "_lag1", "_lag2")
OUTPUT = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        *ROW.fields,
        T.StructField("_pos", T.LongType()),
        T.StructField("count", T.LongType()),
        *[T.StructField(n, T.DoubleType()) for n in NUMBERS],
        T.StructField("_recent", T.ArrayType(T.DoubleType())),
    ]
)


WITHOUT_VECTORS = T.StructType([f for f in OUTPUT.fields if f.name not in (*NUMBERS[len(STATISTICS) :], "_recent")])

LATE = ("metric_id", "metric_type", "value", "timestamp", "host", "service")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def dedup_metrics(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each metric_id once, within the watermark delay."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["metric_id"])


def publish_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """A metric stream appended to the metrics table, each metric_id once whatever was read before: a restart without its
    checkpoint, or a second replica, adds no row."""
    return sink.run_batches(stream, lambda rows, _: store.publish_new_metrics(rows, path), checkpoint, once)


def due_ms(at) -> int:
    """The first watermark, in milliseconds, that passes a time in microseconds."""
    return -(-int(at) // 1000)


class SeriesState(StatefulProcessor):
    """Settles the rows of a series in time order. With ``keep_late``, rows that belong before what is settled come out
    at once, marked, without statistics."""

    def __init__(self, keep_late: bool = False, vectors: bool = True):
        self.keep_late, self.vectors = keep_late, vectors
        self.columns = (OUTPUT if vectors else WITHOUT_VECTORS).fieldNames()

    def init(self, handle):
        self.handle = handle
        self.pending = Pending(handle, ROW, ("at", "metric_id"))
        self.series = handle.getValueState("series", STATE)
        self.last = handle.getValueState("last", LAST) if self.keep_late else None

    def handleInputRows(self, key, rows, timerValues):
        first = None
        last = tuple(self.last.get()) if self.keep_late and self.last.exists() else None
        for pdf in rows:
            if last is not None:
                late = (pdf["at"] < last[0]) | ((pdf["at"] == last[0]) & (pdf["metric_id"] <= last[1]))
                if late.any():
                    out = pdf.loc[late, ROW.fieldNames()].assign(host=key[0], metric_type=key[1], late=True)
                    out = out.reindex(columns=[*self.columns, "late"]).astype({"_pos": "Int64", "count": "Int64"})
                    yield out.assign(_recent=None) if self.vectors else out
                    pdf = pdf[~late]
                if not len(pdf):
                    continue
            self.pending.add(pdf)
            low = due_ms(pdf["at"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done, waits = self.pending.settle(timerValues.getCurrentWatermarkInMs())
        if not len(done):
            return
        if self.keep_late:
            self.last.update((done["at"][-1].as_py(), done["metric_id"][-1].as_py()))
        if waits is not None:
            self.handle.registerTimer(due_ms(waits))
        state = blocks.empty()
        if self.series.exists():
            state = dict(zip(state, self.series.get()))
            state["recent"] = np.array(state["recent"], dtype="float64")
        for part in slices(done):
            rows = part.to_pandas()
            state, columns = blocks.advance(state, rows["value"].to_numpy(dtype="float64"), self.vectors)
            out = pd.DataFrame({"host": key[0], "metric_type": key[1], **rows, **columns})[self.columns]
            yield out.assign(late=False) if self.keep_late else out
        self.series.update((*[state[n] for n in ("pos", "mean", "m2", "lo", "hi")], state["recent"].tolist()))

    def close(self):
        pass


def series_stream(stream: DataFrame, delay: str | None = "10 minutes", keep_late: bool = False, vectors: bool = True) -> DataFrame:
    """Every metric row of the stream with the columns of its series' windows; ``delay=None`` when the stream already has
    its watermark. Rows behind the watermark are dropped and counted; with ``keep_late`` none is: a row that comes after
    later ones of its series are settled is marked in the column ``late``, without statistics, and all others count. Without
    ``vectors``, the windows that only models need are left out."""
    use_rocksdb(stream.sparkSession)
    if delay is not None:
        stream = stream.withWatermark("timestamp", delay)
    stream = stream.where(finite(F.col("value")))
    rows = stream.select("host", "metric_type", "metric_id", "value", F.unix_micros("timestamp").alias("at"), "service", "timestamp")
    # Spark drops late rows by the event time among the input's columns.
    rows = rows.drop("timestamp") if keep_late else rows
    output = OUTPUT if vectors else WITHOUT_VECTORS
    output = T.StructType([*output.fields, T.StructField("late", T.BooleanType())]) if keep_late else output
    stated = rows.groupBy(*params.KEY).transformWithStateInPandas(
        statefulProcessor=SeriesState(keep_late, vectors), outputStructType=output, outputMode="Append", timeMode="EventTime"
    )
    lags = ("_lag1", "_lag2") if vectors else ()
    return stated.withColumn("timestamp", F.timestamp_micros("at")).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in lags})


def score_stream(stream: DataFrame, forest=None, sequence=None, iqr_warmup: str = "zero", delay: str | None = "10 minutes") -> DataFrame:
    """Every metric row of the stream with checks and vote by models that stay the same."""
    stated = series_stream(stream, delay, vectors=forest is not None or sequence is not None)
    return score_rows(with_vectors(stated, forest, sequence), forest, sequence, iqr_warmup).drop("at")


def detect_stream(
    stream: DataFrame, forest=None, sequence=None, iqr_warmup: str = "zero", delay: str | None = "10 minutes",
    flag: str = "is_anomaly", score: str = "ensemble_score",
) -> DataFrame:
    """Anomalies of a metric stream, as soon as the watermark has passed them."""
    return anomalies_of(score_stream(stream, forest, sequence, iqr_warmup, delay), flag, score)


def detect_versions(
    stream: DataFrame, models: str, ledger: str, targets: tuple, checkpoint: str, query: str = "detector", iqr_warmup: str = "zero",
    delay: str | None = "10 minutes", once: bool = True, late: str | None = None,
):
    """Continuous detection with model replacement: every micro-batch is scored by the version of the registry ``models``
    that is committed when it starts, and its anomalies go to all ``targets``. The state of the series outlives versions.
    The ledger notes the version of each batch; a batch that is replayed after its ledger row keeps what it wrote. ``late``:
    a table for the rows that come too late for their series, which are dropped otherwise."""

    def each(rows: DataFrame, number: int) -> None:
        if late is not None:
            rows = materialise(rows)  # what the state gives is computed once
            sink.write_batch(rows.where("late").select(*LATE), f"{query}_late", number, ledger, late)
            rows = rows.where("not late").drop("late")
        version = registry.load(rows.sparkSession, models)
        forest, sequence = (version.forest, version.sequence) if version else (None, None)
        scored = score_rows(with_vectors(rows, forest, sequence), forest, sequence, iqr_warmup).drop("at")
        sink.write_batch(anomalies_of(scored), query, number, ledger, *targets, note=version.name if version else None)

    return sink.run_batches(series_stream(stream, delay, late is not None), each, checkpoint, once)
