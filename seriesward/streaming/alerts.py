"""Continuous alert lifecycle: the batch fold over state, with event-time timers."""

from __future__ import annotations

import json
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import params
from ..operators.alerts import EVENT_COLUMNS, LOG_COLUMNS, MINUTE, RAW_LOG, TIMES, expire, fold, lifecycle_events, new_state, typed_log
from .detect import due_ms, use_rocksdb
from .pending import ROWS, Pending, slices

PENDING = [c for c in EVENT_COLUMNS if c not in params.KEY]
KINDS = {"at": T.LongType(), "kind": T.LongType()}
EVENT = T.StructType([T.StructField(c, KINDS.get(c, T.StringType())) for c in PENDING])


class AlertState(StatefulProcessor):
    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle):
        self.handle = handle
        self.pending = Pending(handle, EVENT, ("at", "kind", "event_id"))
        self.saved = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            self.pending.add(pdf)
            low = due_ms(pdf["at"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        due, waits = self.pending.settle(now)
        if len(due) and waits is not None:
            self.handle.registerTimer(due_ms(waits))
        state = json.loads(self.saved.get()[0]) if self.saved.exists() else new_state()
        events = (dict(e, host=key[0], metric_type=key[1]) for part in slices(due) for e in part.to_pylist())
        log = chain(fold(state, events, self.stale), expire(state, now * 1000, self.stale))
        while rows := list(islice(log, ROWS)):
            out = pd.DataFrame(rows, columns=LOG_COLUMNS)
            for name in (*TIMES, "anomaly_count"):
                out[name] = out[name].astype("Int64")
            yield out
        self.saved.update((json.dumps(state),))
        if state["alert"] is not None:
            self.handle.registerTimer((state["alert"]["timestamp"] + self.stale * MINUTE) // 1000 + 1)

    def close(self):
        pass


def alert_stream(
    anomalies: DataFrame, actions: DataFrame | None = None, delay: str | None = "10 minutes", stale: int = params.STALE_MINUTES
) -> DataFrame:
    """Lifecycle log of an anomaly stream. Streamed actions carry the series of their alert:
    host, metric_type, alert_id, action, user, ts."""
    use_rocksdb(anomalies.sparkSession)
    if delay is not None:
        anomalies = anomalies.withWatermark("timestamp", delay)
    events = lifecycle_events(anomalies, with_time=True)
    if actions is not None:
        if delay is not None:
            actions = actions.withWatermark("ts", delay)
        events = events.unionByName(lifecycle_events(actions=actions, with_time=True))
    raw = events.withColumn("kind", F.col("kind").cast("long")).groupBy(*params.KEY).transformWithStateInPandas(
        statefulProcessor=AlertState(stale), outputStructType=RAW_LOG, outputMode="Append", timeMode="EventTime"
    )
    return typed_log(raw)
