"""What the steps that large tables go through hold, store and repeat."""

import numpy as np
import pandas as pd
import pytest

from seriesward import given, params
from seriesward import schema as S
from seriesward.operators import forest as fo
from seriesward.operators import sequence as sq
from seriesward.operators.ensemble import detect_batch
from seriesward.operators.features import extract_features
from seriesward.operators.series import arrange
from seriesward.operators.stats import recent_quartiles, trailing_order_stats
from seriesward.sources import records as rc
from seriesward.streaming.alerts import PENDING, AlertState
from seriesward.streaming.detect import WITHOUT_VECTORS, SeriesState


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_and_sequences_are_no_sliding_jvm_windows(metrics):
    df = metrics(np.arange(50.0))
    assert "collect_list" not in plan(extract_features(arrange(df, frame=30)).rows())
    found = plan(detect_batch(df, given.forest(1), given.sequence(1)))
    assert "collect_list" not in found and found.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("limit", [None, 1])
def test_frames_over_several_batches_and_series(spark, metrics, limit):
    """Series that begin and end inside a batch, and batches that end inside a series."""
    rng, n = np.random.default_rng(7), (250, 1, 29, 30, 640)
    series = [{"values": rng.normal(50, 5, k), "host": f"h{i}"} for i, k in enumerate(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        df = metrics(*series).coalesce(1)
        quartiles = recent_quartiles(arrange(df, limit=limit)).rows().toPandas()
        features = extract_features(arrange(df, frame=30, limit=limit)).rows().toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in series:
        x = s["values"]
        got = quartiles[quartiles["host"] == s["host"]].sort_values("timestamp")
        q1, q3 = trailing_order_stats(x, params.QUARTILE_WINDOW, params.QUARTILE_MIN_POINTS)
        assert got["q1"].tolist() == q1.tolist() and got["q3"].tolist() == q3.tolist()
        got = features[features["host"] == s["host"]].sort_values("timestamp")
        want = [x[max(0, i - 14) : i + 1].mean() if i >= 29 else np.nan for i in range(len(x))]
        np.testing.assert_allclose(got["mean_15"].to_numpy(dtype=float), want)
        np.testing.assert_allclose(got["std_30"].to_numpy(dtype=float)[29:], [x[i - 29 : i + 1].std() for i in range(29, len(x))], atol=1e-9)


def test_windows_are_not_stored_one_by_one(metrics, monkeypatch):
    stored, keep = [], sq.materialise
    monkeypatch.setattr(sq, "materialise", lambda df: stored.append(keep(df)) or stored[-1])
    sq.sequence_fit(metrics(np.sin(np.arange(500.0))))
    arrays = [df for df in stored if any(kind.startswith("array") for _, kind in df.dtypes)]
    assert len(arrays) == 1 and arrays[0].count() < 10


def test_trees_split_neighbouring_numbers():
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    assert all(len(fo.grow_tree(x, t, params.SEED, 8)) == 3 for t in range(50))


def test_json_is_read_once(spark):
    texts = spark.createDataFrame([("{}",)], "json string")
    for read in (rc.metric_from_json, rc.anomaly_from_json, rc.alert_from_json):
        assert plan(read(texts)[0]).count("from_json(") == 1


class Kept:
    """State of one key in a list."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows if len(self.rows) != 1 or isinstance(self.rows[0][0], bytes) else self.rows[0]

    def appendValue(self, row):
        self.rows.append(row)

    def put(self, rows):
        self.rows = list(rows)

    def update(self, row):
        self.rows = [row]

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, Kept())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_long_series_settles_in_slices():
    n = 25_000
    rows = pd.DataFrame({"metric_id": [f"{i:06d}" for i in range(n)], "value": np.arange(n) % 97.0, "at": np.arange(n) * 1_000_000, "service": "s"})
    mixed, key = rows.sample(frac=1, random_state=1), ("h", "cpu_usage")
    state, handle = SeriesState(vectors=False), Handle()
    state.init(handle)
    list(state.handleInputRows(key, iter(np.array_split(mixed, 5)), Clock(0)))
    assert len(handle.states["pending"].rows) == 5  # an entry per batch, not per row
    parts = list(state.handleExpiredTimer(key, Clock(24_000_000), None))
    assert max(map(len, parts)) <= 10_000 and list(parts[0].columns) == WITHOUT_VECTORS.fieldNames()
    got = pd.concat(parts, ignore_index=True)
    assert got["metric_id"].tolist() == rows["metric_id"][:24_001].tolist() and got["count"].tolist() == list(range(1, 24_002))
    np.testing.assert_allclose(got["mean"], rows["value"][:24_001].expanding().mean())
    rest = pd.concat(state.handleExpiredTimer(key, Clock(25_000_000), None))
    assert rest["count"].tolist() == list(range(24_002, n + 1)) and not handle.states["pending"].rows


def test_many_alert_events_settle_in_slices():
    n = 25_000
    rows = pd.DataFrame({c: [None] * n for c in PENDING}).assign(
        at=np.arange(n) * 60_000_000, kind=0, event_id=[f"{i:06d}" for i in range(n)], severity="low", alert_id=[f"a{i}" for i in range(n)]
    )
    state, handle = AlertState(params.STALE_MINUTES), Handle()
    state.init(handle)
    list(state.handleInputRows(("h", "cpu_usage"), iter(np.array_split(rows, 3)), Clock(0)))
    assert len(handle.states["pending"].rows) == 3
    parts = list(state.handleExpiredTimer(("h", "cpu_usage"), Clock(n * 60_000), None))
    got = pd.concat(parts)
    assert max(map(len, parts)) <= 10_000 and set(got[got["action"] != "auto_resolved"]["trigger_id"]) == set(rows["event_id"])
    assert list(got.columns) == S.LIFECYCLE.fieldNames()
