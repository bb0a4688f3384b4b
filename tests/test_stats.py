import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesward import params
from seriesward.operators.series import arrange
from seriesward.operators.stats import expected_range, recent_quartiles, running_stats, statistical_check, trailing_order_stats
from seriesward.sources.store import buffer_cap


def ordered(df):
    return df.orderBy("host", "metric_type", "timestamp", "metric_id").toPandas()


def test_baseline_and_spike(metrics):
    rng = np.random.default_rng(1)
    df = metrics([*rng.normal(40, 3, 200), 99.5])
    last = ordered(running_stats(arrange(df)).rows()).iloc[-1]
    assert last["count"] == 201 and last["mean"] < 50 and last["max"] == 99.5


@pytest.mark.parametrize("limit", [None, 1])
def test_running_stats_against_numpy(metrics, limit):
    """``limit=1`` cuts the series into chunks of 2 x frame rows."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(50, 5, 333), rng.normal(1e6, 1e-3, 101)
    df = metrics({"values": x, "host": "a"}, {"values": y, "host": "b"})
    sf = running_stats(arrange(df, frame=7, limit=limit))
    assert sf.chunked == (limit is not None)
    out = ordered(sf.rows())
    for host, v in (("a", x), ("b", y)):
        part = out[out["host"] == host]
        n = np.arange(1, len(v) + 1)
        assert (part["count"] == n).all()
        np.testing.assert_allclose(part["mean"], [v[:i].mean() for i in n], rtol=1e-12)
        np.testing.assert_allclose(part["std"], [v[:i].std() for i in n], rtol=1e-5, atol=1e-9)
        assert (part["min"] == np.minimum.accumulate(v)).all() and (part["max"] == np.maximum.accumulate(v)).all()


@pytest.mark.parametrize("limit", [None, 1])
def test_constant_series_never_flags(metrics, limit):
    sf = running_stats(arrange(metrics([50.1] * 500), frame=200, limit=limit))
    out = statistical_check(recent_quartiles(sf).rows())
    assert out.where("stat_flag OR stat_score > 0").count() == 0
    assert out.agg(F.max("std")).first()[0] < params.STD_FLOOR


def test_order_stats_against_sorting():
    x = np.random.default_rng(3).normal(size=777)
    q1, q3 = trailing_order_stats(x, 200, 100)
    for i in range(len(x)):
        s = sorted(x[max(0, i - 199) : i + 1])
        want = (s[len(s) // 4], s[3 * len(s) // 4]) if i >= 99 else (0.0, 0.0)
        assert (q1[i], q3[i]) == want


def brute_check(values, kind="cpu_usage"):
    """The check, row by row."""
    high = params.THRESHOLDS.get(kind, {}).get("high", float("inf"))
    out = []
    for i, x in enumerate(values):
        seen = np.array(values[: i + 1])
        mean, std = seen.mean(), seen.std()
        if i < 29 or std < 1e-10:
            out.append((False, 0.0))
            continue
        s = sorted(seen[-200:])
        q1, q3 = (s[len(s) // 4], s[3 * len(s) // 4]) if i >= 99 else (0.0, 0.0)
        z, reach = abs(x - mean) / std, 1.5 * (q3 - q1)
        outside, big = bool(x < q1 - reach or x > q3 + reach), bool(x >= high)
        out.append((z > 3 or outside or big, max(min(1, z / 5), 0.8 * outside, 0.9 * big)))
    return out


@pytest.mark.parametrize("limit", [None, 1])
def test_statistical_check_against_brute_force(metrics, limit):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(900) < 0.03, rng.uniform(0, 120, 900), rng.normal(60, 8, 900))
    df = metrics({"values": x, "host": "a"}, {"values": x[:150], "host": "b", "metric_type": "network_in"})
    out = ordered(statistical_check(recent_quartiles(running_stats(arrange(df, limit=limit))).rows()))
    for host, kind, v in (("a", "cpu_usage", x), ("b", "network_in", x[:150])):
        part = out[out["host"] == host]
        want = brute_check(v, kind)
        assert part["stat_flag"].tolist() == [f for f, _ in want]
        np.testing.assert_allclose(part["stat_score"], [s for _, s in want], atol=1e-9)


def test_expected_range(metrics):
    x = np.random.default_rng(5).normal(50, 5, 100)
    out = ordered(expected_range(running_stats(arrange(metrics(x))).rows()))
    first, last = out.iloc[0]["expected_range"], out.iloc[-1]["expected_range"]
    assert (first["lower"], first["upper"]) == (0.0, 100.0)
    assert 30 < last["lower"] < 50 < last["upper"] < 70


def test_buffer_cap(metrics):
    x = [i % 100 for i in range(5100)]
    kept = buffer_cap(metrics(x))
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 5000
    assert kept.agg(F.min("metric_id")).first()[0] == "h-cpu_usage-0000100"


def test_one_exchange_one_sort(metrics):
    sf = recent_quartiles(running_stats(arrange(metrics(range(50)))))
    plan = sf.rows()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_frame_guard(metrics):
    with pytest.raises(ValueError):
        recent_quartiles(arrange(metrics(range(5)), frame=30))


@pytest.mark.parametrize("limit", [None, 60])
@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), None])
def test_values_that_are_no_points(spark, metrics, bad, limit):
    """They leave no trace in any later row."""
    x = [50 + i % 7 for i in range(300)]
    whole = metrics(x)
    bad_rows = whole.where("metric_id like '%000015_'").withColumn("value", F.lit(bad).cast("double")).withColumn("metric_id", F.concat("metric_id", F.lit("x")))
    checked = lambda df: statistical_check(recent_quartiles(running_stats(arrange(df, limit=limit))).rows())
    want, got = ordered(checked(whole)), ordered(checked(whole.unionByName(bad_rows)))
    columns = ["metric_id", "count", "mean", "std", "q1", "q3", "stat_flag", "stat_score"]
    assert got[columns].equals(want[columns])
