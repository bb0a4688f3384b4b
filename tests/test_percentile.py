import numpy as np
import pytest

from seriesward.operators.percentile import exact_percentile, value_at_rank
from seriesward.sources.store import cap_history
from tests.conftest import at


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_against_numpy(spark, q):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=5001), "b": np.r_[np.full(400, 2.0), rng.exponential(1e9, 333)], "c": np.array([3.5])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    got = exact_percentile(spark.createDataFrame(rows, "g string, v double"), "v", q, by=("g",))
    for k, vs in groups.items():
        assert got[(k,)] == pytest.approx(np.percentile(vs, 100 * q), rel=1e-12)


def test_rank_with_ties(spark):
    values = [1.0] * 500 + [2.0] * 500 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = sorted(values)
    for rank in (0, 1, 500, 501, 1000, 1001):
        assert value_at_rank(df, "v", rank) == s[rank]


def test_cap_history_with_ties(spark):
    rows = [(f"{i:04d}", at(i // 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "anomaly_id string, timestamp timestamp")
    kept = sorted(r["anomaly_id"] for r in cap_history(df, 25).collect())
    assert kept == [f"{i:04d}" for i in (*range(175, 200),)]
    assert cap_history(df, 200).count() == 200


def test_values_that_are_not_finite_are_ignored(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 2, "nan", "inf", "-inf")] + [(None,)], "v double")
    assert exact_percentile(df, "v", 0.5) == {(): 2.0}
    assert value_at_rank(df, "v", 2) == 3.0
