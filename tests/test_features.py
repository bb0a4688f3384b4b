import numpy as np
import pytest

from seriesward import params
from seriesward.operators.features import align_by_index, extract_features, rolling_bands, sequences, training_features
from seriesward.operators.series import arrange
from seriesward.plans.training import forest_training_rows


def vector(values, i, frame, eps_in_std):
    """One feature vector, directly from the definition."""
    w, x, eps = np.array(values[i - frame + 1 : i + 1]), values[i], 1e-10
    std = {k: w[-k:].std() + (eps if eps_in_std else 0) for k in (5, 15)} | {30: w.std() + (eps if eps_in_std else 0)}
    div = {k: w[-k:].std() + eps for k in (5, 15)} | {30: w.std() + eps}
    return [
        x, w[-5:].mean(), w[-15:].mean(), w.mean(), std[5], std[15], std[30], x - values[i - 1],
        x - 2 * values[i - 1] + values[i - 2], (x - w.mean()) / div[30], w.min(), w.max(),
        (x - w.min()) / (w.max() - w.min() + eps), (w < x).sum() / frame,
        (x - w[-5:].mean()) / div[5], (x - w[-15:].mean()) / div[15],
    ]


@pytest.mark.parametrize("limit", [None, 1])
def test_features_against_definition(metrics, limit):
    x = np.random.default_rng(1).normal(50, 5, 200)
    out = extract_features(arrange(metrics(x), frame=30, limit=limit)).rows().orderBy("timestamp").toPandas()
    assert out.iloc[:29][list(params.FEATURES)].isna().all().all()
    for i in range(29, 200):
        np.testing.assert_allclose(out.iloc[i][list(params.FEATURES)].to_numpy(dtype=float), vector(x, i, 30, True), atol=1e-7)


def test_training_variant(metrics):
    x = np.random.default_rng(2).normal(50, 5, 80)
    out = training_features(arrange(metrics(x), frame=31)).rows().orderBy("timestamp").toPandas()
    assert len(out) == 50
    for i in range(30, 80):
        np.testing.assert_allclose(out.iloc[i - 30][list(params.FEATURES)].to_numpy(dtype=float), vector(x, i, 31, False), atol=1e-7)


def test_sixteen_features(metrics):
    x = [*np.random.default_rng(3).normal(50, 5, 50), 55.0]
    last = extract_features(arrange(metrics(x), frame=30)).rows().orderBy("timestamp").toPandas().iloc[-1]
    assert len(params.FEATURES) == 16 and not last[list(params.FEATURES)].isna().any()


def test_training_rows(metrics):
    df = metrics({"values": range(29), "host": "short"}, {"values": range(40), "host": "long"})
    rows = forest_training_rows(df).collect()
    assert len(rows) == 11 and {r["host"] for r in rows} == {"long"}


@pytest.mark.parametrize("limit", [None, 1])
def test_sequences(metrics, limit):
    out = sequences(arrange(metrics(range(100)), frame=30, limit=limit)).rows().where("sequence IS NOT NULL").orderBy("timestamp").collect()
    assert len(out) == 71
    assert all(r["sequence"] == [float(v) for v in range(i, i + 30)] for i, r in enumerate(out))


def test_bands(metrics):
    x = [1.0, 2.0, 3.0] * 10 + [50.0]
    out = rolling_bands(arrange(metrics(x), frame=10)).rows().orderBy("timestamp").toPandas()
    last = np.array(x[-10:])
    assert out.iloc[-1]["outside"] and not out.iloc[:-1]["outside"].any()
    assert out.iloc[-1]["upper_band"] == pytest.approx(last.mean() + 2 * last.std())


def test_align(metrics):
    """Two hosts, one with a type less; rows are cut to the narrowest and to the shortest series."""
    df = metrics(
        {"values": range(40), "host": "a"},
        {"values": range(35), "host": "a", "metric_type": "memory_usage"},
        {"values": range(33), "host": "b"},
        {"values": range(20), "host": "c"},
    )
    lengths = df.groupBy("host", "metric_type").count().withColumnRenamed("count", "n")
    rows = training_features(arrange(df, frame=31)).rows(keep_position=True)
    out = align_by_index(rows, lengths).orderBy("host", "i").collect()
    assert [(r["host"], r["i"]) for r in out] == [("a", i) for i in range(30, 35)] + [("b", i) for i in range(30, 33)]
    assert {len(r["features"]) for r in out} == {16}
    assert [r["features"][0] for r in out if r["host"] == "b"] == [30.0, 31.0, 32.0]
