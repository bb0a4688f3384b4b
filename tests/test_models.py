import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesward import params
from seriesward.operators import forest as fo
from seriesward.operators import sequence as sq
from seriesward.operators.ensemble import detect_batch, score_metrics
from seriesward.operators.features import sequences
from seriesward.operators.series import arrange
from seriesward.plans import reports, training
from seriesward.sources import store

COLS = ("a", "b", "c", "d")


def matrix(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in COLS))


@pytest.fixture(scope="module")
def forest(spark):
    x = np.random.default_rng(42).normal([50, 60, 40, 100], [5, 8, 3, 20], size=(1000, 4))
    return fo.isolation_forest_fit(matrix(spark, x), COLS)


def flagged(df, model):
    return fo.isolation_forest_score(fo.isolation_forest_predict(df, model)).where("forest_flag").count()


def test_too_few_rows(spark):
    x = np.random.default_rng(0).normal(size=(10, 4))
    assert fo.isolation_forest_fit(matrix(spark, x), COLS) == {"status": "insufficient_data", "samples": 10}


def test_training_report(forest):
    assert forest.stats["status"] == "trained" and forest.stats["samples"] == 1000 and forest.stats["features"] == 4
    assert forest.stats["anomalies_in_training"] == 50 and forest.stats["anomaly_rate"] == 0.05


def test_every_tree_holds_its_sample(forest):
    leaves = forest.nodes[forest.nodes["feature"] < 0].groupby("tree")["size"].sum()
    assert len(leaves) == params.FOREST_TREES and (leaves == params.FOREST_SAMPLES).all()
    assert forest.nodes["depth"].max() <= 8


def test_planted_outliers(spark, forest):
    rng = np.random.default_rng(1)
    usual = matrix(spark, rng.normal([50, 60, 40, 100], [5, 8, 3, 20], size=(100, 4)))
    odd = matrix(spark, rng.normal([150, 150, 150, 300], [5, 5, 5, 10], size=(100, 4)))
    assert flagged(usual, forest) < 20
    assert flagged(odd, forest) > 80


def test_paths_against_walking_the_nodes(forest):
    x = np.random.default_rng(2).normal([50, 60, 40, 100], [9, 9, 9, 30], size=(20, 4))
    scaled = (x - forest.mean) / forest.std
    want = np.zeros(20)
    for _, nodes in forest.nodes.groupby("tree"):
        rows = {n.node: n for n in nodes.itertuples()}
        for i, r in enumerate(scaled):
            n = rows[0]
            while n.feature >= 0:
                n = rows[n.left if r[n.feature] <= n.split else n.right]
            want[i] += n.depth + fo.average_path(n.size)
    np.testing.assert_allclose(fo._paths(scaled, forest.arrays()), want / params.FOREST_TREES)


def test_labels_and_missing_model(spark, forest):
    df = matrix(spark, np.random.default_rng(3).normal(50, 40, size=(50, 4)))
    labels = {r[0] for r in fo.isolation_forest_predict(df, forest).select("forest_label").distinct().collect()}
    assert labels <= {-1, 1}
    none = fo.isolation_forest_score(fo.isolation_forest_predict(df, None))
    assert none.where("forest_flag OR forest_score != 0").count() == 0


def test_large_input_is_thinned(spark):
    """More rows than twice all samples: disjoint bags, one hash per row."""
    df = spark.range(20000).select("id", *[F.randn(i).alias(c) for i, c in enumerate(COLS)])
    model = fo.isolation_forest_fit(df, COLS, identity=("id",), trees=10, max_samples=64)
    leaves = model.nodes[model.nodes["feature"] < 0].groupby("tree")["size"].sum()
    assert len(leaves) == 10 and leaves.min() >= 60 and leaves.max() <= 64
    assert model.stats["anomalies_in_training"] == 1000


def test_forest_reload(spark, forest, tmp_path):
    store.save_forest(spark, forest, str(tmp_path / "f"))
    again = store.load_forest(spark, str(tmp_path / "f"))
    df = matrix(spark, np.random.default_rng(4).normal(50, 20, size=(100, 4)))
    gap = df.select(F.abs(fo.forest_score_samples(spark, forest) - fo.forest_score_samples(spark, again)).alias("g"))
    assert gap.agg(F.max("g")).first()[0] < 1e-6 and again.offset == forest.offset


@pytest.fixture(scope="module")
def waves():
    t = np.arange(600)
    rng = np.random.default_rng(5)
    return 50 + 20 * np.sin(t / 8) + rng.normal(0, 0.5, 600), 30 + 10 * np.cos(t / 5) + rng.normal(0, 0.3, 600)


@pytest.mark.parametrize("limit", [None, 1])
def test_sequence_model(metrics, spark, waves, limit, tmp_path):
    a, b = waves
    df = metrics({"values": a, "host": "a"}, {"values": b, "host": "b"}, {"values": range(30), "host": "c"}, {"values": range(40), "metric_type": "disk_usage"})
    model = sq.sequence_fit(df, limit=limit)
    report = model.stats["cpu_usage"]
    assert (report["status"], report["samples"], report["sequences"]) == ("trained", 1200, 2 * 571)
    assert model.stats["disk_usage"] == {"status": "insufficient_data", "metric_type": "disk_usage", "samples": 40}
    both = np.r_[a, b]
    assert model.types["cpu_usage"]["mean"] == pytest.approx(both.mean()) and model.types["cpu_usage"]["std"] == pytest.approx(both.std(), abs=1e-6)

    m = model.types["cpu_usage"]
    frames = np.concatenate([np.lib.stride_tricks.sliding_window_view((v - m["mean"]) / m["std"], 30) for v in (a, b)])
    d = frames - m["center"]
    errors = np.mean((d - d @ m["components"] @ m["components"].T) ** 2, axis=1)
    assert m["threshold"] == pytest.approx(np.percentile(errors, 95))
    assert report["mse_mean"] == pytest.approx(errors.mean()) and report["mse_std"] == pytest.approx(errors.std())

    bad = a.copy()
    bad[300] += 60
    rows = sq.sequence_predict(sequences(arrange(metrics(bad), frame=30)).rows(), model).orderBy("timestamp").toPandas()
    assert not rows.iloc[:29]["sequence_flag"].any() and (rows.iloc[:29]["sequence_score"] == 0).all()
    assert rows.iloc[300:330]["sequence_flag"].all() and (rows.iloc[300:330]["sequence_score"] > 0.5).all()

    store.save_sequence(spark, model, str(tmp_path / "s"))
    again = store.load_sequence(spark, str(tmp_path / "s"))
    same = sq.sequence_predict(sequences(arrange(metrics(bad), frame=30)).rows(), again).orderBy("timestamp").toPandas()
    np.testing.assert_allclose(same["sequence_mse"].dropna(), rows["sequence_mse"].dropna(), rtol=1e-9)


def test_short_sequences_are_padded_after_normalising(metrics, spark, waves):
    model = sq.sequence_fit(metrics({"values": waves[0]}))
    m = model.types["cpu_usage"]
    short = spark.createDataFrame([("cpu_usage", [50.0, 60.0]), ("cpu_usage", None), ("none", [50.0] * 30)], "metric_type string, sequence array<double>")
    x = np.r_[np.zeros(28), (np.array([50.0, 60.0]) - m["mean"]) / m["std"]] - m["center"]
    want = np.mean((x - x @ m["components"] @ m["components"].T) ** 2)
    got = sq.sequence_predict(short, model, pad=True).collect()
    assert got[0]["sequence_mse"] == pytest.approx(want) and got[1]["sequence_mse"] is None and got[2]["sequence_mse"] is None
    assert sq.sequence_predict(short, model).where("sequence_flag OR sequence_score > 0").count() == 0


def test_train_and_detect(metrics, spark, waves):
    a, _ = waves
    history = metrics({"values": a, "host": "a"})
    forest, sequence, results = training.train_all(history, trees=50)
    assert set(results) == {"isolation_forest", *[f"lstm_{k}" for k in params.METRIC_TYPES]}
    assert reports.training_report(spark, results).where("key = 'status' AND value = 'trained'").count() == 2
    bad = a.copy()
    bad[400] = 99.5
    found = detect_batch(metrics({"values": bad, "host": "a"}), forest, sequence).collect()
    spike = [r for r in found if r["value"] == 99.5]
    assert len(spike) == 1 and spike[0]["severity"] == "critical" and spike[0]["model_used"] == "ensemble"
    assert "CRITICAL anomaly detected on a for cpu_usage. Current value: 99.50" in spike[0]["description"]
    assert len(found) < 60


def test_votes_need_a_second_detector(metrics):
    scored = score_metrics(metrics([*[50.0, 51.0] * 100, 99.0]))
    assert scored.where("stat_flag").count() > 0 and scored.where("is_anomaly").count() == 0
    assert reports.detector_stats(scored).first()["anomalies_detected"] == 0


def test_no_data(metrics, spark):
    assert training.train_all(metrics([]))[2] == {"status": {"status": "no_data"}}


def test_detection_quality(spark):
    df = spark.createDataFrame([(True, True)] * 9 + [(True, False)] + [(False, True)] * 2 + [(False, False)] * 38, "label boolean, is_anomaly boolean")
    row = reports.detection_quality(df).first()
    assert (row["detection_rate"], row["false_positive_rate"]) == (0.9, 0.05)
