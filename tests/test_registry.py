"""Model versions, the retrain job, and batches written once to several targets."""

import pytest
from pyspark.sql import functions as F

from seriesward import given
from seriesward import schema as S
from seriesward.operators.ensemble import detect_batch
from seriesward.plans import training
from seriesward.sources import registry, rollup, sink, store
from seriesward.streaming.detect import detect_versions, publish_stream
from tests.conftest import START, at, metric_rows
from tests.test_streaming import feed, waves


def test_readers_follow_committed_versions_only(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "models")
    assert registry.load(spark, root) is None and registry.runs(spark, root).count() == 0
    report = {"isolation_forest": {"status": "trained", "samples": 256}}
    assert registry.commit(spark, root, given.forest(1), given.sequence(1), report, "2024-01-01") == "20240101T000000000000"

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "save_sequence", killed)  # the forest of the next version is written, nothing else
        with pytest.raises(RuntimeError):
            registry.commit(spark, root, given.forest(2), given.sequence(2), report, "2024-01-02")
    assert len(list((tmp_path / "models" / "versions").iterdir())) == 2
    now = registry.load(spark, root)
    assert now.name == "20240101T000000000000" and now.forest.offset == given.OFFSETS[1] and now.sequence.types["cpu_usage"]["threshold"] == given.LIMITS[1]
    assert registry.runs(spark, root).where("name = 'isolation_forest'").count() == 1

    for _ in range(2):  # the job comes again, and once more
        registry.commit(spark, root, given.forest(2), given.sequence(2), report, "2024-01-02")
    assert registry.load(spark, root).forest.offset == given.OFFSETS[2]
    assert registry.load(spark, root, "2024-01-01 12:00:00").forest.offset == given.OFFSETS[1]
    assert registry.load(spark, root, "2023-01-01") is None
    runs = store.get_model_state(registry.runs(spark, root))
    assert {r.name: r.state for r in runs.collect()}[registry.LATEST_RUN] == {"isolation_forest": "trained"}
    assert registry.runs(spark, root).where("name = 'isolation_forest'").count() == 2


def test_retrain_job(spark, tmp_path):
    root, rows = str(tmp_path / "models"), metric_rows(waves(600), step=300)
    metrics = spark.createDataFrame(rows, S.METRIC)
    at_hour = lambda h: at(60 * h).replace(tzinfo=None)
    job = lambda h: training.retrain(metrics, root, at_hour(h), trees=5)
    assert training.retrain(metrics, root, "2023-06-01", trees=5) is None  # nothing to train on
    assert job(24) is not None and job(36) is None and job(48) is not None
    assert job(48) is None
    samples = {r.ts.hour + 24 * r.ts.day: int(r.state["samples"]) for r in registry.runs(spark, root).where("name = 'isolation_forest'").collect()}
    assert samples == {48: 289 - 29, 72: 577 - 29}
    assert registry.load(spark, root).forest.samples == 577 - 29
    few = spark.createDataFrame(rows[:40], S.METRIC)
    other = str(tmp_path / "few")
    assert training.retrain(few, other, at_hour(24)) is not None and registry.load(spark, other).forest is None
    assert training.retrain(few, other, at_hour(25)) is not None  # without a forest a run is always due


def _found(spark, n, first=0):
    return spark.createDataFrame([(f"a{first + k}", START) for k in range(n)], "id string, timestamp timestamp")


def test_a_batch_is_written_once(spark, tmp_path, monkeypatch):
    ledger, targets = str(tmp_path / "ledger"), (str(tmp_path / "log"), str(tmp_path / "history"))
    schema = _found(spark, 1).schema
    read = lambda: [sorted((r.id, r.sink_batch) for r in sink.read_target(spark, t, ledger, "q", schema).collect()) for t in targets]
    assert read() == [[], []]
    assert sink.write_batch(_found(spark, 3), "q", 0, ledger, *targets, note="v1")
    assert not sink.write_batch(_found(spark, 9, 50), "q", 0, ledger, *targets)  # replayed after its ledger row
    first = [("a0", 0), ("a1", 0), ("a2", 0)]
    assert read() == [first, first]

    # An attempt that dies after the first target is seen by no reader, and its replay replaces it.
    def dies(self, name, f=type(_found(spark, 1).write).parquet, **options):
        if "/history/" in name:
            raise RuntimeError("killed")
        return f(self, name, **options)

    with monkeypatch.context() as m:
        m.setattr(type(_found(spark, 1).write), "parquet", dies)
        with pytest.raises(RuntimeError):
            sink.write_batch(_found(spark, 5, 10), "q", 1, ledger, *targets)
    assert read() == [first, first]
    assert sink.write_batch(_found(spark, 2, 10), "q", 1, ledger, *targets)
    both = sorted([*first, ("a10", 1), ("a11", 1)])
    assert read() == [both, both]
    assert sink.write_batch(_found(spark, 2).where("false"), "q", 2, ledger, *targets) and read() == [both, both]
    assert sink.write_batch(_found(spark, 1), "other", 0, ledger, *targets) and read() == [both, both]
    assert {(r.batch, r.rows) for r in sink.recorded(spark, ledger, "q").collect()} == {(0, 3), (1, 2), (2, 0)}


def test_targets_get_the_rows_of_one_computation(spark, tmp_path):
    rows = _found(spark, 200).withColumn("drawn", F.rand()).withColumn("timestamp", F.col("timestamp") + F.expr("make_interval(0, 0, 0, cast(drawn * 5 as int))"))
    store.publish_anomaly(rows, str(tmp_path / "log"), str(tmp_path / "history"))
    log, history = (spark.read.parquet(str(tmp_path / x)) for x in ("log", "history"))
    assert log.count() == 200 and log.exceptAll(history).count() == 0


def test_detection_in_a_stream_whose_models_are_replaced(spark, tmp_path):
    """Four micro-batches, trained models, a retrain after the second: as batch detection by the version of the time."""
    rows = [r for h, t in (("a", "cpu_usage"), ("b", "memory_usage")) for r in metric_rows(waves(400), host=h, metric_type=t)]
    rows.sort(key=lambda r: (r[3], r[0]))
    parts = [rows[i : i + 200] for i in range(0, 800, 200)]
    df, base = spark.createDataFrame(rows, S.METRIC), str(tmp_path)
    models, found = {}, {}
    for version, end in ((1, 400), (2, 800)):
        known = spark.createDataFrame(rows[:end], S.METRIC)
        forest, sequence, report = training.train_all(known, trees=10)
        models[version] = registry.commit(spark, f"{base}/models", forest, sequence, report, rows[end - 1][3].replace(tzinfo=None))
        found[version] = detect_batch(df, forest, sequence)
        stream = feed(spark, f"{base}/in", *parts[2 * version - 2 : 2 * version])
        detect_versions(stream, f"{base}/models", f"{base}/ledger", (f"{base}/log", f"{base}/history"), f"{base}/offsets", delay="0 seconds")
    half = F.lit(rows[399][3])
    want = found[1].where(F.col("timestamp") <= half).withColumn("sink_note", F.lit(models[1]))
    want = want.unionByName(found[2].where(F.col("timestamp") > half).withColumn("sink_note", F.lit(models[2])))
    columns = ["anomaly_id", "severity", "sink_note", "host", "metric_type", "description"]
    for target in ("log", "history"):
        got = sink.read_target(spark, f"{base}/{target}", f"{base}/ledger", "detector", found[1].schema)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert want.groupBy("sink_note").count().count() == 2


def test_late_rows_are_kept_apart(spark, tmp_path):
    """What comes after later rows of its series are settled lands in a table of its own; nothing is lost."""
    base, rows = str(tmp_path), [r for h in "ab" for r in metric_rows(waves(200), host=h)]
    rows.sort(key=lambda r: (r[3], r[0]))
    held = [r for k, r in enumerate(rows) if k % 7 == 3]
    parts = [[r for r in rows[:240] if r not in held], [r for r in rows[240:] if r not in held] + held[:20], held[20:]]
    registry.commit(spark, f"{base}/models", given.forest(1), given.sequence(1), {}, "2024-01-01")
    stream = feed(spark, f"{base}/in", *parts, metric_rows([1.0], first=10_000))
    detect_versions(stream, f"{base}/models", f"{base}/ledger", (f"{base}/log",), f"{base}/offsets", delay="0 seconds", late=f"{base}/late")
    schema = stream.select("metric_id", "metric_type", "value", "timestamp", "host", "service").schema
    late = sink.read_target(spark, f"{base}/late", f"{base}/ledger", "detector_late", schema).collect()
    ids = {r[0] for r in held}
    assert {r.metric_id for r in late} <= ids and len({r.metric_id for r in late}) == len(late) == 14  # behind row 240, which was settled then
    known = {r[0]: r[2] for r in rows}
    assert all(r.value == known[r.metric_id] and r.host == r.metric_id[0] for r in late)
    # The others were settled in order, late ones left out.
    missing = {r.metric_id for r in late}
    kept = spark.createDataFrame([r for r in rows if r[0] not in missing], S.METRIC)
    want = detect_batch(kept, given.forest(1), given.sequence(1))
    got = sink.read_target(spark, f"{base}/log", f"{base}/ledger", "detector", want.schema)
    assert {(r.metric_id, r.severity) for r in got.collect()} == {(r.metric_id, r.severity) for r in want.collect()}


def test_compaction_drops_days_and_rewrites_the_boundary(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = metric_rows(range(300), host="a", step=1800) + metric_rows(range(250), host="b", step=1800) + metric_rows(range(5), host="c")
    metrics = spark.createDataFrame(rows, S.METRIC)
    store.publish_metric(metrics, path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "metrics").rglob("*.parquet")}
    before = files()
    assert store.compact(spark, path, 100) == {"dropped": 2, "rewritten": 3, "kept": 2}
    left = store.read_metrics(spark, path)
    assert sorted(r.metric_id for r in left.collect()) == sorted(r.metric_id for r in store.newest_per_series(metrics, 100).collect())
    assert set(before.items()) & set(files().items()) == {(f, t) for f, t in before.items() if any(d in f for d in ("day=2024-01-06", "day=2024-01-07"))}
    assert store.compact(spark, path, 100)["rewritten"] == 0


def test_a_restart_publishes_nothing_twice(spark, tmp_path):
    base, rows = str(tmp_path), metric_rows(range(60), step=7200)
    stream = lambda: feed(spark, f"{base}/in", rows[:30] + rows[:3])
    publish_stream(stream(), f"{base}/metrics", f"{base}/one")
    spark.createDataFrame(rows[20:], S.METRIC).coalesce(1).write.mode("append").parquet(f"{base}/in")
    publish_stream(store.read_stream(spark, f"{base}/in", S.METRIC), f"{base}/metrics", f"{base}/two")
    assert sorted(r.metric_id for r in store.read_metrics(spark, f"{base}/metrics").collect()) == [r[0] for r in rows]


def test_rollups_merge_and_count_a_batch_once(spark, tmp_path):
    root, rows = str(tmp_path), metric_rows(range(50), host="a") + metric_rows(range(20), host="b")
    assert rollup.series_catalog(spark, root).count() == 0
    df = spark.createDataFrame(rows, S.METRIC)
    assert rollup.add_metrics(df.where("host = 'a'"), root, 0) and rollup.add_metrics(df, root, 1) and not rollup.add_metrics(df, root, 1)
    assert {(r.host, r.points) for r in rollup.series_catalog(spark, root).collect()} == {("a", 100), ("b", 20)}
    stats = {r.name: r.value for r in rollup.pipeline_stats(spark, root).collect()}
    assert stats == {"metrics_stream_length": 120, "total_metric_series": 2, "anomalies_stream_length": 0, "anomaly_history_count": 0, "alerts_stream_length": 0, "alert_history_count": 0}
