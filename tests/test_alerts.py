import random

import pytest
from pyspark.sql import functions as F

from seriesward import params
from seriesward import schema as S
from seriesward.operators import alerts as al
from seriesward.operators.notify import route_notifications
from seriesward.plans import reports
from tests.conftest import at


def anomaly(i, minute, severity="high", host="test-host", metric_type="cpu_usage", score=0.9):
    return (f"a{i:05d}", metric_type, 95.0, (30.0, 60.0), score, severity, at(minute), host, "test", "ensemble", "Test anomaly description")


@pytest.fixture
def lifecycle(spark):
    def run(rows, actions=(), **options):
        found = spark.createDataFrame(rows, S.ANOMALY)
        acted = None
        if actions:
            ids = {r[0]: r[1] for r in found.select("anomaly_id", al.alert_id_of()).collect()}
            acted = spark.createDataFrame([(ids.get(a, a), act, user, at(m)) for a, act, user, m in actions], S.ACTION)
        log = al.process_anomalies(found, acted, **options)
        return log.orderBy("host", "metric_type", "event_time", "trigger_id").collect()

    return run


def acts(log):
    return [r["action"] for r in log]


def test_create(lifecycle):
    (row,) = lifecycle([anomaly(1, 0)])
    assert (row["action"], row["severity"], row["status"], row["host"], row["metric_type"]) == (
        "created", "high", "firing", "test-host", "cpu_usage",
    )
    assert row["title"] == "[HIGH] cpu_usage anomaly on test-host (score: 0.90)"


def test_cooldown_and_its_end(lifecycle):
    """High cools 10 minutes; at its end the firing alert suppresses until five anomalies."""
    log = lifecycle([anomaly(1, 0), anomaly(2, 9.99), anomaly(3, 10)])
    assert acts(log) == ["created", "suppressed", "suppressed"]


def test_separate_keys(lifecycle):
    log = lifecycle([anomaly(1, 0, host="a"), anomaly(2, 0, host="b"), anomaly(3, 0, host="a", metric_type="memory_usage")])
    assert acts(log) == ["created"] * 3


def test_escalation_until_critical(lifecycle):
    log = lifecycle([anomaly(i, m, "medium") for i, m in enumerate((0, 1, 2, 3, 15, 16, 17))])
    assert acts(log) == ["created", *["suppressed"] * 3, "escalated", "escalated", "unchanged"]
    assert [r["severity"] for r in log if r["action"] == "escalated"] == ["high", "critical"]
    assert log[4]["description"] == "ESCALATED from medium to high. Test anomaly description"
    assert len({r["alert_id"] for r in log}) == 1


def test_acknowledge_then_new_alert(lifecycle):
    log = lifecycle([anomaly(1, 0), anomaly(2, 11)], [("a00001", "acknowledge", "ops", 5)])
    assert acts(log) == ["created", "acknowledged", "created"]
    assert log[1]["acknowledged_by"] == "ops" and log[1]["status"] == "acknowledged"
    assert log[2]["anomaly_count"] == 2


def test_create_escalates_with_count(lifecycle):
    """Ten anomalies since the last reset raise a new alert by a level, fifteen make it critical."""
    for n, want in ((9, "low"), (10, "medium"), (14, "medium"), (15, "critical")):
        rows = [anomaly(i, i / 10, "low") for i in range(n - 1)] + [anomaly(99, 30, "low")]
        log = lifecycle(rows, [("a00000", "acknowledge", "ops", 3)])
        assert log[-1]["action"] == "created" and log[-1]["severity"] == want


def test_resolve_keeps_cooldown_and_count(lifecycle):
    rows = [anomaly(i, m, "low") for i, m in enumerate((0, 10, 11, 31))]
    log = lifecycle(rows, [("a00000", "resolve", "ops", 5)])
    assert acts(log) == ["created", "resolved", "suppressed", "suppressed", "created"]
    assert log[1]["resolved_at"] == at(5).replace(tzinfo=None) and log[-1]["anomaly_count"] == 3


def test_unknown_alert_action(lifecycle):
    assert acts(lifecycle([anomaly(1, 0)], [("nobody", "resolve", "ops", 1)])) == ["created"]


def test_stale_boundary(lifecycle):
    assert acts(lifecycle([anomaly(1, 0, "critical"), anomaly(2, 30)])) == ["created", "suppressed"]
    log = lifecycle([anomaly(1, 0, "critical"), anomaly(2, 30.001)])
    assert acts(log) == ["created", "auto_resolved", "created"]
    assert log[1]["resolved_at"] == at(30).replace(tzinfo=None)


def test_sweep(lifecycle):
    assert acts(lifecycle([anomaly(1, 0)], as_of=at(60).replace(tzinfo=None))) == ["created", "auto_resolved"]
    assert acts(lifecycle([anomaly(1, 0)], as_of=at(30).replace(tzinfo=None))) == ["created"]


def test_critical_cools_faster():
    assert params.COOLDOWN_MINUTES["critical"] < params.COOLDOWN_MINUTES["low"]


def one_by_one(rows, actions, stale=30):
    """Plain simulation of one series: (action, anomaly or alert, severity, count) per step."""
    steps = [(minute, 0, i, sev) for i, minute, sev in rows] + [(m, 1, a, what) for a, what, m in actions]
    steps.sort(key=lambda s: (s[0], s[1], s[2]) if s[1] == 0 else (s[0], 1 + (s[3] == "resolve"), s[2]))
    names, out = params.SEVERITIES, []
    live, count, quiet_until = None, 0, -1.0
    for minute, is_action, ref, what in steps:
        if live and minute - live["since"] > stale:
            out.append(("auto_resolved", live["id"], live["sev"], count))
            live, count = None, 0
        if is_action:
            if live and live["id"] == ref:
                if what == "resolve":
                    out.append(("resolved", ref, live["sev"], count))
                    live, count = None, 0
                else:
                    live["acked"] = True
                    out.append(("acknowledged", ref, live["sev"], count))
            continue
        count += 1
        level = names.index(what)
        if minute < quiet_until:
            out.append(("suppressed", live and live["id"], live and live["sev"], count))
        elif live and not live["acked"]:
            if count < 5:
                out.append(("suppressed", live["id"], live["sev"], count))
            elif live["sev"] == "critical":
                out.append(("unchanged", live["id"], "critical", count))
            else:
                live["sev"] = names[names.index(live["sev"]) + 1]
                out.append(("escalated", live["id"], live["sev"], count))
        else:
            sev = "critical" if count >= 15 else names[min(level + 1, 3)] if count >= 10 else what
            live = {"id": ref, "sev": sev, "since": minute, "acked": False}
            quiet_until = minute + {"low": 30, "medium": 15, "high": 10, "critical": 5}[sev]
            out.append(("created", ref, sev, count))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [None, 3, 5])
@pytest.mark.parametrize("stale", [1, 5, 30])
def test_random_lives(lifecycle, spark, stale, limit):
    """Dense and sparse series with actions, whole and in slices, against the plain simulation."""
    rng = random.Random(11)
    rows, actions, want = [], [], []
    for s in range(8):
        host, minute, mine, acted = f"h{s}", 0.0, [], []
        for i in range(60):
            minute += rng.choice([0.25, 1, 2, 4, 9, 31 if s % 2 else 3])
            key = s * 1000 + i
            mine.append((key, minute, rng.choice(params.SEVERITIES)))
            if s > 3 and rng.random() < 0.4:
                acted.append((key, rng.choice(["acknowledge", "resolve"] if s > 5 else ["acknowledge"]), minute + rng.choice([0.5, 6, 20])))
        rows += [anomaly(i, m, sev, host) for i, m, sev in mine]
        actions += [(f"a{i:05d}", what, "ops", m) for i, what, m in acted]
        want += one_by_one(mine, acted, stale)
    log = lifecycle(rows, actions, limit=limit, stale=stale)
    got = [(r["action"], r["anomaly_id"] and int(r["anomaly_id"][1:]), r["severity"], r["anomaly_count"]) for r in log]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def dense_life(seed, n=400, acted=0.1):
    """One series without a pause, with actions on some alerts."""
    rng, minute, rows, actions = random.Random(seed), 0.0, [], []
    for i in range(n):
        minute += rng.choice([0, 0.25, 0.5, 1, 3, 7])
        rows.append((i, minute, rng.choice(params.SEVERITIES)))
        if rng.random() < acted:
            actions.append((i, rng.choice(["acknowledge", "resolve"]), minute + rng.choice([0, 0.5, 6, 20, 29, 31])))
    return rows, actions


@pytest.mark.parametrize(("limit", "stale", "acted"), [(4, 30, 0.3), (7, 30, 0.0), (50, 30, 0.3), (20, 30, 1.0), (9, 12, 0.4), (30, 1, 0.3)])
def test_slices_of_a_life_without_pauses(lifecycle, limit, stale, acted):
    """Slices shorter and longer than the stale limit, anomalies at one time, alerts acted on across slices."""
    rows, actions = dense_life(limit + stale, acted=acted)
    log = lifecycle([anomaly(i, m, sev) for i, m, sev in rows], [(f"a{i:05d}", what, "ops", m) for i, what, m in actions], limit=limit, stale=stale)
    got = [(r["action"], r["anomaly_id"] and int(r["anomaly_id"][1:]), r["severity"], r["anomaly_count"]) for r in log]
    assert sorted(got, key=repr) == sorted(one_by_one(rows, actions, stale), key=repr)


def test_jobs_do_not_grow_with_the_slices(spark):
    rows, _ = dense_life(3, n=600, acted=0)
    found = spark.createDataFrame([anomaly(i, m, sev) for i, m, sev in rows], S.ANOMALY)

    def jobs(limit):
        group = f"slices-{limit}"
        spark.sparkContext.setJobGroup(group, group)
        assert al.process_anomalies(found, limit=limit).count() >= 600
        spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert abs(jobs(20) - jobs(200)) <= 2


def test_sweep_of_slices(lifecycle):
    rows = [anomaly(i, i / 2, "low") for i in range(100)]
    for end, last in ((60, "suppressed"), (90, "auto_resolved")):
        whole = lifecycle(rows, as_of=at(end).replace(tzinfo=None))
        assert lifecycle(rows, as_of=at(end).replace(tzinfo=None), limit=8) == whole
        assert acts(whole)[-1] == last or acts(whole)[-2] == last


def test_queries_over_a_log(spark):
    rows = [anomaly(1, 0, host="a"), anomaly(2, 0, host="b"), anomaly(3, 40, host="b"), anomaly(4, 41, host="b"), anomaly(5, 0, "low", host="c")]
    found = spark.createDataFrame(rows, S.ANOMALY)
    ids = {r[0]: r[1] for r in found.select("anomaly_id", al.alert_id_of()).collect()}
    acts_ = spark.createDataFrame([(ids["a00001"], "acknowledge", "ops", at(2)), (ids["a00005"], "resolve", "ops", at(2))], S.ACTION)
    log = al.process_anomalies(found, acts_)
    live = {r["host"]: r["status"] for r in al.active_alerts(log).collect()}
    assert live == {"a": "acknowledged", "b": "firing"}
    stats = reports.alert_stats(log).first()
    assert (stats["active_alerts"], stats["alerts_created_total"], stats["alerts_suppressed_total"]) == (2, 4, 1)
    last = {r["anomaly_id"]: r["action"] for r in al.latest_per_alert(al.alert_rows(log)).collect()}
    assert last == {"a00001": "acknowledged", "a00002": "auto_resolved", "a00003": "created", "a00005": "resolved"}
    lineage = al.alerts_of_anomalies(found, al.alert_rows(log).where("action = 'created'"))
    assert lineage.count() == 4 and lineage.where("anomaly_time != timestamp").count() == 0


def test_notifications(spark, lifecycle):
    found = spark.createDataFrame([anomaly(1, 0, host="h" * 120)], S.ANOMALY)
    alerts = al.alert_rows(al.process_anomalies(found))
    rows = {r["channel"]: r for r in route_notifications(alerts).collect()}
    assert set(rows) == {"sns", "slack", "log"}
    assert len(rows["sns"]["subject"]) == 100 and rows["sns"]["subject"].startswith("🔴 [HIGH] cpu_usage")
    assert "level = high" in rows["sns"]["payload"] and "Test anomaly description" in rows["sns"]["payload"]
    card = spark.range(1).select(F.get_json_object(F.lit(rows["slack"]["payload"]), "$.card.accent").alias("c")).first()["c"]
    assert card == "#F44336"
    assert [r["channel"] for r in route_notifications(alerts, sns=False, slack=False).collect()] == ["log"]
