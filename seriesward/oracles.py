"""SQL twins of the registered queries, for DuckDB over the same tables."""

import math

from . import given, params

SQL: dict = {}

METRICS = """
m AS (
  SELECT CAST(event_id AS VARCHAR) AS metric_id,
         'host-' || CAST(user_id % 4 AS VARCHAR) AS host,
         CASE event_type WHEN 'click' THEN 'cpu_usage' WHEN 'signup' THEN 'memory_usage'
              WHEN 'view' THEN 'request_latency' WHEN 'error' THEN 'error_rate'
              WHEN 'purchase' THEN 'network_in' ELSE 'unknown' END AS metric_type,
         CASE WHEN event_type IN ('click', 'signup') THEN least(value / 2, 100.0)
              WHEN event_type = 'view' THEN value * 5
              WHEN event_type = 'error' THEN value / 20 ELSE value END AS value,
         ts, 'unknown' AS service, props
  FROM events)"""

RUNNING = """
r AS (
  SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std,
         min(value) OVER w AS lo, max(value) OVER w AS hi,
         list(value) OVER (PARTITION BY host, metric_type ORDER BY ts, metric_id ROWS 199 PRECEDING) AS recent
  FROM m WINDOW w AS (PARTITION BY host, metric_type ORDER BY ts, metric_id ROWS UNBOUNDED PRECEDING))"""

QUARTILES = """
q AS (
  SELECT *, CASE WHEN n >= 100 THEN list_sort(recent)[len(recent) // 4 + 1] ELSE 0.0 END AS q1,
            CASE WHEN n >= 100 THEN list_sort(recent)[3 * len(recent) // 4 + 1] ELSE 0.0 END AS q3
  FROM r)"""


def near(expr, places=4):
    """Rounded away from decimal ties, as in the queries."""
    return f"round({expr} + {0.0037 * 10**-places!r}, {places})"


def _case(column, table, default="NULL"):
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def limit_of(level):
    return _case("metric_type", {k: v[level] for k, v in params.THRESHOLDS.items()})


def check(q1="q1", q3="q3"):
    """CTEs f (fence) and c (checked rows)."""
    return f"""
f AS (
  SELECT *, {q1} AS a, {q3} AS b, n >= 30 AND std >= 1e-10 AS ready FROM q),
c0 AS (
  SELECT *, CASE WHEN ready THEN abs(value - mean) / std END AS z,
         ready AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS iqr_flag,
         ready AND coalesce(value >= {limit_of("high")}, false) AS abs_flag
  FROM f),
c AS (
  SELECT *, coalesce(z > 3.0, false) OR iqr_flag OR abs_flag AS stat_flag,
         CASE WHEN ready THEN greatest(least(1.0, z / 5.0), CASE WHEN iqr_flag THEN 0.8 ELSE 0.0 END,
              CASE WHEN abs_flag THEN 0.9 ELSE 0.0 END) ELSE 0.0 END AS stat_score
  FROM c0)"""


BASE = f"WITH RECURSIVE {METRICS}"
TO_CHECK = f"{BASE},{RUNNING},{QUARTILES},{check()}"

SQL["w1_running_stats"] = f"""{BASE},{RUNNING}
SELECT metric_id, host, metric_type, n AS "count", {near("mean", 6)} AS mean, {near("std", 6)} AS std,
       {near("lo", 6)} AS "min", {near("hi", 6)} AS "max" FROM r"""

SQL["w2_recent_quartiles"] = f"""{BASE},{RUNNING},{QUARTILES}
SELECT metric_id, host, metric_type, {near("q1", 4)} AS q1, {near("q3", 4)} AS q3 FROM q"""

SQL["d1_statistical_check"] = f"""{TO_CHECK}
SELECT metric_id, host, metric_type, stat_flag, iqr_flag, abs_flag, {near("stat_score", 4)} AS stat_score FROM c"""

SQL["d1_statistical_check_mean_std"] = f"""{BASE},{RUNNING},{QUARTILES},
{check("CASE WHEN n < 100 THEN mean - std ELSE q1 END", "CASE WHEN n < 100 THEN mean + std ELSE q3 END")}
SELECT metric_id, host, metric_type, stat_flag, iqr_flag, {near("stat_score", 4)} AS stat_score FROM c"""

# Every seventh event lost its value in one way or another; such rows are no points of a series.
SQL["d1_dirty_values"] = SQL["d1_statistical_check"].replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 7 <> 3)")
SQL["s1_missing_fields"] = f"""{BASE} SELECT CASE WHEN metric_type IN ('cpu_usage', 'error_rate') THEN 'quarantine' ELSE metric_type END AS outcome,
  count(*) AS n FROM m GROUP BY 1"""

SQL["flagged_per_series"] = f"""{TO_CHECK}
SELECT host, metric_type, count(*) AS points, CAST(sum(CASE WHEN stat_flag THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
       {near("max(stat_score)", 4)} AS top_score
FROM c GROUP BY ALL"""


# ---- anomalies and the lifecycle -------------------------------------------

SQUEEZED = "CAST(floor((epoch_us(ts) - 1704067200000000) / 60.0) AS BIGINT) + 1704067200000000"


def severity(value="value", score="stat_score"):
    levels = " ".join(
        f"WHEN {value} >= {limit_of(s)} THEN '{s}'" for s in reversed(params.SEVERITIES)
    )
    scores = " ".join(f"WHEN {score} >= {v} THEN '{s}'" for s, v in params.SCORE_SEVERITY.items())
    return f"CASE {levels} {scores} ELSE 'low' END"


def score_text(x):
    return f"format('{{:.3f}}', round({x}, 6))"


ANOMALIES = f"""
a0 AS (
  SELECT *, sha256('anomaly|' || metric_id) AS anomaly_id, round(stat_score, 4) AS anomaly_score,
         {severity()} AS severity, {SQUEEZED} AS at_us,
         CASE WHEN n < 30 THEN 0.0 ELSE round(mean - 2 * std, 2) END AS lower,
         CASE WHEN n < 30 THEN 100.0 ELSE round(mean + 2 * std, 2) END AS upper
  FROM c WHERE stat_flag),
a AS (
  SELECT *, sha256('alert|' || anomaly_id) AS alert_id,
         upper(severity) || ' anomaly detected on ' || host || ' for ' || metric_type ||
         '. Current value: ' || format('{{:.2f}}', value) || ', Expected: ' || format('{{:.2f}}', round(mean, 6)) || ' ± ' ||
         format('{{:.2f}}', round(std, 6)) || '. Detected by: statistical. Scores: statistical=' || {score_text("stat_score")} ||
         ', isolation_forest=0.000, lstm=0.000.' AS description,
         '[' || upper(severity) || '] ' || metric_type || ' anomaly on ' || host ||
         ' (score: ' || format('{{:.2f}}', anomaly_score) || ')' AS title
  FROM a0)"""

TO_ANOMALIES = f"{TO_CHECK},{ANOMALIES}"

ACTIONS = """
act AS (
  SELECT host, metric_type, at_us + (CASE severity WHEN 'high' THEN 3 ELSE 7 END) * 60000000 AS at_us,
         CASE severity WHEN 'high' THEN 1 ELSE 2 END AS kind, alert_id, 'user-' || host AS usr,
         CASE severity WHEN 'high' THEN 'acknowledge' ELSE 'resolve' END AS action
  FROM a WHERE severity IN ('high', 'medium'))"""


def fold(actions=False):
    """CTEs: ev (ordered events), step (the state machine, one row per event), log."""
    acted = """
    UNION ALL
    SELECT host, metric_type, at_us, kind,
           sha256(alert_id || '|' || action || '|' || usr || '|' ||
                  regexp_replace(regexp_replace(CAST(make_timestamp(at_us) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')),
           NULL, alert_id, usr, NULL, NULL FROM act""" if actions else ""
    return f"""{ACTIONS},
ev AS (
  SELECT *, row_number() OVER (PARTITION BY host, metric_type ORDER BY at_us, kind, event_id) AS rn FROM (
    SELECT host, metric_type, at_us, 0 AS kind, anomaly_id AS event_id,
           {_case("severity", {"low": 1, "medium": 2, "high": 3, "critical": 4})} AS sev, alert_id,
           CAST(NULL AS VARCHAR) AS usr, title, description FROM a{acted})),
step AS (
  SELECT DISTINCT host, metric_type, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS at_us, CAST(NULL AS VARCHAR) AS event_id,
         CAST(NULL AS VARCHAR) AS act, CAST(0 AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS cool,
         CAST(NULL AS VARCHAR) AS alert_id, 0 AS sev, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS created,
         CAST(NULL AS VARCHAR) AS usr, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description,
         false AS expired, CAST(NULL AS VARCHAR) AS old_id, 0 AS old_sev, CAST(0 AS BIGINT) AS old_cnt,
         CAST(0 AS BIGINT) AS old_created, CAST(NULL AS VARCHAR) AS old_usr, CAST(NULL AS VARCHAR) AS log_id, 0 AS log_sev,
         CAST(NULL AS VARCHAR) AS log_usr, CAST(0 AS BIGINT) AS log_cnt, CAST(NULL AS VARCHAR) AS old_title,
         CAST(NULL AS VARCHAR) AS old_description FROM ev
  UNION ALL
  SELECT host, metric_type, rn, at_us, event_id, act,
         CASE WHEN act = 'resolved' THEN 0 ELSE cnt2 END,
         CASE WHEN act = 'created' THEN at_us + (CASE nsev WHEN 1 THEN 30 WHEN 2 THEN 15 WHEN 3 THEN 10 ELSE 5 END) * 60000000 ELSE cool END,
         CASE WHEN act = 'created' THEN e_alert WHEN act = 'resolved' THEN NULL ELSE alert1 END,
         nsev,
         CASE act WHEN 'created' THEN 'firing' WHEN 'acknowledged' THEN 'acknowledged' ELSE status1 END,
         CASE WHEN act = 'created' THEN at_us ELSE created END,
         nusr, ntitle, ndesc, expired, s_alert, s_sev, s_cnt, s_created, s_usr,
         CASE WHEN act = 'created' THEN e_alert ELSE alert1 END, nsev, nusr, cnt2, s_title, s_desc
  FROM (
    SELECT *, CASE WHEN act = 'created' THEN CASE WHEN cnt2 >= 15 THEN 4 WHEN cnt2 >= 10 THEN least(e_sev + 1, 4) ELSE e_sev END
                   WHEN act = 'escalated' THEN s_sev + 1 WHEN alert1 IS NULL THEN 0 ELSE s_sev END AS nsev,
              CASE WHEN act = 'acknowledged' THEN e_usr WHEN act = 'created' OR alert1 IS NULL THEN NULL ELSE s_usr END AS nusr,
              CASE WHEN act = 'created' THEN e_title ELSE s_title END AS ntitle,
              CASE WHEN act = 'created' THEN e_desc
                   WHEN act = 'escalated' THEN 'ESCALATED from ' || ['low','medium','high','critical'][s_sev] || ' to ' ||
                        ['low','medium','high','critical'][s_sev + 1] || '. ' || e_desc
                   ELSE s_desc END AS ndesc
    FROM (
      SELECT *, CASE
          WHEN kind > 0 AND alert1 IS DISTINCT FROM e_alert THEN 'ignored'
          WHEN kind = 1 THEN 'acknowledged' WHEN kind = 2 THEN 'resolved'
          WHEN at_us < cool THEN 'suppressed'
          WHEN alert1 IS NOT NULL AND status1 = 'firing' THEN
               CASE WHEN cnt2 < 5 THEN 'suppressed' WHEN s_sev = 4 THEN 'unchanged' ELSE 'escalated' END
          ELSE 'created' END AS act
      FROM (
        SELECT *, CASE WHEN expired THEN NULL ELSE s_alert END AS alert1,
                  CASE WHEN expired THEN NULL ELSE s_status END AS status1,
                  CASE WHEN expired THEN 0 ELSE s_cnt END + CASE WHEN kind = 0 THEN 1 ELSE 0 END AS cnt2
        FROM (
          SELECT e.host, e.metric_type, e.rn, e.at_us, e.kind, e.event_id, e.sev AS e_sev, e.alert_id AS e_alert, e.usr AS e_usr,
                 e.title AS e_title, e.description AS e_desc,
                 s.alert_id AS s_alert, s.sev AS s_sev, s.status AS s_status, s.created, s.cool, s.cnt AS s_cnt,
                 s.created AS s_created, s.usr AS s_usr, s.title AS s_title, s.description AS s_desc,
                 s.alert_id IS NOT NULL AND e.at_us - s.created > 1800000000 AS expired
          FROM step s JOIN ev e ON e.host = s.host AND e.metric_type = s.metric_type AND e.rn = s.rn + 1)))) x),
log AS (
  SELECT host, metric_type, act AS action, event_id AS trigger_id, log_cnt AS anomaly_count, log_id AS alert_id,
         ['low','medium','high','critical'][log_sev] AS severity,
         CASE WHEN log_id IS NULL THEN NULL WHEN act = 'resolved' THEN 'resolved' ELSE status END AS status,
         log_usr AS acknowledged_by, at_us, title, description,
         CASE WHEN log_id IS NOT NULL THEN created END AS created_at, CASE WHEN act = 'resolved' THEN at_us END AS resolved
  FROM step WHERE rn > 0 AND act <> 'ignored'
  UNION ALL
  SELECT host, metric_type, 'auto_resolved', NULL, old_cnt, old_id, ['low','medium','high','critical'][old_sev], 'resolved',
         old_usr, old_created + 1800000000, old_title, old_description, old_created, old_created + 1800000000
  FROM step WHERE expired)"""


LIFE = f"{TO_ANOMALIES},{fold()}"
LIFE_ACTED = f"{TO_ANOMALIES},{fold(actions=True)}"
CHANGES = "action IN ('created', 'escalated', 'acknowledged', 'resolved', 'auto_resolved')"
RANK = "list_position(['created', 'escalated', 'acknowledged', 'resolved', 'auto_resolved'], action)"
LOG_COLS = "host, metric_type, action, trigger_id, anomaly_count, alert_id, severity, status, acknowledged_by, at_us"

SQL["l1_process_anomaly"] = f"{LIFE} SELECT {LOG_COLS} FROM log"
SQL["l6_l7_actions"] = f"{LIFE_ACTED} SELECT {LOG_COLS} FROM log"
SQL["l8_auto_resolve"] = f"""{LIFE},
tail AS (
  SELECT host, metric_type, cnt, alert_id, sev, usr, created FROM step s
  WHERE alert_id IS NOT NULL AND rn = (SELECT max(rn) FROM step t WHERE t.host = s.host AND t.metric_type = s.metric_type)
    AND epoch_us(TIMESTAMP '2024-01-01 11:30:00') - created > 1800000000)
SELECT {LOG_COLS} FROM log WHERE action = 'auto_resolved'
UNION ALL
SELECT host, metric_type, 'auto_resolved', NULL, cnt, alert_id, ['low','medium','high','critical'][sev], 'resolved', usr,
       created + 1800000000 FROM tail"""
SQL["l2_cooldown"] = f"""{LIFE} SELECT alert_id, severity,
  at_us + {_case("severity", params.COOLDOWN_MINUTES)} * 60000000 AS cool_until FROM log WHERE action = 'created'"""
SQL["l5_next_severity"] = f"""{TO_ANOMALIES} SELECT anomaly_id, severity,
  {_case("severity", {"low": "'medium'", "medium": "'high'", "high": "'critical'", "critical": "'critical'"})} AS raised,
  CAST({_case("severity", {"low": 1, "medium": 2, "high": 3, "critical": 4})} AS BIGINT) AS rank, severity || '?' AS unknown_stays FROM a"""

LATEST = f"""
rows_ AS (SELECT *, {RANK} AS rk, list_position(['low','medium','high','critical'], severity) AS sr FROM log WHERE {CHANGES}),
active AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, metric_type ORDER BY created_at DESC, at_us DESC, rk DESC, sr DESC) AS k
                 FROM rows_) WHERE k = 1 AND status <> 'resolved'),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY at_us DESC, rk DESC, sr DESC) AS k FROM rows_) WHERE k = 1)"""

SQL["l9_active_alerts"] = f"{LIFE_ACTED},{LATEST} SELECT host, metric_type, alert_id, severity, status, acknowledged_by FROM active"
SQL["l10_alert_title"] = f"{LIFE} SELECT alert_id, action, title, description, at_us FROM log WHERE {CHANGES}"
EMOJI = _case("severity", {k: f"'{v}'" for k, v in params.SEVERITY_EMOJI.items()})
COLOR = _case("severity", {k: f"'{v}'" for k, v in params.SEVERITY_COLOR.items()})
ISO = "strftime(make_timestamp(created_at), '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
SQL["l11_route_notifications"] = f"""{LIFE},
n AS (SELECT *, {EMOJI} AS emoji, {COLOR} AS color, {ISO} AS iso FROM log WHERE action IN ('created', 'escalated'))
SELECT alert_id, severity, host, 'sns' AS channel, left(emoji || ' ' || title, 100) AS subject,
  concat_ws(chr(10), description, 'what = ' || metric_type, 'where = unknown / ' || host, 'level = ' || severity, 'state = ' || status,
    'since = ' || iso, 'id = ' || alert_id, '(Incident Desk)') AS payload FROM n
UNION ALL
SELECT alert_id, severity, host, 'log', NULL, concat_ws(' | ', severity, host, metric_type, title) FROM n
UNION ALL
SELECT alert_id, severity, host, 'slack', NULL,
  '{{"from":"Incident Desk","card":{{"accent":"' || color || '","headline":"' || emoji || ' ' || title || '","body":"' || description ||
  '","fields":{{"what":"' || metric_type || '","where":"unknown / ' || host || '","level":"' || severity || '","state":"' || status ||
  '","since":"' || iso || '","id":"' || alert_id || '"}}}}}}' FROM n"""

SQL["s2_anomaly_json"] = f"""{TO_ANOMALIES} SELECT anomaly_id, severity, at_us, {near("lower", 2)} AS lower, {near("upper", 2)} AS upper FROM a"""
SQL["s3_alert_json"] = f"""{LIFE} SELECT alert_id, severity, status, title, created_at AS at_us, resolved FROM log WHERE {CHANGES}"""
SQL["d9_describe_anomaly"] = f"{TO_ANOMALIES} SELECT anomaly_id, host, metric_type, severity, description FROM a"
SQL["d8_determine_severity"] = f"""{BASE} SELECT metric_id, host, metric_type, {severity("value", "(value / 100)")} AS severity FROM m"""
SQL["j4_anomalies_with_alerts"] = f"""{LIFE} SELECT log.alert_id, a.anomaly_id, log.severity, a.severity AS anomaly_severity,
  {near("value")} AS value, {near("anomaly_score")} AS anomaly_score FROM log JOIN a ON log.trigger_id = a.anomaly_id WHERE action = 'created'"""

# ---- sources ------------------------------------------------------------------

STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
SQL["s1_metric_from_json"] = f"""{BASE} SELECT metric_id, host, metric_type, service, {STAMP} AS ts, {near("value")} AS value,
  json_extract_string(props, '$.k') AS tag_k FROM m"""
SQL["s1_metric_quarantine"] = f"""{BASE} SELECT CASE metric_type WHEN 'error_rate' THEN 'quarantine' ELSE metric_type END AS outcome,
  count(*) AS n FROM m GROUP BY 1"""
SQL["s3_health_json"] = """SELECT event_type AS service_name, CASE WHEN value > 60 THEN 'degraded' ELSE 'healthy' END AS status,
  CAST(user_id AS VARCHAR) AS "user", count(*) AS n FROM events GROUP BY ALL"""

CLOUD = f"""
p AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'AWS/EC2' WHEN 1 THEN 'AWS/RDS' ELSE 'AWS/ApplicationELB' END AS namespace,
         CASE event_type WHEN 'click' THEN 'CPUUtilization' WHEN 'signup' THEN 'FreeableMemory' WHEN 'view' THEN 'ReadLatency'
              WHEN 'error' THEN 'HTTPCode_Target_5XX_Count' ELSE 'NetworkIn' END AS cw_metric,
         CASE WHEN user_id > 0 THEN 'i-' || user_id ELSE 'unknown' END AS host,
         CASE WHEN value >= 20 THEN value END AS average, CASE WHEN value >= 10 THEN value * 1.5 END AS maximum, ts
  FROM events),
cw AS (
  SELECT *, {_case("namespace || '/' || cw_metric", {"/".join(k): f"'{v}'" for k, v in params.CLOUDWATCH_METRICS.items()})} AS metric_type,
         coalesce(average, maximum, 0.0) AS value FROM p)"""
SQL["s8_normalize_cloudwatch"] = f"""WITH {CLOUD} SELECT metric_type, host, namespace AS service, {STAMP} AS ts, {near("value")} AS value,
  cw_metric, {near("coalesce(maximum, 0.0)")} AS max_value FROM cw WHERE metric_type IS NOT NULL"""
PERIOD = "make_timestamp(epoch_us(ts) - epoch_us(ts) % 300000000)"
DOWN = f"""SELECT host, metric_type, strftime({PERIOD}, '%Y-%m-%d %H:%M:%S.%f') AS period_start, {near("avg(value)")} AS average,
  {near("max(value)")} AS maximum FROM m"""
SQL["s9_downsample"] = f"{BASE} {DOWN} GROUP BY host, metric_type, 3"
SQL["s9_downsample_lookback"] = f"""{BASE} {DOWN} WHERE ts >= (SELECT max(ts) FROM m) - INTERVAL 600 MINUTE GROUP BY host, metric_type, 3"""
SQL["s10_counters_to_rate"] = f"""WITH k AS (
  SELECT 'host-' || (user_id % 4) AS host, CASE event_type WHEN 'click' THEN 'disk_read' WHEN 'signup' THEN 'disk_write'
         WHEN 'view' THEN 'net_in' WHEN 'error' THEN 'net_out' ELSE 'net_drop' END AS counter, event_id * 123456789.0::DOUBLE AS value, ts
  FROM events),
d AS (SELECT *, (value - lag(value) OVER w) / greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0.1) / 1048576.0 AS rate
  FROM k WINDOW w AS (PARTITION BY host, counter ORDER BY ts, value))
SELECT host, counter, {STAMP} AS ts,
  {near("CASE WHEN counter LIKE 'disk%' THEN round(rate, 2) ELSE round(rate, 4) END", 4)} AS rate_mb FROM d"""

# ---- projections, lookups, joins ------------------------------------------------

SQL["p1_series_key"] = f"{BASE} SELECT metric_id, host || ':' || metric_type AS key FROM m"
SQL["p2_host_to_service"] = """WITH h AS (SELECT event_id, ['web','api','db','cache','worker','edge','api-db','cache-web'][user_id % 8 + 1]
  || '-' || user_id AS host FROM events)
SELECT event_id, host, CASE WHEN contains(host, 'web') THEN 'web' WHEN contains(host, 'api') THEN 'api' WHEN contains(host, 'db') THEN 'database'
  WHEN contains(host, 'cache') THEN 'cache' WHEN contains(host, 'worker') THEN 'worker' ELSE 'unknown' END AS service FROM h"""
LOWS = _case("metric_type", {k: v[0] for k, v in params.PROFILES.items()})
HIGHS = _case("metric_type", {k: v[1] for k, v in params.PROFILES.items()})
SQL["p3_clamp_value"] = f"""{BASE} SELECT metric_id, host, metric_type,
  {near(f"round(greatest({LOWS}, least({HIGHS}, (value - 40) * 3)), 4)", 4)} AS value FROM m"""
SQL["p4_metric_history"] = f"""{BASE} SELECT metric_id, {STAMP} AS ts, {near("value")} AS value FROM m
  WHERE host = 'host-1' AND metric_type = 'cpu_usage' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY"""
SQL["p5_training_history"] = f"""{BASE} SELECT host, metric_type, count(*) AS n, {near("sum(value)", 2)} AS total FROM m
  WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 15 DAY GROUP BY ALL"""
SQL["p6_clean_matrix"] = f"""{BASE} SELECT metric_id,
  {near("CASE WHEN value < 1 THEN 0.0 WHEN value < 2 THEN 1e6 WHEN value < 3 THEN -1e6 ELSE value END", 3)} AS forest_value,
  {near("CASE WHEN value < 1 THEN 0.0 ELSE value END", 3)} AS sequence_value FROM m"""
SQL["p7_threshold_lookup"] = f"""{BASE} SELECT metric_id, {", ".join(f"CAST({limit_of(s)} AS DOUBLE) AS {s}" for s in params.SEVERITIES)} FROM m"""
SQL["j5_union_sources"] = f"""{BASE},{CLOUD},
u AS (SELECT service, metric_type, value, 1 AS t FROM m UNION ALL SELECT namespace, metric_type, value, NULL FROM cw WHERE metric_type IS NOT NULL)
SELECT service, metric_type, count(*) AS n, count(t) AS tagged, {near("sum(value)", 2)} AS total FROM u GROUP BY ALL"""

# ---- windows -------------------------------------------------------------------------


def features(frame, eps_in_std):
    """CTE g: the sixteen features of every row, with its position n."""
    eps = "1e-10"
    std = {k: f"(std_{k} + {eps})" for k in (5, 15, 30)}
    shown = std if eps_in_std else {k: f"std_{k}" for k in std}
    over = "OVER (PARTITION BY host, metric_type ORDER BY ts, metric_id ROWS {} PRECEDING)"
    rolls = ", ".join(
        f"avg(value) {over.format(k - 1)} AS mean_{name}, stddev_pop(value) {over.format(k - 1)} AS std_{name}"
        for name, k in ((5, 5), (15, 15), (30, frame))
    )
    full = over.format(frame - 1)
    return f"""
g0 AS (
  SELECT *, row_number() OVER w AS n, {rolls}, min(value) {full} AS lo, max(value) {full} AS hi, list(value) {full} AS rec,
         lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2
  FROM m WINDOW w AS (PARTITION BY host, metric_type ORDER BY ts, metric_id)),
g AS (
  SELECT metric_id, host, metric_type, ts, n, value AS current, mean_5, mean_15, mean_30, {shown[5]} AS std_5, {shown[15]} AS std_15,
         {shown[30]} AS std_30, value - l1 AS rate_of_change, value - 2 * l1 + l2 AS acceleration,
         (value - mean_30) / {std[30]} AS z_score, lo AS min_30, hi AS max_30, (value - lo) / (hi - lo + {eps}) AS range_position,
         len(list_filter(rec, lambda v: v < value)) / len(rec) AS percentile,
         (value - mean_5) / {std[5]} AS dev_5, (value - mean_15) / {std[15]} AS dev_15
  FROM g0)"""


FEATURE_LIST = ", ".join(f"{near(f, 3)} AS {f}" for f in params.FEATURES)
NULLABLE = ", ".join(f"{near(f'CASE WHEN n >= 30 THEN {f} END', 3)} AS {f}" for f in params.FEATURES)
SQL["w3_w11_extract_features"] = f"{BASE},{features(30, True)} SELECT metric_id, host, metric_type, {NULLABLE} FROM g"
SQL["w12_training_features"] = f"{BASE},{features(31, False)} SELECT metric_id, host, metric_type, {FEATURE_LIST} FROM g WHERE n > 30"
SQL["j2_align_metrics_by_index"] = f"""{BASE},{features(31, False)},
h AS (SELECT host, min(k) AS shortest, count(*) AS types FROM (SELECT host, metric_type, count(*) AS k FROM m GROUP BY ALL) GROUP BY host
      HAVING min(k) >= 30),
w AS (SELECT min(types) * {len(params.FEATURES)} AS width FROM h WHERE shortest > 30),
x AS (SELECT g.host, n - 1 AS i, metric_type, [{", ".join(params.FEATURES)}] AS f FROM g JOIN h ON g.host = h.host WHERE n > 30 AND n <= shortest),
y AS (SELECT host, i, list_slice(flatten(list(f ORDER BY metric_type)), 1, (SELECT width FROM w)) AS v FROM x GROUP BY host, i)
SELECT host, i, CAST(len(v) AS INTEGER) AS width, {near("v[1]", 3)} AS first_value, {near("list_sum(v)", 2)} AS total FROM y"""
SQL["w13_rolling_bands"] = f"""{BASE},
b AS (SELECT *, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd FROM m
      WINDOW w AS (PARTITION BY host, metric_type ORDER BY ts, metric_id ROWS 9 PRECEDING))
SELECT metric_id, host, metric_type, {near("mu")} AS rolling_mean, {near("mu + 2 * sd")} AS upper_band, {near("mu - 2 * sd")} AS lower_band,
  value > mu + 2 * sd OR value < mu - 2 * sd AS outside FROM b"""
SQL["w14_sequences"] = f"""{BASE},
b AS (SELECT *, list(value) OVER w AS s FROM m WINDOW w AS (PARTITION BY host, metric_type ORDER BY ts, metric_id ROWS 29 PRECEDING))
SELECT metric_id, host, metric_type, CAST(len(s) AS INTEGER) AS length, {near("s[1]", 3)} AS first_value, {near("list_sum(s)", 3)} AS total
FROM b WHERE len(s) = 30"""
SQL["w15_expected_range"] = f"""{BASE},{RUNNING} SELECT metric_id, host, metric_type,
  {near("CASE WHEN n < 30 THEN 0.0 ELSE round(mean - 2 * std, 2) END", 2)} AS lower,
  {near("CASE WHEN n < 30 THEN 100.0 ELSE round(mean + 2 * std, 2) END", 2)} AS upper FROM r"""


def newest(k):
    return f"""{BASE},
b AS (SELECT *, row_number() OVER (PARTITION BY host, metric_type ORDER BY ts DESC, metric_id DESC) AS k FROM m)
SELECT metric_id, host, metric_type, {near("value")} AS value FROM b WHERE k <= {k}"""


SQL["w16_retention_trim"] = newest(100)
SQL["w17_buffer_cap"] = newest(200)

# ---- aggregates, top-k, reports ----------------------------------------------------------

RECENT_ALERTS = "SELECT * FROM log WHERE action IN ('created', 'escalated') ORDER BY at_us DESC, alert_id DESC LIMIT"
RECENT_ANOMALIES = "SELECT * FROM a ORDER BY at_us DESC, anomaly_id DESC LIMIT"
SQL["a1_series_catalog"] = f"{BASE} SELECT host, metric_type, count(*) AS points, host || ':' || metric_type AS key FROM m GROUP BY ALL"
SQL["a2_severity_counts"] = f"{TO_ANOMALIES} SELECT severity, count(*) AS n FROM ({RECENT_ANOMALIES} 20) GROUP BY 1"
SQL["a3_alert_status_counts"] = f"""{LIFE} SELECT status, count(*) AS n FROM
  (SELECT * FROM log WHERE {CHANGES} ORDER BY at_us DESC, alert_id DESC LIMIT 20) GROUP BY 1"""
STATS = """
pieces AS (
  SELECT 'metrics_stream_length' AS name, (SELECT count(*) FROM m) AS value
  UNION ALL SELECT 'total_metric_series', (SELECT count(*) FROM (SELECT DISTINCT host, metric_type FROM m))
  UNION ALL SELECT 'anomalies_stream_length', (SELECT count(*) FROM a)
  UNION ALL SELECT 'anomaly_history_count', (SELECT count(*) FROM a)
  UNION ALL SELECT 'alerts_stream_length', (SELECT count(*) FROM log WHERE action IN ('created', 'escalated'))
  UNION ALL SELECT 'alert_history_count', (SELECT count(*) FROM log WHERE action IN ('created', 'escalated')))"""
SQL["a4_pipeline_stats"] = f"{LIFE},{STATS} SELECT name, value FROM pieces"
SQL["a5_detector_stats"] = f"""{TO_CHECK} SELECT count(*) AS total_checked, count(*) FILTER (WHERE stat_flag) AS anomalies_detected,
  round(count(*) FILTER (WHERE stat_flag) / count(*), 4) AS anomaly_rate, count(DISTINCT host || ':' || metric_type) AS metric_series_tracked FROM c"""
SQL["a5_buffer_sizes"] = f"""{BASE} SELECT host || ':' || metric_type AS key, count(*) AS size FROM m
  GROUP BY host, metric_type ORDER BY min(ts), host, metric_type LIMIT 10"""
SQL["a6_alert_stats"] = f"""{LIFE_ACTED},{LATEST} SELECT count(*) FILTER (WHERE action = 'created') AS alerts_created_total,
  count(*) FILTER (WHERE action = 'suppressed') AS alerts_suppressed_total, (SELECT count(*) FROM active) AS active_alerts FROM log"""
SQL["a6_active_alert_details"] = f"{LIFE_ACTED},{LATEST} SELECT alert_id AS id, severity, host, metric_type AS metric, status FROM active"
SQL["a10_standard_scale"] = f"""{BASE} SELECT metric_id, host, metric_type,
  {near("(value - (SELECT avg(value) FROM m)) / (SELECT stddev_pop(value) FROM m)")} AS value, {near("0.0")} AS one FROM m"""
SQL["a11_detection_quality"] = f"""{TO_CHECK},
t AS (SELECT stat_flag AS p, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 AS t FROM c)
SELECT count(*) FILTER (WHERE t AND p) AS true_positives, count(*) FILTER (WHERE NOT t AND p) AS false_positives,
  count(*) FILTER (WHERE t AND NOT p) AS false_negatives, count(*) FILTER (WHERE NOT t AND NOT p) AS true_negatives,
  round(count(*) FILTER (WHERE NOT t AND p) / count(*) FILTER (WHERE NOT t), 6) AS false_positive_rate,
  round(count(*) FILTER (WHERE t AND p) / count(*) FILTER (WHERE t), 6) AS detection_rate FROM t"""

def health(ttl):
    return f"""
hl AS (
  SELECT event_type AS service_name, CASE WHEN value > 60 THEN 'degraded' ELSE 'healthy' END AS status, epoch_us(ts) AS at_us,
         CAST(floor(epoch_us(ts) / 1e6 - 1704067200.0) AS BIGINT) AS up
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events) WHERE k = 1),
fresh AS (SELECT * FROM hl WHERE at_us > epoch_us(TIMESTAMP '2024-01-31 00:00:00') - {ttl * 1000000})"""


UPTIME = """CASE WHEN up = 0 THEN '--' WHEN up // 3600 > 0 THEN (up // 3600) || 'h ' || (up % 3600 // 60) || 'm'
  WHEN up // 60 > 0 THEN (up // 60) || 'm ' || (up % 60) || 's' ELSE up || 's' END"""
SQL["a12_health_latest"] = f"WITH {health(1800)} SELECT service_name, status, at_us, {UPTIME} AS uptime FROM fresh"
SQL["a13_dashboard_summary"] = f"""{LIFE},{STATS},{health(300)}
SELECT 'stats' AS part, name, value FROM pieces
UNION ALL SELECT 'severity', severity, count(*) FROM ({RECENT_ANOMALIES} 20) GROUP BY severity
UNION ALL SELECT 'status', status, count(*) FROM ({RECENT_ALERTS} 20) GROUP BY status
UNION ALL SELECT 'anomaly', anomaly_id, at_us FROM ({RECENT_ANOMALIES} 10)
UNION ALL SELECT 'alert', alert_id, at_us FROM ({RECENT_ALERTS} 10)
UNION ALL SELECT 'service', service_name, at_us FROM fresh"""
SQL["a14_system_health"] = f"""WITH {health(1800)} SELECT CASE WHEN count(*) = (SELECT count(*) FROM hl) THEN 'healthy' ELSE 'degraded' END AS status,
  (SELECT count(*) FROM hl) AS services, count(*) AS services_fine FROM fresh WHERE status = 'healthy'"""
SQL["t1_recent_metrics"] = f"""{BASE} SELECT metric_id, host, metric_type, {near("value")} AS value FROM m ORDER BY ts DESC, metric_id DESC LIMIT 200"""
SQL["t2_recent_anomalies"] = f"""{TO_ANOMALIES} SELECT anomaly_id, host, metric_type, severity, {near("value")} AS value,
  {near("anomaly_score")} AS anomaly_score FROM ({RECENT_ANOMALIES} 50)"""
SQL["t3_recent_alerts"] = f"{LIFE} SELECT alert_id, severity, action, title FROM ({RECENT_ALERTS} 50)"
SQL["t3_latest_per_alert"] = f"{LIFE},{LATEST} SELECT alert_id, severity, action, status FROM latest"
SQL["t4_cap_history"] = f"""{BASE} SELECT metric_id, host, metric_type, {near("value")} AS value FROM m ORDER BY ts DESC, metric_id DESC LIMIT 777"""
SQL["t5_host_selector"] = f"{BASE} SELECT DISTINCT host FROM m ORDER BY host"
SQL["t5_metric_selector"] = f"""{BASE} SELECT DISTINCT metric_type, upper(replace(metric_type, '_', ' ')) AS label FROM m WHERE host = 'host-2' ORDER BY 1"""
SQL["t6_anomaly_timeline"] = f"""{TO_ANOMALIES} SELECT host, metric_type, at_us, {near("anomaly_score * 100", 3)} AS score_pct,
  {near("greatest(6.0, anomaly_score * 100 / 8)", 3)} AS marker_size,
  {_case("severity", {k: f"'{v}'" for k, v in params.TIMELINE_COLOR.items()})} AS color, anomaly_score * 100 > 85 AS over_line FROM a"""
SQL["scalar_text"] = f"""WITH e AS (SELECT *, CAST(floor(value * 60) AS BIGINT) AS up FROM events)
SELECT event_id, CASE event_type WHEN 'click' THEN 'CPU USAGE' WHEN 'signup' THEN 'MEMORY USAGE' WHEN 'view' THEN 'REQUEST LATENCY'
  WHEN 'error' THEN 'ERROR RATE' ELSE 'NETWORK IN' END AS label, CASE WHEN value = 0 THEN '--' ELSE {UPTIME.replace("WHEN up = 0 THEN '--'", "WHEN false THEN ''")} END AS uptime,
  {near("(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000.0", 3)} AS age_minutes,
  strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000000Z' AS iso FROM e"""

# ---- tables, model states, votes, streams ------------------------------------------------------

SQL["s4_publish_metric"] = f"""{BASE} SELECT host, metric_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n,
  {near("sum(value)", 2)} AS total FROM m GROUP BY host, metric_type, 3"""
SQL["s5_publish_anomaly"] = f"""{TO_ANOMALIES} SELECT target, severity, count(*) AS n
  FROM a, (VALUES ('log'), ('history')) t(target) GROUP BY ALL"""
SQL["s6_publish_alert"] = f"{LIFE} SELECT alert_id, count(*) AS times FROM log WHERE action IN ('created', 'escalated') GROUP BY alert_id"
SQL["s7_read_after"] = f"""{BASE} SELECT metric_id, host, metric_type, {STAMP} AS ts FROM m
  WHERE (ts, metric_id) > (TIMESTAMP '2024-01-15 12:00:00', '0') ORDER BY m.ts, metric_id LIMIT 100"""
SQL["s7_read_stream"] = f"{BASE} SELECT host, metric_type, count(*) AS n FROM m GROUP BY ALL"
SQL["s12_model_state"] = """SELECT event_type AS name, epoch_us(max(ts)) AS at_us, CAST(arg_max(user_id, ts) AS VARCHAR) AS "user",
  CAST(arg_max(value, ts) AS VARCHAR) AS value FROM events GROUP BY 1"""
SQL["d11_should_retrain"] = """SELECT event_type AS name, epoch_us(max(ts)) AS at_us,
  epoch_us(TIMESTAMP '2024-01-31 23:45:00') - epoch_us(max(ts)) >= 86400000000 AS due FROM events GROUP BY 1
  UNION ALL SELECT 'never_run', NULL, true"""
SQL["d4_isolation_forest_score"] = f"""{BASE} SELECT metric_id, host, metric_type, value > 1 AND value < 50 AS forest_flag,
  {near("CASE WHEN value > 1 THEN 1 / (1 + exp((value - 50) / 100)) ELSE 0.0 END")} AS forest_score FROM m"""
SQL["d7_ensemble_vote"] = f"""{TO_CHECK},
v AS (SELECT *, 0.25 * stat_score + 0.40 * least(1.0, value / 100) + 0.35 * stat_score AS score,
             stat_flag::INTEGER + iqr_flag::INTEGER + abs_flag::INTEGER AS votes FROM c)
SELECT metric_id, host, metric_type, votes, score >= 0.85 OR votes >= 2 AS is_anomaly, {near("round(score, 4)", 3)} AS score FROM v"""
SQL["a8_exact_percentile"] = f"{BASE} SELECT metric_type, {near('quantile_cont(value, 0.95)', 6)} AS p FROM m GROUP BY 1"
SQL["j3_model_by_metric_type"] = f"""{BASE},
b AS (SELECT *, row_number() OVER (PARTITION BY host, metric_type ORDER BY ts, metric_id) AS k FROM m)
SELECT metric_type, count(*) AS n, count(*) FILTER (WHERE k >= 30 AND metric_type <> 'error_rate') AS with_model FROM b GROUP BY 1"""
SQL["s11_save_and_load_model"] = f"SELECT unnest(['forest', 'sequence']) AS model, {near('0.0', 6)} AS widest_gap"
SQL["x1_detect_stream"] = f"""{TO_ANOMALIES} SELECT anomaly_id, host, metric_type, severity, {near("value")} AS value,
  {near("anomaly_score")} AS anomaly_score FROM a
  WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM m)"""
# The stream ends at its watermark, which has milliseconds; rows after it still wait.
SQL["x2_alert_stream"] = (
    SQL["l8_auto_resolve"]
    .replace("epoch_us(TIMESTAMP '2024-01-01 11:30:00')", "(SELECT max(at_us) // 1000 * 1000 FROM a)")
    .replace("FROM log WHERE action = 'auto_resolved'", "FROM log")
    .replace("title, description FROM a)),", "title, description FROM a WHERE at_us <= (SELECT max(at_us) // 1000 * 1000 FROM a))),")
)
SQL["x3_dedup_metrics"] = f"{BASE} SELECT host, metric_type, count(*) AS n, count(DISTINCT metric_id) AS ids FROM m GROUP BY ALL"
SQL["x5_downsample_stream"] = f"""{BASE} {DOWN} WHERE epoch_us(ts) - epoch_us(ts) % 300000000 + 300000000 <= (SELECT max(epoch_us(ts)) FROM m)
  GROUP BY host, metric_type, 3"""
SQL["x6_health_stream"] = "SELECT 'downsampler' AS service_name, 'healthy' AS status, count(*) AS rows_processed FROM events"

# ---- what holds for fitted models whatever their random choices ---------------

SIZES = """,
sizes AS (SELECT host, metric_type, count(*) AS n FROM m GROUP BY ALL),
vectors AS (SELECT coalesce(sum(greatest(n - 29, 0)), 0)::bigint AS n FROM sizes)"""
KINDS = ", ".join(f"('{kind}')" for kind in params.METRIC_TYPES)
PER_KIND = f"""{SIZES},
kinds AS (
  SELECT k.kind AS metric_type, coalesce((SELECT count(*) FROM m WHERE metric_type = k.kind), 0)::bigint AS samples,
    (SELECT sum(CASE WHEN n > 30 THEN n - 29 ELSE 0 END)::bigint FROM sizes WHERE metric_type = k.kind) AS sequences,
    (SELECT avg(value) FROM m WHERE metric_type = k.kind) AS mean, (SELECT stddev_pop(value) FROM m WHERE metric_type = k.kind) + 1e-8 AS std
  FROM (VALUES {KINDS}) AS k(kind))"""
SQL["d2_forest_bounds"] = f"""{BASE}{SIZES} SELECT t::int AS tree, least(256, n)::bigint AS "rows", 1::bigint AS more_leaves, true AS depth_bounded
  FROM vectors, range(200) AS r(t) WHERE n >= 50"""
SQL["d5_sequence_counts"] = f"""{BASE}{PER_KIND} SELECT metric_type, 'trained' AS status, samples, sequences, {near("mean")} AS mean, {near("std")} AS std
  FROM kinds WHERE samples >= 80 UNION ALL SELECT metric_type, 'insufficient_data', samples, NULL, NULL, NULL FROM kinds WHERE samples < 80"""
SQL["d12_training_status"] = f"""{BASE}{PER_KIND} SELECT 'isolation_forest' AS model, 'trained' AS status, n AS samples FROM vectors
  UNION ALL SELECT 'lstm_' || metric_type, CASE WHEN samples >= 80 THEN 'trained' ELSE 'insufficient_data' END, samples FROM kinds"""

SQL["s12_save_model_state"] = f"""{BASE} SELECT metric_type AS name, CAST(count(*) * CASE WHEN metric_type < 'm' THEN 2 ELSE 1 END AS BIGINT) AS points
  FROM m GROUP BY metric_type"""
SQL["p4_published_history"] = SQL["p4_metric_history"]
SQL["p5_published_history"] = SQL["p5_training_history"]
SQL["x1_detect_batches"] = SQL["x1_detect_stream"]
SQL["x4_late_rows"] = f"""{BASE},
reach AS (SELECT max(epoch_us(ts)) FILTER (WHERE CAST(metric_id AS BIGINT) % 5 <> 0) // 1000 * 1000 AS first_, max(epoch_us(ts)) // 1000 * 1000 AS last_ FROM m),
p AS (SELECT *, date_trunc('day', ts) AS period, epoch_us(date_trunc('day', ts)) + 86400000000 AS ends FROM m, reach)
SELECT host, metric_type, strftime(period, '%Y-%m-%d %H:%M:%S.%f') AS period_start, {near("avg(value)")} AS average, {near("max(value)")} AS maximum
FROM p WHERE ends <= last_ AND (CAST(metric_id AS BIGINT) % 5 <> 0 OR ends > first_) GROUP BY host, metric_type, period"""

# ---- given models ---------------------------------------------------------------------------------


def _path(size):
    """Mean path below a leaf of so many rows."""
    return 0.0 if size < 2 else 1.0 if size == 2 else 2 * (math.log(size - 1) + 0.5772156649015329) - 2 * (size - 1) / size


def scored_by(version, source="x"):
    """CTE d: the rows of x with both given models and the vote."""
    paths = " + ".join(f"CASE WHEN {f} <= {split!r} THEN {1 + _path(left)!r} ELSE {1 + _path(right)!r} END" for f, split, left, right in given.TREES[version])
    mean, std = (_case("metric_type", {k: v[i] for k, v in given.NORMAL.items()}) for i in (0, 1))
    n = params.SEQUENCE_LENGTH
    return f"""
d0 AS (
  SELECT *, CASE WHEN n >= 30 THEN -pow(2.0, -(({paths}) / 3.0) / {_path(given.ROWS)!r}) END AS forest_raw,
         CASE WHEN n >= 30 THEN list_transform(seq, lambda v: (v - {mean}) / {std}) END AS norm FROM {source}),
d1 AS (
  SELECT *, forest_raw - {given.OFFSETS[version]!r} AS decision,
         (list_sum(list_transform(norm, lambda v: v * v)) - pow(list_sum(norm), 2) / {n}
          - pow(list_sum(list_transform(norm, lambda v, i: v * (i - {(n + 1) / 2}))), 2) / {n * (n * n - 1) / 12}) / {n} AS mse FROM d0),
d2 AS (
  SELECT *, coalesce(decision < 0, false) AS forest_flag, coalesce(1 / (1 + exp(decision)), 0.0) AS forest_score,
         coalesce(mse > {given.LIMITS[version]}, false) AS sequence_flag, CASE WHEN mse IS NULL THEN 0.0 ELSE least(1.0, mse / {2 * given.LIMITS[version]}) END AS sequence_score FROM d1),
d AS (
  SELECT *, 0.25 * stat_score + 0.40 * forest_score + 0.35 * sequence_score AS ens, round(0.25 * stat_score + 0.40 * forest_score + 0.35 * sequence_score, 4) AS anomaly_score,
         0.25 * stat_score + 0.40 * forest_score + 0.35 * sequence_score >= 0.85
         OR stat_flag::INTEGER + forest_flag::INTEGER + sequence_flag::INTEGER >= 2 AS is_anomaly FROM d2)"""


TO_VOTE = f"""{TO_CHECK},{features(30, True)},
seqs AS (SELECT metric_id, list(value) OVER (PARTITION BY host, metric_type ORDER BY ts, metric_id ROWS 29 PRECEDING) AS seq FROM m),
x AS (
  SELECT c.*, seqs.seq, g.z_score, g.dev_5, g.dev_15, g.percentile, g.range_position
  FROM c JOIN seqs ON seqs.metric_id = c.metric_id JOIN g ON g.metric_id = c.metric_id)"""


def anomalies_by(version, where="true"):
    """The anomalies of the ensemble with one version of the models."""
    sev = severity("value", "ens")
    return f"""SELECT sha256('anomaly|' || metric_id) AS anomaly_id, host, metric_type, {sev} AS severity, {near("value")} AS value,
  {near("anomaly_score")} AS anomaly_score,
  upper({sev}) || ' anomaly detected on ' || host || ' for ' || metric_type || '. Current value: ' || format('{{:.2f}}', value) || ', Expected: '
  || format('{{:.2f}}', round(mean, 6)) || ' ± ' || format('{{:.2f}}', round(std, 6)) || '. Detected by: '
  || concat_ws(', ', CASE WHEN stat_flag THEN 'statistical' END, CASE WHEN forest_flag THEN 'isolation_forest' END, CASE WHEN sequence_flag THEN 'lstm' END)
  || '. Scores: statistical=' || {score_text("stat_score")} || ', isolation_forest=' || {score_text("forest_score")}
  || ', lstm=' || {score_text("sequence_score")} || '.' AS description FROM d WHERE is_anomaly AND {where}"""


SQL["d3_given_forest"] = f"""{TO_VOTE},{scored_by(1)}
SELECT metric_id, host, metric_type, CASE WHEN decision < 0 THEN -1 ELSE 1 END AS forest_label, {near("decision")} AS forest_decision FROM d WHERE n >= 30"""
SQL["d6_given_sequence"] = f"""{TO_VOTE},{scored_by(1)}
SELECT metric_id, host, metric_type, sequence_flag, {near("sequence_score")} AS sequence_score, {near("mse")} AS sequence_mse FROM d"""
SQL["d10_given_ensemble"] = f"{TO_VOTE},{scored_by(1)} {anomalies_by(1)}"
SQL["a11_ensemble_quality"] = SQL["a11_detection_quality"].replace(TO_CHECK, f"{TO_VOTE},{scored_by(1)}").replace("SELECT stat_flag AS p", "SELECT is_anomaly AS p").replace("FROM c)", "FROM d)")
# The version valid when a row is settled: the first until the watermark of the second micro-batch.
BEFORE = "epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM m WHERE day(ts) <= 16)"
SETTLED = "epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM m)"
SQL["x1_versioned_detection"] = f"""{TO_VOTE},
first_ AS (SELECT * FROM (WITH {scored_by(1)} {anomalies_by(1, BEFORE)})),
second_ AS (SELECT * FROM (WITH {scored_by(2)} {anomalies_by(2, f"NOT ({BEFORE}) AND {SETTLED}")}))
SELECT *, '20240101' AS version FROM first_ UNION ALL SELECT *, '20240117' FROM second_"""
FOREST_STATS = f"""
fo AS (SELECT quantile_cont(forest_raw, {params.CONTAMINATION}) AS off FROM d WHERE n >= 30),
fs AS (
  SELECT count(*) AS samples, count(*) FILTER (WHERE forest_raw - off < 0) AS anomalies, round(count(*) FILTER (WHERE forest_raw - off < 0) / count(*), 4) AS rate,
         round(avg(forest_raw - off), 4) AS mean, round(stddev_pop(forest_raw - off), 4) AS std FROM d, fo WHERE n >= 30)"""
SEQUENCE_STATS = """
ss AS (
  SELECT metric_type, count(*) AS sequences, avg(mse) FILTER (WHERE metric_id::BIGINT % 10 <> 0) AS final_loss, avg(mse) FILTER (WHERE metric_id::BIGINT % 10 = 0) AS val_loss,
         quantile_cont(mse, 0.95) AS threshold, avg(mse) AS mse_mean, stddev_pop(mse) AS mse_std FROM d WHERE mse IS NOT NULL GROUP BY 1)"""
TO_STATS = f"{TO_VOTE},{scored_by(1)},{FOREST_STATS},{SEQUENCE_STATS}"
SQL["a7_training_stats_forest"] = f"""{TO_STATS} SELECT 'trained' AS status, samples, 16::BIGINT AS features, anomalies, {near("rate")} AS rate,
  {near("mean")} AS mean, {near("std")} AS std FROM fs"""
SQL["a8_training_stats_sequence"] = f"""{TO_STATS} SELECT metric_type, sequences, {near("final_loss")} AS loss, {near("val_loss")} AS val_loss,
  {near("threshold")} AS threshold, {near("mse_mean")} AS mse_mean, {near("mse_std")} AS mse_std FROM ss"""
SQL["a9_training_report"] = f"""{TO_STATS},
long AS (
  SELECT 'isolation_forest' AS model, unnest(['samples', 'features', 'anomalies_in_training', 'anomaly_rate', 'score_mean', 'score_std']) AS key,
         unnest([samples, 16, anomalies, rate, mean, std]::DOUBLE[]) AS number FROM fs
  UNION ALL
  SELECT 'lstm_' || metric_type, unnest(['sequences', 'final_loss', 'val_loss', 'threshold', 'mse_mean', 'mse_std']),
         unnest([sequences, final_loss, val_loss, threshold, mse_mean, mse_std]::DOUBLE[]) FROM ss)
SELECT model, key, {near("number")} AS number, NULL::VARCHAR AS text FROM long UNION ALL SELECT 'isolation_forest', 'status', NULL, 'trained'"""

# A run is due a day after the last one, or while there is no forest for want of rows.
_DUE = ["2024-01-25 00:00:00", "2024-01-25 12:00:00", "2024-01-26 00:00:00", "2024-01-27 06:00:00"]
SQL["d11_retrain_job"] = f"""{BASE},
t AS (SELECT unnest([{", ".join(f"TIMESTAMP '{x}'" for x in _DUE)}]) AS due),
h AS (SELECT t.due, m.host, m.metric_type, m.value FROM t JOIN m ON m.ts >= t.due - INTERVAL 600 HOUR AND m.ts <= t.due),
sizes AS (SELECT due, host, metric_type, count(*) AS n FROM h GROUP BY ALL),
fit AS (SELECT due, sum(greatest(n - 29, 0))::BIGINT AS n FROM sizes GROUP BY due),
runs AS (SELECT * FROM fit WHERE due <> TIMESTAMP '{_DUE[1]}' OR (SELECT n FROM fit WHERE due = TIMESTAMP '{_DUE[0]}') < 50),
kinds AS (
  SELECT r.due, k.kind, (SELECT coalesce(sum(s.n), 0)::BIGINT FROM sizes s WHERE s.due = r.due AND s.metric_type = k.kind AND s.n > 30) AS n
  FROM runs r, (VALUES {KINDS}) AS k(kind)),
result AS (
  SELECT due, 'isolation_forest' AS model, CASE WHEN n >= 50 THEN 'trained' ELSE 'insufficient_data' END AS status, n AS samples FROM runs
  UNION ALL SELECT due, 'lstm_' || kind, CASE WHEN n >= 80 THEN 'trained' ELSE 'insufficient_data' END, n FROM kinds)
SELECT strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS "at", model, status, samples FROM result"""
SQL["s5_stream_to_two_targets"] = SQL["s5_publish_anomaly"]
# The watermark of two streams is that of the slower one; what is newer still waits.
SEEN = "(SELECT least((SELECT max(at_us) FROM a), (SELECT max(at_us) FROM act)) // 1000 * 1000)"
SQL["x2_alert_actions"] = (
    SQL["l8_auto_resolve"]
    .replace(LIFE, LIFE_ACTED)
    .replace("epoch_us(TIMESTAMP '2024-01-01 11:30:00')", SEEN)
    .replace("FROM log WHERE action = 'auto_resolved'", "FROM log")
    .replace("title, description FROM a\n", f"title, description FROM a WHERE at_us <= {SEEN}\n")
    .replace("NULL, alert_id, usr, NULL, NULL FROM act))", f"NULL, alert_id, usr, NULL, NULL FROM act WHERE at_us <= {SEEN}))")
)
SQL["w16_compacted_table"] = SQL["w16_retention_trim"]
SQL["x3_restart"] = SQL["x3_dedup_metrics"]
SQL["a1_catalog_from_rollup"] = SQL["a1_series_catalog"]
SQL["a4_stats_from_rollup"] = SQL["a4_pipeline_stats"]
SQL["a13_summary_from_rollup"] = SQL["a13_dashboard_summary"]
