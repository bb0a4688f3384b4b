"""Column expressions used across the operators. All of them stay in generated JVM code."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table as a CASE expression; ``default`` when the key is missing."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr if default is None else expr.otherwise(F.lit(default))


def series_key(host="host", metric_type="metric_type") -> Column:
    return F.concat_ws(":", F.col(host), F.col(metric_type))


def host_to_service(host: Column) -> Column:
    expr = None
    for part, service in params.HOST_SERVICES:
        test = host.contains(part)
        expr = F.when(test, service) if expr is None else expr.when(test, service)
    return expr.otherwise("unknown")


def clamp_value(metric_type: Column, value: Column) -> Column:
    """Bound a value to the profile of its metric type and round it; types without profile pass."""
    low = lookup(metric_type, {k: v[0] for k, v in params.PROFILES.items()})
    high = lookup(metric_type, {k: v[1] for k, v in params.PROFILES.items()})
    return F.when(low.isNull(), value).otherwise(F.round(F.greatest(low, F.least(high, value)), 4))


def clean_number(value: Column, infinity: float | None = 1e6) -> Column:
    """NaN becomes 0; infinities become +-``infinity`` (kept when it is None)."""
    finite = F.nanvl(value, F.lit(0.0))
    if infinity is None:
        return finite
    return (
        F.when(finite == float("inf"), infinity)
        .when(finite == float("-inf"), -infinity)
        .otherwise(finite)
    )


def finite(value: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def threshold(metric_type: Column, level: str) -> Column:
    """Threshold of a metric type at a severity; null for types without thresholds."""
    return lookup(metric_type, {k: float(v[level]) for k, v in params.THRESHOLDS.items()})


def determine_severity(metric_type: Column, value: Column, score: Column) -> Column:
    """By the thresholds of the type, else by the score; NaN reaches no threshold."""
    expr, known = None, F.nanvl(value, F.lit(float("-inf")))
    for level in reversed(params.SEVERITIES):
        test = known >= threshold(metric_type, level)
        expr = F.when(test, level) if expr is None else expr.when(test, level)
    for level, least in params.SCORE_SEVERITY.items():
        expr = expr.when(F.nanvl(score, F.lit(0.0)) >= least, level)
    return expr.otherwise("low")


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {name: i + 1 for i, name in enumerate(params.SEVERITIES)})


def next_severity(severity: Column) -> Column:
    """One level up, saturating; an unknown level stays."""
    return F.coalesce(lookup(severity, params.RAISED), severity)


def cooldown_minutes(severity: Column) -> Column:
    return lookup(severity, params.COOLDOWN_MINUTES, params.DEFAULT_COOLDOWN_MINUTES)


def decimals(value: Column, places: int) -> Column:
    """Fixed number of decimals, rounding the exact binary value half to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def filled(text: str, **values: Column) -> Column:
    """A fixed text with columns in the places of its {names}."""
    return F.concat(*(F.lit(t) if k % 2 == 0 else values[t] for k, t in enumerate(re.split(r"[{}]", text)) if t))


def alert_title(severity: Column, metric_type: Column, host: Column, score: Column) -> Column:
    return filled(params.TITLE, severity=F.upper(severity), metric=metric_type, host=host, score=decimals(score, 2))


def label(name: Column) -> Column:
    """Display name of a metric type."""
    return F.upper(F.replace(name, F.lit("_"), F.lit(" ")))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def format_uptime(seconds: Column) -> Column:
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return (
        F.when(seconds.isNull() | (seconds == 0), "--")
        .when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m")))
        .when(m > 0, F.concat(m, F.lit("m "), s, F.lit("s")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def stable_id(*parts) -> Column:
    """Identifier that a rerun reproduces."""
    return F.sha2(F.concat_ws("|", *parts), 256)
