"""Exact percentiles with linear interpolation, without sorting or collecting the column.

One pass counts the rows and merges quantile sketches, whose rank error is far below a step of the grid that is asked of
them; so the grid's values bracket a rank. The next pass counts equal-width bins inside the bracket and the rows on either
side of it (map-side combined, at most ``BINS`` + 2 rows per group reach the driver). If the bin that holds the rank has
more than one value, further passes look inside that bin. A bracket that missed would be found out by the same counts.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite

BINS = 2048
GRID, ACCURACY = 128, 10_000


def _sketch() -> list:
    """Rows, and the grid of approximate percentiles of the column ``_v``."""
    steps = [k / GRID for k in range(GRID + 1)]
    return [F.count("*"), F.percentile_approx("_v", steps, ACCURACY)]


def _bracket(rank: int, n: int, grid: list) -> dict:
    """A span that holds the rank, to be counted from outside first."""
    step = int(rank / n * GRID)
    return {"low": grid[max(0, step - 1)], "high": grid[min(GRID, step + 2)], "before": 0, "n": n, "value": None, "outside": True}


def exact_percentile(df: DataFrame, value: str, q: float, by: tuple = ()) -> dict:
    """Percentile ``q`` of ``value`` per group; group keys are tuples. The number of groups must be
    small by nature (metric types). Missing, NaN and infinite values are ignored."""
    data = df.select(*by, F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    ranks, out = {}, {}
    for row in data.groupBy(*by).agg(*_sketch()).collect():
        group, (n, grid) = tuple(row[: len(by)]), tuple(row[len(by) :])
        if not n:
            continue
        place = q * (n - 1)
        lower = math.floor(place)
        for k in {lower, min(lower + 1, n - 1)}:
            ranks[(*group, k)] = _bracket(k, n, grid)
        out[group] = (lower, min(lower + 1, n - 1), place - lower)
    found = _select(data, by, ranks)
    result = {}
    for group, (lower, upper, part) in out.items():
        a, b = found[(*group, lower)], found[(*group, upper)]
        result[group] = a + (b - a) * part
    return result


def value_at_rank(df: DataFrame, value: str, rank: int) -> float:
    """The value at a 0-based rank of the ascending column."""
    data = df.select(F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    n, grid = data.agg(*_sketch()).first()
    return _select(data, (), {(rank,): _bracket(rank, n, grid)})[(rank,)]


def cut_from_top(df: DataFrame, value: str, keep: int) -> tuple[float, int] | None:
    """The smallest of the ``keep`` largest values and the number of rows above it; None if there are no more rows."""
    data = df.select(F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    n, grid = data.agg(*_sketch()).first()
    if n <= keep:
        return None
    ranks = {(n - keep,): _bracket(n - keep, n, grid)}
    found = _select(data, (), ranks)[(n - keep,)]
    r = ranks[(n - keep,)]
    return found, n - r["before"] - r["n"]


def _select(data: DataFrame, by: tuple, ranks: dict) -> dict:
    """Value at each 0-based rank of its group."""
    while True:
        open_ = {k: r for k, r in ranks.items() if r["value"] is None}
        for r in open_.values():
            if r["low"] == r["high"] and not r["outside"]:
                r["value"] = r["low"]
        open_ = {k: r for k, r in open_.items() if r["value"] is None}
        if not open_:
            return {k: r["value"] for k, r in ranks.items()}
        spans = {}
        for key, r in open_.items():
            spans.setdefault((*key[:-1], r["low"], r["high"], r["outside"]), []).append(key)
        seen = {}
        for row in _histogram(data, by, list(spans)).collect():
            seen.setdefault(row["_span"], []).append(row)
        for i, (span, keys) in enumerate(spans.items()):
            bins = sorted(seen[i], key=lambda b: b["_bin"])
            for key in keys:
                r, left = ranks[key], key[-1] - ranks[key]["before"]
                for b in bins:
                    if left < b["n"]:
                        break
                    left -= b["n"]
                r["before"] = key[-1] - left
                r["n"] = b["n"]
                if (b["low"], b["high"]) == (r["low"], r["high"]) and b["low"] < b["high"] and not r["outside"]:
                    raise ArithmeticError(f"the span {r['low']} to {r['high']} no longer narrows")
                r["low"], r["high"], r["outside"] = b["low"], b["high"], False


def _histogram(data: DataFrame, by: tuple, spans: list) -> DataFrame:
    """Counts and extremes of the bins of every open span, and of what lies on either side of those counted from outside."""
    picks = []
    for i, (*group, low, high, outside) in enumerate(spans):
        inside = F.lit(True) if outside else (F.col("_v") >= low) & (F.col("_v") <= high)
        for name, val in zip(by, group):
            inside = inside & F.col(name).eqNullSafe(F.lit(val))
        at = F.floor((F.col("_v") - low) / F.lit(high - low) * BINS) if high > low else F.lit(0)
        at = F.when(F.col("_v") < low, -1).when(F.col("_v") > high, BINS).otherwise(F.least(at, F.lit(BINS - 1))).cast("int")
        picks.append(F.when(inside, F.struct(F.lit(i).alias("span"), at.alias("bin"))))
    return (
        data.select("_v", F.explode(F.array_compact(F.array(*picks))).alias("_p"))
        .groupBy(F.col("_p.span").alias("_span"), F.col("_p.bin").alias("_bin"))
        .agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    )
