"""Running statistics of a series and the statistical check."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params
from ..functions.scalars import finite, threshold
from .series import SeriesFrame, Trailing


def running_stats(sf: SeriesFrame) -> SeriesFrame:
    """Count, mean, population std, min and max from the start of the series, current row included."""
    w = sf.so_far()
    value = sf.own(F.col("value"))
    if not sf.chunked:
        return sf.with_df(
            sf.df.select(
                "*",
                F.count(value).over(w).alias("count"),
                F.avg(value).over(w).alias("mean"),
                F.stddev_pop(value).over(w).alias("std"),
                F.min(value).over(w).alias("min"),
                F.max(value).over(w).alias("max"),
            )
        )
    here = sf.df.select(
        "*",
        F.count(value).over(w).alias("_n"),
        F.avg(value).over(w).alias("_mean"),
        (F.var_pop(value).over(w) * F.count(value).over(w)).alias("_m2"),
        F.min(value).over(w).alias("_min"),
        F.max(value).over(w).alias("_max"),
    )
    df = sf.join_prefix(here, _moments_before(sf))
    n0, n1 = F.coalesce("_n0", F.lit(0)), F.col("_n")
    n = n0 + n1
    mean0, mean1 = F.coalesce("_mean0", F.lit(0.0)), F.coalesce("_mean", F.lit(0.0))
    delta = F.when((n0 > 0) & (n1 > 0), mean1 - mean0).otherwise(0.0)
    mean = F.when(n1 == 0, mean0).when(n0 == 0, mean1).otherwise(mean0 + delta * n1 / n)
    m2 = F.coalesce("_m20", F.lit(0.0)) + F.coalesce("_m2", F.lit(0.0)) + delta * delta * n0 * n1 / n
    df = (
        df.withColumn("count", n)
        .withColumn("mean", F.when(n > 0, mean))
        .withColumn("std", F.when(n > 0, F.sqrt(m2 / n)))
        .withColumn("min", F.least("_min", "_min0"))
        .withColumn("max", F.greatest("_max", "_max0"))
        .drop("_n", "_mean", "_m2", "_min", "_max", "_n0", "_mean0", "_m20", "_min0", "_max0")
    )
    return sf.with_df(df)


def _moments_before(sf: SeriesFrame) -> DataFrame:
    """Moments of all chunks before each chunk. Means are taken relative to the first chunk, so
    that merging does not cancel."""
    totals = sf._chunk_totals(
        sf.df,
        [
            F.count("value").alias("n"),
            F.avg("value").alias("m"),
            (F.var_pop("value") * F.count("value")).alias("m2"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
        ],
    )
    by_chunk = Window.partitionBy(*sf.key).orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    base = F.first("m", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shifted = totals.withColumn("base", base).withColumn("d", F.col("m") - F.col("base"))
    n = F.sum("n").over(before)
    off = F.sum(F.col("n") * F.col("d")).over(before) / n
    spread = F.sum(F.col("m2") + F.col("n") * F.col("d") * F.col("d")).over(before) - n * off * off
    return shifted.select(
        *sf.part,
        n.alias("_n0"),
        (F.col("base") + off).alias("_mean0"),
        F.greatest(spread, F.lit(0.0)).alias("_m20"),
        F.min("lo").over(before).alias("_min0"),
        F.max("hi").over(before).alias("_max0"),
    )


def trailing_order_stats(values: np.ndarray, window: int, minimum: int):
    """Elements n//4 and 3n//4 of the sorted last n = min(i + 1, window) values; 0.0 below ``minimum``."""
    q1, q3 = np.zeros(len(values)), np.zeros(len(values))
    for i in range(minimum - 1, min(window - 1, len(values))):
        head = np.sort(values[: i + 1])
        q1[i], q3[i] = head[(i + 1) // 4], head[3 * (i + 1) // 4]
    if len(values) >= window:
        full, rolled = slice(window - 1, None), pd.Series(values).rolling(window)
        for out, kth in ((q1, window // 4), (q3, 3 * window // 4)):
            # Half a step below the wanted rank, taken upwards: exactly the kth smallest.
            out[full] = rolled.quantile((kth - 0.5) / (window - 1), interpolation="higher").to_numpy()[full]
            for i in np.flatnonzero(np.isnan(out)):  # windows that hold a NaN: it sorts last
                out[i] = np.partition(values[i - window + 1 : i + 1], kth)[kth]
    return q1, q3


def quartile_window(window: int = params.QUARTILE_WINDOW, minimum: int = params.QUARTILE_MIN_POINTS) -> Trailing:
    def compute(x, row, pos):
        found = [v[window - 1 :] for v in trailing_order_stats(x, window, window)]
        for v in found:
            v[row < window] = 0.0
        for i in np.flatnonzero((row >= minimum) & (row < window) & (row == pos)):  # where a series begins, not halo rows
            head = np.sort(x[window + i - row[i] : window + i])
            for v, place in zip(found, (row[i] // 4, 3 * row[i] // 4)):
                v[i] = head[place]
        return [pa.array(v) for v in found]

    return Trailing(window, (T.StructField("q1", T.DoubleType()), T.StructField("q3", T.DoubleType())), compute)


def recent_quartiles(
    sf: SeriesFrame, window: int = params.QUARTILE_WINDOW, minimum: int = params.QUARTILE_MIN_POINTS
) -> SeriesFrame:
    """Quartiles of the recent values. A sliding sort per row is the one costly window here, so it runs on Arrow batches
    of the window partitions, already shuffled and sorted: no exchange is added when it follows other windows."""
    return sf.trailing(quartile_window(window, minimum))


def statistical_check(df: DataFrame, iqr_warmup: str = "zero") -> DataFrame:
    """Z-score, quartile fence and absolute threshold on rows with running stats and quartiles.

    Before ``QUARTILE_MIN_POINTS`` points the fence is [0, 0] (``iqr_warmup="zero"``) or
    mean +- std (``"mean_std"``).
    """
    q1, q3 = F.col("q1"), F.col("q3")
    if iqr_warmup == "mean_std":
        warm = F.col("count") < params.QUARTILE_MIN_POINTS
        q1 = F.when(warm, F.col("mean") - F.col("std")).otherwise(q1)
        q3 = F.when(warm, F.col("mean") + F.col("std")).otherwise(q3)
    elif iqr_warmup != "zero":
        raise ValueError(f"unknown iqr_warmup: {iqr_warmup}")
    ready = finite(F.col("value")) & finite(F.col("std")) & (F.col("count") >= params.MIN_POINTS) & (F.col("std") >= params.STD_FLOOR)
    reach = 1.5 * (q3 - q1)
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    return (
        df.withColumn("stat_z", F.when(ready, z))
        .withColumn("iqr_flag", F.when(ready, (F.col("value") < q1 - reach) | (F.col("value") > q3 + reach)).otherwise(False))
        .withColumn(
            "abs_flag",
            F.when(ready, F.coalesce(F.col("value") >= threshold(F.col("metric_type"), "high"), F.lit(False))).otherwise(False),
        )
        .withColumn(
            "stat_flag", F.coalesce(F.col("stat_z") > 3.0, F.lit(False)) | F.col("iqr_flag") | F.col("abs_flag")
        )
        .withColumn(
            "stat_score",
            F.when(
                ready,
                F.greatest(
                    F.when(F.col("stat_z").isNotNull(), F.least(F.lit(1.0), F.col("stat_z") / 5.0)),
                    F.when(F.col("iqr_flag"), 0.8).otherwise(0.0),
                    F.when(F.col("abs_flag"), 0.9).otherwise(0.0),
                ),
            ).otherwise(0.0),
        )
    )


def expected_range(df: DataFrame) -> DataFrame:
    """Mean +- 2 std of the running statistics, (0, 100) while the series is short."""
    short = F.col("count") < params.MIN_POINTS
    lower = F.when(short, 0.0).otherwise(F.round(F.col("mean") - 2 * F.col("std"), 2))
    upper = F.when(short, 100.0).otherwise(F.round(F.col("mean") + 2 * F.col("std"), 2))
    return df.withColumn("expected_range", F.struct(lower.alias("lower"), upper.alias("upper")))
