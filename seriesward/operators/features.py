"""Rolling windows, feature vectors and sequences. All windows of a series share one sort."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params
from .series import SeriesFrame, Trailing

FRAMES = (5, 15, 30)


def feature_columns() -> dict:
    """The sixteen feature expressions over the window columns of a stream's state."""
    eps = params.STD_FLOOR
    x = F.col("value")
    std = {k: F.col(f"_std_{k}") + eps for k in FRAMES}
    spread = F.col("_max_30") - F.col("_min_30") + eps
    below = F.size(F.filter("_recent", lambda v: v < x)) / F.size("_recent")
    return {
        "current": x,
        "mean_5": F.col("_mean_5"),
        "mean_15": F.col("_mean_15"),
        "mean_30": F.col("_mean_30"),
        **{f"std_{k}": std[k] for k in FRAMES},
        "rate_of_change": x - F.col("_lag1"),
        "acceleration": x - 2 * F.col("_lag1") + F.col("_lag2"),
        "z_score": (x - F.col("_mean_30")) / std[30],
        "min_30": F.col("_min_30"),
        "max_30": F.col("_max_30"),
        "range_position": (x - F.col("_min_30")) / spread,
        "percentile": below,
        "dev_5": (x - F.col("_mean_5")) / std[5],
        "dev_15": (x - F.col("_mean_15")) / std[15],
    }


def drop_rolling(df: DataFrame) -> DataFrame:
    return df.drop(
        *[f"_{m}_{k}" for m in ("mean", "std") for k in FRAMES],
        "_min_30", "_max_30", "_recent", "_lag1", "_lag2",
    )


def _moments(x: np.ndarray, last: int, k: int) -> tuple:
    """Mean and population std of the ``k`` values up to each of the last ``last`` rows, added up as Spark's windows do."""
    total, mean, m2 = np.zeros(last), np.zeros(last), np.zeros(last)
    for j in range(k):
        v = x[len(x) - last - k + 1 + j :][:last]
        total += v
        d = v - mean
        step = d / (j + 1)
        mean += step
        m2 += d * (d - step)
    return total / k, np.sqrt(m2 / k)


def _extreme(x: np.ndarray, k: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``k`` consecutive values, by doubling."""
    wide = 1
    while 2 * wide <= k:
        x, wide = pick(x[wide:], x[:-wide]), 2 * wide
    return pick(x[k - wide :], x[: len(x) - (k - wide)]) if wide < k else x


def feature_window(names: tuple, frame: int = params.MIN_POINTS, eps_in_std: bool = True) -> Trailing:
    """The sixteen features; null until a series has ``frame`` points.

    Detection uses 30 rows and adds the epsilon to the stds; the training variant uses 31 rows
    and adds it only where a std divides.
    """
    eps = params.STD_FLOOR

    def compute(x, row, pos):
        now, lag1, lag2 = (x[frame - 1 - i : len(x) - i] for i in range(3))
        n, frames = len(now), (*FRAMES[:2], frame)
        with np.errstate(all="ignore"):
            (mean5, std5), (mean15, std15), (mean30, std30) = (_moments(x, n, k) for k in frames)
            low, high = _extreme(x, frame, np.minimum), _extreme(x, frame, np.maximum)
            below = np.zeros(n)
            for j in range(frame):
                below += x[j : j + n] < now
            over = std5 + eps, std15 + eps, std30 + eps
            stds = over if eps_in_std else (std5, std15, std30)
            columns = (
                now, mean5, mean15, mean30, *stds, now - lag1, now - 2 * lag1 + lag2, (now - mean30) / over[2], low, high,
                (now - low) / (high - low + eps), below / frame, (now - mean5) / over[0], (now - mean15) / over[1],
            )
        return [pa.array(c, mask=row < frame) for c in columns]

    return Trailing(frame, tuple(T.StructField(n, T.DoubleType()) for n in names), compute)


def sequence_window(length: int = params.SEQUENCE_LENGTH) -> Trailing:
    def compute(x, row, pos):
        full = row >= length
        ends = np.concatenate([[0], np.cumsum(full * length)]).astype("int32")
        flat = np.lib.stride_tricks.sliding_window_view(x, length)[full].ravel() if full.any() else np.zeros(0)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~full))]

    return Trailing(length, (T.StructField("sequence", T.ArrayType(T.DoubleType())),), compute)


def extract_features(sf: SeriesFrame) -> SeriesFrame:
    """The sixteen features as columns; null until a series has 30 points."""
    return sf.trailing(feature_window(params.FEATURES))


def training_features(sf: SeriesFrame) -> SeriesFrame:
    """The training variant: 31-row frame, first row at index 30, rows before it left out."""
    wide = sf.trailing(feature_window(params.FEATURES, params.MIN_POINTS + 1, eps_in_std=False))
    return wide.with_df(wide.df.where(F.col("_pos") > params.MIN_POINTS))


def sequences(sf: SeriesFrame, length: int = params.SEQUENCE_LENGTH) -> SeriesFrame:
    """Overlapping windows of ``length`` values, one per row from the ``length``-th on."""
    return sf.trailing(sequence_window(length))


def rolling_bands(sf: SeriesFrame, k: int = 10, sigma: float = 2.0) -> SeriesFrame:
    """Trailing mean +- ``sigma`` std and a mark for points outside."""
    mean, std = F.avg("value").over(sf.last(k)), F.stddev_pop("value").over(sf.last(k))
    df = (
        sf.df.select("*", mean.alias("rolling_mean"), std.alias("_std"))
        .withColumn("upper_band", F.col("rolling_mean") + sigma * F.col("_std"))
        .withColumn("lower_band", F.col("rolling_mean") - sigma * F.col("_std"))
        .withColumn("outside", (F.col("value") > F.col("upper_band")) | (F.col("value") < F.col("lower_band")))
        .drop("_std")
    )
    return sf.with_df(df)


def align_by_index(metrics_features: DataFrame, lengths: DataFrame) -> DataFrame:
    """Wide matrix: per host, the feature blocks of its metric types in sorted order, aligned by
    position and cut to the host's shortest series; all rows cut to the narrowest host.

    ``metrics_features`` is ``training_features`` output with positions, ``lengths`` one row per
    series (host, metric_type, n).
    """
    hosts = lengths.groupBy("host").agg(F.min("n").alias("_shortest"), F.count("*").alias("_types"))
    hosts = hosts.where(F.col("_shortest") >= params.MIN_POINTS)
    narrowest = hosts.where(F.col("_shortest") > params.MIN_POINTS).agg(F.min("_types")).first()[0] or 0
    block = F.struct("metric_type", F.array(*params.FEATURES).alias("f"))
    return (
        metrics_features.join(hosts, "host")
        .where(F.col("_pos") <= F.col("_shortest"))
        .groupBy("host", (F.col("_pos") - 1).alias("i"))
        # One entry per metric type of the host: bounded by the number of types.
        .agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
        .select(
            "host",
            "i",
            F.slice(F.flatten(F.transform("_blocks", lambda b: b["f"])), 1, narrowest * len(params.FEATURES)).alias("features"),
        )
    )
