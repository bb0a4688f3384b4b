"""Ordered series as Spark window partitions that stay bounded under skew.

``arrange`` measures the longest series first. While it fits one task, a series is one window
partition: one exchange and one sort serve every window of the query. Beyond that, rows are
range-partitioned by (series, time, id), which splits a hot series like any other data; each row
gets its exact position from per-slice counts, and positions are cut into chunks. The first rows
of a chunk see the tail of the chunk before it (``_halo`` copies), so bounded frames stay exact,
and running aggregates add the prefix of all earlier chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params
from ..functions.scalars import finite
from ..session import materialise, rows_per_task

ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


@dataclass(frozen=True)
class Trailing:
    """Columns that follow from the last ``frame`` values of a row. ``compute`` gets the values of a batch with ``frame - 1``
    earlier ones in front, the rows' numbers in their window partition, and their positions in the series. What lies in
    front of a row belongs to its series only from number ``frame`` on."""

    frame: int
    fields: tuple
    compute: Callable


def led(batches, lead: int):
    """Arrow batches of ordered rows, each with its values behind the ``lead`` values before them."""
    before = np.zeros(lead)
    for batch in batches:
        x = np.concatenate([before, batch.column("value").to_numpy(zero_copy_only=False).astype("float64")])
        before = x[len(x) - lead :]
        yield batch, x


@dataclass(frozen=True)
class SeriesFrame:
    df: DataFrame
    key: tuple
    order: tuple
    chunked: bool
    frame: int

    @property
    def part(self) -> tuple:
        return (*self.key, "_chunk") if self.chunked else self.key

    def with_df(self, df: DataFrame) -> SeriesFrame:
        return replace(self, df=df)

    def ordered(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def last(self, rows: int):
        """The current row and the ``rows - 1`` before it."""
        if rows > self.frame:
            raise ValueError(f"arranged for frames of {self.frame} rows, asked for {rows}")
        return self.ordered().rowsBetween(-(rows - 1), 0)

    def so_far(self):
        """All rows of the window partition up to the current one."""
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def own(self, col: Column) -> Column:
        """The column on rows that belong to this chunk, null on halo copies."""
        return F.when(~F.col("_halo"), col) if self.chunked else col

    def running(self, name: str, col: Column, how: str) -> SeriesFrame:
        """Running ``sum`` or ``max`` of a column from the start of the series."""
        agg = {"sum": F.sum, "max": F.max}[how]
        df = self.df.withColumn(name, agg(self.own(col)).over(self.so_far()))
        if not self.chunked:
            return self.with_df(df)
        totals = self._chunk_totals(self.df, [agg(self.own(col)).alias("_t")])
        before = Window.partitionBy(*self.key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        prefix = totals.select(*self.part, agg("_t").over(before).alias("_p"))
        df = self.join_prefix(df, prefix)
        if how == "sum":
            merged = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col("_p"), F.lit(0))
        else:
            merged = F.greatest(name, "_p")  # ignores nulls
        return self.with_df(df.withColumn(name, merged).drop("_p"))

    def _chunk_totals(self, df: DataFrame, aggs) -> DataFrame:
        return df.where(~F.col("_halo")).groupBy(*self.part).agg(*aggs)

    def join_prefix(self, df: DataFrame, prefix: DataFrame) -> DataFrame:
        """Attach one row per chunk. Chunks are bounded, so the join key cannot be hot."""
        right = prefix.select(*[F.col(c).alias("_r_" + c) for c in self.part],
                              *[c for c in prefix.columns if c not in self.part])
        cond = F.lit(True)
        for c in self.part:
            cond = cond & df[c].eqNullSafe(right["_r_" + c])
        return df.join(right, cond, "left").drop(*["_r_" + c for c in self.part])

    def numbered(self) -> DataFrame:
        """The rows, partitioned and in order, with their number ``_row`` in the window partition."""
        order = (*self.order, "_pos") if self.chunked else self.order
        row = F.row_number().over(Window.partitionBy(*self.part).orderBy(*order))
        return self.df.withColumn("_row", row)

    def trailing(self, *windows: Trailing) -> SeriesFrame:
        """Columns of the last values, by numpy on Arrow batches in one pass. A task holds a batch and the values of the
        longest frame before it."""
        for w in windows:
            self.last(w.frame)  # checks that the arrangement covers the window
        df, most = self.numbered(), max(w.frame for w in windows)

        def add(batches):
            for batch, x in led(batches, most - 1):
                row, pos = batch.column("_row").to_numpy(), batch.column("_pos").to_numpy()
                columns = dict(zip(batch.schema.names, batch.columns))
                del columns["_row"]
                for w in windows:
                    columns |= zip([f.name for f in w.fields], w.compute(x[most - w.frame :], row, pos))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        fields = [f for w in windows for f in w.fields]
        return self.with_df(df.mapInArrow(add, T.StructType([*self.df.schema.fields, *fields])))

    def rows(self, keep_position: bool = False) -> DataFrame:
        """The result without halo copies and helper columns."""
        df = self.df.where(~F.col("_halo")) if self.chunked else self.df
        helpers = ["_chunk", "_halo"] + ([] if keep_position else ["_pos"])
        return df.drop(*helpers)


def arrange(
    df: DataFrame,
    frame: int = params.QUARTILE_WINDOW,
    key: tuple = params.KEY,
    order: tuple = params.ORDER,
    limit: int | None = None,
) -> SeriesFrame:
    """Lay out ``df`` for windows of at most ``frame`` rows; adds ``_pos``, 1-based per series. Rows whose ``value`` is
    missing, NaN or infinite are no points of a series: they are left out, in streams too."""
    if "value" in df.columns:
        df = df.where(finite(F.col("value")))
    limit = max(rows_per_task(df.sparkSession, limit), 2 * frame)
    sizes = df.groupBy(*key).count().agg(F.sum("count"), F.max("count")).first()
    total, longest = sizes[0] or 0, sizes[1] or 0
    if longest <= limit:
        position = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        return SeriesFrame(df.withColumn("_pos", position.cast("long")), key, order, False, frame)

    slices = max(math.ceil(total / limit), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = materialise(
        df.repartitionByRange(slices, *key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_id", ROW_BITS))
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        laid.groupBy(*key, "_slice")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .select(
            *[F.col(c).alias("_s_" + c) for c in (*key, "_slice")],
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    cond = F.lit(True)
    for c in (*key, "_slice"):
        cond = cond & laid[c].eqNullSafe(starts["_s_" + c])
    index = F.col("_id") + F.col("_shift")
    chunk = F.floor(index / limit)
    tail = F.pmod(index, F.lit(limit)) >= limit - (frame - 1)
    placed = (
        laid.join(starts, cond)
        .withColumn("_pos", index + 1)
        .withColumn("_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
        .withColumn("_halo", F.floor((F.col("_pos") - 1) / limit) != F.col("_chunk"))
        .drop("_id", "_slice", "_shift", *["_s_" + c for c in (*key, "_slice")])
    )
    return SeriesFrame(placed, key, order, True, frame)
