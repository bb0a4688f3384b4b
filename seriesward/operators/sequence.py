"""Sequence reconstruction detector: one principal-component model per metric type.

A single pass over all series sums the products of the normalised windows per metric type; the
30 x 30 covariances that result are all the driver sees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.scalars import clean_number, lookup
from ..session import materialise
from .percentile import exact_percentile
from .series import arrange, led


@dataclass
class SequenceModel:
    length: int
    types: dict = field(default_factory=dict)  # metric type -> mean, std, center, components, threshold
    stats: dict = field(default_factory=dict)  # metric type -> training report


def _type_moments(metrics: DataFrame, length: int) -> dict:
    """Rows, mean and population std per known metric type over its series of more than ``length`` rows.
    The data is read once, for one partial per series; the partials are merged twice, for the mean
    and for the spread around it."""
    series = metrics.groupBy(*params.KEY).agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    kept = materialise(series.where(F.col("n") > length))
    n = F.sum("n")
    means = kept.groupBy("metric_type").agg(n.alias("n"), (F.sum(F.col("n") * F.col("m")) / n).alias("mean"))
    rows = {r["metric_type"]: r for r in means.collect()}  # one row per metric type
    if not rows:
        return {}
    off = F.col("m") - lookup(F.col("metric_type"), {k: r["mean"] for k, r in rows.items()})
    spread = kept.groupBy("metric_type").agg((F.sum(F.col("n") * (F.col("v") + off * off)) / n).alias("var"))
    var = {r["metric_type"]: r["var"] for r in spread.collect()}
    return {k: (r["n"], r["mean"], float(np.sqrt(var[k]))) for k, r in rows.items()}


def _blocks(length: int):
    """Per batch of ordered rows one row: the values with ``length - 1`` earlier ones in front, and per window 0 if it
    takes no part, else twice the number of its metric type (from 1), plus 1 if it is held out. The windows themselves
    would be ``length`` times as large."""

    def pack(batches):
        for batch, x in led(batches, length - 1):
            codes = batch.column("code").to_numpy(zero_copy_only=False).copy()
            codes[batch.column("_row").to_numpy() < length] = 0
            if codes.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.list_(pa.float64())), pa.array([codes], pa.list_(pa.int8()))], names=["x", "codes"]
                )

    return pack


def _unpacked(batches, length: int):
    """Code after code, the windows of every block."""
    for batch in batches:
        for x, codes in zip(batch.column("x"), batch.column("codes")):
            view = np.lib.stride_tricks.sliding_window_view(x.values.to_numpy(), length)
            codes = codes.values.to_numpy()
            for code in np.unique(codes[codes > 0]):
                yield int(code), view[codes == code]


def _products(kinds: list, length: int):
    """Per task and metric type: rows, sums and sums of products of the windows that are not held out."""

    def run(batches):
        sums = {}
        for code, part in _unpacked(batches, length):
            if code % 2 == 0:
                n, s, g = sums.get(code, (0, 0.0, 0.0))
                sums[code] = (n + len(part), s + part.sum(axis=0), g + part.T @ part)
        if sums:
            terms = [np.concatenate([[float(n)], s, g.ravel()]).tolist() for n, s, g in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kinds[c // 2 - 1] for c in sums]), pa.array(terms, pa.list_(pa.float64()))], names=["metric_type", "terms"]
            )

    return run


def _block_errors(spark, kinds: list, model: SequenceModel):
    """The error of every window, already normalised, with its metric type and whether it is held out."""
    shipped = spark.sparkContext.broadcast((model.length, model.types))

    def run(batches):
        length, types = shipped.value
        for code, part in _unpacked(batches, length):
            m = types.get(kinds[code // 2 - 1])
            if m is not None:
                mse = pa.array(_error(part, m))
                kind = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), "int8")), pa.array([kinds[code // 2 - 1]])).cast(pa.string())
                held = pa.array(np.full(len(part), code % 2 == 1))
                yield pa.RecordBatch.from_arrays([kind, held, mse], names=["metric_type", "held", "mse"])

    return run


def _error(x: np.ndarray, m: dict) -> np.ndarray:
    """Mean squared error of normalised windows by the model of their type."""
    d = np.nan_to_num(x) - m["center"]
    r = d - (d @ m["components"]) @ m["components"].T
    return np.mean(r * r, axis=1)


def sequence_fit(
    metrics: DataFrame,
    length: int = params.SEQUENCE_LENGTH,
    components: int = params.SEQUENCE_COMPONENTS,
    quantile: float = params.SEQUENCE_QUANTILE,
    limit: int | None = None,
) -> SequenceModel:
    """Fit all metric types. Windows never cross series; one tenth of them, by hash, is held out of
    the fit and gives ``val_loss``."""
    spark = metrics.sparkSession
    value = clean_number(F.coalesce("value", F.lit(0.0)), infinity=None)
    known = metrics.where(F.col("metric_type").isin(*params.METRIC_TYPES))
    # Read three times; expressions over the caller's metric types would be worked out anew in every branch of a lookup.
    metrics = materialise(known.select(*params.KEY, *params.ORDER, value.alias("value")))
    moments = _type_moments(metrics, length)
    model = SequenceModel(length)
    for kind in params.METRIC_TYPES:
        n = moments.get(kind, (0,))[0]
        if n < length + params.SEQUENCE_EXTRA:
            model.stats[kind] = {"status": "insufficient_data", "metric_type": kind, "samples": n}
            moments.pop(kind, None)
    if not moments:
        return model

    kind = F.col("metric_type")
    mean = lookup(kind, {k: m[1] for k, m in moments.items()})
    std = lookup(kind, {k: m[2] + 1e-8 for k, m in moments.items()})
    chosen = metrics.where(kind.isin(*moments)).select(
        *params.KEY, *params.ORDER, ((F.col("value") - mean) / std).alias("value")
    )
    sf = arrange(chosen, frame=length, limit=limit)
    # A series of exactly `length` rows is too short to train on.
    longer = (F.col("_pos") > length) | ((F.col("_pos") == length) & F.lead("value").over(sf.ordered()).isNotNull())
    held = F.pmod(F.xxhash64(*params.KEY, *params.ORDER), F.lit(10)) == 0
    kinds = list(moments)
    number = lookup(kind, {k: 2 * (i + 1) for i, k in enumerate(kinds)})
    code = F.when(sf.own(longer), number + held.cast("int")).otherwise(0).cast("byte")
    rows = sf.with_df(sf.df.withColumn("code", code)).numbered().select("value", "_row", "code")
    packed = materialise(rows.mapInArrow(_blocks(length), "x array<double>, codes array<tinyint>"))  # laid out once, read twice

    terms = (
        packed.mapInArrow(_products(kinds, length), "metric_type string, terms array<double>")
        .select("metric_type", F.posexplode("terms").alias("i", "v"))
        .groupBy("metric_type", "i")
        .agg(F.sum("v").alias("v"))
    )
    flat = {}
    for row in terms.collect():  # metric types x (1 + length + length^2) numbers
        flat.setdefault(row["metric_type"], np.zeros(1 + length + length * length))[row["i"]] = row["v"]
    for name, t in flat.items():
        center = t[1 : 1 + length] / t[0]
        cov = t[1 + length :].reshape(length, length) / t[0] - np.outer(center, center)
        _, vectors = np.linalg.eigh(cov)
        model.types[name] = {
            "mean": moments[name][1],
            "std": moments[name][2] + 1e-8,
            "center": center,
            "components": vectors[:, ::-1][:, : min(components, length)],
            "threshold": float("nan"),
        }

    errors = materialise(packed.mapInArrow(_block_errors(spark, kinds, model), "metric_type string, held boolean, mse double"))
    for name, stats in training_stats(errors, quantile).items():
        model.types[name]["threshold"] = stats["threshold"]
        model.stats[name] = {"status": "trained", "samples": moments[name][0], **stats}
    return model


def training_stats(errors: DataFrame, quantile: float = params.SEQUENCE_QUANTILE) -> dict:
    """Per metric type, what the report says of the errors (metric_type, held, mse) of its windows: their number, the
    mean error of those fitted and of those held out, the threshold, mean and population std."""
    limits = exact_percentile(errors, "mse", quantile, by=("metric_type",))
    report = errors.groupBy("metric_type").agg(
        F.count("*").alias("sequences"),
        F.avg(F.when(~F.col("held"), F.col("mse"))).alias("loss"),
        F.avg(F.when(F.col("held"), F.col("mse"))).alias("val_loss"),
        F.avg("mse").alias("mse_mean"),
        F.stddev_pop("mse").alias("mse_std"),
    )
    return {
        row["metric_type"]: {
            "sequences": row["sequences"],
            "final_loss": row["loss"],
            "val_loss": row["val_loss"],
            "threshold": limits[(row["metric_type"],)],
            "mse_mean": row["mse_mean"],
            "mse_std": row["mse_std"],
        }
        for row in report.collect()
    }


def reconstruction_error(spark, model: SequenceModel, seq: Column, metric_type: Column) -> Column:
    """Mean squared reconstruction error of the last ``length`` values. Shorter input is padded with
    zeros in front, after normalising. Null without a sequence or a model for the type."""
    shipped = spark.sparkContext.broadcast((model.length, model.types))

    @F.arrow_udf("double")
    def mse(seqs: pa.Array, kinds: pa.Array) -> pa.Array:
        length, types = shipped.value
        out = np.full(len(seqs), np.nan)
        size = pc.fill_null(pc.list_value_length(seqs), 0).to_numpy(zero_copy_only=False).astype("int64")
        known, ends = seqs.is_valid().to_numpy(zero_copy_only=False), np.cumsum(size)
        values = seqs.flatten().to_numpy(zero_copy_only=False)
        for kind in kinds.unique().to_pylist():
            m = types.get(kind)
            part = np.flatnonzero(known & pc.fill_null(pc.equal(kinds, kind), False).to_numpy(zero_copy_only=False)) if m else []
            if len(part) == 0:
                continue
            back = np.arange(length, 0, -1)
            there = size[part][:, None] >= back
            x = np.full(there.shape, np.nan)
            x[there] = values[(ends[part][:, None] - back)[there]]
            out[part] = _error((x - m["mean"]) / m["std"], m)
        return pa.array(out, mask=np.isnan(out))

    # Declared nondeterministic so that a filter on the result does not evaluate it a second time.
    return mse.asNondeterministic()(seq, metric_type)


def sequence_predict(df: DataFrame, model: SequenceModel | None, pad: bool = False) -> DataFrame:
    """Adds error, flag and score of the row's ``sequence`` by the model of its metric type.
    Without a model, or a full sequence unless ``pad``, the result is (false, 0)."""
    if model is None or not model.types:
        return (
            df.withColumn("sequence_mse", F.lit(None).cast("double"))
            .withColumn("sequence_flag", F.lit(False))
            .withColumn("sequence_score", F.lit(0.0))
        )
    kind = F.col("metric_type")
    seq = F.col("sequence") if pad else F.when(F.size("sequence") >= model.length, F.col("sequence"))
    limit = lookup(kind, {k: float(m["threshold"]) for k, m in model.types.items()})
    mse = F.col("sequence_mse")
    score = F.when(limit > 0, F.least(F.lit(1.0), mse / (2 * limit))).otherwise(0.0)
    return (
        df.withColumn("sequence_mse", reconstruction_error(df.sparkSession, model, seq, kind))
        .withColumn("sequence_flag", F.coalesce(mse > limit, F.lit(False)))
        .withColumn("sequence_score", F.when(mse.isNull(), 0.0).otherwise(score))
    )
