"""Bounded training samples of labelled documents, and models as bounded tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import text as tx

PER_CLASS = 6_000
FOLDS = 5
SLICE_BYTES = 512 << 10  # a text makes several features per word, each of several numbers


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text, label (0 or 1) of labelled documents outside the held-out fold: at most ``per_class`` rows of each
    class, those of ``docs`` with the smallest hash of their doc_id. Of rows that repeat a doc_id, the text with the
    smallest hash is taken. Rows without id or label take no part."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    # Each class is picked by a pass of its own over the ids; a table of them would be as many small files as partitions.
    picked = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    picked = materialise(picked[0].unionByName(picked[1]))  # per_class bounds what is broadcast
    own = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    # Merged where the rows are, so that one doc_id with many rows brings one row a task.
    own = own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return own.join(F.broadcast(picked), "doc_id")


def featurised(rows: DataFrame, features: Callable) -> DataFrame:
    """doc_id, label and the distinct feature numbers of every row; ``features(texts)`` gives (numbers, where each text's begin)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text", SLICE_BYTES):
            numbers, at = features(batch.column("text"))
            own = [np.unique(numbers[at[k] : at[k + 1]]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "label", "features"])

    return rows.mapInArrow(run, "doc_id long, label int, features array<int>")


def fitted(rows: DataFrame, fit: Callable, most: int) -> dict[int, float]:
    """The bounded sample goes to one task in an order of its own; ``fit(labels, features)`` gives (numbers, weights),
    ``most`` at most, which is what the driver gets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, lists = [], []
        for batch in batches:
            labels.append(batch.column("label").to_numpy())
            column = batch.column("features")
            values, at = column.values.to_numpy(), column.offsets.to_numpy()
            lists += [values[at[k] : at[k + 1]] for k in range(batch.num_rows)]  # parts of the batch, not thousands of small copies
        if lists:
            numbers, weights = fit(np.concatenate(labels), lists)
            if len(numbers) > most:
                raise ValueError("the model is larger than its bound")
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(weights, pa.float64())], names=["number", "weight"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label")
    return {r.number: r.weight for r in ordered.mapInArrow(run, "number int, weight double").collect()}


def dense(model: dict[int, float], size: int) -> np.ndarray:
    out = np.zeros(size)
    for k, v in model.items():
        if 0 <= k < size:
            out[k] = v
    return out


def sums(numbers: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every text, the weights of its distinct features added up. Most features weigh nothing and go first."""
    own = weights[numbers]
    live = np.flatnonzero(own)
    text = np.searchsorted(at, live, side="right") - 1
    pairs = np.unique(text * len(weights) + numbers[live])
    return np.bincount(pairs // len(weights), weights=weights[pairs % len(weights)], minlength=len(at) - 1)


def joined_features(parts: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of several kinds, each with the word they begin at, brought together text by text."""
    where, numbers = np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts])
    text = np.searchsorted(at, where, side="right") - 1
    order = np.argsort(text, kind="stable")
    return numbers[order], np.searchsorted(text[order], np.arange(len(at)))


def inside(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words from which ``width`` words of the same text follow, itself included."""
    if n < width:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.flatnonzero(text[: n - width + 1] == text[width - 1 :])


def curve(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits best: damped Newton steps towards smoothed targets."""
    ones = max(1, int(labels.sum()))
    zeros = max(1, len(labels) - int(labels.sum()))
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    spread = float(margins.std()) or 1.0
    x = np.stack([(margins - margins.mean()) / spread, np.ones(len(margins))], 1)

    def loss(beta):
        z = x @ beta
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * 1e-3 * beta @ beta)

    beta = np.array([0.0, np.log(ones / zeros)])
    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step, size = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * beta), 1.0
        while size > 1e-6 and (new := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-9:
            break
        beta, now = beta - size * step, new
    return float(beta[0] / spread), float(beta[1] - beta[0] * margins.mean() / spread)


def scored(docs: DataFrame, score: Callable, column: str) -> DataFrame:
    """``docs`` with a double column; ``score(texts)`` works on Arrow strings. A column of that name is replaced."""
    from pyspark.sql import types as T

    rows, extra = tx.with_text(docs.drop(column), docs["text"])
    docs = docs.drop(column)
    many = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, extra, SLICE_BYTES):
            values = pa.array(score(batch.column(extra)), pa.float64())
            kept = batch.schema.names[:many]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), values], names=[*kept, column])

    return rows.mapInArrow(run, schema)
