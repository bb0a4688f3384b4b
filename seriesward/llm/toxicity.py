"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A logistic curve fitted on rows that the weights haven't seen turns sums into scores. Features are presences of words, of word pairs side by side and of pairs with one word between. Every coordinate has a
learning rate of its own; the L1 term leaves most weights exactly zero, so the model is a short list that tasks share.

Rows: a null or empty text has no features and scores by the bias. Rows that repeat are scored alike. Without labelled
rows the model is empty and every score 0.5. An empty table gives no rows. Other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled as lb
from . import text as tx

SIZE = 1 << 20
BIAS = SIZE  # the bias's number in a model
SLOPE, SHIFT = SIZE + 1, SIZE + 2
ALPHA, BETA, L1, L2, PASSES = 3.0, 1.0, 4.0, 0.0, 5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, at = tx.split_words(tx.translated(texts, tx.ALNUM))
    codes, distinct = tx.coded(words)
    own = tx.hashed(distinct)[codes] if len(distinct) else np.empty(0, np.uint64)
    mask = np.uint64(SIZE - 1)
    parts = [(np.arange(len(own)), (own & mask).astype(np.int64))]
    for salt, gap in ((1, 1), (2, 2)):
        where = lb.inside(at, len(own), gap + 1)
        parts.append((where, (tx.mixed(tx.mixed(own[where] + np.uint64(salt)) + own[where + gap]) & mask).astype(np.int64)))
    return lb.joined_features(parts, at)


def descend(labels: np.ndarray, rows: list[np.ndarray], alpha=ALPHA, beta=BETA, l1=L1, l2=L2, passes=PASSES) -> np.ndarray:
    """FTRL-proximal, one row at a time. The bias has no L1 term."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    penalty = np.full(SIZE + 1, l1)
    penalty[BIAS] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= penalty[i], 0.0, (np.sign(zi) * penalty[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for y, x in zip(labels, rows):
            i = np.append(x, BIAS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    return weights(np.arange(SIZE + 1))


def fit(labels: np.ndarray, rows: list[np.ndarray], **options) -> tuple[np.ndarray, np.ndarray]:
    """Weights from four fifths of the rows, the curve from the rest; then weights from all rows."""
    rest = np.arange(len(rows)) % 5 == 4
    if len(np.unique(labels)) < 2:
        return np.empty(0, np.int64), np.empty(0)
    if len(np.unique(labels[rest])) < 2 or len(np.unique(labels[~rest])) < 2:
        rest[:] = False
    learn, seen = ~rest, rest if rest.any() else ~rest
    w = descend(labels[learn], [x for x, r in zip(rows, learn) if r], **options)
    sums = np.array([w[x].sum() + w[BIAS] for x, r in zip(rows, seen) if r])
    slope, shift = lb.curve(sums, labels[seen])
    if rest.any():
        w = descend(labels, rows, **options)
    live = np.flatnonzero(w)
    return np.append(live, [SLOPE, SHIFT]), np.append(w[live], [slope, shift])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = lb.PER_CLASS) -> dict[int, float]:
    return lb.fitted(lb.featurised(lb.sample(docs, labels, label, per_class), features), fit, SIZE + 3)


def score(docs: DataFrame, model: dict[int, float], column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. The model has ``SIZE`` + 3 numbers at most."""
    numbers, values = np.array([k for k in model if k < SIZE], np.int64), np.array([v for k, v in model.items() if k < SIZE])
    bias, slope, shift = model.get(BIAS, 0.0), model.get(SLOPE, 0.0), model.get(SHIFT, 0.0)
    weights = None

    def run(texts: pa.Array) -> np.ndarray:
        nonlocal weights
        if weights is None:  # once a task
            weights = np.zeros(SIZE)
            weights[numbers] = values
        return 1 / (1 + np.exp(-np.clip(slope * (lb.sums(*features(texts), weights) + bias) + shift, -500, 500)))

    return lb.scored(docs, run, column)
