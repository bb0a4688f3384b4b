"""Quality by naive Bayes support vectors: n-gram indicators, each scaled by its class log-count ratio, under a linear
model with hinge loss fitted by dual coordinate descent; a logistic curve turns margins into scores.

Words stand in two streams. One holds the words themselves (lower case, 1- and 2-grams). The other holds their forms: small
and capital letters, digits and signs, runs shortened to one character, with a mark if the word repeats the one before it
or the one before that (1- to 3-grams). The second stream carries over to words never seen.

Rows: a null or empty text has no features and scores by the bias. Rows that repeat are scored alike. Without labelled
rows of both classes the model is empty and every score 0.5. An empty table gives no rows. Other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled as lb
from . import text as tx

SIZE = 1 << 20
BIAS, SLOPE, SHIFT = SIZE, SIZE + 1, SIZE + 2
COST, PASSES, SMOOTH, LEAST_DOCS = 0.02, 20, 1.0, 3
KEEP = 0.3
#: The form of each byte: letters a or A, digits 0, from 128 on a, the rest itself.
FORMS = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
)


def _forms(texts: pa.Array) -> pa.Array:
    """The texts' forms with runs of one character shortened; words keep their places."""
    column = tx.translated(texts, FORMS)
    _, offsets, data = column.buffers()
    if data is None or not data.size:
        return column
    raw, at = np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[: len(column) + 1]
    keep = np.ones(len(raw), bool)
    keep[1:] = raw[1:] != raw[:-1]
    keep[at[:-1][at[:-1] < len(raw)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(before[at].astype(np.int64)), pa.py_buffer(raw[keep])])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = tx.filled(texts)
    words, at = tx.split_words(tx.translated(texts, tx.LOWER))
    if not len(words):
        return np.empty(0, np.int64), at
    codes, distinct = tx.coded(words)
    own = tx.hashed(distinct)[codes]
    forms, _ = tx.split_words(_forms(texts))
    form_codes, kinds = tx.coded(forms)
    form = tx.hashed(kinds)[form_codes]
    for gap in (2, 1):
        where = lb.inside(at, len(own), gap + 1)
        same = where[codes[where] == codes[where + gap]] + gap
        form[same] = tx.mixed(form[same] + np.uint64(gap))
    mask, parts = np.uint64(SIZE - 1), []
    for salt, stream, longest in ((11, own, 2), (23, form, 3)):
        rolled = tx.mixed(stream + np.uint64(salt))
        parts.append((np.arange(len(rolled)), (rolled & mask).astype(np.int64)))
        for width in range(2, longest + 1):
            where = lb.inside(at, len(stream), width)
            rolled = tx.mixed(rolled[: len(stream) - width + 1]) + stream[width - 1 :]
            parts.append((where, (tx.mixed(rolled[where]) & mask).astype(np.int64)))
    return lb.joined_features(parts, at)


def log_count_ratios(labels: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Of each feature, from smoothed shares of the documents of either class; 0 for features of few documents."""
    counts = np.zeros((2, SIZE))
    for y, x in zip(labels, rows):
        counts[int(y), x] += 1
    share = (counts + SMOOTH) / ((np.bincount(labels, minlength=2) + 2 * SMOOTH)[:, None])
    return np.where(counts.sum(axis=0) >= LEAST_DOCS, np.log(share[1] / share[0]), 0.0)


def _live(rows: list[np.ndarray], live: np.ndarray) -> list[np.ndarray]:
    """Each row's ``live`` features and the bias, as parts of one array that is given back whole."""
    ends = np.cumsum([0, *(np.count_nonzero(live[x]) + 1 for x in rows)])
    flat = np.full(ends[-1], BIAS, np.int32)
    for x, at, to in zip(rows, ends, ends[1:]):
        flat[at : to - 1] = x[live[x]]
    return [flat[at:to] for at, to in zip(ends, ends[1:])]


def dual_descent(signs: np.ndarray, rows: list[np.ndarray], scales: np.ndarray, cost: float, passes: int) -> np.ndarray:
    """Hinge loss with a squared norm; one dual variable at a time, in an order drawn anew for each pass."""
    w, rng = np.zeros(SIZE + 1), np.random.default_rng(7)
    columns, full = _live(rows, scales != 0), np.append(scales, 1.0)
    norms, dual = np.array([v @ v for v in (full[i] for i in columns)]), np.zeros(len(rows))
    for _ in range(passes):
        most = 0.0
        for k in rng.permutation(len(rows)):
            i = columns[k]
            v = full[i]
            slope = signs[k] * (w[i] @ v) - 1
            new = min(max(dual[k] - slope / norms[k], 0.0), cost)
            if new != dual[k]:
                w[i] += (new - dual[k]) * signs[k] * v
                most = max(most, abs(new - dual[k]))
                dual[k] = new
        if most < 1e-3 * cost:
            break
    return w * full


def fit(labels: np.ndarray, rows: list[np.ndarray], cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Weights from four fifths of each class's rows, the curve from the rest; from all rows where a class has too few."""
    if len(np.unique(labels)) < 2:
        return np.empty(0, np.int64), np.empty(0)
    rest = np.zeros(len(rows), bool)
    for y in (0, 1):
        rest[np.flatnonzero(labels == y)[4::5]] = True
    if len(np.unique(labels[rest])) < 2:
        rest[:] = False
    learn = [x for x, r in zip(rows, rest) if not r]
    scales = log_count_ratios(labels[~rest], learn)
    w = dual_descent(np.where(labels[~rest] == 1, 1.0, -1.0), learn, scales, cost, passes)
    seen = rest if rest.any() else ~rest
    margins = np.array([w[x].sum() + w[BIAS] for x, r in zip(rows, seen) if r])
    slope, shift = lb.curve(margins, labels[seen])
    live = np.flatnonzero(w)
    return np.append(live, [SLOPE, SHIFT]), np.append(w[live], [slope, shift])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = lb.PER_CLASS) -> dict[int, float]:
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


def kept(docs: DataFrame, model: dict[int, float], least: float = KEEP) -> DataFrame:
    """The rows that score ``least`` or more."""
    name = tx.spare(docs, "_quality")
    return score(docs, model, name).where(F.col(name) >= least).drop(name)
