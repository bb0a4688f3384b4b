"""Isolation forest: sampling, tree growth and scoring as Spark jobs.

Rows are dealt to trees by hash, every tree grows in its own group of at most ``max_samples``
rows, and the model is a node table whose size is fixed by the parameters
(trees x (2 x max_samples - 1) nodes), so it can be handed to every task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.scalars import clean_number
from ..session import materialise
from .percentile import exact_percentile

NODES = "tree int, node int, feature int, split double, left int, right int, depth int, size long"
EULER = 0.5772156649015329


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype="float64")
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0) - 1
    return np.where(big, 2.0 * (np.log(m) + EULER) - 2.0 * m / (m + 1), out)


@dataclass
class ForestModel:
    features: tuple
    mean: list
    std: list
    nodes: pd.DataFrame
    offset: float
    contamination: float
    samples: int
    max_samples: int
    stats: dict = field(default_factory=dict)
    flat: dict | None = field(default=None, repr=False)

    def arrays(self) -> dict:
        """All trees as complete binary trees of one depth: node i has children 2i+1 and 2i+2. A leaf
        above the bottom sends every row left."""
        if self.flat is None:
            self.flat = self._flatten()
        return self.flat

    def _flatten(self) -> dict:
        depth = int(self.nodes["depth"].max())
        inner, trees = 2**depth - 1, int(self.nodes["tree"].nunique())
        feature = np.zeros((trees, inner), dtype="int32")
        split = np.full((trees, inner), np.inf)
        value = np.zeros((trees, inner + 1))
        path = self.nodes["depth"] + average_path(self.nodes["size"])
        columns = self.nodes[["tree", "node", "feature", "split", "left", "right"]].assign(path=path)
        for t, (_, nodes) in enumerate(columns.groupby("tree")):
            rows = {n[1]: n[2:] for n in nodes.itertuples(index=False, name=None)}
            todo = [(0, 0)]
            while todo:
                at, node = todo.pop()
                f, s, left, right, length = rows[node]
                if f >= 0:
                    feature[t, at], split[t, at] = f, s
                    todo += [(2 * at + 1, left), (2 * at + 2, right)]
                else:
                    while at < inner:
                        at = 2 * at + 1
                    value[t, at - inner] = length
        return {"feature": feature, "split": split, "value": value, "depth": depth}


def standard_scaler(df: DataFrame, features) -> tuple[int, list, list]:
    """Rows, means and population stds; a zero std divides by 1."""
    aggs = [F.count("*")]
    for name in features:
        aggs += [F.avg(name), F.stddev_pop(name)]
    row = df.agg(*aggs).first()
    mean = [v if v is not None else 0.0 for v in row[1::2]]
    std = [v if v else 1.0 for v in row[2::2]]
    return row[0], mean, std


def standard_scale(df: DataFrame, features) -> DataFrame:
    _, mean, std = standard_scaler(df, features)
    return df.withColumns({n: (F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(features, mean, std)})


def deal_to_trees(df: DataFrame, identity, rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` rows for every tree, chosen by hash, the same way at every size: one hash per row thins the rows to
    those that some tree may want, and these look up their trees; about twice ``sample`` rows a tree are then ranked."""
    ident, unit = [F.col(c).cast("string") for c in identity], 2.0**63
    share = min(1.0, 2.0 * sample / max(rows, 1))
    some = min(1.0, share * trees)
    row = F.xxhash64(F.lit(seed), *ident)
    wants = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.abs(F.xxhash64(t, "_row")) < share / some * unit)
    dealt = df.withColumn("_row", row).where(F.abs("_row") < some * unit).withColumn("tree", F.explode(wants))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), "tree", *ident)))
    return dealt.withColumn("_rank", rank).where(F.col("_rank") <= sample)


def grow_tree(x: np.ndarray, tree: int, seed: int, limit: int) -> list:
    """Nodes of one isolation tree: random feature, uniform split, until alone or too deep."""
    rng = np.random.default_rng([seed, tree])
    nodes, todo, used = [], [(0, np.arange(len(x)), 0)], 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= limit or len(usable) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, depth, len(rows)))
            continue
        f = int(rng.choice(usable))
        split = float(rng.uniform(low[f], high[f]))
        split = split if split < high[f] else float(low[f])  # neighbouring numbers: a draw may round up to the higher one
        goes_left = x[rows, f] <= split
        left, right = used, used + 1
        used += 2
        nodes.append((tree, node, f, split, left, right, depth, len(rows)))
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def isolation_forest_fit(
    df: DataFrame,
    features=params.FEATURES,
    identity=None,
    rows: int | None = None,
    trees: int = params.FOREST_TREES,
    contamination: float = params.CONTAMINATION,
    max_samples: int = params.FOREST_SAMPLES,
    seed: int = params.SEED,
) -> ForestModel | dict:
    """Train on the rows of ``df``; a dict with status ``insufficient_data`` below 50 rows.

    ``identity`` names the columns that identify a row for sampling (default: the features), and
    ``rows`` their number, if known. ``df`` is read twice: for the samples and for the scores that
    set the offset. The scaler is fitted on the sampled rows: isolation splits do not change under
    scaling, it only keeps the numbers in range.
    """
    features = tuple(features)
    identity = tuple(identity or features)
    spark = df.sparkSession
    clean = df.select(
        *[F.col(c) for c in identity if c not in features],
        *[clean_number(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in features],
    )
    rows = clean.count() if rows is None else rows
    if rows < params.FOREST_MIN_ROWS:
        return {"status": "insufficient_data", "samples": rows}
    sample = min(max_samples, rows)
    limit = math.ceil(math.log2(max(sample, 2)))

    bags = deal_to_trees(clean, identity, rows, trees, sample, seed)
    bags = materialise(bags.select("tree", "_rank", *features))  # at most trees x max_samples rows
    _, mean, std = standard_scaler(bags, features)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_rank")
        x = (group[list(features)].to_numpy() - mean) / std
        return pd.DataFrame(grow_tree(x, int(group["tree"].iloc[0]), seed, limit), columns=[c.split()[0] for c in NODES.split(", ")])

    spread = bags.repartition(min(trees, spark.sparkContext.defaultParallelism), "tree")
    nodes = spread.groupBy("tree").applyInPandas(grow, NODES).toPandas()
    model = ForestModel(features, mean, std, nodes, 0.0, contamination, rows, sample)

    scored = materialise(clean.select(forest_score_samples(spark, model).alias("score")))
    model.offset = exact_percentile(scored, "score", contamination)[()]
    model.stats = training_stats(scored, model.offset, rows, len(features))
    return model


def training_stats(scored: DataFrame, offset: float, rows: int, features: int) -> dict:
    """What the report says of a forest: rows flagged by their scores, mean and population std of the decisions."""
    decision = F.col("score") - F.lit(offset)
    made = scored.agg(F.sum((decision < 0).cast("long")), F.avg(decision), F.stddev_pop(decision)).first()
    return {
        "status": "trained",
        "samples": rows,
        "features": features,
        "anomalies_in_training": made[0],
        "anomaly_rate": round(made[0] / rows, 4),
        "score_mean": round(made[1], 4),
        "score_std": round(made[2], 4),
    }


def _paths(x: np.ndarray, m: dict) -> np.ndarray:
    """Mean path length of each row over all trees."""
    rows, inner = len(x), 2 ** m["depth"] - 1
    flat = np.ascontiguousarray(x.T).ravel()  # column after column
    start, total = np.arange(rows), np.zeros(rows)
    at, place = np.empty(rows, dtype="int64"), np.empty(rows, dtype="int64")
    value_at, split_at, right = np.empty(rows), np.empty(rows), np.empty(rows, dtype=bool)
    for column, split, value in zip(m["feature"].astype("int64") * rows, m["split"], m["value"]):
        at[:] = 0
        for _ in range(m["depth"]):
            # All places are inside; with "clip", take writes to the given array without a copy.
            np.add(column.take(at, out=place, mode="clip"), start, out=place)
            np.greater(flat.take(place, out=value_at, mode="clip"), split.take(at, out=split_at, mode="clip"), out=right)
            at *= 2
            at += 1
            at += right
        at -= inner
        total += value.take(at, out=value_at, mode="clip")
    return total / len(m["value"])


def forest_score_samples(spark, model: ForestModel, features=None) -> Column:
    """-2^(-mean path / c) per row; lower is more anomalous. Null when a feature is null."""
    shipped = spark.sparkContext.broadcast(
        {**model.arrays(), "mean": np.array(model.mean), "std": np.array(model.std), "c": float(average_path(model.max_samples))}
    )

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        m = shipped.value
        raw = x.to_numpy(dtype="float64", na_value=np.nan)
        known = ~np.isnan(raw).any(axis=1)
        scaled = (raw - m["mean"]) / m["std"]
        mean_path = np.concatenate([_paths(scaled[i : i + 16384], m) for i in range(0, len(raw), 16384)] or [np.zeros(0)])
        return pd.Series(np.where(known, -np.power(2.0, -mean_path / m["c"]), np.nan)).where(known, None)

    # Declared nondeterministic so that a filter on the result does not evaluate it a second time.
    return score.asNondeterministic()(F.struct(*(features or model.features)))


def isolation_forest_predict(df: DataFrame, model: ForestModel | None) -> DataFrame:
    """Adds label (-1 anomaly, 1 normal) and decision score (lower is more anomalous)."""
    if model is None:
        return df.withColumn("forest_label", F.lit(None).cast("int")).withColumn("forest_decision", F.lit(None).cast("double"))
    raw = forest_score_samples(df.sparkSession, model)
    return df.withColumn("forest_decision", raw - F.lit(model.offset)).withColumn(
        "forest_label", F.when(F.col("forest_decision") < 0, -1).when(F.col("forest_decision").isNotNull(), 1)
    )


def isolation_forest_score(df: DataFrame) -> DataFrame:
    """Flag and score in 0..1 from the prediction; (false, 0) where there is none."""
    return df.withColumn("forest_flag", F.coalesce(F.col("forest_label") == -1, F.lit(False))).withColumn(
        "forest_score", F.coalesce(1 / (1 + F.exp(F.col("forest_decision"))), F.lit(0.0))
    )
