"""The ensemble: votes, severity, description, and the composed detection query."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.scalars import decimals, determine_severity, stable_id
from .features import drop_rolling, feature_columns, feature_window, sequence_window
from .forest import ForestModel, isolation_forest_predict, isolation_forest_score
from .sequence import SequenceModel, sequence_predict
from .series import arrange
from .stats import expected_range, quartile_window, running_stats, statistical_check


def ensemble_vote(df: DataFrame, threshold: float = params.ANOMALY_THRESHOLD) -> DataFrame:
    """Weighted score and decision: a high score, or two detectors that agree."""
    score = (
        params.STAT_WEIGHT * F.col("stat_score")
        + params.FOREST_WEIGHT * F.col("forest_score")
        + params.SEQUENCE_WEIGHT * F.col("sequence_score")
    )
    votes = F.col("stat_flag").cast("int") + F.col("forest_flag").cast("int") + F.col("sequence_flag").cast("int")
    return (
        df.withColumn("ensemble_score", score)
        .withColumn("votes", votes)
        .withColumn("is_anomaly", (score >= threshold) | (votes >= params.VOTES))
        .withColumn("anomaly_score", F.round("ensemble_score", 4))
    )


def describe_anomaly(df: DataFrame) -> DataFrame:
    """The text of an anomaly, from the columns of a voted row with its severity."""
    fired = F.array_compact(
        F.array(
            F.when(F.col("stat_flag"), "statistical"),
            F.when(F.col("forest_flag"), "isolation_forest"),
            F.when(F.col("sequence_flag"), "lstm"),
        )
    )
    def shown(name, places):
        # Without the last bits, so that the text does not depend on the order of a sum.
        return decimals(F.round(name, 6), places)

    text = F.concat(
        F.upper("severity"), F.lit(" anomaly detected on "), F.col("host"),
        F.lit(" for "), F.col("metric_type"),
        F.lit(". Current value: "), decimals(F.col("value"), 2),
        F.lit(", Expected: "), shown("mean", 2), F.lit(" ± "), shown("std", 2),
        F.lit(". Detected by: "), F.concat_ws(", ", fired),
        F.lit(". Scores: statistical="), shown("stat_score", 3),
        F.lit(", isolation_forest="), shown("forest_score", 3),
        F.lit(", lstm="), shown("sequence_score", 3), F.lit("."),
    )
    return df.withColumn("description", text)


def score_metrics(
    metrics: DataFrame,
    forest: ForestModel | None = None,
    sequence: SequenceModel | None = None,
    iqr_warmup: str = "zero",
    limit: int | None = None,
) -> DataFrame:
    """Every metric row with statistics, the three checks and the vote."""
    windows = [quartile_window()]
    if forest is not None:
        windows.append(feature_window(tuple("f_" + n for n in params.FEATURES)))
    if sequence is not None:
        windows.append(sequence_window(params.MIN_POINTS))
    sf = running_stats(arrange(metrics.select(*METRIC_COLUMNS), limit=limit)).trailing(*windows)
    return score_rows(sf.rows(), forest, sequence, iqr_warmup)


METRIC_COLUMNS = ("metric_id", "metric_type", "value", "timestamp", "host", "service")


def with_vectors(df: DataFrame, forest, sequence) -> DataFrame:
    """Replace the rolling columns by the inputs of the models that are present."""
    enough = F.col("_pos") >= params.MIN_POINTS
    if forest is not None:
        df = df.select("*", *[F.when(enough, c).alias("f_" + n) for n, c in feature_columns().items()])
    if sequence is not None:
        df = df.withColumn("sequence", F.when(enough, F.col("_recent")))
    return drop_rolling(df)


def score_rows(df: DataFrame, forest=None, sequence=None, iqr_warmup: str = "zero") -> DataFrame:
    """The checks and the vote on rows that carry running statistics, quartiles and model inputs."""
    df = statistical_check(df, iqr_warmup)
    vector = forest and replace(forest, features=tuple("f_" + n for n in forest.features))
    df = isolation_forest_score(isolation_forest_predict(df, vector)).drop(*["f_" + n for n in params.FEATURES])
    return ensemble_vote(sequence_predict(df, sequence).drop("sequence", "_pos"))


def anomalies_of(scored: DataFrame, flag: str = "is_anomaly", score: str = "ensemble_score") -> DataFrame:
    """Anomaly rows of the flagged metrics, stamped with the metric's time."""
    hit = expected_range(scored.where(F.col(flag)))
    hit = hit.withColumn("severity", determine_severity(F.col("metric_type"), F.col("value"), F.col(score)))
    return describe_anomaly(hit).select(
        stable_id(F.lit("anomaly"), "metric_id").alias("anomaly_id"),
        "metric_type",
        "value",
        "expected_range",
        F.round(score, 4).alias("anomaly_score"),
        "severity",
        "timestamp",
        "host",
        "service",
        F.lit("ensemble" if flag == "is_anomaly" else "statistical").alias("model_used"),
        "description",
        "metric_id",
    )


def detect_batch(
    metrics: DataFrame,
    forest: ForestModel | None = None,
    sequence: SequenceModel | None = None,
    iqr_warmup: str = "zero",
    limit: int | None = None,
) -> DataFrame:
    """Anomalies of many metric rows."""
    return anomalies_of(score_metrics(metrics, forest, sequence, iqr_warmup, limit))
