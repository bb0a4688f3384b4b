"""Training of all models and the guard of the periodic job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.scalars import finite
from ..operators.features import extract_features
from ..operators.forest import ForestModel, isolation_forest_fit
from ..operators.sequence import sequence_fit
from ..operators.series import arrange
from ..session import materialise
from ..sources import registry, store


def forest_training_rows(metrics: DataFrame, limit: int | None = None) -> DataFrame:
    """Feature vectors of every series row that has one, with the row's identity."""
    rows = metrics.select(*params.KEY, *params.ORDER, "value")
    sf = extract_features(arrange(rows, frame=params.MIN_POINTS, limit=limit))
    return sf.rows(keep_position=True).where(F.col("_pos") >= params.MIN_POINTS).drop("_pos", "value")


def train_forest(metrics: DataFrame, limit: int | None = None, **options) -> ForestModel | dict:
    """Fit on the feature vectors. Their number follows from the series lengths, a scan without the
    windows."""
    per_series = metrics.where(finite(F.col("value"))).groupBy(*params.KEY).count()
    vectors = F.greatest(F.col("count") - (params.MIN_POINTS - 1), F.lit(0))
    rows = per_series.agg(F.sum(vectors)).first()[0] or 0
    # Laid out once: the fit reads them for the samples and for the scores.
    return isolation_forest_fit(
        materialise(forest_training_rows(metrics, limit)), identity=(*params.KEY, *params.ORDER), rows=rows, **options
    )


def train_all(metrics: DataFrame, limit: int | None = None, trees: int = params.FOREST_TREES) -> tuple:
    """Fit the forest and the sequence models. Returns forest, sequence model and a report per model;
    the report of an empty input has the single status ``no_data``."""
    if metrics.isEmpty():
        return None, None, {"status": {"status": "no_data"}}
    forest = train_forest(metrics, limit, trees=trees)
    sequence = sequence_fit(metrics, limit=limit)
    results = {"isolation_forest": forest.stats if isinstance(forest, ForestModel) else forest}
    results |= {f"lstm_{kind}": sequence.stats[kind] for kind in params.METRIC_TYPES}
    return (forest if isinstance(forest, ForestModel) else None), sequence, results


def retrain(
    metrics: DataFrame,
    root: str,
    now,
    every: int = params.RETRAIN_HOURS,
    retention: int = params.RETENTION_HOURS,
    limit: int | None = None,
    trees: int = params.FOREST_TREES,
) -> str | None:
    """The periodic job: if the last run is ``every`` hours old, or has no forest, train on the last ``retention`` hours
    before ``now`` and commit the models with their run rows as one version. Returns the version, or None if nothing was
    due or there was nothing to train on."""
    spark = metrics.sparkSession
    last = registry.latest(spark, root, now)
    if last is not None and last.forest and not store.should_retrain(registry.runs(spark, root), now, registry.LATEST_RUN, every):
        return None
    history = store.training_history(metrics, retention, now).where(F.col("timestamp") <= F.lit(now).cast("timestamp"))
    forest, sequence, report = train_all(history, limit, trees)
    if sequence is None:
        return None
    return registry.commit(spark, root, forest, sequence, report, now)
