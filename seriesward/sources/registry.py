"""Versions of the models, with a pointer that moves in one step.

A version is a folder of its own, written first and never changed, and then one commit row, a table of one file. Readers
follow committed rows only: what a killed job has half written is never loaded, and a reader never mixes two models. The
commit row also carries the training results (the model runs), so that a run is recorded if and only if its models are.
A version is named by the model's time; a second attempt at a committed one adds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import ForestModel
from ..operators.sequence import SequenceModel
from ..session import exists
from . import store

COMMIT = "version string, path string, valid_from timestamp, forest boolean, sequence boolean, states map<string,map<string,string>>"
LATEST_RUN = "latest_training"


@dataclass
class Version:
    name: str
    forest: ForestModel | None
    sequence: SequenceModel | None


def version_of(at) -> str:
    return pd.Timestamp(at).strftime("%Y%m%dT%H%M%S%f")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed version. Of two jobs that committed one version at a time, the smaller path counts."""
    if not exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], COMMIT)
    rows = spark.read.schema(COMMIT).parquet(f"{root}/commits")
    return rows.groupBy("version").agg(F.min_by(F.struct(*rows.columns), "path").alias("r")).select("r.*")


def commit(spark: SparkSession, root: str, forest: ForestModel | None, sequence: SequenceModel | None, report: dict, at) -> str:
    """Write a version and commit it; returns its name. ``report``: training results by model."""
    version = version_of(at)
    if not committed(spark, root).where(F.col("version") == version).isEmpty():
        return version
    path = f"{root}/versions/{version}-{uuid.uuid4().hex}"
    if forest is not None:
        store.save_forest(spark, forest, f"{path}/forest")
    if sequence is not None:
        store.save_sequence(spark, sequence, f"{path}/sequence")
    states = {name: {k: str(v) for k, v in state.items()} for name, state in report.items()}
    states[LATEST_RUN] = {name: state.get("status", "") for name, state in states.items()}
    row = [(version, path, pd.Timestamp(at).to_pydatetime(), forest is not None, sequence is not None, states)]
    spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def latest(spark: SparkSession, root: str, at=None):
    """The commit row of the newest version, or of the newest that was valid at a time; None without one."""
    rows = committed(spark, root)
    if at is not None:
        rows = rows.where(F.col("valid_from") <= F.lit(at).cast("timestamp"))
    return rows.orderBy(F.desc("valid_from")).first()


def load(spark: SparkSession, root: str, at=None) -> Version | None:
    row = latest(spark, root, at)
    if row is None:
        return None
    forest = store.load_forest(spark, f"{row.path}/forest") if row.forest else None
    return Version(row.version, forest, store.load_sequence(spark, f"{row.path}/sequence") if row.sequence else None)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Model runs (name, ts, state) as ``store.retrain_due`` and ``store.get_model_state`` read them."""
    return committed(spark, root).select(F.col("valid_from").alias("ts"), F.explode("states").alias("name", "state")).select("name", "ts", "state")
