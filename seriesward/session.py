"""Session helpers: reliable materialisation and limits."""

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import params

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names, else a private one on a local master."""
    configured = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="seriesward-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, on storage that all executors share."""
    return f"{checkpoint_dir(spark)}/seriesward/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a parquet table in the shared folder. Unlike a plain
    checkpoint it is compressed, readers prune columns, and its size is known to the optimizer."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends rows to the workers in Arrow batches of about ``BATCH_BYTES``, unless the session names a
    limit of its own. Spark's is 64 MB, which the JVM holds for each task, and each worker for two batches."""
    if ARROW_BYTES in spark.conf.getAll:
        yield
        return
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES)


def rows_per_task(spark: SparkSession, override: int | None = None) -> int:
    if override:
        return int(override)
    return int(spark.conf.get(params.ROWS_PER_TASK_CONF, str(params.ROWS_PER_TASK)))


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, on whatever file system."""
    system, place = _located(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    system, place = _located(spark, path)
    system.delete(place, True)
