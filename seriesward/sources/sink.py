"""Micro-batches of a stream written to several tables, each batch once.

A batch has a folder of its own in every target, named by query and batch number; writing it replaces the folder, so an
attempt that died half way leaves nothing behind once the batch is replayed. The rows are computed once, into the first
target, and copied to the others. Then one row goes to the ledger. Readers see the batches of the ledger only, and a
batch that is in the ledger is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import exists

LEDGER = "batch long, note string, rows long"
PART = ("sink_query", "sink_batch")


def recorded(spark: SparkSession, ledger: str, query: str) -> DataFrame:
    """The ledger's rows of one query."""
    path = f"{ledger}/sink_query={query}"
    return spark.read.schema(LEDGER).parquet(path).distinct() if exists(spark, path) else spark.createDataFrame([], LEDGER)


def write_batch(rows: DataFrame, query: str, batch: int, ledger: str, *targets: str, note: str | None = None, time: str = "timestamp") -> bool:
    """Write a batch to all targets by day, unless the ledger has it. ``note`` is kept in its ledger row."""
    spark = rows.sparkSession
    if not recorded(spark, ledger, query).where(F.col("batch") == batch).isEmpty():
        return False
    rows = rows.withColumn("day", F.to_date(time))
    first, *others = [f"{t}/sink_query={query}/sink_batch={batch}" for t in targets]
    rows.repartitionByRange("day", time).write.mode("overwrite").partitionBy("day").parquet(first)
    stored = spark.read.schema(rows.schema).parquet(first)
    for path in others:
        stored.write.mode("overwrite").partitionBy("day").parquet(path)
    entry = spark.createDataFrame([(batch, note, stored.count())], LEDGER)
    entry.coalesce(1).write.mode("append").parquet(f"{ledger}/sink_query={query}")
    return True


def read_target(spark: SparkSession, target: str, ledger: str, query: str, schema: T.StructType) -> DataFrame:
    """The rows of a target whose batches are in the ledger, with the batch's number and note."""
    full = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("sink_query", T.StringType()), T.StructField("sink_batch", T.LongType())])
    known = recorded(spark, ledger, query).select(F.col("batch").alias("sink_batch"), F.col("note").alias("sink_note"))
    if not exists(spark, f"{target}/sink_query={query}"):
        return spark.createDataFrame([], full).drop("day", "sink_query").join(known, "sink_batch")
    rows = spark.read.schema(full).parquet(target).where(F.col("sink_query") == query)
    return rows.drop("day", "sink_query").join(known, "sink_batch")


def run_batches(stream: DataFrame, each, checkpoint: str, once: bool = True):
    """Call ``each(batch, number)`` for the micro-batches of a stream; with ``once``, for what it has now, to the end."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
