"""Streams: the embedding queue as a resumable job, and telemetry by window (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.operators.ingest import embed
from vecatlas.sources import parts
from vecatlas.sources.artworks import SCHEMA


def embedding_job(spark: SparkSession, catalogue: str, results: str, checkpoint: str, encode: Callable, *, files_per_batch: int = 1):
    """Embed what new catalogue files hold and append to ``results``; a rerun starts where the last one stopped.

    Each micro-batch is written under its number, so a batch that is repeated after a failure replaces itself.
    """
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(catalogue)
    open_ = rows.where((F.col("localImageUrl") != "") & F.col("imgVec").isNull()).select("id", "localImageUrl")

    def commit(batch: DataFrame, number: int) -> None:
        embed(batch, encode).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return open_.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embedding_into_parts(spark: SparkSession, catalogue: str, table: str, checkpoint: str, encode: Callable, *, width: int = parts.WIDTH, files_per_batch: int = 1):
    """Embed what new catalogue files hold and set the vectors in a table in parts; each micro-batch is one of its numbered batches, so
    one that is repeated after a failure changes nothing twice, and parts that it doesn't touch stay as they are."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(catalogue)
    open_ = rows.where((F.col("localImageUrl") != "") & F.col("imgVec").isNull()).select("id", "localImageUrl")

    def commit(batch: DataFrame, number: int) -> None:
        parts.apply(batch.sparkSession, table, embed(batch, encode).where("ok"), number, {"imgVec": "vector"}, width=width, schema=SCHEMA)

    return open_.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def telemetry_by_window(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events, mean and largest value by type and window of event time; windows close ``late`` after their end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("largest")).select(
        F.col("window.start").alias("start"), "event_type", "n", "mean", "largest"
    )
