"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def held_out(column: str | Column, modulus: int, remainder: int) -> Column:
    """True where the id falls in the held-out fold; a null id is in no fold."""
    return F.coalesce(id_remainder(column, modulus) == remainder, F.lit(False))


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name that is none of the taken ones, whatever their case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared place that the cluster names in spark.checkpoint.dir; on a local master a temporary folder will do."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vecatlas-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vecatlas-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a working folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let Hadoop's file system remove a working folder when the driver ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared work folder and read it back.

    The schema is passed on the way back, so empty results keep their columns.
    """
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, key: str = "doc_id", text: str = "text", max_docs_per_class: int = 3000, max_chars_per_class: int = 5_000_000
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample of labelled texts for fitting on the driver: texts, 0/1 labels, rows of either class.

    About ``max_docs_per_class`` labels of each class are drawn by a hash of the key, and of their texts, in the order
    of that hash, as many as hold ``max_chars_per_class`` characters and the one that goes beyond it. Texts are drawn
    whole, whatever their length. Keys with contradicting labels, null keys, null labels and null texts are left out;
    repeated keys count once.
    """
    one = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where("key is not null and label in (0, 1)")
        .groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    )
    totals = np.zeros(2)
    for row in one.groupBy("label").agg(F.count("*").alias("n")).collect():
        totals[row["label"]] = row["n"]
    rate = np.minimum(1.0, max_docs_per_class / np.maximum(totals, 1))
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    drawn = one.withColumn("draw", draw).where(F.col("draw") < F.when(F.col("label") == 1, float(rate[1] * (1 << 30))).otherwise(float(rate[0] * (1 << 30))))
    before = Window.partitionBy("label").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1)  # about max_docs_per_class rows
    rows = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
        .join(F.broadcast(drawn), "key")  # at most about 2 x max_docs_per_class rows of three numbers
        .groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"), F.min("draw").alias("draw"))
        .withColumn("held", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0))).where(F.col("held") < max_chars_per_class)
        .orderBy("key")
        .select("text", "label").toArrow()
    )
    return rows.column("text").to_pylist(), np.array(rows.column("label").to_pylist(), dtype=np.int64), totals
