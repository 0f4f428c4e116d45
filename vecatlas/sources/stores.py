"""Connectors: JDBC, the PCA basis as JSON, vectors as text, and a connection probe."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.sources.artworks import conform


def read_jdbc(spark: SparkSession, url: str, table: str, *, partitions: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """The catalogue from a database; with ``bounds`` of the id it is read by ``partitions`` tasks. Vectors come as text."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds:
        reader = reader.options(partitionColumn="id", lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    df = reader.load()
    if dict(df.dtypes).get("imgVec") == "string":
        df = df.withColumn("imgVec", vector_from_text("imgVec"))
    return conform(df)


def vector_from_text(column: str | Column) -> Column:
    """``[a,b,...]`` as an array of floats; null for null and for what isn't all numbers."""
    c = F.col(column) if isinstance(column, str) else column
    parts = F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("float"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def vector_to_text(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def write_basis(spark: SparkSession, path: str, basis: list[list[float]], explained: list[float], n_samples: int) -> None:
    """The basis document (k x d numbers), written by Spark, so to any file system that it knows."""
    doc = {"basis": basis, "explained_variance_ratio": explained, "n_samples": n_samples, "n_components": len(basis), "embedding_dim": len(basis[0]) if basis else 0}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_basis(spark: SparkSession, path: str) -> list[list[float]]:
    """The rows of a basis document, each scaled to length one; at least two of one dimension are needed."""
    row = spark.read.option("multiLine", True).schema("basis array<array<double>>").json(path).first()
    rows = [list(r) for r in (row["basis"] if row and row["basis"] else [])]
    if len(rows) < 2 or len({len(r) for r in rows}) != 1:
        raise ValueError("a basis has two rows or more, all of one dimension")
    return [[x / (math.sqrt(sum(v * v for v in r)) or 1.0) for x in r] for r in rows]


def ping(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT current_timestamp() AS current_time")
