"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.common import delete, work_dir, written


def _ranked(edges: DataFrame) -> DataFrame:
    """The edges of each a without repeats, in order of b: ``least`` is its least b, ``before`` is null at that one only."""
    order = Window.partitionBy("a").orderBy("b", F.col("moved").desc())  # of repeats one that has moved stays
    ranked = edges.select("a", "b", "moved", F.first("b").over(order).alias("least"), F.lag("b").over(order).alias("before"))
    return ranked.where("before is null or before <> b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = _ranked(both.withColumn("moved", F.lit(False)))
    return ranked.where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"), (F.col("least") < F.col("a")).alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges whose b is less than their a."""
    first = F.col("before").isNull()
    return _ranked(edges).select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"), (F.col("moved") | ~first).alias("moved"))


def labels(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns a, b; any sortable type) but the roots: root is the least
    node that it is connected to. Loops and repeated edges change nothing; no edge gives no row.

    Each round deals the edges out twice, is written to the shared folder and removed after the next; the rounds end
    when no edge has moved: then each node but the roots has one edge, to its root. A round never adds edges. The
    edges of one node meet in one task.
    """
    spark = edges.sparkSession
    path, stars = None, edges.where("a <> b")
    while True:
        old, path = path, work_dir(spark)
        stars = written(_small_star(_large_star(stars)), path)
        moved = stars.agg(F.max("moved")).first()[0]
        if old:
            delete(spark, old)
        if not moved:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` but those that have loops only, as ``labels`` has them, the roots included."""
    found = labels(edges)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
