"""The catalogue as a table in parts, by ranges of ids, of which an update rewrites only those that it touches.

Updates come in numbered batches. A batch first writes the new contents of the parts that it touches beside the table, then puts
them in their place by dynamic partition overwrite, and then notes its number. A batch that failed on the way goes on from
what it had written when it is repeated, and one that is noted changes nothing more, even if later ones touched the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

WIDTH = 100_000  # ids of a part


def part_of(column: str, width: int) -> Column:
    return F.floor(F.col(column) / width).cast("int")


def create(df: DataFrame, path: str, *, key: str = "id", width: int = WIDTH) -> None:
    """Write ``df`` in parts of ``width`` ids. A null id has no place here."""
    placed = df.where(F.col(key).isNotNull()).withColumn("part", part_of(key, width))
    placed.repartition("part").write.partitionBy("part").parquet(f"{path}/rows")


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(StructType([*schema.fields]).add("part", IntegerType())) if schema else spark.read
    return reader.parquet(f"{path}/rows")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def applied(spark: SparkSession, path: str, batch: int) -> bool:
    return _exists(spark, f"{path}/batches/{batch}/_SUCCESS")


def apply(spark: SparkSession, path: str, results: DataFrame, batch: int, columns: dict[str, str], *, key: str = "id", width: int = WIDTH, schema: StructType | None = None) -> bool:
    """Set columns of the rows that ``results`` names; True unless the batch had been applied before.

    columns: the table's column -> the result's. A null result leaves the old value, of several results for an id the largest
    counts, and results for other ids are not used. The numbers of the parts that are touched pass through the driver: at most
    the largest id over ``width``.
    """
    if applied(spark, path, batch):
        return False
    pending = f"{path}/pending/{batch}"
    if not _exists(spark, f"{pending}/_SUCCESS"):
        rows = read(spark, path, schema)
        found = results.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("to")).agg(F.struct(*[F.max(c).alias(f"c{i}") for i, c in enumerate(columns.values())]).alias("new"))
        touched = [r[0] for r in found.select(part_of("to", width)).distinct().collect()]
        old = rows.where(F.col("part").isin(touched)).select(F.struct(*rows.columns).alias("old"))  # one column each, so that no name can clash
        joined = old.join(found, F.col("old")[key] == F.col("to"), "left")
        of = {c: F.col(f"new.c{i}") for i, c in enumerate(columns)}
        joined.select(*[(F.coalesce(of[c], F.col("old")[c]) if c in of else F.col("old")[c]).alias(c) for c in rows.columns]).write.mode("overwrite").parquet(pending)
    ready = spark.read.schema(read(spark, path, schema).schema).parquet(pending)
    ready.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/rows")
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/{batch}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pending)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return True
