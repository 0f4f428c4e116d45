"""The catalogue table: its schema, checks on load, and the view of it over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, StringType, StructField, StructType, TimestampType

# The catalogue's columns, and the longest text that each bounded column takes.
SCHEMA = StructType([
    StructField("id", IntegerType(), False),
    StructField("objectId", IntegerType(), False),
    StructField("title", StringType()),
    StructField("artist", StringType()),
    StructField("date", StringType()),
    StructField("medium", StringType()),
    StructField("primaryImage", StringType()),
    StructField("localImageUrl", StringType()),
    StructField("imgVec", ArrayType(FloatType())),
    StructField("department", StringType()),
    StructField("culture", StringType()),
    StructField("createdAt", TimestampType()),
    StructField("additionalImages", StringType()),
    StructField("objectUrl", StringType()),
    StructField("isHighlight", BooleanType()),
    StructField("artistDisplayBio", StringType()),
    StructField("objectBeginDate", IntegerType()),
    StructField("objectEndDate", IntegerType()),
    StructField("creditLine", StringType()),
    StructField("classification", StringType()),
    StructField("artistNationality", StringType()),
    StructField("primaryImageSmall", StringType()),
    StructField("description", StringType()),
    StructField("importedAt", TimestampType(), False),
])
LONGEST = {
    "date": 200, "primaryImage": 1000, "localImageUrl": 1000, "department": 300, "culture": 300,
    "objectUrl": 1000, "classification": 500, "artistNationality": 500, "primaryImageSmall": 1000,
}


def conform(df: DataFrame) -> DataFrame:
    """``df`` in the catalogue's schema: missing columns are null (importedAt: now), types are cast, others dropped."""
    have = set(df.columns)
    columns = []
    for f in SCHEMA:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name == "importedAt":
            c = F.coalesce(c, F.current_timestamp())
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue from Parquet; files that lack later columns read as null there."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path))


def violations(df: DataFrame, dimension: int | None = None) -> DataFrame:
    """One row per broken rule: rule, n. Rules: id unique and not null, texts not too long, vectors of one dimension."""
    checks = {f"{c} longer than {n}": F.count_if(F.length(c) > n) for c, n in LONGEST.items()}
    checks["id is null"] = F.count_if(F.col("id").isNull())
    if dimension is not None:
        checks[f"imgVec not of dimension {dimension}"] = F.count_if(F.size("imgVec") != dimension)
    one = df.agg(*[c.alias(k) for k, c in checks.items()])
    listed = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in checks])).alias("x")).select("x.*")
    repeated = df.groupBy("id").count().where("count > 1 and id is not null").agg(F.count("*").alias("n")).select(F.lit("id repeated").alias("rule"), "n")
    return listed.unionByName(repeated).where("n > 0")


def from_test_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue derived from the test tables: vectors of ``embeddings``, names of ``part`` and ``supplier``."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = read("part").where("p_partkey < 200").select("p_partkey", "p_name", "p_type", "p_brand")  # 200 rows
    suppliers = read("supplier").where("s_suppkey < 10").select("s_suppkey", "s_name")  # 10 rows
    e = read("embeddings").select("vec_id", "embedding")
    joined = e.join(F.broadcast(parts), F.col("p_partkey") == F.col("vec_id") % 200, "left").join(F.broadcast(suppliers), F.col("s_suppkey") == F.col("vec_id") % 10, "left")
    i, number = F.col("vec_id"), (F.col("vec_id") + 1).cast("string")
    return conform(joined.select(
        (i + 1).cast("int").alias("id"), (i + 100000).cast("int").alias("objectId"), F.col("p_name").alias("title"), F.col("s_name").alias("artist"),
        F.col("p_type").alias("department"), F.col("p_brand").alias("classification"),
        F.when(i % 7 == 0, None).when(i % 11 == 0, "").otherwise(F.concat(F.lit("https://img.example.org/artworks/"), number, F.lit(".jpg"))).alias("localImageUrl"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, "").otherwise(F.concat(F.lit("https://museum.example.org/o/"), number)).alias("primaryImage"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, None).otherwise(F.concat(F.lit("https://museum.example.org/s/"), number)).alias("primaryImageSmall"),
        F.when(i % 13 == 0, None).otherwise(F.col("embedding")).alias("imgVec"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("importedAt"),
    ))


#: The same view as a DuckDB common table expression.
CTE = """artworks AS (
  SELECT CAST(e.vec_id + 1 AS INTEGER) AS id, CAST(e.vec_id + 100000 AS INTEGER) AS objectId, p.p_name AS title, s.s_name AS artist,
    p.p_type AS department, p.p_brand AS classification, CAST(NULL AS VARCHAR) AS "date", CAST(NULL AS VARCHAR) AS creditLine,
    CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS objectUrl,
    CASE WHEN e.vec_id % 7 = 0 THEN NULL WHEN e.vec_id % 11 = 0 THEN '' ELSE concat('https://img.example.org/artworks/', e.vec_id + 1, '.jpg') END AS localImageUrl,
    CASE WHEN e.vec_id % 5 = 0 THEN NULL WHEN e.vec_id % 5 = 1 THEN '' ELSE concat('https://museum.example.org/o/', e.vec_id + 1) END AS primaryImage,
    CASE WHEN e.vec_id % 3 = 0 THEN '' WHEN e.vec_id % 3 = 1 THEN NULL ELSE concat('https://museum.example.org/s/', e.vec_id + 1) END AS primaryImageSmall,
    CASE WHEN e.vec_id % 13 = 0 THEN NULL ELSE CAST(e.embedding AS DOUBLE[]) END AS imgVec
  FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id % 200 LEFT JOIN supplier s ON s.s_suppkey = e.vec_id % 10
)"""
