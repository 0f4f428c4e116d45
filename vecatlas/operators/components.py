"""Principal components of the catalogue's vectors, at once or from moments that are kept up to date."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.functions import scalars
from vecatlas.operators.catalogue import eligible

GUARD = 1e-12


def _signed(found: np.ndarray) -> np.ndarray:
    """Unit components, each with its largest entry positive."""
    found = found / (np.linalg.norm(found, axis=1, keepdims=True) + GUARD)
    largest = found[np.arange(len(found)), np.abs(found).argmax(axis=1)]
    return found * np.where(largest < 0, -1.0, 1.0)[:, None]


def fit(artworks: DataFrame, k: int = 4) -> dict:
    """Unit components (each with its largest entry positive), their shares of the variance, and the numbers of rows and dimensions.

    The covariance is summed by the executors; only d x d numbers reach the driver.
    """
    rows = artworks.where(eligible()).select(F.transform("imgVec", lambda x: x.cast("double")).alias("v"))
    scaled = rows.withColumn("n", scalars.norm(F.col("v")) + GUARD).select(F.transform("v", lambda x: x / F.col("n")).alias("v"))
    vectors = scaled.select(array_to_vector("v").alias("v")).persist(StorageLevel.MEMORY_AND_DISK)  # read once, passed over several times
    try:
        n = vectors.count()
        model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    finally:
        vectors.unpersist()
    found = _signed(np.asarray(model.pc.toArray()).T)
    return {"basis": found.tolist(), "explained_variance_ratio": model.explainedVariance.toArray().tolist(), "n_samples": n, "n_components": k, "embedding_dim": found.shape[1]}


def as_table(spark, fitted: dict) -> DataFrame:
    rows = [(i + 1, [float(x) for x in v], float(e)) for i, (v, e) in enumerate(zip(fitted["basis"], fitted["explained_variance_ratio"], strict=True))]
    return spark.createDataFrame(rows, "component int, vec array<double>, evr double")


# Moments that can be merged: a fit from the sums of all rows seen so far, brought up to date from new rows alone

STATE = "i int, n long, total double, products array<double>"


def _summed(table: pa.Table) -> pa.Table:
    """The sum of the rows of one dimension."""
    products = np.stack([np.asarray(v) for v in table.column("products").to_pylist()]).sum(axis=0)
    n, total = (table.column(c).to_numpy().sum() for c in ("n", "total"))
    return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "total": [total], "products": pa.array([products], pa.list_(pa.float64()))})


def merged(states: DataFrame) -> DataFrame:
    """One state of several: a row for each dimension. Sums are made in two steps, so that a task meets few rows of a dimension."""
    some = states.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).applyInArrow(_summed, STATE)
    return some.groupBy("i").applyInArrow(_summed, STATE)


def moments(artworks: DataFrame, dimension: int) -> DataFrame:
    """The state of the eligible rows: for each dimension i (from 0) the number of rows, the sum of the unit vectors' entries, and
    the sums of their products with each other entry. Each task sends ``dimension`` rows, whatever it has read."""

    def run(batches):
        n, total, products = 0, np.zeros(dimension), np.zeros((dimension, dimension))
        for batch in batches:
            lists = batch.column(0)
            if (lists.value_lengths().to_numpy(zero_copy_only=False) != dimension).any():
                raise ValueError(f"a vector has not {dimension} dimensions")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + GUARD)
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array(np.full(dimension, n)), pa.array(total), pa.array(list(products), pa.list_(pa.float64()))], names=["i", "n", "total", "products"])

    return merged(artworks.where(eligible()).select("imgVec").mapInArrow(run, STATE))


def update(path: str, batch: int, new: DataFrame, dimension: int) -> None:
    """Add new rows to the state at ``path``, reading nothing else. A batch that is repeated replaces itself."""
    moments(new, dimension).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def state_at(spark: SparkSession, path: str) -> DataFrame:
    """The state of all batches at ``path``."""
    return merged(spark.read.schema(STATE).parquet(path).select("i", "n", "total", "products"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The state of all batches as the first batch of another place."""
    state_at(spark, path).write.mode("overwrite").parquet(f"{to}/batch=0")


def fit_state(state: DataFrame, k: int = 4) -> dict:
    """What ``fit`` gives, from a state: dimension x dimension numbers reach the driver."""
    rows = state.orderBy("i").collect()
    if not rows or rows[0]["n"] < 2:
        raise ValueError("components need two rows or more")
    n, mean = rows[0]["n"], np.array([r["total"] for r in rows]) / rows[0]["n"]
    covariance = (np.array([r["products"] for r in rows]) - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(covariance)
    found = _signed(vectors.T[::-1][:k])
    return {"basis": found.tolist(), "explained_variance_ratio": (values[::-1][:k] / values.sum()).tolist(), "n_samples": int(n), "n_components": k, "embedding_dim": len(mean)}
