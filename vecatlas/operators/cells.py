"""Cells of the unit sphere: centroids fitted by Spark, the nearest cells of vectors, and vectors of an Arrow batch as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.functions import scalars

SAMPLE = 256  # rows for each cell that centroids are fitted on, about
MOST_CELLS = 16_384


def unit_matrix(lists: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have this dimension and aren't zero, and these scaled to length one."""
    use = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimension)
    rows = lists.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(use), dimension)
    norms = np.linalg.norm(rows, axis=1)
    good = norms > 0
    return use[good], rows[good] / norms[good, None]


def drawn(rows: DataFrame, id_column: str, share: float) -> DataFrame:
    """About this share of the rows, by a hash of the id."""
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < int(share * (1 << 30)))


def usual_number(n: int) -> int:
    """Cells for n rows: the square root, MOST_CELLS at most."""
    return max(1, min(MOST_CELLS, round(n**0.5)))


def fit(rows: DataFrame, n: int, dimension: int, cells: int, *, id_column: str = "id", vector: str = "imgVec", seed: int = 7) -> np.ndarray:
    """Centroids by distributed k-means over the unit vectors of at most about SAMPLE x ``cells`` rows."""
    some = drawn(rows.where((F.size(vector) == dimension) & F.exists(vector, lambda x: x != 0)), id_column, SAMPLE * cells / max(1, n))
    units = some.select(array_to_vector(scalars.unit(F.transform(vector, lambda x: x.cast("double")))).alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if cells == 1 or units.isEmpty():
            return np.zeros((1, dimension))
        return np.array(KMeans(k=cells, maxIter=8, seed=seed).fit(units).clusterCenters())
    finally:
        units.unpersist()


def distances(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row for each vector."""
    squares = 1.0 - 2.0 * (units @ centroids.T) + np.square(centroids).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0.0))
