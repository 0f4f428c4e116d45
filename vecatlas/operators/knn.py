"""Exact nearest items by cosine similarity, for one query or a few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions import scalars
from vecatlas.operators.catalogue import Response, eligible, image_source, image_url, target, without


def with_similarity(df: DataFrame, vector, name: str = "similarity") -> DataFrame:
    """Add the cosine similarity to one vector, within the JVM. Zero vectors, and vectors of another dimension, have none."""
    v = [float(x) for x in vector]
    own = F.col("imgVec")
    length = float(np.sqrt(np.square(np.asarray(v)).sum()))
    score = F.try_divide(scalars.dot(own, scalars.literal_vector(v)), scalars.norm(own) * F.lit(length))
    return df.withColumn(name, F.when(F.size(own) == len(v), score)).where(F.col(name).isNotNull())


def nearest(df: DataFrame, vector, k: int) -> DataFrame:
    """The k rows most similar to ``vector`` (ties by id): a top-k in each task, then of those."""
    return with_similarity(df, vector).orderBy(F.desc("similarity"), "id").limit(k)


def similar(artworks: DataFrame, item: int, k: int = 160) -> Response:
    """The eligible items most similar to an item, itself first."""
    of = target(artworks, item)
    rows = nearest(artworks.where(eligible()), of["imgVec"], k)
    data = rows.select(
        "id", "objectId", "title", "artist", image_url().alias("imageUrl"), F.col("primaryImage").alias("originalImageUrl"), image_source().alias("imageSource"), (F.col("id") == item).alias("original"), "similarity"
    )
    return Response(data, {"targetId": item, "targetTitle": of["title"], "targetArtist": of["artist"]})


def nearest_without(artworks: DataFrame, item: int, k: int, excluded, *, after: bool) -> DataFrame:
    """Nearest items but the target and the excluded: left out before the top-k, or after it (then fewer may be left)."""
    of = target(artworks, item)
    rows = artworks.where(eligible() & (F.col("id") != item))
    if after:
        return without(nearest(rows, of["imgVec"], k), excluded).select("id", "similarity")
    return nearest(without(rows, excluded), of["imgVec"], k).select("id", "similarity")


def nearest_of_many(df: DataFrame, queries: list, limits: list[int], id_column: str = "id", vector_column: str = "imgVec") -> DataFrame:
    """``query`` (its place in the list), id, similarity, rank: the best rows for each of a few query vectors.

    One scan scores the rows against all queries in numpy and keeps each query's best of the task; a window over
    what is left gives the final ranks. Rows of another dimension and zero vectors are left out.
    """
    wanted = np.asarray(queries, dtype=np.float64)
    lengths = np.linalg.norm(wanted, axis=1, keepdims=True)
    wanted = wanted / np.where(lengths == 0, 1, lengths)

    def score(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in limits]
        for batch in batches:
            lists = batch.column(1)
            use = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == wanted.shape[1])
            if not len(use):
                continue
            rows = lists.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(use), -1)
            norms = np.linalg.norm(rows, axis=1)
            use, rows, norms = use[norms > 0], rows[norms > 0], norms[norms > 0]
            number = batch.column(0).to_numpy(zero_copy_only=False)[use]
            for q, limit in enumerate(limits):
                ids, s = np.concatenate([best[q][0], number]), np.concatenate([best[q][1], rows @ wanted[q] / norms])
                top = np.lexsort((ids, -s))[:limit]
                best[q] = ids[top], s[top]
        for q, (ids, s) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, pa.int64()), pa.array(s)], names=["query", "id", "similarity"])

    scored = df.select(F.col(id_column).cast("bigint").alias("id"), vector_column).mapInArrow(score, "query int, id bigint, similarity double")
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("query") + 1) if len(set(limits)) > 1 else F.lit(limits[0])
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= max(limits))
    return ranked.where(F.col("rank") <= limit)


def above(rows: DataFrame, threshold: float = 0.3, column: str = "similarity") -> DataFrame:
    return rows.where(F.col(column) >= threshold)


def search(artworks: DataFrame, text: str, encode, k: int = 50, threshold: float = 0.3) -> DataFrame:
    """Items whose vectors are near the vector that ``encode`` gives for a text."""
    rows = above(nearest(artworks.where(eligible()), encode(text), k), threshold)
    return rows.select("id", "title", "artist", image_url().alias("imageUrl"), "similarity", F.lit("semantic similarity").alias("matchReason"))
