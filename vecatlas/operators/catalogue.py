"""Filters, projections, samples, lists and work queues of the catalogue."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


# The image addresses in order of preference, and the tag of each.
IMAGE_TAGS = {"localImageUrl": "s3", "primaryImageSmall": "met_small", "primaryImage": "met_original"}


class TargetNotFound(LookupError):
    """The item doesn't exist, or isn't eligible."""


@dataclass(frozen=True)
class Response:
    """What a request returns: rows as a DataFrame and facts about the request."""

    data: DataFrame
    meta: dict

    def as_json(self) -> DataFrame:
        """The rows as JSON text."""
        return self.data.select(F.to_json(F.struct(*self.data.columns)).alias("json"))

    def fetched(self) -> tuple[list, dict]:
        """The rows of a request, which its limits bound, and its facts with their number and the milliseconds that they took."""
        start = time.perf_counter()
        rows = self.data.collect()
        return rows, self.meta | {"totalItems": len(rows), "processingTime": round(1000 * (time.perf_counter() - start))}


def eligible() -> Column:
    """A vector and a stored image."""
    return F.col("imgVec").isNotNull() & F.col("localImageUrl").isNotNull() & (F.col("localImageUrl") != "")


def image_url() -> Column:
    """The first image address that is neither null nor empty: stored, small, original."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in IMAGE_TAGS])


def image_source() -> Column:
    return F.coalesce(*[F.when(F.col(c) != "", tag) for c, tag in IMAGE_TAGS.items()])


def clamp(value: Column, default: int, low: int, high: int) -> Column:
    """A request's number: unparseable, null and 0 take the default, others are clamped."""
    n = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.least(F.greatest(F.coalesce(F.nullif(n, F.lit(0)), F.lit(default)), F.lit(low)), F.lit(high))


def leading_integer(value) -> int | None:
    """The integer that a value's text starts with, after white space."""
    found = re.match(r"\s*([+-]?[0-9]+)", "" if value is None else str(value))
    return int(found[1]) if found else None


def clamped(value, default: int, low: int, high: int) -> int:
    """``clamp`` for one value on the driver."""
    return min(high, max(low, leading_integer(value) or default))


def id_list(text: str | None) -> list[int]:
    """The integers that the parts of a comma list start with; parts that start with none are dropped."""
    return [n for n in map(leading_integer, (text or "").split(",")) if n is not None]


def without(df: DataFrame, ids, column: str = "id", most_listed: int = 1000) -> DataFrame:
    """Rows whose id isn't among ``ids`` (a list or a DataFrame with that column): a filter for a short list, an anti join else."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column).distinct(), column, "left_anti")
    ids = sorted({i for i in ids if isinstance(i, int) and not isinstance(i, bool)})
    if len(ids) <= most_listed:
        return df.where(~F.col(column).isin(ids)) if ids else df
    kind = StructType([StructField(column, IntegerType())])
    return df.join(df.sparkSession.createDataFrame([(i,) for i in ids], kind), column, "left_anti")


def target(artworks: DataFrame, item: int) -> dict:
    """The eligible item of this id."""
    return targets(artworks, [item])[0]


def targets(artworks: DataFrame, items: list[int], most: int = 100) -> list[dict]:
    """The eligible items of a few ids, in the order asked for, by one job."""
    if len(items) > most or not all(isinstance(i, int) and i > 0 for i in items):
        raise ValueError(f"item ids are positive integers, {most} at most")
    rows = artworks.where(F.col("id").isin(items) & eligible()).select("id", "title", "artist", "imgVec").dropDuplicates(["id"]).collect()
    found = {r["id"]: r.asDict() for r in rows}
    for i in items:
        if i not in found:
            raise TargetNotFound(f"no eligible item {i}")
    return [found[i] for i in items]


def random_key(seed: Column | int) -> Column:
    """The order of a seeded sample: it depends on id and seed alone, not on partitions or scan order."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), s.cast("string")).cast("binary"))


def random_sample(artworks: DataFrame, seed: int, count: int = 5) -> Response:
    """A seeded sample of eligible items."""
    count = clamped(count, 5, 1, 500)
    picked = artworks.where(eligible()).orderBy(random_key(seed), "id").limit(count)
    data = picked.select(
        "id", "objectId", "title", "artist", "date", "department", "creditLine", "description", image_url().alias("imageUrl"),
        F.col("primaryImage").alias("originalImageUrl"), image_source().alias("imageSource"), "objectUrl", F.lit(True).alias("hasEmbedding"),
    )
    return Response(data, {"seed": seed, "count": count})


def first_items(artworks: DataFrame, count: int = 10) -> DataFrame:
    return artworks.orderBy("id").limit(count)


def download_queue(artworks: DataFrame, count: int | None = 10_000) -> DataFrame:
    """Items with an original image that isn't stored yet, the first ``count`` by id (None: all, in no order)."""
    open_ = (F.col("primaryImage") != "") & (F.col("localImageUrl").isNull() | (F.col("localImageUrl") == ""))
    queue = artworks.where(open_).select("id", "primaryImage")
    return queue if count is None else queue.orderBy("id").limit(count)


def embedding_queue(artworks: DataFrame, count: int | None = 7500, offset: int = 0) -> DataFrame:
    """Items with a stored image and no vector, ``count`` by id after ``offset`` (None: all, in no order)."""
    queue = artworks.where((F.col("localImageUrl") != "") & F.col("imgVec").isNull()).select("id", "localImageUrl")
    return queue if count is None else queue.orderBy("id").offset(offset).limit(count)


def facets(artworks: DataFrame, column: str = "department") -> DataFrame:
    return artworks.where(eligible()).groupBy(column).agg(F.count("*").alias("n"))
