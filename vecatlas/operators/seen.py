"""What many users have seen, as bitmaps by user and bucket of ids (32,768 ids each), and lists without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(views: DataFrame, user: str = "user", item: str = "id") -> DataFrame:
    """user, bucket, seen: a bit for each item (positive integers) that stands in ``views``; repeats count once, nulls not at all."""
    rows = views.select(F.col(user).alias("user"), F.col(item).cast("long").alias("id")).where("user is not null and id > 0")
    return rows.groupBy("user", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("seen"))


def merged(*sets: DataFrame) -> DataFrame:
    """The union of bitmaps: a day's can be added to those of all days before without reading these days' views."""
    together = sets[0]
    for s in sets[1:]:
        together = together.unionByName(s)
    return together.groupBy("user", "bucket").agg(F.bitmap_or_agg("seen").alias("seen"))


def has(seen: Column, item: Column) -> Column:
    """Whether an item's bit is set; false for no bitmap."""
    at = F.bitmap_bit_position(item)
    byte = F.conv(F.hex(F.substring(seen, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), at % 8).cast("int")
    return F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))


def unseen(lists: DataFrame, seen: DataFrame, user: str = "user", item: str = "id") -> DataFrame:
    """The rows of ``lists`` whose item the row's user has not seen: each row meets one bitmap at most, so none is multiplied.

    Rows with a null user or item stay.
    """
    rows = lists.select(F.struct(*[F.col(f"`{c}`") for c in lists.columns]).alias("row"))
    key = F.when(F.col("row")[item] > 0, F.bitmap_bucket_number(F.col("row")[item].cast("long")))
    joined = rows.join(seen, (F.col("row")[user] == seen["user"]) & (key == seen["bucket"]), "left")
    return joined.where(~has(F.col("seen"), F.col("row")[item].cast("long"))).select("row.*")


def counts(seen: DataFrame) -> DataFrame:
    """user, n: the distinct items that each user has seen."""
    return seen.groupBy("user").agg(F.sum(F.bitmap_count("seen")).alias("n"))
