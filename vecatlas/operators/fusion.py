"""Reciprocal-rank fusion of ranked lists, and evaluation against labels."""

from __future__ import annotations

from math import exp, factorial, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, score: str, id_column: str = "id") -> DataFrame:
    """id and rank of a bounded list, the highest score first, ties by id."""
    return rows.select(F.col(id_column).alias("id"), F.row_number().over(Window.orderBy(F.desc(score), id_column)).alias("rank"))


def fuse(text: DataFrame, image: DataFrame, *, k: int = 50, w_text: float = 1.0, w_image: float = 1.0, k_rrf: int = 60) -> DataFrame:
    """The k best ids of two ranked lists (id, rank): the sum of weight / (k_rrf + rank), and both ranks."""
    lists = text.select("id", "rank", F.lit("text").alias("of")).unionByName(image.select("id", "rank", F.lit("image").alias("of")))
    weight = F.when(F.col("of") == "text", w_text).otherwise(w_image)
    score = F.sum(weight / (F.lit(k_rrf) + F.col("rank"))).alias("score")
    ranks = [F.min(F.when(F.col("of") == x, F.col("rank"))).alias(f"{x}_rank") for x in ("text", "image")]
    return lists.groupBy("id").agg(score, *ranks).orderBy(F.desc("score"), "id").limit(k)


def depth_needed(k: int, w_text: float, w_image: float, k_rrf: int) -> int:
    """How far into both lists the k best of their whole fusion reach at most.

    The k first of the heavier list score heavier / (k_rrf + k) each at least; what stands deeper than d in both lists
    scores (w_text + w_image) / (k_rrf + d + 1) at most. At this depth the second is the smaller.
    """
    heavier = max(w_text, w_image)
    if min(w_text, w_image) < 0 or heavier <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    return max(k, floor((w_text + w_image) * (k_rrf + k) / heavier) - k_rrf + 1)


def _ranks(rows: DataFrame, wanted: list, score: str) -> dict:
    """Ranks (the highest score first, ties by id) of a few of the rows, by counting: no list is sorted.

    ``wanted``: (id, score) of these. A task finds between which of them each of its rows stands, and adds up.
    """
    order = sorted((-s, i) for i, s in wanted)
    scores, ids = np.array([s for s, _ in order], np.float64), np.array([i for _, i in order], np.int64)

    def count(batches):
        places = np.zeros(len(order) + 1, np.int64)
        for batch in batches:
            own, number = -batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            first, place = np.searchsorted(scores, own, "left"), np.searchsorted(scores, own, "right")
            equal = first < place
            for start in np.unique(first[equal]).tolist():
                at = np.flatnonzero(equal & (first == start))
                place[at] = start + np.searchsorted(ids[start : place[at[0]]], number[at], "right")
            places += np.bincount(place, minlength=len(places))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(places), dtype=np.int32)), pa.array(places)], names=["place", "n"])

    found = rows.select(F.col("id").cast("bigint").alias("id"), F.col(score).cast("double").alias("score")).where("score is not null").mapInArrow(count, "place int, n bigint")
    n = np.zeros(len(order) + 1, np.int64)
    for r in found.groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row for each of the wanted
        n[r["place"]] = r["n"]
    return dict(zip(ids.tolist(), (np.cumsum(n)[: len(order)] + 1).tolist(), strict=True))


def fuse_whole(rows: DataFrame, *, text: str = "text", image: str = "image", k: int = 50, w_text: float = 1.0, w_image: float = 1.0, k_rrf: int = 60) -> tuple[DataFrame, dict]:
    """The k best ids of the fusion of two whole rankings (``fuse`` cuts both lists first), and facts: depth, candidates.

    ``rows``: id (unique, a whole number) and two scores; a score that is null or not a number is not in that list. The bound of the threshold algorithm
    says before how deep the lists must be read: only the first ``depth_needed`` of each can be among the k best. Their
    ranks in the other list, however low, come from a pass that counts. So two top-k scans and two counting scans do, and
    at most 2 x depth rows reach the driver. Ties by id; a zero weight gives no share, and ids without a share have no place.
    """
    depth = depth_needed(k, w_text, w_image, k_rrf)
    rows = rows.select("id", *[F.nanvl(F.col(of).cast("double"), F.lit(None).cast("double")).alias(to) for of, to in ((text, "text"), (image, "image"))])
    text, image = "text", "image"
    chosen, lists = {}, ((text, w_text), (image, w_image))
    for score, weight in lists:
        if weight:
            for r in rows.where(F.col(score).isNotNull()).orderBy(F.desc(score), "id").limit(depth).select("id", F.col(text).alias("a"), F.col(image).alias("b")).collect():
                chosen[r["id"]] = (r["a"], r["b"])
    ranks = [_ranks(rows, [(i, s[n]) for i, s in chosen.items() if s[n] is not None], score) for n, (score, _) in enumerate(lists)]
    out = []
    for i in chosen:
        at = [r.get(i) for r in ranks]
        out.append((i, sum(w / (k_rrf + r) for r, (_, w) in zip(at, lists, strict=True) if r), *at))
    best = sorted(out, key=lambda r: (-round(r[1], 12), r[0]))[:k]
    return rows.sparkSession.createDataFrame(best, "id bigint, score double, text_rank bigint, image_rank bigint"), {"depth": depth, "candidates": len(chosen)}


def hit_rate(ranks: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """The share of plausible results among each query's first ``top``. ranks: query, id, rank; labels: query, id, plausible."""
    judged = ranks.where(F.col("rank") <= top).join(labels, ["query", "id"], "left")
    return judged.agg(F.avg(F.coalesce(F.col("plausible"), F.lit(False)).cast("double")).alias("hit_rate"), F.count("*").alias("judged"))


def _judged(text: DataFrame, image: DataFrame, labels: DataFrame, weights: list[tuple[float, float]], top: int, k_rrf: int) -> DataFrame:
    """w_text, w_image, query, id, plausible of each query's first ``top`` for each pair of weights."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("w_text"), F.lit(float(b)).alias("w_image")) for a, b in weights])).alias("w")
    lists = text.select("query", "id", "rank", F.lit(True).alias("of_text")).unionByName(image.select("query", "id", "rank", F.lit(False).alias("of_text")))
    tried = lists.select("query", "id", "rank", "of_text", grid).select("query", "id", "rank", "of_text", "w.*")
    share = F.when(F.col("of_text"), F.col("w_text")).otherwise(F.col("w_image"))
    scored = tried.groupBy("w_text", "w_image", "query", "id").agg(F.sum(share / (F.lit(k_rrf) + F.col("rank"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("w_text", "w_image", "query").orderBy(F.desc(F.round("score", 12)), "id"))
    best = scored.withColumn("place", place).where(F.col("place") <= top).join(labels, ["query", "id"], "left")
    return best.withColumn("plausible", F.coalesce("plausible", F.lit(False)))


def weight_grid(text: DataFrame, image: DataFrame, labels: DataFrame, weights: list[tuple[float, float]], *, top: int = 5, k_rrf: int = 60) -> DataFrame:
    """The hit rate of fusion for each pair of weights. text and image: query, id, rank."""
    return _judged(text, image, labels, weights, top, k_rrf).groupBy("w_text", "w_image").agg(F.avg(F.col("plausible").cast("double")).alias("hit_rate"))


def poisson_bounds() -> list[int]:
    """A number drawn evenly from 0 to 2^32 - 1 gives the Poisson count (of mean 1) of the bounds that it reaches."""
    return [floor(sum(exp(-1) / factorial(i) for i in range(j + 1)) * (1 << 32)) for j in range(12)]


def intervals(judged: DataFrame, by: list[str], *, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """hit_rate, low, high for each group of the columns ``by``. judged: by, query (unique in a group), hits, judged.

    A Poisson bootstrap over queries: in each replicate a query counts as often as md5 of seed, replicate and query says, so
    no rows are drawn or sorted, one aggregation makes all replicates, and every group sees the same replicates. Only sums by
    group and replicate are shuffled. A replicate in which nothing counts has no rate.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate"), F.col("query")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    times = F.size(F.filter(F.array(*map(F.lit, poisson_bounds())), lambda x: x <= F.col("drawn")))
    rows = judged.select(*by, "query", "hits", "judged", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate")).withColumn("drawn", drawn)
    rows = rows.withColumn("times", F.when(F.col("replicate") == 0, 1).otherwise(times))  # replicate 0: as measured
    rates = rows.groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col("hits") * F.col("times")).cast("double"), F.sum(F.col("judged") * F.col("times")).cast("double")).alias("rate"))
    again = F.when(F.col("replicate") > 0, F.col("rate"))
    side = (1 - level) / 2
    return rates.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col("rate"))).alias("hit_rate"), F.percentile(again, F.lit(side)).alias("low"), F.percentile(again, F.lit(1 - side)).alias("high"))


def weight_intervals(text: DataFrame, image: DataFrame, labels: DataFrame, weights: list[tuple[float, float]], *, top: int = 5, k_rrf: int = 60, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """The hit rate of fusion for each pair of weights, with a bootstrap interval. text and image: query, id, rank."""
    by = ["w_text", "w_image"]
    judged = _judged(text, image, labels, weights, top, k_rrf).groupBy(*by, "query").agg(F.sum(F.col("plausible").cast("int")).alias("hits"), F.count("*").alias("judged"))
    return intervals(judged, by, replicates=replicates, level=level, seed=seed)
