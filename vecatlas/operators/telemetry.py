"""Checks on vectors and measures of use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_coverage(artworks: DataFrame, columns: tuple[str, ...] = ("imgVec",)) -> DataFrame:
    """Rows, rows that have all the vectors, and their share."""
    has = F.lit(True)
    for c in columns:
        has &= F.col(c).isNotNull()
    return artworks.agg(F.count("*").alias("n"), F.count_if(has).alias("covered"), F.avg(has.cast("double")).alias("coverage"))


def vector_integrity(artworks: DataFrame, dimension: int, percent: int = 100) -> DataFrame:
    """Over a sample of ``percent`` of the ids by hash: rows, vectors missing, of another dimension, with a NaN or null, of length 0."""
    drawn = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(100)) < percent
    v = F.col("imgVec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    zero = F.forall(v, lambda x: x == 0)
    return artworks.where(drawn).agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.size(v) != dimension).alias("other_dimension"), F.count_if(bad).alias("not_numbers"), F.count_if(zero).alias("zero")
    )


def latency(events: DataFrame, by: str = "event_type", value: str = "value") -> DataFrame:
    """Count and exact percentiles, from the counts of the distinct values; ``latency_approximate`` is for groups with very many."""
    counted = events.groupBy(by, value).agg(F.count("*").alias("__times"))
    return counted.groupBy(by).agg(F.sum("__times").alias("n"), *[F.percentile(value, p, F.col("__times")).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


def latency_approximate(events: DataFrame, by: str = "event_type", value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """The same with sketches of bounded size instead of all values of a group."""
    return events.groupBy(by).agg(F.count("*").alias("n"), *[F.percentile_approx(value, p, accuracy).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])


def no_results(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Requests, those without any result row of the same key, and their share."""
    answered = results.select(key).distinct().withColumn("__found", F.lit(True))
    empty = F.col("__found").isNull()
    return requests.select(key).join(answered, key, "left").agg(F.count("*").alias("n"), F.count_if(empty).alias("no_result"), F.avg(empty.cast("double")).alias("share"))


def use(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Views, clicks, errors, click-through and error rates."""
    count = lambda x: F.count_if(F.col(kind) == x)
    return events.agg(
        count("view").alias("views"), count("click").alias("clicks"), count("error").alias("errors"),
        F.try_divide(count("click").cast("double"), count("view").cast("double")).alias("click_through"), (count("error") / F.count("*")).alias("error_rate"),
    )


SKETCH_K = 1024  #: with this, ranks of quantiles are off by less than RANK_ERROR of the rows (at 99 % confidence)
RANK_ERROR = 0.005


def latency_sketches(events: DataFrame, width: str = "1 hour", *, by: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """kind, start, n, sketch: a quantile sketch of bounded size for each kind and window of time, to be stored and merged later."""
    rows = events.where(F.col(value).isNotNull()).select(F.col(by).alias("kind"), F.window(F.col(ts).cast("timestamp"), width)["start"].alias("start"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("kind", "start").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("sketch"))


def latency_of_windows(sketches: DataFrame, *, start=None, end=None) -> DataFrame:
    """kind, n, p50, p95, p99 over the stored windows from ``start`` to before ``end``, from their sketches alone."""
    rows = sketches
    rows = rows if start is None else rows.where(F.col("start") >= F.lit(start))
    rows = rows if end is None else rows.where(F.col("start") < F.lit(end))
    merged = rows.groupBy("kind").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    return merged.select("kind", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])
