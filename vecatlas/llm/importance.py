"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, and a draw by Gumbel noise.

Texts are made lower-case (ASCII), runs of separators collapse to single spaces, and for each n a regular expression with
boundary lookarounds runs over the text with overlapping matches, so that each match is one n-gram's span of bytes, whose
CRC-32 gives the feature's bucket. Texts are read once: a row keeps its bucket counts, a task adds up its totals.
"""

from __future__ import annotations

import math
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecatlas.llm.common import slices, written

# Word bytes are 0-9, a-z (A-Z are made lower-case) and all beyond ASCII; every other byte separates.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SPACES = regex.compile(rb" {2,}")
COUNTS = "n_words long, n_features long, buckets array<int>, counts array<int>, totals array<long>"


def collapsed(text: bytes) -> bytes:
    """Lower-case words with one space between."""
    return SPACES.sub(b" ", text.translate(FOLDED)).strip(b" ")


def ngrams(n: int) -> regex.Pattern:
    """Matches n whole words of a collapsed text; with overlapping matches, one at each word that n - 1 others follow."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def buckets_of(text: bytes, patterns: list[regex.Pattern], buckets: int) -> list[np.ndarray]:
    """For each pattern the buckets of its matches in a collapsed text, repeats included."""
    return [np.fromiter(map(crc32, map(itemgetter(0), p.finditer(text, overlapped=True))), np.int64) % buckets for p in patterns]


def count_features(df: DataFrame, text: str, key: Column, *, max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """key, n_words, n_features, and the text's buckets with their counts; and for each task one row with its ``totals`` by bucket."""
    rows = df.select(key.alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    kind = to_arrow_type(rows.schema["key"].dataType)

    def run(batches):
        patterns, totals = [ngrams(n) for n in range(1, max_n + 1)], np.zeros(buckets, np.int64)

        def batch_of(keys, words, features, found, times, sums):
            lists = [pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([keys, pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists], names=["key", "n_words", "n_features", "buckets", "counts", "totals"])

        for batch in slices(batches, "text"):
            words, features, found, times = [], [], [], []
            for body in batch.column(1).to_pylist():
                by_n = buckets_of(collapsed(body), patterns, buckets)
                b, c = np.unique(np.concatenate(by_n), return_counts=True)
                totals[b] += c
                words.append(len(by_n[0]))
                features.append(sum(map(len, by_n)))
                found.append(b)
                times.append(c)
            yield batch_of(batch.column(0), words, features, found, times, [None] * len(words))
        if totals.any():
            yield batch_of(pa.nulls(1, kind), [0], [0], [None], [None], [totals])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {COUNTS}")


def _totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: one row for each bucket reaches the driver."""
    sums = np.zeros(buckets, np.int64)
    for bucket, n in counted.where("totals is not null").select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col")).collect():
        sums[bucket] = n
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of target over source share of each bucket, with one more feature in each, rounded down."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    ratio = [(t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weighted(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features, weight: the sum of gains over a text's features."""
    rows = counted.where("totals is null").select("key", "n_words", "n_features", "buckets", "counts")

    def run(batches):
        for batch in batches:
            found, times = batch.column(3), batch.column(4)
            sums = np.concatenate([[0], np.cumsum(gain[found.flatten().to_numpy()] * times.flatten().to_numpy())])
            ends = np.cumsum(found.value_lengths().to_numpy())
            weight = sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight.astype(np.int64))], names=["key", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """A thousand times a Gumbel draw, rounded down, from the SHA-256 of seed and key (a null key counts as empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024
) -> DataFrame:
    """One row per row of ``docs``: key, n_features, weight, score, and the rank (from 1) of rows that are drawn, else null.

    Of the rows of at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn: the highest scores,
    ties by smaller key (null keys last; equal rows in any order). A null text has no words and weight 0. Repeated rows
    count and are drawn each. An empty table gives an empty result; with an empty target every feature is scored
    against none. Columns other than key and text are not read. The driver holds numbers by bucket only.
    """
    of_key = F.col(f"`{key}`")
    counted = written(count_features(docs, text, of_key, max_n=max_n, buckets=buckets))
    wanted = _totals(count_features(target, target_text, F.lit(0), max_n=max_n, buckets=buckets), buckets)
    weighted = _weighted(counted, gains(_totals(counted, buckets), wanted))
    scored = written(weighted.withColumn("score", F.col("weight") + noise(F.col("key"), seed)).withColumn("row", F.monotonically_increasing_id()))

    able = scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("key"), "row"]
    place = F.monotonically_increasing_id()  # the partition's number, and the row's place in it
    dealt = able.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = written(dealt.select("key", "n_features", "weight", "score", F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("drawn"))  # a row for each partition
    rank = F.col("before") + F.col("place") + 1
    ranked = dealt.join(F.broadcast(before), "range").select(F.col("key").alias(key), "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).cast("long").alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(F.col("key").alias(key), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)

