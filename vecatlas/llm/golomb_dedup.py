"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each partition sends its sorted distinct fingerprints, cut by ranges of values and Golomb-coded, to the owners of the
ranges. An owner finds the fingerprints that stand in several messages, or twice in one, and answers each message with a
bitmap. The partition reads the bitmaps of its own messages, and only rows whose fingerprint came back marked are
shuffled with their text, which is then compared byte by byte. Fingerprints are short (a thousandth of the texts may
be suspected for nothing), so a message takes little more than log2(1000 x rows / rows of the message) bits a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import delete_at_exit, work_dir, written

SPARE_BITS = 10  # fingerprints have so many bits more than it takes to number the rows
PARTS_PER_FOLDER = 64
CODED = "n int, k int, quotients binary, remainders binary"
MESSAGE = f"part int, owner int, {CODED}, marks binary"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Golomb code, with a power of two as parameter, of ascending distinct integers below ``span``.

    Returns k, the quotients of the gaps by 2^k in unary, and their remainders in k bits each.
    """
    gaps = np.diff(values, prepend=-1) - 1
    k = max(0, (span // max(1, len(values))).bit_length() - 1)
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low).tobytes()


def decode(n: int, k: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The integers that ``encode`` was given."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1) << k
    if k:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k)
        gaps = gaps + (bits.astype(np.int64) << np.arange(k)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


def _bitmap(marks: np.ndarray) -> bytes:
    return np.packbits(marks.astype(np.uint8)).tobytes()


def _marks(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)


def _sender(bits: int, owner_bits: int, hold: int):
    """Messages of a partition: one to each owner for every ``hold`` rows or so."""
    span = 1 << (bits - owner_bits)

    def run(batches):
        part, held, size = TaskContext.get().partitionId(), [], 0

        def messages():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            owners = values >> (bits - owner_bits)
            rows = []
            for owner in np.unique(owners).tolist():
                a, b = np.searchsorted(owners, [owner, owner + 1])
                rows.append((part, owner, int(b - a), *encode(values[a:b] - owner * span, span), _bitmap(times[a:b] > 1)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "owner", "n", "k", "quotients", "remainders", "marks"])

        for batch in batches:
            held.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size >= hold:
                yield messages()
                held, size = [], 0
        if size:
            yield messages()

    return run


def _owner(table: pa.Table) -> pa.Table:
    """The messages of one owner, with a mark at each fingerprint that stands in several of them or was marked by its sender."""
    rows = table.to_pylist()
    values = [decode(r["n"], r["k"], r["quotients"], r["remainders"]) for r in rows]
    together, times = np.unique(np.concatenate(values), return_counts=True)
    twice = times > 1
    for r, v in zip(rows, values, strict=True):
        twice[np.searchsorted(together, v[_marks(r["marks"], r["n"])])] = True
    marks = [_bitmap(twice[np.searchsorted(together, v)]) for v in values]
    return table.set_column(table.schema.get_field_index("marks"), "marks", pa.array(marks, pa.binary()))


def _suspects(folder: str, span: int):
    """A column function: whether a row's fingerprint is marked in the answers to the row's partition."""

    @F.pandas_udf("boolean")
    def marked(fingerprints: Iterator[pd.Series]) -> Iterator[pd.Series]:
        part = TaskContext.get().partitionId()
        system, base = fs.FileSystem.from_uri(f"{folder}/folder={part // PARTS_PER_FOLDER}")
        rows = []
        if system.get_file_info(base).type != fs.FileType.NotFound:
            rows = ds.dataset(base, filesystem=system, format="parquet").to_table(filter=ds.field("part") == part).to_pylist()
        known = np.concatenate([np.zeros(0, np.int64), *(decode(r["n"], r["k"], r["quotients"], r["remainders"]) + r["owner"] * span for r in rows)])
        marks = np.concatenate([np.zeros(0, bool), *(_marks(r["marks"], r["n"]) for r in rows)])
        order = np.argsort(known, kind="stable")
        known, marks = known[order], marks[order]
        for values in fingerprints:
            v = values.to_numpy()
            at = np.searchsorted(known, v)
            if len(v) and (at.max() >= len(known) or (known[at] != v).any()):
                raise ValueError("a partition has other rows than when its fingerprints were sent: write the documents to a table first")
            yield pd.Series(marks[at])

    return marked


def duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", per_owner: int = 1 << 20, hold: int = 1 << 22) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Rows are equal if their normalised texts are equal byte by byte; a null text counts as empty. Of a group the row of
    the smallest key stays (null keys last; of several rows with that key, one). Repeated rows count each. An empty
    table gives an empty result; other columns are not read. ``docs`` is read twice and must have the same partitions
    each time, as a table has: a row that was not there before ends the job. An owner has about ``per_owner``
    fingerprints, a message those of at most about ``hold`` rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), normalised(F.col(f"`{text}`")).alias("text"))
    n = docs.count()
    owner_bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_owner), 2).bit_length()
    bits = min(62, max(n.bit_length() + SPARE_BITS, owner_bits + 1))
    fingerprint = F.shiftrightunsigned(F.xxhash64("text"), 64 - bits)

    messages = rows.select("key", fingerprint.alias("fingerprint")).mapInArrow(  # with the key, so that both readings ask for the same columns
        _sender(bits, owner_bits, hold), MESSAGE
    )
    answers = messages.groupBy("owner").applyInArrow(_owner, MESSAGE).withColumn("folder", F.floor(F.col("part") / PARTS_PER_FOLDER))
    folder = work_dir(spark)
    answers.repartition("folder").sortWithinPartitions("folder", "part").write.partitionBy("folder").parquet(folder)
    delete_at_exit(spark, folder)

    suspect = _suspects(folder, 1 << (bits - owner_bits))(F.col("fingerprint"))
    seen = rows.withColumn("fingerprint", fingerprint).withColumn("suspect", suspect)
    seen = written(seen.select("key", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("sha"), F.when(F.col("suspect"), F.col("text")).alias("text")))

    suspects = seen.where("text is not null")
    first = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "row")).alias("first")
    texts = suspects.groupBy("sha", "text").agg(first, F.count("*").alias("n"))
    clash = F.when(F.count("*") > 1, F.raise_error(F.lit("different texts have one SHA-256"))).otherwise(F.min("n"))
    groups = written(texts.groupBy("sha").agg(F.min("first").alias("first"), clash.cast("long").alias("n")))  # a table, so that AQE can split the rows of a hot text
    alone = seen.where("text is null").select(F.col("key").alias(key), F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    found = suspects.select("key", "row", "sha").join(groups, "sha").select(
        F.col("key").alias(key), F.col("first.key").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(found)
