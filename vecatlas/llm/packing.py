"""Best-fit packing of token pieces into sequences, as a tree of merges.

Each input partition cuts and tokenizes its documents and packs what is shorter than a sequence best-fit (longest
first, each into the fullest sequence that has room). Nearly full sequences are final. What is in underfull ones goes
on as items, spread at random over fewer tasks, and is packed by best fit again, until few enough items are left for
one task or a round closes few sequences; the last round keeps its underfull sequences. A sequence that is more than
half full could not be merged with another, so pieces go on one by one rather than in the sequence that did not fill.
An item holds at most ``capacity`` pieces and a task about ``items_per_task`` items, so neither grows with the corpus.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from vecatlas.llm.common import slices, written
from vecatlas.llm.tokenization import tokenizer

NUMBERS = ("piece", "start", "length", "ids_crc32", "offset")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item (0 < size <= capacity) by best fit, longest items first, and the number of bins."""
    bins = np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = count = 0  # bit r of rooms: a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i] = b
        if room > size:
            free[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, count


def opened(bins: np.ndarray, n_bins: int, sizes: np.ndarray, full: int) -> tuple[np.ndarray, int]:
    """Only bins that hold ``full`` or more stay; every other item gets a bin of its own."""
    closed = np.bincount(bins, weights=sizes, minlength=n_bins) >= full
    number = np.cumsum(closed) - 1
    kept = closed[bins]
    n = int(closed.sum())
    return np.where(kept, number[bins], n + np.cumsum(~kept) - 1), n + int((~kept).sum())


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but the first piece, which has the rest."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _types(key_type, with_ids: bool) -> StructType:
    member = StructType().add("key", key_type)
    for name in NUMBERS:
        member = member.add(name, IntegerType() if name == "piece" else LongType())
    if with_ids:
        member = member.add("ids", ArrayType(IntegerType()))
    return StructType().add("sequence_id", LongType()).add("fill", IntegerType()).add("closed", BooleanType()).add("members", ArrayType(member))


def _rows(ids: np.ndarray, members: pa.StructArray, bins: np.ndarray, n_bins: int, full: int, names: list[str]) -> pa.RecordBatch:
    """One row for a bin from its members (already grouped: bins ascending), with the members' offsets set."""
    lengths = members.field(members.type.get_field_index("length")).to_numpy(zero_copy_only=False)
    counts = np.bincount(bins, minlength=n_bins)
    edges = np.concatenate(([0], np.cumsum(counts)))
    ends = np.cumsum(lengths)
    before = np.concatenate(([0], ends))[edges[:-1]]
    fill = np.concatenate(([0], ends))[edges[1:]] - before
    fields = [members.field(i) for i in range(members.type.num_fields)]
    at = members.type.get_field_index("offset")
    fields[at] = pa.array(ends - lengths - np.repeat(before, counts), pa.int64())
    inner = pa.StructArray.from_arrays(fields, fields=list(members.type))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(fill.astype(np.int32)), pa.array(fill >= full), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), inner)], names=names
    )


def pack(
    docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024, slack: int = 8,
    items_per_task: int = 20_000, fan_in: int = 8, pieces_at_once: int = 100_000, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Only documents longer than ``capacity`` are cut. A sequence is final once it lacks at most ``slack`` tokens. A task
    of the first round packs ``pieces_at_once`` pieces together.
    A null text counts as empty: its document is the end id alone. Null and repeated keys are kept: each row is a
    document. An empty table gives an empty result. Columns other than key and text are not read.
    """
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType
    schema = _types(kind, with_ids)
    end = int(end_id).to_bytes(4, "little")
    names = schema.fieldNames()

    def first_round(batches):
        base, made = TaskContext.get().partitionId() << 34, 0
        member = to_arrow_type(schema["members"].dataType).value_type
        library = tokenizer(tokenizer_path, "byte")
        keys, numbers, held, seen = [], [[] for _ in NUMBERS], [], 0  # seen: rows so far, what "offset" holds until the bins are known

        def packed():
            sizes = np.array(numbers[2])
            bins, n_bins = opened(*best_fit(sizes, capacity), sizes, capacity - slack)
            order = np.argsort(bins, kind="stable")
            columns = [pa.concat_arrays(keys).take(pa.array(np.array(numbers[-1])[order])), *(pa.array(np.array(n, dtype=np.int64)[order]).cast(member.field(f).type) for f, n in zip(NUMBERS, numbers, strict=True))]
            if with_ids:
                columns.append(pa.array([np.frombuffer(held[i], "<i4") for i in order.tolist()], member.field("ids").type))
            inner = pa.StructArray.from_arrays(columns, fields=list(member))
            return _rows(base + made + np.arange(n_bins), inner, bins[order], n_bins, capacity - slack, names)

        for batch in slices(batches, "text", 2_000_000):
            keys.append(batch.column(0))
            for row, ids in enumerate(library.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for n, x in zip(numbers, (piece, start, length, zlib.crc32(part), seen + row), strict=True):
                        n.append(x)
                    if with_ids:
                        held.append(part)
            seen += batch.num_rows
            if len(numbers[0]) >= pieces_at_once:
                out = packed()
                made += out.num_rows
                yield out
                keys, numbers, held, seen = [], [[] for _ in NUMBERS], [], 0
        if seen:
            yield packed()

    def merge_round(last: bool):
        def run(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            items = pa.Table.from_batches(held).combine_chunks()
            lists = items.column("members").chunk(0)
            inner, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = items.column("fill").to_numpy()
            bins, n_bins = best_fit(sizes, capacity)
            if not last:
                bins, n_bins = opened(bins, n_bins, sizes, capacity - slack)
            order = np.argsort(bins, kind="stable")
            counts = np.diff(edges)[order]
            take = np.repeat(edges[:-1][order] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            ids = items.column("sequence_id").to_numpy()[order][np.searchsorted(bins[order], np.arange(n_bins))]
            yield _rows(ids, inner.take(pa.array(take)), np.repeat(bins[order], counts), n_bins, capacity - slack, names)

        return run

    level = written(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(first_round, schema))
    done, tasks, before = [], None, None
    while True:
        done.append(level.where("closed"))
        rest = level.where("not closed")
        n = rest.count()
        if not n:
            break
        least = ceil(n / items_per_task)
        tasks = least if tasks is None else max(least, ceil(tasks / fan_in))
        last = tasks == 1 or (before is not None and n > 0.9 * before)
        level, before = written(rest.repartition(tasks, F.xxhash64("sequence_id")).mapInArrow(merge_round(last), schema)), n
        if last:
            done.append(level)
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    rows = out.select("sequence_id", F.inline("members")).withColumnRenamed("key", key)
    return rows.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
