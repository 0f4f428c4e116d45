"""Minimax contiguous sharding with DataFrame operations only.

Groups of equal texts are the atoms, ordered by the text's digest. Running sums over that order are made in two
levels (within digest ranges, then over the ranges). The shard capacity is the least that still lets a greedy
pass, which fills each shard as far as it fits, cover everything in the given number of shards. It is found by
binary search over summaries of the running sums: the places where a cut can still fall are read at a fixed
number of cells, which bounds the capacity to within a cell; the next round reads only what lies around the
possible cuts, until it reads single groups. Within that capacity the cuts are then placed evenly: each as near as it
can be to an equal share of what remains, and never so early that the shards after it could not hold the rest. All of
these are looked up in the first summary, whose cells around the cuts are read again until they hold one end each.
Each summary has a bounded number of rows whatever the table's size.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.common import written

SALTS = 64  # a group of equal texts is numbered in so many parts
RANGES = 4096  # digest ranges of the running sums


def _greedy(ends: list[int], total: int, capacity: int, shards: int) -> list[int] | None:
    """Cuts after each shard if ``shards`` of this capacity are enough, else None. ends: where groups end, ascending."""
    cuts, at = [], 0
    for _ in range(shards - 1):
        i = bisect_right(ends, at + capacity) - 1
        at = max(at, ends[i]) if i >= 0 else at
        cuts.append(at)
    return cuts if total - at <= capacity else None


def _least_capacity(ends: list[int], total: int, low: int, high: int, shards: int) -> int:
    """The least feasible capacity from low to high (high is feasible)."""
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, total, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


class Ends:
    """Where groups end, as a summary of disjoint cells: the first and the last end in each.

    A question that falls between a cell's first and last end is answered by one of these for the time being, and the cell is noted
    in ``open``; ``refine`` reads all noted cells at a finer width, by one job.
    """

    def __init__(self, groups: DataFrame, cells: list[tuple[int, int]], fine: int = 20_000) -> None:
        self.groups, self.fine = groups, fine
        self.open: set[int] = set()
        self._hold(cells)

    def _hold(self, cells: list[tuple[int, int]]) -> None:
        cells = sorted(cells)
        self.first, self.last = [c[0] for c in cells], [c[1] for c in cells]

    def up_to(self, x: int) -> int | None:
        """The last end up to ``x``."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return None
        if self.last[i] <= x:
            return self.last[i]
        self.open.add(i)
        return self.first[i]

    def after(self, x: int) -> int | None:
        """The first end after ``x``."""
        i = bisect_right(self.last, x)
        if i == len(self.last):
            return None
        if self.first[i] > x:
            return self.first[i]
        self.open.add(i)
        return self.last[i]

    def refine(self) -> None:
        end = F.col("end")
        wanted = [(self.first[i], self.last[i]) for i in sorted(self.open)]
        each = max(2, self.fine // len(wanted))
        inside, cell = F.lit(False), F.lit(None)
        for k, (a, b) in enumerate(wanted):
            within = end.between(a, b)
            inside |= within
            cell = F.when(within, F.lit(k * each) + F.floor((end - a) / max(1, -(-(b - a + 1) // each)))).otherwise(cell)
        rows = self.groups.where(inside).groupBy(cell.alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()
        kept = [c for i, c in enumerate(zip(self.first, self.last, strict=True)) if i not in self.open]
        self.open = set()
        self._hold([*kept, *((r["a"], r["b"]) for r in rows)])


def _even_cuts(ends: Ends, top: list[tuple[int, int]], total: int, capacity: int, shards: int) -> list[int]:
    """Cuts of shards of at most ``capacity``, each as near to an equal share of what remains as a group's end allows.
    top: end and size of the largest groups, as many as there are shards."""
    # a group larger than its share counts as one share, so that what it takes is not missing from the shards around it
    big, share = [], total / shards
    while len(larger := [x for x in top if x[1] > share]) > len(big):
        big, share = sorted(larger), (total - sum(x for _, x in larger)) / max(1, shards - len(larger))

    def counted(end: int) -> float:
        return end - sum(size - share for e, size in big if e <= end)

    def place(count: float) -> int:
        """Where the running sum is that counts so much."""
        gone = 0.0
        for e, size in big:
            start = e - size - gone
            if count <= start:
                break
            if count < start + share:
                return int(e - size + (count - start) * size / share)
            gone += size - share
        return int(count + gone)

    def settled() -> list[int]:
        least, at = [], total  # least[k]: where a cut must be at least, for the shards after it to hold the rest
        for _ in range(shards - 1):
            at = 0 if at <= capacity else ends.after(at - capacity - 1)
            least.append(at)
        least.reverse()
        cuts, at = [], 0
        for k in range(shards - 1):
            low, high = max(at, least[k]), min(at + capacity, total)
            aim = counted(at) + (counted(total) - counted(at)) / (shards - k)
            near = place(aim)
            found = [e for e in (ends.up_to(min(near, high)), ends.after(max(near, low - 1))) if e is not None and low <= e <= high]
            at = min([*found, low], key=lambda e: (not at < e < total, abs(counted(e) - aim), e))
            cuts.append(at)
        return cuts

    while True:
        cuts = settled()
        if not ends.open:
            return cuts
        ends.refine()


def minimax_cuts(groups: DataFrame, shards: int, cells: int = 20_000) -> tuple[int, list[int]]:
    """The least capacity, and the running sums after which the shards end. groups: end, size (of each group)."""
    row = groups.agg(F.max("end").alias("total"), F.max("size").alias("largest"), F.count("*").alias("n")).first()
    if not row["n"]:
        return 0, [0] * (shards - 1)
    total, largest = row["total"], row["largest"]
    top = [(r["end"], r["size"]) for r in groups.orderBy(F.desc("size")).limit(shards).collect()]
    summary = None
    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    windows = [(0, total)]
    while True:
        width = sum(b - a + 1 for a, b in windows)
        cell = max(1, width // cells)
        inside = F.lit(False)
        for a, b in windows:
            inside |= F.col("end").between(a, b)
        read = groups.where(inside).groupBy(F.floor(F.col("end") / cell).alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("end")).collect()
        if summary is None:  # of the whole: where the even cuts begin to look
            summary = Ends(groups, [(r["first"], r["end"]) for r in read], cells)
        ends = sorted({r["end"] for r in read} | {total})
        # a cut at a group's end may move up to the end of its cell, so what is feasible is feasible with a cell more
        found = _least_capacity(ends, total, low, high + cell, shards)
        low, high = max(low, found - cell), found
        if cell == 1:
            return high, _even_cuts(summary, top, total, high, shards)
        windows, least, most = [], 0, 0
        for _ in range(shards - 1):
            i = bisect_right(ends, least + low) - 1
            least = max(least, ends[i] if i >= 0 else 0)
            most = min(total, most + high)
            if windows and least - cell <= windows[-1][1]:
                windows[-1] = (windows[-1][0], most)
            else:
                windows.append((max(0, least - cell), most))
        # reading at a finer cell than before is all that another round gains
        if sum(b - a + 1 for a, b in windows) >= width:
            cells *= 4


def _digest_range(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """One row per row of ``docs``: key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot and
    grown_shard (null: the law is ``bytes``).

    Sizes of the shards are as near equal as whole groups of equal texts allow: the largest is as small as it can
    be for contiguous runs of groups. Slots number a shard's rows from 0 without a gap, in order of digest, then
    of key within parts of a group. A null text counts as empty and shares the group of empty texts. Repeated rows
    and null keys are kept. An empty table gives an empty result. Other columns are not read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    base = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("digest"))
    base = written(base.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")))

    parts = base.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("range", _digest_range(F.col("digest")))
    within = Window.partitionBy("range").orderBy("digest", "salt")
    parts = written(parts.withColumn("row_end", F.sum("n").over(within)).withColumn("byte_end", F.sum("bytes").over(within)))
    ranges = parts.groupBy("range").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"))
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    ranges = ranges.select("range", F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("bytes_before"))
    placed = parts.join(F.broadcast(ranges), "range").select(
        "digest", "salt", (F.col("rows_before") + F.col("row_end") - F.col("n")).alias("row_start"), (F.col("bytes_before") + F.col("byte_end")).alias("byte_end"), "bytes"
    )
    groups = written(placed.groupBy("digest").agg(F.max("byte_end").alias("end"), F.sum("bytes").alias("size"), F.min("row_start").alias("row_start")))

    _, cuts = minimax_cuts(groups, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("end") > F.lit(c)).cast("int")
    firsts = {r["shard"]: r["first"] for r in groups.groupBy(number.alias("shard")).agg(F.min("row_start").alias("first")).collect()}  # a row for each shard
    first = F.lit(0)
    for k, v in firsts.items():
        first = F.when(F.col("shard") == k, F.lit(v)).otherwise(first)
    of_part = placed.join(groups.select("digest", "end"), "digest").select("digest", "salt", "row_start", number.alias("shard"))
    rank = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("key")) - 1
    return base.join(of_part, ["digest", "salt"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_start") + rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
