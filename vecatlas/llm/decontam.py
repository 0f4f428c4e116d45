"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive words of benchmark items. Patterns of one length form one table set:
a shift table over blocks of two words tells how far a search position may move on, blocks that may end a
pattern lead to a bucket of patterns with that suffix, and direct comparison, first word first, confirms each
occurrence. Spark drops repeated items and deals the rest to groups of bounded size. One group is broadcast; more are
written to the shared folder, and each task builds the tables of one group after another, so that a worker holds one
group's tables whatever the benchmark's size, and no text is carried from pass to pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructType

from vecatlas.llm.common import slices, unused, written

# Bytes that belong to words (after lower-casing A-Z) are 0-9, a-z and all of 0x80-0xFF.
_TO_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


@dataclass(frozen=True)
class PatternTables:
    """Wu-Manber tables of the patterns of one length (in words)."""

    length: int
    shift: dict  # block -> safe shift; blocks that are in no pattern allow the largest
    suffix: dict  # block at a pattern's end -> [pattern words, item ids, pattern words, item ids, ...]
    block: int

    @staticmethod
    def build(patterns: dict[tuple[bytes, ...], tuple[int, ...]], length: int) -> PatternTables:
        block = min(2, length)
        shift: dict = {}
        suffix: dict = {}
        for words, items in patterns.items():
            for end in range(block, length + 1):
                key = words[end - block : end] if block == 2 else words[end - 1]
                shift[key] = min(shift.get(key, length), length - end)
            suffix.setdefault(key, []).extend((words, items))
        return PatternTables(length, shift, suffix, block)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """The start of each occurrence and the items that the pattern comes from."""
        m, shift, suffix = self.length, self.shift, self.suffix
        skip, n, at = m - self.block + 1, len(words), m - 1
        if self.block == 1:
            for i, w in enumerate(words):
                if w in suffix:
                    yield i, suffix[w][1]
            return
        get = shift.get
        while at < n:
            move = get((words[at - 1], words[at]), skip)
            if move:
                at += move
                continue
            start = at - m + 1
            found, here = suffix[(words[at - 1], words[at])], tuple(words[start : at + 1])
            for i in range(0, len(found), 2):
                if found[i] == here:
                    yield start, found[i + 1]
            at += 1


def tables_of(items: list[tuple], window: int) -> list[PatternTables]:
    """The tables of all windows of the items. An item shorter than a window, but not empty, is one pattern."""
    found: dict[int, dict[tuple[bytes, ...], dict]] = {}
    same: dict = {}  # one object for all occurrences of a word or of a tuple of ids
    for item, text in items:
        words = [same.setdefault(w, w) for w in words_of(text)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(words[i : i + size]), {})[item] = None
    ids_of = lambda ids: same.setdefault(ids, ids)
    return [PatternTables.build({words: ids_of(tuple(items)) for words, items in p.items()}, n) for n, p in sorted(found.items())]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_text(text: str | None, tables: list[PatternTables]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged (start, end) word ranges that occurrences cover, and the items found."""
    words = words_of(text)
    ranges: list[tuple[int, int]] = []
    items: set[int] = set()
    for t in tables:
        for start, ids in t.search(words):
            ranges.append((start, start + t.length))
            items.update(ids)
    return len(words), merged(ranges), items


def _groups(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> list[tuple[list[str], list]]:
    """The distinct items in groups of about ``max_bytes`` bytes of text: (files in the shared folder, rows), of which
    a single group has rows and several have files."""
    rows = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null").distinct()
    size = F.octet_length("text").cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= max_bytes:
        return [([], [tuple(r) for r in rows.collect()])]
    dealt = written(rows.repartition(-(-2 * total // max_bytes), F.xxhash64("item", "text")))
    files = dealt.groupBy(F.input_file_name().alias("file")).agg(F.sum(size).alias("n")).orderBy("file").collect()  # a row for each group
    out, held = [], 0
    for f in files:
        if not out or held + f["n"] > max_bytes:
            out.append(([], []))
            held = 0
        out[-1][0].append(f["file"])
        held += f["n"]
    return out


_built: dict[tuple, list[PatternTables]] = {}


def _tables(name: tuple, files: list[str], rows: list, window: int) -> list[PatternTables]:
    """The tables of one group; a worker keeps those of the last group that it used."""
    if name not in _built:
        _built.clear()
        for file in files:
            system, path = fs.FileSystem.from_uri(file)
            found = pq.read_table(path, filesystem=system)
            rows = [*rows, *zip(found.column("item").to_pylist(), found.column("text").to_pylist(), strict=True)]
        _built[name] = tables_of(rows, window)
    return _built[name]


def find(
    docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 10, max_bytes: int = 1 << 20,
) -> DataFrame:
    """Add ``n_words``, ``hit_ranges`` (merged word ranges that occurrences cover) and ``items`` (ids of any type that sorts) to the
    ``keep`` columns.

    A worker holds the tables of ``max_bytes`` of benchmark text at a time (about 70 times as much memory, if all
    words differ), and searches each batch of documents for one group after another. Null and empty texts have no
    words and no hits; an item with a null id hits words but is not listed; null benchmark texts and repeated
    items add nothing; an empty benchmark hits nothing. Rows are searched one by one in full, so repeated rows
    get equal results. Input columns with the names of results are replaced.
    """
    own = ["n_words", "hit_ranges", "items"]
    keep = [c for c in (keep or docs.columns) if c not in own]
    groups = docs.sparkSession.sparkContext.broadcast(_groups(benchmark, item, item_text, max_bytes))
    mark, several = uuid.uuid4().hex, len(groups.value) > 1
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    id_type = benchmark.select(F.col(f"`{item}`").alias("item")).schema["item"].dataType
    id_list = pa.list_(to_arrow_type(id_type))
    range_type = ArrayType(StructType().add("start", LongType()).add("end", LongType()))

    def run(batches):
        for batch in slices(batches, hidden, 64_000_000 if several else 2_000_000):
            texts = batch.column(len(keep)).to_pylist()
            n_words, ranges, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for k, (files, rows) in enumerate(groups.value):
                tables = _tables((mark, k), files, rows, window)
                for i, t in enumerate(texts):
                    n_words[i], found, ids = search_text(t, tables)
                    if found:
                        ranges[i] = merged([*ranges[i], *found])
                        items[i] |= ids
            arrays = [pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in ranges], kind), pa.array([sorted(x - {None}) for x in items], id_list)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *own])

    hidden = unused("text", keep)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    return given.mapInArrow(run, given.drop(hidden).schema.add("n_words", LongType()).add("hit_ranges", range_type).add("items", ArrayType(id_type)))


def report(found: DataFrame, keep: list[str]) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from the result of ``find``."""
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
