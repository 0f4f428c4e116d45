"""Near-duplicate documents by Order MinHash, with candidates verified by banded alignment of their words.

The k-mers of a text are its runs of five words, each labelled with its occurrence (how many equal ones stand
before it), so all labelled k-mers of a text differ. For each of several hash functions a sketch takes the two
k-mers of least hash and keeps them in the order of the text; two texts agree in a sketch if they share both
k-mers in the same order. Sketches give candidate buckets, and each pair of texts in a bucket is
verified or proven to be in one class already, in three steps. First, small buckets give all their pairs, and in the
others each text is compared with the one before it in a random order (which differs from bucket to bucket); that
joins groups whose texts are all alike. Second, in large buckets that still hold several
classes each text is compared with the text of most links, the likely original of independently edited copies. Last,
what still holds several classes is compared whole, block by block: the common words of all pairs of two blocks are
counted at once, and the pairs whose counts allow a link are aligned. Only this last step grows with the square of a
bucket, and only in texts that are not yet in one class.
Alignment: the longest common subsequence of the words of two texts within a band, as wide as texts of the likeness
asked for can drift apart. In long texts, labelled k-mers anchor it: they are unique in a text, so the longest chain
of common ones in ascending order is aligned first, and then what lies between; where that gives no link but the
words' counts would allow one, they are aligned without anchors. The likeness of two texts is aligned words over all
words. Equal texts are one node from the start. Links are closed to classes
by connected components.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.common import slices, written
from vecatlas.llm.components import labels

# Bytes that belong to words (after lower-casing A-Z) are 0-9, a-z and all of 0x80-0xFF.
_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 28) - 1)  # low bits of a hash that hold the k-mer's place
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SMALL = 4  # buckets of so many texts give all their pairs at once
_HUB = 200  # in larger buckets the text of most links is compared with all others before the blocks are
_HUB_PARTS = 32
_LARGE_CLASS = 16  # members in a bucket from which on the largest class is compared with its strangers of all buckets at once
_ANCHORED = 2000  # words from which on texts are anchored before they are aligned
_FEW_HUBS = 10_000  # rows of three short columns


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    data = np.frombuffer(b"".join([b" " + (t or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS) for t in texts]) + b" ", dtype=np.uint8)
    sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts])
    text_at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    word = np.concatenate(([False], data != 32, [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        # Horner's rule over all words at once, one byte a step, words that have ended dropping out
        length = end - begin
        order = np.argsort(-length, kind="stable")
        running = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
        hashes = length.astype(np.uint64)[order]
        at = begin[order]
        for i, n in enumerate(running.tolist()):
            hashes[:n] = (hashes[:n] ^ data[at[:n] + i]) * _STEP
        words = np.empty_like(hashes)
        words[order] = hashes
        return _mixed(words), np.diff(np.searchsorted(begin, np.concatenate((text_at, [len(data)]))))


def kmers_of(words: np.ndarray, n_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled k-mers of texts given as word hashes, in order, and their number in each text.

    A text of fewer than k words, but not none, is one k-mer.
    """
    with np.errstate(over="ignore"):
        counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        first_word = np.cumsum(n_words) - n_words
        total = int(counts.sum())
        text_of = np.repeat(np.arange(len(n_words)), counts)
        start = np.repeat(first_word - (np.cumsum(counts) - counts), counts) + np.arange(total)
        span = np.minimum(n_words, k)[text_of]
        kmers = span.astype(np.uint64)
        for i in range(k):
            has = span > i
            part = words[np.minimum(start + i, max(len(words) - 1, 0))] if len(words) else np.zeros(total, np.uint64)
            kmers = np.where(has, kmers * _MIX + part, kmers)
        kmers = _mixed(kmers)
        own = kmers ^ _mixed(text_of.astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        same = np.concatenate(([False], own[order][1:] == own[order][:-1]))
        group_at = np.maximum.accumulate(np.where(same, 0, np.arange(total)))
        label = np.empty(total, dtype=np.uint64)
        label[order] = (np.arange(total) - group_at).astype(np.uint64)
        return np.where(label > 0, _mixed(kmers + label * _STEP), kmers), counts


def labelled_kmers(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled k-mers of all texts in order, and their number in each text."""
    return kmers_of(*word_hashes(texts), k)


def band_keys(texts: list[str | None], *, bands: int, per_band: int, k: int, seed: int = 11) -> np.ndarray:
    """Texts x bands: the key of each band of Order MinHash sketches of two k-mers; texts without words get zeros."""
    kmers, counts = labelled_kmers(texts, k)
    out = np.zeros((len(texts), bands), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    counts = counts[some]
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(kmers)) - np.repeat(starts, counts)).astype(np.uint64) & _PLACE
    factors = np.random.default_rng(seed).integers(1 << 62, dtype=np.uint64, size=bands * per_band) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(factors):
            value = kmers * factor
            value ^= value >> np.uint64(32)
            value |= _PLACE
            value ^= _PLACE
            value |= place
            pair = []
            for _ in range(2):
                least = np.minimum.reduceat(value, starts)
                at = starts + np.minimum((least & _PLACE).astype(np.int64), counts - 1)
                pair.append((np.where(least == _NONE, -1, at), least == _NONE))
                value[at] = _NONE
            (a, _), (b, alone) = pair
            early, late = kmers[np.where(alone, a, np.minimum(a, b))], np.where(alone, _STEP, kmers[np.maximum(a, b)])
            out[some, j // per_band] = _mixed(out[some, j // per_band] * _STEP + _mixed(early * _MIX + late) + np.uint64(j + 1))
    return out


def _chain(places: np.ndarray) -> np.ndarray:
    """Which of the places make up a longest ascending chain."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return np.arange(len(places))
    tails: list[int] = []
    last: list[int] = []  # the element that ends the best chain of each length
    before: list[int] = []
    for at, x in enumerate(places.tolist()):
        i = bisect_left(tails, x)
        before.append(last[i - 1] if i else -1)
        if i == len(tails):
            tails.append(x)
            last.append(at)
        else:
            tails[i], last[i] = x, at
    out, at = [], last[-1]
    while at >= 0:
        out.append(at)
        at = before[at]
    return np.array(out[::-1])


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int | None = None, need: float = 0) -> int:
    """The length of the longest common subsequence, all of ``a`` at once in the bits of one number; with ``band``, of
    pairs that are at most so many places apart. 0 once it is clear to be less than ``need``."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    inside = full if band is None else (1 << (2 * band + 1)) - 1
    left, get, n, m = full, where.get, len(a), len(b)  # left: a zero bit for each step of the subsequence
    for j, x in enumerate(b.tolist()):
        hit = left & get(x, 0)
        if hit and band is not None:
            hit &= inside << (j - band) if j > band else inside >> (band - j)
        if hit:
            left = ((left + hit) | (left - hit)) & full
        if j & 31 == 31 and n - left.bit_count() + m - 1 - j < need:
            return 0
    found = n - left.bit_count()
    return found if found >= need else 0


def similarity(a: np.ndarray, b: np.ndarray, at_least: float, k: int = 5) -> float:
    """Banded alignment of two texts given as word hashes: aligned words over all words; 0 where the texts are
    less alike than ``at_least``.

    The band is as wide as two texts of this likeness can drift apart. Long texts are anchored first.
    """
    n, m = len(a), len(b)
    need = at_least / (1 + at_least) * (n + m) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    band = int(n + m - 2 * need) + 1  # words that may be left unaligned
    if max(n, m) <= _ANCHORED:
        aligned = common_subsequence(a, b, band, need)
        return aligned / (n + m - aligned)
    one, both = np.array([n]), np.array([m])
    if len(np.intersect1d(kmers_of(a, one, 1)[0], kmers_of(b, both, 1)[0], assume_unique=True)) < need:
        return 0.0
    _, ia, ib = np.intersect1d(kmers_of(a, one, k)[0], kmers_of(b, both, k)[0], assume_unique=True, return_indices=True)
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    chain = _chain(ib)
    ia, ib = ia[chain], ib[chain]
    # runs of neighbouring anchors on one diagonal
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(ia) != 1) | (np.diff(ib) != 1)))) if len(ia) else np.zeros(0, np.int64)
    ends = np.concatenate((starts[1:], [len(ia)]))[: len(starts)] - 1
    span = min(k, n, m)
    aligned, x, y, gaps = 0, 0, 0, []
    for i, j, length in zip(ia[starts].tolist(), ib[starts].tolist(), (ia[ends] - ia[starts] + span).tolist(), strict=True):
        over = max(x - i, y - j, 0)  # words that the run before has aligned already
        if over < length:
            gaps.append((x, i + over, y, j + over))
            aligned += length - over
            x, y = i + length, j + length
    gaps.append((x, n, y, m))
    room = sum(min(p - o, q - r) for o, p, r, q in gaps)
    for o, p, r, q in sorted(gaps, key=lambda g: min(g[1] - g[0], g[3] - g[2])):
        if aligned + room < need:
            break
        least = min(p - o, q - r)
        if least:
            found = common_subsequence(a[o:p], b[r:q])
            aligned, room = aligned + found, room - least
    if aligned < need:  # repetitive texts may be anchored badly
        aligned = common_subsequence(a, b, band, need)
    return aligned / (n + m - aligned) if aligned >= need else 0.0


def _common(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x n: how many values two different owners share (each has a value once). Frequent values by matrix product, others by their pairs."""
    _, column = np.unique(values, return_inverse=True)
    owner = owner[np.argsort(column, kind="stable")]
    size = np.bincount(column)
    at = np.cumsum(size) - size
    out = np.zeros((n, n))
    most = max(16, n // 10)
    frequent = np.flatnonzero(size > most)
    for start in range(0, len(frequent), 2048):
        part = frequent[start : start + 2048]
        has = np.zeros((n, len(part)), dtype=np.float32)
        for i, c in enumerate(part.tolist()):
            has[owner[at[c] : at[c] + size[c]], i] = 1
        out += has @ has.T
    flat = out.reshape(-1)
    for d in np.unique(size[(size > 1) & (size <= most)]).tolist():
        first = at[size == d]
        step = max(1, 2_000_000 // (d * d))
        for start in range(0, len(first), step):
            who = owner[first[start : start + step, None] + np.arange(d)]
            index, count = np.unique((who[:, :, None] * n + who[:, None, :]).ravel(), return_counts=True)
            flat[index] += count
    return out


def links_of_block(words: list[np.ndarray], roots: list, block: list, at_least: float, k: int) -> list[tuple[int, int, float]]:
    """Links that join the classes (``roots``) of all texts of one block, or of two, as (i, j, aligned).

    Every pair of different classes (with two blocks: across them) is decided by its count of common words, by
    alignment, or by links found before that put both into one class.
    """
    n = len(words)
    length = np.array([len(x) for x in words])
    _, root = np.unique(np.array([x.hex() for x in roots]), return_inverse=True)
    side = np.array(block)
    wanted = np.triu(root[:, None] != root[None, :], 1)
    if (side != side[0]).any():
        wanted &= side[:, None] != side[None, :]
    common = _common(kmers_of(np.concatenate(words), length, 1)[0], np.repeat(np.arange(n), length), n)
    likely = common / np.maximum(length[:, None] + length[None, :] - common, 1)
    a, b = np.nonzero(wanted & (likely >= at_least - 1e-9))
    parent = list(range(int(root.max()) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for at in np.argsort(-likely[a, b], kind="stable").tolist():
        i, j = int(a[at]), int(b[at])
        x, y = find(int(root[i])), find(int(root[j]))
        if x != y:
            aligned = similarity(words[i], words[j], at_least, k)
            if aligned >= at_least:
                parent[x] = y
                out.append((i, j, aligned))
    return out


def _node(text: str):
    """The digest that stands for all equal texts."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def _classes(docs: DataFrame, key: str, text: str, at_least: float, k: int, bands: int, per_band: int, run_length: int, block_words: int):
    """Tables: a row's key and node; a node's least key, number of rows and class root; verified links."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), _node(text).alias("node"))

    def sketch(batches):
        for batch in slices(batches, "text", 2_000_000):
            keys = band_keys(batch.column(2).to_pylist(), bands=bands, per_band=per_band, k=k)
            has = pa.array(~keys.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()), mask=has)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["key", "node", "bands"])

    key_type = rows.schema["key"].dataType.simpleString()
    sketches = written(rows.select("key", "node", "text").mapInArrow(sketch, f"key {key_type}, node binary, bands array<bigint>"))
    nodes = sketches.groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("n_rows"), F.any_value("bands").alias("bands"))
    nodes = written(nodes)
    member = nodes.where("bands is not null").select("node", F.explode("bands").alias("band"))
    bucket = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    small = min(_SMALL, run_length)
    shared = written(member.join(bucket, "band"))
    inside = shared.withColumn("run", F.pmod(F.xxhash64("band", "node"), F.ceil(F.col("n") / run_length)))
    order = Window.partitionBy("band", "run").orderBy(F.hash("node", "band"), "node")
    before = [F.lag("node").over(order), *(F.when(F.col("n") <= small, F.lag("node", i).over(order)) for i in range(2, small))]
    pairs = inside.select("node", F.array(*before).alias("others")).select("node", F.explode("others").alias("other")).where("other is not null and node <> other")
    pairs = written(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("key").alias("of")), "node")

    def split(batches):
        for batch in slices(batches, "text", 2_000_000):
            found, counts = word_hashes(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            parts = [found[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary()), pa.array(counts, pa.int64())], names=["node", "words", "size"])

    source = rows.join(wanted, (rows["node"] == wanted["node"]) & rows["key"].eqNullSafe(wanted["of"])).select(rows["node"], rows["text"])
    texts = written(source.dropDuplicates(["node"]).mapInArrow(split, "node binary, words binary, size bigint"))

    def verify(batches):
        for batch in slices(batches, "wa", 4_000_000):
            a, b, wa, wb = (batch.column(i).to_pylist() for i in range(4))
            found = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), at_least, k) for x, y in zip(wa, wb, strict=True)]
            keep = [i for i, x in enumerate(found) if x >= at_least]
            columns = [pa.array([x[i] for i in keep], kind) for x, kind in ((a, pa.binary()), (b, pa.binary()), (found, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "aligned"])

    def verified(pairs, parts=1):
        """The pairs that are links. With ``parts``, each text of side a meets its partners in so many tasks."""
        left, right = (texts.select(F.col("node").alias(x), F.col("words").alias(f"w{x}")) for x in "ab")
        on = ["a"]
        if parts > 1:
            on = ["a", "part"]
            pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
            left = left.join(pairs.select("a").distinct(), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        both = pairs.join(left, on).join(right, "b").select("a", "b", "wa", "wb")
        return both.mapInArrow(verify, "a binary, b binary, aligned double").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "aligned")

    def of_several_classes(members, roots):
        """The members, with the roots of their classes, of the buckets that still hold more than one class. A text is
        looked up once, not once for each of its buckets."""
        each = members.groupBy("node").agg(F.collect_list(F.struct("band", "n")).alias("of")).join(roots, "node", "left")
        rooted = written(each.withColumn("root", F.coalesce("root", "node")).select("*", F.inline("of")).drop("of"))
        return written(_several(rooted, "band"))

    links = written(verified(pairs))
    roots = labels(links)  # without the roots themselves
    facts = texts.select("node", "size").join(roots, "node", "left").join(_degrees(links, "degree"), "node", "left")
    mixed = of_several_classes(shared.where(F.col("n") > small), facts)

    def joined(found):
        return labels(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found.select("a", "b")))

    large = mixed.where(F.col("n") > _HUB)
    if large.limit(1).count():
        hub = large.where("degree is not null").groupBy("band").agg(F.max(F.struct("degree", "node", "root")).alias("hub"))
        hub = written(hub.select("band", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root")))
        # a hub's partners in one bucket are met in HUB_PARTS tasks
        spokes = large.join(F.broadcast(hub) if hub.count() <= _FEW_HUBS else hub, "band").where("root <> hub_root").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        found = written(verified(written(spokes), _HUB_PARTS).distinct())
        links, roots = written(links.unionByName(found)), joined(found)
        mixed = of_several_classes(mixed, texts.select("node", "size").join(roots, "node", "left"))

    if mixed.limit(1).count():
        found = written(_by_blocks(mixed, texts, at_least, k, block_words).distinct())
        links, roots = written(links.unionByName(found)), joined(found)

    labelled = nodes.select("node", "key", "n_rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return sketches.select("key", "node"), labelled, links


def _degrees(links: DataFrame, into: str) -> DataFrame:
    """The number of links of each node that has any."""
    return links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias(into))


def _several(rows: DataFrame, of: str) -> DataFrame:
    """The rows of those ``of`` that hold more than one root."""
    several = rows.groupBy(of).agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select(of)
    return rows.join(several, of)


def _by_blocks(mixed: DataFrame, texts: DataFrame, at_least: float, k: int, block_words: int) -> DataFrame:
    """Links between different classes of a bucket, from comparing its members in blocks of about ``block_words``.

    Texts can be alike only if their sizes are, so a bucket is cut into windows of two neighbouring classes of size,
    and windows of one class need no comparison. The largest class of a window, if it has many members there (as of
    copies with strangers beside them), is compared once with all strangers that it meets in any bucket; what else
    the window holds is compared within it.
    """
    size = F.greatest("size", F.lit(1))
    cell = F.floor(F.log(size) / F.log(F.lit(1 / at_least)) + 1e-9).cast("int")
    sized = mixed.withColumn("cell", cell).select("band", F.explode(F.array("cell", F.col("cell") + 1)).alias("w"), "node", "root", F.greatest("size", F.lit(500)).alias("weight"))
    sized = written(sized.withColumn("window", F.xxhash64("band", "w")).drop("band", "w"))
    held = sized.groupBy("window", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    held = held.groupBy("window").agg(F.count("*").alias("classes"), F.sum("weight").alias("weight"), F.max(F.struct("n", "root", "weight")).alias("top")).where("classes > 1")
    has_large = F.col("top.n") >= _LARGE_CLASS
    left = F.col("classes") - F.when(has_large, 1).otherwise(0)
    blocks = F.ceil((F.col("weight") - F.when(has_large, F.col("top.weight")).otherwise(0)) / block_words)
    held = held.select("window", F.when(has_large, F.col("top.root")).alias("of"), left.alias("left"), blocks.alias("blocks"))
    members = written(sized.join(held, "window"))

    def task(of: str, x: Column, y: Column) -> Column:
        return F.sha2(F.to_json(F.struct(of, x.alias("x"), y.alias("y"))), 256).alias("task")

    def in_block(blocks: Column) -> Column:
        return F.pmod(F.xxhash64("node"), blocks)

    def each(blocks: Column) -> Column:
        """Numbers of the blocks that a row's block meets: a row for each, without looking for those that have rows."""
        return F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")

    # the largest classes' blocks and their strangers'
    met = written(members.where("of is not null").select("of", "node", "root", "weight", (F.col("root") == F.col("of")).alias("own")).distinct())
    count = lambda side: F.ceil(F.sum(F.when(side, F.col("weight"))) / block_words)
    totals = met.groupBy("of").agg(count(F.col("own")).alias("here"), count(~F.col("own")).alias("there"))
    met = met.join(totals, "of").withColumns({"here": F.when(F.col("own"), F.col("here")).otherwise(F.col("there")), "there": F.when(F.col("own"), F.col("there")).otherwise(F.col("here"))})
    met = met.select("of", "node", "root", "own", in_block(F.col("here")).alias("block"), each(F.col("there")))
    of_sides = [F.when(F.col("own"), F.col(x)).otherwise(F.col(y)) for x, y in (("block", "other"), ("other", "block"))]
    by_class = met.select(task("of", *of_sides), F.lit(2).alias("sides"), F.concat(F.when(F.col("own"), "own").otherwise("other"), F.col("block").cast("string")).alias("block"), "node", "root")

    # what else the windows hold
    rest = members.where("left > 1 and (of is null or root <> of)").select("window", "node", "root", in_block(F.col("blocks")).alias("block"), each(F.col("blocks")))
    of_window = task("window", F.least("block", "other"), F.greatest("block", "other"))
    by_window = rest.select(of_window, F.when(F.col("block") == F.col("other"), 1).otherwise(2).alias("sides"), F.col("block").cast("string").alias("block"), "node", "root")
    rows = by_class.unionByName(by_window).join(texts.select("node", "words"), "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        nodes, block = group["node"].to_pylist(), group["block"].to_pylist()
        words = [np.frombuffer(x, np.uint64) for x in group["words"].to_pylist()]
        met = len(set(block)) == group["sides"][0].as_py()  # else no row lies in the other block
        found = links_of_block(words, group["root"].to_pylist(), block, at_least, k) if met else []
        columns = [([nodes[i] for i, _, _ in found], pa.binary()), ([nodes[j] for _, j, _ in found], pa.binary()), ([x for _, _, x in found], pa.float64())]
        return pa.table([pa.array(x, kind) for x, kind in columns], names=["a", "b", "aligned"])

    return rows.groupBy("task").applyInArrow(compare, "a binary, b binary, aligned double")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", at_least: float = 0.8, k: int = 5, bands: int = 32, per_band: int = 1, run_length: int = 500, block_words: int = 500_000
) -> DataFrame:
    """One row per row of ``docs``: key, class_id (the least key of its class), class_size (rows) and n_links
    (links of its text to other texts that were verified).

    Two texts are linked if aligned words over all words are ``at_least``; each pair that shares a band is verified,
    unless other links have put both into one class already.
    Equal texts are one class; a null text counts as empty, and texts without words are only equal to equal
    texts. Repeated rows and keys are kept. An empty table gives an empty result; columns other than key and text
    are not read.
    """
    rows, labelled, links = _classes(docs, key, text, at_least, k, bands, per_band, run_length, block_words)
    degree = _degrees(links, "n_links")
    classes = labelled.groupBy("root").agg(F.min("key").alias("class_id"), F.sum("n_rows").alias("class_size"))
    of_node = labelled.join(classes, "root").join(degree, "node", "left").select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # a table of its own on either side of the join, so that AQE can split a text with very many copies
    return rows.join(written(of_node), "node").select(F.col("key").alias(key), "class_id", "class_size", "n_links")


def deduplicate(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", at_least: float = 0.8, k: int = 5, bands: int = 32, per_band: int = 1, run_length: int = 500, block_words: int = 500_000
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the least key of their class: one row of each class.

    Of repeated rows with equal key and text one stays (their other columns may differ: any one of them).
    """
    rows, labelled, _ = _classes(docs, key, text, at_least, k, bands, per_band, run_length, block_words)
    chosen = labelled.groupBy("root").agg(F.min(F.struct("key", "node")).alias("of")).select(F.col("of.node").alias("__chosen"), F.col("of.key").alias("__key"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{key}`").alias("__own"), _node(text).alias("__node"))
    kept = left.join(chosen, (F.col("__node") == F.col("__chosen")) & F.col("__own").eqNullSafe(F.col("__key")))
    if rows.groupBy("node", "key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["__node"])
    return kept.select("__row.*")
