"""I-Match fingerprints with randomised lexicons, with DataFrame operations only.

The lexicon is the terms within a band of inverse document frequency, counted over all documents. As the band's
ends are shares of the documents, the lexicon does not grow with them: at most (terms of a document) / min_share
terms stand in min_share of all. It is held as a Bloom filter: a table of bits, of which each term sets several. A text's
distinct terms of the lexicon are sorted, and each of several random subsets of the lexicon gives one component:
the hash of the sorted terms that lie in the subset. Subsets keep from a half to 1/512 of the lexicon, so some
components survive small changes only and others large ones. The likeness of two fingerprints is the share of
equal components among those that either of them has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.common import written

LEAST_CELLS = 1 << 22
#: Bits held for a term of the lexicon, and set by it: of the other terms (1 - exp(-4 / 16)) ** 4 = 0.24 % pass at most.
CELLS_PER_TERM, PROBES = 16, 4
#: More bits than these (128 MiB, 67 million terms) are refused.
MOST_CELLS = 1 << 30
WORDS_PER_BLOCK = 1024
#: Families of nested random subsets: 1 of so many terms is kept.
FAMILIES = (*[(2, 8, 32)] * 2, *[(32, 128, 512)] * 14)
#: Documents in a range of neighbouring ids, ranges at most, and drawn rows for each bound between two ranges.
RANGE_ROWS, MOST_RANGES, DRAWN_FOR_BOUND = 512, 30_000, 16


def terms(text: Column) -> Column:
    """Hashes of the distinct terms (runs of letters and digits, lower-cased)."""
    hashed = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.xxhash64(t))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")))


def _cells(term: Column, cells: int) -> list[Column]:
    """The bits that a term sets; ``cells`` is a power of two."""
    first, step = term.bitwiseAND(F.lit(cells - 1)), F.shiftrightunsigned(term, 32).bitwiseOR(F.lit(1))
    return [(first + step * i).bitwiseAND(F.lit(cells - 1)) for i in range(PROBES)]


def band(docs: DataFrame, text: str = "text", *, max_share: float = 0.05, min_share: float = 1e-5, min_docs: int = 2) -> DataFrame:
    """The terms of the lexicon: those that stand in at least ``min_share`` of the documents, and in ``min_docs``, and in
    at most ``max_share``. That is the band of inverse document frequency from -log(max_share) to -log(min_share), but for
    the few documents of a small table."""
    n = docs.count()
    low = max(min_docs, ceil(min_share * n))
    seen = docs.select(F.explode(terms(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return seen.where(F.col("n").between(low, max(low, int(max_share * n)))).select("term")


def lexicon(inside: DataFrame) -> tuple[DataFrame, int]:
    """The terms of a band as one row of bits (``blocks``: WORDS_PER_BLOCK numbers of 64 bits each), and how many bits.

    The row is put together by Spark, block by block, so its size is known before: CELLS_PER_TERM bits a term, up to the
    next power of two. A band of texts with d distinct terms on average has at most d / min_share terms, whatever the
    number of documents; ValueError asks for a narrower band if that is more than MOST_CELLS bits.
    """
    cells = max(LEAST_CELLS, 64 * WORDS_PER_BLOCK, 1 << max(0, CELLS_PER_TERM * inside.count() - 1).bit_length())
    if cells > MOST_CELLS:
        raise ValueError(f"a lexicon of {cells} bits is more than {MOST_CELLS}: raise min_share")
    at = F.explode(F.array(*_cells(F.col("term"), cells))).alias("cell")
    word = F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")
    words = inside.select(at).groupBy(F.shiftright("cell", 6).alias("word")).agg(word)
    grid = inside.sparkSession.range(cells // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    block = F.floor(F.col("word") / WORDS_PER_BLOCK).alias("block")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    blocks = written(grid.groupBy(block).agg(ordered["bits"].alias("bits")))
    return blocks.agg(F.array_sort(F.collect_list(F.struct("block", "bits")))["bits"].alias("blocks")), cells  # one row of checked size


def _drawn(family: int, rate: int):
    """Whether a term belongs to the family's subset that keeps 1 of ``rate`` terms."""
    return lambda t: F.pmod(F.xxhash64(t, F.lit(family)), F.lit(rate)) == 0


@contextmanager
def membership(words: DataFrame, cells: int) -> Iterator[Callable[[Column], Column]]:
    """The test whether a term is in the lexicon, for plans made inside the ``with`` block.

    The lexicon's row becomes the value of a session variable, which Spark folds to a constant of the plan: it goes to
    tasks with their code, once, and never through Python.
    """
    spark, name = words.sparkSession, f"lexicon_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<ARRAY<BIGINT>>")
    try:
        spark.sql(f"SET VAR {name} = (SELECT blocks FROM {{words}})", words=words)
        bits = F.expr(f"session.{name}")

        def set_(cell: Column) -> Column:
            word = F.shiftright(cell, 6)
            of = F.element_at(bits, (F.shiftright(word, WORDS_PER_BLOCK.bit_length() - 1) + 1).cast("int"))
            return F.getbit(F.element_at(of, (word.bitwiseAND(F.lit(WORDS_PER_BLOCK - 1)) + 1).cast("int")), cell.bitwiseAND(F.lit(63)).cast("int")) == 1

        yield lambda t: F.forall(F.array(*_cells(t, cells)), set_)  # the lexicon stands in the plan once
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")  # the plans keep the value


def known_terms(text: Column, known: Callable[[Column], Column]) -> Column:
    """A text's terms of the lexicon, sorted. ``sort_array`` compares numbers; ``array_sort`` would evaluate a lambda for each comparison."""
    return F.sort_array(F.filter(terms(text), known))


def with_known(df: DataFrame, texts: list[str], words: DataFrame, cells: int, into: str) -> DataFrame:
    """Add ``into``: for each of the texts its sorted terms of the lexicon."""
    with membership(words, cells) as known:
        return df.withColumn(into, F.transform(F.array(*texts), lambda text: known_terms(text, known)))


def _described(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add parts and fingerprint, with the prefix ``into``, of a text whose terms of the lexicon are there as known."""
    df = with_parts(df, F.col(f"{into}known"), f"{into}parts")
    return df.withColumn(f"{into}fingerprint", written_out(F.col(f"{into}parts"), F.col(text)))


def with_parts(df: DataFrame, known: Column, into: str) -> DataFrame:
    """Add ``into``: one hash per random subset of the lexicon, null where there is no term in the subset."""
    out, subsets = df.withColumn("__kept", known), []
    for level in range(len(FAMILIES[0])):
        layer = {}
        for k, rates in enumerate(FAMILIES):
            above = f"__kept_{k}_{level - 1}" if level else "__kept"
            layer[f"__kept_{k}_{level}"] = F.filter(above, _drawn(k, rates[level]))
        out = out.withColumns(layer)
        subsets += layer
    none = F.xxhash64(F.array().cast("array<bigint>"))
    hashes = F.transform(F.array(*[F.xxhash64(c) for c in subsets]), lambda x: F.when(x != none, x))
    return out.withColumn(into, hashes).drop("__kept", *subsets)


def likeness(a: Column, b: Column) -> Column:
    """Equal components among those that either fingerprint has."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.try_divide(same.cast("double"), either.cast("double"))


def written_out(parts: Column, text: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for a component, - for one that is missing; for a text
    without any component, a digest of the text."""
    digits = F.array_join(F.transform(parts, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit("-"))), ":")
    return F.when(F.exists(parts, lambda x: x.isNotNull()), digits).otherwise(F.concat(F.lit("text:"), F.md5(text.cast("binary"))))


def _with_range(rows: DataFrame, order: tuple[str, ...], n: int) -> DataFrame:
    """Add ``range``: ascending numbers of ranges of about RANGE_ROWS rows in the order of the columns ``order``.

    The bounds are every DRAWN_FOR_BOUND-th of rows drawn by a hash, so their number is bounded (MOST_RANGES) and they
    follow the rows, whatever the columns' types and values. They are looked up in two levels.
    """
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    me = F.struct(*order)
    drawn = rows.where(F.pmod(F.xxhash64(*order), F.lit(max(1, n // (ranges * DRAWN_FOR_BOUND)))) == 0).select(*order)
    place = F.row_number().over(Window.orderBy(*order))  # about MOST_RANGES x DRAWN_FOR_BOUND short rows at most
    bounds = drawn.withColumn("place", place).where(F.col("place") % DRAWN_FOR_BOUND == 0).orderBy("place").select(F.to_json(me).alias("bound"))
    found = [json.loads(r["bound"]) for r in bounds.collect()]
    if not found:
        return rows.withColumn("range", F.lit(0))
    step = isqrt(len(found)) + 1
    groups = [{"first": found[i], "all": found[i : i + step]} for i in range(0, len(found), step)]
    one = rows.select(me.alias("x")).schema["x"].dataType.simpleString()
    table = F.from_json(F.lit(json.dumps(groups)), f"array<struct<first:{one},all:array<{one}>>>")  # folded to a constant
    coarse = F.size(F.filter(table, lambda g: g["first"] <= me))
    fine = F.size(F.filter(F.element_at(table, F.greatest(coarse, F.lit(1)))["all"], lambda b: b <= me))
    return rows.withColumn("range", F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine))


def fingerprint_and_compare(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by as many of the next document's first code points
    as it has; the next document is the next in ascending key order (null keys first, ties by a hash of the text),
    after the last the first. A null text counts as empty. Keys may have any type that sorts and that JSON holds.
    Rows are dealt by ranges of (key, tie), each of about RANGE_ROWS rows, so neither far-off ids nor one repeated id
    fill a task; the first text of a range also goes to the range before it. Repeated rows get the same
    fingerprint. An empty table gives an empty result; other columns are not read.
    """
    words, cells = lexicon(written(band(docs, text)))
    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # rows equal in key and text are split at random; which of them comes first does not matter
    own = _with_range(own.withColumn("lot", F.xxhash64(F.monotonically_increasing_id())), ("key", "tie", "lot"), docs.count()).drop("lot")

    firsts = own.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("head"))  # at most MOST_RANGES + 1 rows
    order = Window.orderBy("range")
    firsts = firsts.select("head.*", F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    firsts = firsts.withColumnsRenamed({"key": "head_key", "tie": "head_tie"})
    heads = own.join(F.broadcast(firsts), F.col("key").eqNullSafe(F.col("head_key")) & (F.col("tie") == F.col("head_tie")))
    heads = heads.select(F.col("to").alias("range"), "text").dropDuplicates(["range"])

    # each text is fingerprinted once, in its place in the order; the row before it takes that over with the text
    following = Window.partitionBy("range").orderBy("key", "tie")
    whole = F.struct("text", "known", "parts", "fingerprint")
    half = F.floor(F.col("n") / 2).cast("int")
    with membership(words, cells) as known:
        placed, heads = (_described(df.withColumn("known", known_terms(F.col("text"), known)), "text", "") for df in (own.repartition("range").sortWithinPartitions("range", "key", "tie"), heads))
        rows = placed.withColumn("next", F.lead(whole).over(following)).join(heads.select("range", whole.alias("head")), "range", "left")
        rows = rows.select("key", "text", "known", "parts", "fingerprint", F.length("text").alias("n"), F.coalesce("next", "head").alias("next"))
        rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next.text", F.lit(1), half)))
        # most terms of the edited text are those of the two: only the others, as words that the cut makes, are looked up
        rows = rows.withColumns({"found": F.concat("known", "next.known"), "terms": terms(F.col("edited"))})
        rows = rows.withColumn("edited_known", F.sort_array(F.concat(F.array_intersect("terms", "found"), F.filter(F.array_except("terms", "found"), known))))
    rows = _described(rows, "edited", "edited_")

    def near(parts: str, name: str) -> Column:
        return F.coalesce(likeness(F.col("parts"), F.col(parts)), (F.col("fingerprint") == F.col(name)).cast("double"))

    return rows.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near("edited_parts", "edited_fingerprint").alias("near_edited"), near("next.parts", "next.fingerprint").alias("near_next"),
    )
