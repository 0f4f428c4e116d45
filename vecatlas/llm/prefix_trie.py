"""The prefix trie of conversations by truncation peeling.

A prefix is known by 128 bits: the exclusive or of its turns' hashes, each with its place. Conversations are peeled from
their greatest depth: those that end at a depth join the nodes that survived from below, the last turn is stripped, and what
has the same prefix now becomes one node; all of a node's figures are there when it is met. Subtrees of at most
``at_once`` turns are peeled whole, many in a task. What survives at their tops goes on, truncated, and is regrouped by one
aggregation: conversations whose truncated forms are equal become one, for the next round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.common import written

NODE = ["na", "nb"]
FIGURES = ["n", "kids", "leaves", "saved"]
PEELED = "na long, nb long, pa long, pb long, depth long, conv long, n long, kids long, leaves long, saved long, top boolean"
PIECE_BYTES = 1 << 20


def _ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and sorted, with each row's ``range`` and its ``place`` in it from 0; written."""
    at = F.monotonically_increasing_id()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(dealt.select("*", F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv, i (from 1, by turn, null first; then role and text), role, text. A conversation may lie in several ranges."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = _ranged(rows, "conv", F.asc_nulls_first("turn"), "role", F.xxhash64("text"))
    parts = dealt.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    so_far = Window.partitionBy("conv").orderBy("range")  # a row for each range that the conversation lies in
    parts = parts.select("conv", "range", "first", (F.sum("n").over(so_far) - F.col("n")).alias("before"))
    return dealt.join(parts, ["conv", "range"]).select("conv", (F.col("before") + F.col("place") - F.col("first") + 1).alias("i"), "role", "text", "range")


def rebuilt(turns: DataFrame, step: int = 100, most: int = 6) -> DataFrame:
    """conv, k, ha, hb, len, range: the turns (k from 1) of each conversation c, the first h of them those of conversation
    c - c % step, with h = crc32(c) % most; hashes of place, role and text, and the text's code points."""
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    of = own.select("conv", (F.col("conv") - F.col("conv") % step).alias("base"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).alias("h"))
    heads = turns.where((F.col("i") < most) & (F.col("conv") % step == 0)).select(F.col("conv").alias("base"), "i", "role", "text")
    taken = of.join(heads, "base").where("i <= h").select("conv", F.col("i").alias("k"), "role", "text", F.lit(-1).cast("long").alias("range"))
    have = own.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    shift = of.join(have, "base", "left").select("conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("from_base"))
    kept = turns.join(shift, "conv").where("i > h").select("conv", (F.col("i") - F.col("h") + F.col("from_base")).alias("k"), "role", "text", "range")
    both = taken.unionByName(kept)
    hashes = [F.xxhash64(F.lit(x), "k", "role", "text").alias(x) for x in ("ha", "hb")]
    return both.select("conv", "k", *hashes, F.length("text").cast("long").alias("len"), "range")


def prefixes(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """conv, k (from 0), na, nb, pa, pb, len, last: each prefix of each conversation, its parent, its last text's length and the
    conversation's number of turns. Running hashes are made within ranges and then over a conversation's ranges."""
    within = Window.partitionBy("conv", "range").orderBy("k")
    run = rows.select("conv", "range", "k", "len", "ha", "hb", F.bit_xor("ha").over(within).alias("ra"), F.bit_xor("hb").over(within).alias("rb"))
    parts = rows.groupBy("conv", "range").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"), F.max("k").alias("k"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    parts = parts.select("conv", "range", *[F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(o) for t, o in (("ta", "oa"), ("tb", "ob"))], F.max("k").over(whole).alias("last"))
    a, b = F.col("ra").bitwiseXOR(F.col("oa")), F.col("rb").bitwiseXOR(F.col("ob"))
    deep = run.join(parts, ["conv", "range"]).select("conv", "k", a.alias("na"), b.alias("nb"), a.bitwiseXOR(F.col("ha")).alias("pa"), b.bitwiseXOR(F.col("hb")).alias("pb"), "len", "last")
    lengths = parts.groupBy("conv").agg(F.max("last").alias("last"))
    zero = F.lit(0).cast("long")
    roots = everyone.join(lengths, "conv", "left").select("conv", zero.alias("k"), *[zero.alias(c) for c in ("na", "nb", "pa", "pb", "len")], F.coalesce("last", zero).alias("last"))
    return deep.unionByName(roots)


def peel(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole subtrees, as distinct nodes with what ended or survived at them: every node with its figures.

    Depth by depth from the greatest: the nodes of a depth are complete; each is stripped of its last turn and merged
    into the node that it then is.
    """
    rows = rows.reset_index(drop=True)
    up = rows[["pa", "pb"]].merge(rows[NODE].assign(at=rows.index), how="left", left_on=["pa", "pb"], right_on=NODE)["at"].fillna(-1).to_numpy(np.int64)
    depth, length = rows["depth"].to_numpy(), rows["len"].to_numpy()
    up = np.where(rows["top"].to_numpy(), -1, up)
    n, kids, leaves, saved = (rows[c].to_numpy().copy() for c in FIGURES)
    conv = rows["conv"].to_numpy().copy()
    for at in np.split(order := np.argsort(-depth, kind="stable"), np.flatnonzero(np.diff(depth[order])) + 1):
        leaves[at[kids[at] == 0]] = 1
        saved[at] += (n[at] - 1) * length[at]
        at = at[up[at] >= 0]
        stripped = up[at]
        for figure, add in ((n, n[at]), (kids, 1), (leaves, leaves[at]), (saved, saved[at])):
            np.add.at(figure, stripped, add)
        np.minimum.at(conv, stripped, conv[at])
    return rows.assign(n=n, kids=kids, leaves=leaves, saved=saved, conv=conv)


def _peel_stream(batches):
    """Peel batches of whole subtrees; rows come sorted by the subtree's top node (ta, tb)."""
    names = [f.split()[0] for f in PEELED.split(", ")]

    def out(table):
        return pa.RecordBatch.from_pandas(peel(table.to_pandas())[names], preserve_index=False)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        ta, tb = held.column("ta").to_numpy(), held.column("tb").to_numpy()
        cut = int(np.flatnonzero(np.concatenate([[True], (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])]))[-1]) if len(ta) else 0
        if cut:
            yield out(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield out(held.combine_chunks())


def _round(rows: DataFrame, items: DataFrame, at_once: int) -> DataFrame:
    """Peel every subtree of at most ``at_once`` turns. items: na, nb, depth, conv (a member, the smallest) and what is
    known so far of the node; rows: the prefixes of all conversations."""
    alive = rows.join(items.select("conv", F.col("depth").alias("until")), "conv").where("k <= until")
    alive = written(alive.select("conv", "k", *NODE, "pa", "pb", "len", "until"))
    below = alive.groupBy(*NODE).agg(F.sum(F.col("until") - F.col("k") + 1).alias("below"))
    small = alive.join(below.where(F.col("below") <= at_once), NODE).groupBy("conv").agg(F.min_by(F.struct(*NODE, "k"), "k").alias("t"))
    small = small.select("conv", F.col("t.na").alias("ta"), F.col("t.nb").alias("tb"), F.col("t.k").alias("from"))
    inside = alive.join(small, "conv").where(F.col("k") >= F.col("from"))
    known = items.select(*NODE, F.col("conv").alias("least"), *FIGURES)
    nodes = inside.groupBy(*NODE).agg(*[F.first(c).alias(c) for c in ("ta", "tb", "pa", "pb", "len")], F.first("k").alias("depth"), (F.first("k") == F.first("from")).alias("top"))
    nodes = nodes.join(known, NODE, "left").select(
        "ta", "tb", *NODE, "pa", "pb", "depth", "len", "top", F.coalesce("least", F.lit((1 << 63) - 1)).alias("conv"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FIGURES]
    )
    return nodes.repartition("ta", "tb").sortWithinPartitions("ta", "tb").mapInArrow(_peel_stream, PEELED)


def _digests(ends: DataFrame) -> DataFrame:
    """na, nb, ends_sha256: of the conversations that end at a node, in ascending order, comma-joined. The ids of a node lie
    in any number of ranges; each range joins its ids to pieces, and a node's pieces are hashed one after another."""

    def pieces(batches):
        node, first, ids, size = None, None, [], 0

        def piece():
            return pa.RecordBatch.from_pydict({"na": [node[0]], "nb": [node[1]], "first": [first], "ids": [",".join(ids)]})

        for batch in batches:
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (a, b) != node or size > PIECE_BYTES:
                    if ids:
                        yield piece()
                    node, first, ids, size = (a, b), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashed(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            for a, b, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (a, b) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("na", "nb", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))
        if node:
            yield pa.RecordBatch.from_pydict({"na": [node[0]], "nb": [node[1]], "ends_sha256": [digest.hexdigest()]})

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select(*NODE, "conv").repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    joined = dealt.mapInArrow(pieces, "na long, nb long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "na long, nb long, ends_sha256 string")


def trie(conversations: DataFrame, *, step: int = 100, most: int = 6, at_once: int = 20_000) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (see ``rebuilt``): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation. Null roles and texts are empty; turns of one number follow in
    the order of role and of a hash of the text; repeated rows are turns each. Other columns are not read. An empty table has no node, not even the root.
    A conversation of T turns of its own takes T / ``at_once`` rounds.
    """
    turns = turns_in_order(conversations)
    everyone = turns.select("conv").distinct()
    rows = written(prefixes(rebuilt(turns, step, most), everyone))
    zero = F.lit(0).cast("long")
    ends = rows.where("k = last").select("conv", *NODE, F.col("k").alias("depth"))
    items = ends.groupBy(*NODE).agg(F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n")).select("*", *[zero.alias(c) for c in FIGURES[1:]])
    items, nodes = written(items), None
    while not items.isEmpty():
        done = written(_round(rows, items, at_once))
        nodes = done if nodes is None else nodes.unionByName(done)
        if not done.where("depth = 0").isEmpty():  # the root is peeled last
            break
        stripped = done.where("top").select(F.col("pa").alias("na"), F.col("pb").alias("nb"), (F.col("depth") - 1).alias("depth"), "conv", "n", F.lit(1).cast("long").alias("kids"), "leaves", "saved")
        waiting = items.join(done.select(*NODE), NODE, "left_anti").select(*NODE, "depth", "conv", *FIGURES)
        sums = [F.sum(c).alias(c) for c in FIGURES]
        items = written(stripped.unionByName(waiting).groupBy(*NODE).agg(F.first("depth").alias("depth"), F.min("conv").alias("conv"), *sums))
    empty = hashlib.sha256().hexdigest()
    if nodes is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    parents = nodes.where("kids > 0").select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv").alias("parent"))
    found = nodes.join(_digests(ends), NODE, "left").join(parents, ["pa", "pb"], "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
