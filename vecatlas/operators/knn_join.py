"""The exact k nearest items of every item of a table: a join of blocks that bounds on distances let skip.

Items lie in cells around centroids, each cell in shells: blocks of rows of like distance to the centroid. Queries of like
cells are blocks as well. A query block first meets the cells nearest to its queries that hold enough rows, which gives every
query a distance within which its k nearest lie. By the triangle inequality a row can only be that near if its distance to its
centroid differs by no more than that from the query's, so a block pair is joined only if its shell is within
reach of one of the queries; and as pairs come in the order of their least distance, those that the bounds reached meanwhile
rule out are passed over. No row is made for a pair of items: a query block holds its k best while it meets its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.operators import cells as sphere
from vecatlas.sources.work import written

BLOCK, ASKED = 512, 1024  # rows of a block, queries of one
PART = 20_000  # rows of a cell that one task sorts into shells
SLACK = 1e-9  # distances this much beyond a bound are still looked at
SHELLS = "cell int, part int, seq int, near double, far double, ids binary, units binary"
FOUND = "block long, ids binary, units binary, best binary, scores binary, joined long, skipped long"


def _raw(lists: pa.ListArray, use: np.ndarray, dimension: int) -> np.ndarray:
    """The vectors at these places in single precision, as the catalogue has them."""
    return lists.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(use), dimension)


def _packed(cell, part, seq, dist, ids, units):
    values = (int(cell), int(part), seq, float(dist[0]), float(dist[-1]), ids.tobytes(), units.tobytes())
    return pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(SHELLS.split(", "), values, strict=True)}, schema=pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.binary()), ("units", pa.binary())]))


def _shells(rows: DataFrame, centroids: np.ndarray, dimension: int) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """Blocks of rows (id, vector) of one cell and of like distance to its centroid; and of each cell the number of rows and its radius."""

    def assign(batches):
        for batch in batches:
            use, units = sphere.unit_matrix(batch.column(1), dimension)
            far = sphere.distances(units, centroids)
            cell = far.argmin(axis=1)
            blobs = pa.array([v.tobytes() for v in _raw(batch.column(1), use, dimension)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use)), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell]), blobs], names=["id", "cell", "dist", "unit"])

    def pack(batches):
        key, held, size, seq = None, [], 0, 0

        def block(n):
            nonlocal held, size
            dist, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            units = np.concatenate([h[2] for h in held])
            held, size = ([(dist[n:], ids[n:], units[n:])] if n < len(ids) else []), len(ids) - n
            return dist[:n], ids[:n], units[:n]

        for batch in batches:
            cell, part = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), [True]])) if batch.num_rows else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if key != (cell[a], part[a]):
                    if size:
                        yield _packed(*key, seq, *block(size))
                    key, seq = (cell[a], part[a]), 0
                units = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), np.float32).reshape(b - a, dimension)
                held.append((batch.column(3).to_numpy()[a:b], batch.column(0).to_numpy()[a:b], units))
                size += b - a
                while size >= BLOCK:
                    yield _packed(*key, seq, *block(BLOCK))
                    seq += 1
        if size:
            yield _packed(*key, seq, *block(size))

    assigned = written(rows.mapInArrow(assign, "id long, cell int, dist double, unit binary"))
    facts = {r["cell"]: (r["n"], r["radius"]) for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}  # a row for each cell
    parts = [-(-facts.get(c, (1, 0.0))[0] // PART) for c in range(len(centroids))]
    placed = assigned.select("id", "cell", F.pmod(F.xxhash64("id"), F.element_at(F.lit(parts), F.col("cell") + 1)).cast("int").alias("part"), "dist", "unit")
    order = ["cell", "part", "dist", "id"]
    return written(placed.repartition("cell", "part").sortWithinPartitions(*order).mapInArrow(pack, SHELLS)), facts


def _matrix(blob: bytes, dimension: int) -> np.ndarray:
    """Vectors as sent, in single precision, scaled to length one in double."""
    x = np.frombuffer(blob, np.float32).reshape(-1, dimension).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _asked(queries: DataFrame, centroids: np.ndarray, dimension: int) -> DataFrame:
    """Blocks of queries of like cells, without anything found yet."""

    def assign(batches):
        for batch in batches:
            use, units = sphere.unit_matrix(batch.column(1), dimension)
            cell = sphere.distances(units, centroids).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use)), pa.array(cell), pa.array([v.tobytes() for v in _raw(batch.column(1), use, dimension)], pa.binary())], names=["id", "cell", "unit"])

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ASKED):
                rows = batch.slice(i, ASKED)
                ids = rows.column(0).to_numpy().astype(np.int64)
                blobs = (ids.tobytes(), b"".join(rows.column(2).to_pylist()), b"", b"")
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), *(pa.array([x], pa.binary()) for x in blobs)], names=["block", "ids", "units", "best", "scores"])

    found = queries.mapInArrow(assign, "id long, cell int, unit binary")
    return found.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(pack, "block long, ids binary, units binary, best binary, scores binary")


def _home(queries: DataFrame, centroids: np.ndarray, facts: dict, dimension: int, k: int) -> DataFrame:
    """block, to: for the queries of a block the nearest cells that hold more than k rows together."""
    cells = np.array(sorted(facts), np.int64)
    size = np.array([facts[c][0] for c in cells.tolist()])

    def run(batches):
        for batch in batches:
            block, to = [], []
            for b, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                order = np.argsort(sphere.distances(_matrix(units, dimension), centroids[cells]), axis=1, kind="stable")
                enough = np.cumsum(size[order], axis=1)
                near = np.unique(order[(enough - size[order]) <= k])
                block += [b] * len(near)
                to += cells[near].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(to, pa.int32())], names=["block", "to"])

    return queries.select("block", "units").mapInArrow(run, "block long, `to` int")


def _meet(k: int, dimension: int, without_self: bool):
    """A stream of query blocks, each followed by the item blocks that it meets, nearest first: its k best after them."""

    def run(batches):
        block = None

        def out():
            b, ids, units, best, scores, joined, skipped = block
            return pa.RecordBatch.from_pydict(
                {"block": [b], "ids": [ids], "units": [units], "best": [best.tobytes()], "scores": [scores.tobytes()], "joined": [joined], "skipped": [skipped]},
                schema=pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "units", "best", "scores")], ("joined", pa.int64()), ("skipped", pa.int64())]),
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["best"] is not None:
                    if block:
                        yield out()
                    n = len(row["ids"]) // 8
                    best, scores = np.frombuffer(row["best"], np.int64).reshape(n, -1), np.frombuffer(row["scores"], np.float64).reshape(n, -1)
                    block = [row["block"], row["ids"], row["units"], best, scores, 0, 0]
                    continue
                own = np.frombuffer(block[1], np.int64)
                least = block[4][:, k - 1] if block[4].shape[1] >= k else np.full(len(own), -np.inf)
                reach = np.sqrt(np.maximum(2.0 - 2.0 * np.maximum(least, -1.0), 0.0)).max() if np.isfinite(least).all() else np.inf
                if row["least"] > reach + SLACK:
                    block[6] += 1
                    continue
                block[5] += 1
                ids, units = np.frombuffer(row["ids"], np.int64), _matrix(row["units"], dimension)
                scores = _matrix(block[2], dimension) @ units.T
                if without_self:
                    scores[own[:, None] == ids[None]] = -np.inf
                both = np.concatenate([block[4], scores], axis=1)
                names = np.concatenate([block[3], np.broadcast_to(ids, scores.shape)], axis=1)
                top = np.lexsort((names, -both), axis=1)[:, :k]
                block[3], block[4] = np.take_along_axis(names, top, axis=1), np.take_along_axis(both, top, axis=1)
        if block:
            yield out()

    return run


def _joined(state: DataFrame, pairs: DataFrame, items: DataFrame, k: int, dimension: int, without_self: bool) -> DataFrame:
    """The state after each block has met the shells of its pairs: block, to, low, high (of the distance to the centroid), least."""
    nothing = F.lit(None).cast("binary")
    met = pairs.join(items, (pairs["to"] == items["cell"]) & (items["far"] >= pairs["low"]) & (items["near"] <= pairs["high"]))
    gap = F.greatest(F.col("inner") - F.col("far"), F.col("near") - F.col("outer"), F.lit(0.0))  # of the queries' distances to the centroid, and the shell's
    sent = met.select("block", gap.alias("least"), "near", "far", items["ids"], items["units"], nothing.alias("best"), nothing.alias("scores"))
    zero = F.lit(-1.0)
    both = state.select("block", zero.alias("least"), zero.alias("near"), zero.alias("far"), "ids", "units", "best", "scores").unionByName(sent)
    return both.repartition("block").sortWithinPartitions("block", "least", F.col("best").isNull(), "near").mapInArrow(_meet(k, dimension, without_self), FOUND)


def _reach(centroids: np.ndarray, facts: dict, dimension: int, k: int):
    """For each query block the cells that may hold one of the k nearest of a query, and the distances to the centroid in question."""
    cells = np.array(sorted(facts), np.int64)
    radius = np.array([facts[c][1] for c in cells.tolist()])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                scores = np.frombuffer(r["scores"], np.float64).reshape(len(r["ids"]) // 8, -1)
                least = scores[:, k - 1] if scores.shape[1] >= k else np.full(len(scores), -np.inf)
                reach = np.where(np.isfinite(least), np.sqrt(np.maximum(2.0 - 2.0 * np.maximum(least, -1.0), 0.0)), 4.0)[:, None] + SLACK
                far = sphere.distances(_matrix(r["units"], dimension), centroids[cells])
                low, high = (far - reach).min(axis=0), (far + reach).max(axis=0)
                wanted = (far - reach <= radius).any(axis=0)
                done = set(r["home"])
                rows += [(r["block"], int(c), float(low[i]), float(high[i]), float(far[:, i].min()), float(far[:, i].max())) for i, c in enumerate(cells) if wanted[i] and int(c) not in done]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "to", "low", "high", "inner", "outer"])

    return run


def knn_join(queries: DataFrame, items: DataFrame, k: int, *, cells: int | None = None, without_self: bool = False, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """query, id, rank, similarity: the k items most similar to each query, ties by id; and facts: blocks joined and passed over.

    queries and items: id (integer), imgVec. ``without_self`` leaves an item of the query's id out. Vectors of another
    dimension than most items have, and zero vectors, meet nothing. Ids are distinct on either side, and vectors are in single
    precision. The result is exact: bounds only leave out what can't be among the k nearest.
    """
    spark = items.sparkSession
    sizes = items.where("imgVec is not null").groupBy(F.size("imgVec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query long, id long, rank int, similarity double"), spark.createDataFrame([], "joined long, skipped long, pairs long")
    dimension, n = sizes[0]
    plain = lambda df: df.select(F.col("id").cast("long").alias("id"), "imgVec")
    centroids = sphere.fit(plain(items), n, dimension, cells or sphere.usual_number(n), seed=seed)
    blocks, facts = _shells(plain(items), centroids, dimension)
    asked = written(_asked(plain(queries), centroids, dimension))

    wide = [F.lit(x).alias(c) for c, x in (("low", 0.0), ("high", 4.0), ("inner", 0.0), ("outer", 4.0))]
    home = written(_home(asked, centroids, facts, dimension, k).select("block", "to", *wide))
    near = written(_joined(asked, home, blocks, k, dimension, without_self))
    homes = near.join(home.groupBy("block").agg(F.collect_list("to").alias("home")), "block")  # the few cells of a block
    pairs = homes.select("block", "ids", "units", "scores", "home").mapInArrow(_reach(centroids, facts, dimension, k), "block long, `to` int, low double, high double, inner double, outer double")
    done = written(_joined(near.drop("joined", "skipped"), pairs, blocks, k, dimension, without_self))

    def rows(batches):
        for batch in batches:
            for r in batch.select(["ids", "best", "scores"]).to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                best, scores = np.frombuffer(r["best"], np.int64).reshape(len(ids), -1), np.frombuffer(r["scores"], np.float64).reshape(len(ids), -1)
                place = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(ids))
                real = np.isfinite(scores).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in (np.repeat(ids, best.shape[1]), best.ravel(), place, scores.ravel())], names=["query", "id", "rank", "similarity"])

    none = F.lit(0).cast("long")
    counted = near.select("joined", none.alias("skipped"), none.alias("asked"), none.alias("blocks"))
    counted = counted.unionByName(done.select("joined", "skipped", F.lit(1).cast("long").alias("asked"), none.alias("blocks")))
    counted = counted.unionByName(blocks.select(none.alias("joined"), none.alias("skipped"), none.alias("asked"), F.lit(1).cast("long").alias("blocks")))
    facts_of = counted.agg(F.sum("joined").alias("joined"), F.sum("skipped").alias("skipped"), (F.sum("asked") * F.sum("blocks")).alias("pairs"))
    return done.mapInArrow(rows, "query long, id long, rank int, similarity double"), facts_of
