"""An inverted-file index of the catalogue's vectors, stored by cell, with product-quantised residuals and exact re-ranking.

Only eligible items are indexed. A row lies in the folder of its nearest cell (and of a part of it, if the cell is
large) with its vector's code: the nearest of 256 codewords for each slice of what the vector has beyond its centroid. A search
reads the codes of each query's nearest cells only, keeps a short list by the codes, and ranks that by the exact
similarity. How many cells are read, and how long the short list is, is settled when the index is built, by the recall that is
asked for.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecatlas.operators import cells as sphere
from vecatlas.operators.catalogue import eligible, targets
from vecatlas.operators.knn import nearest_of_many
from vecatlas.sources.work import written

CODEWORDS = 256
MOST_TRIED = 64  # targets, about, that probes and short lists are settled on
CODES_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 512
LONGEST = 64  # short lists are at most so many times as long as what is asked for


@dataclass(frozen=True)
class Index:
    """The index's facts. parts: folders of each cell; probes: cells that a search reads; times: a short list's length over k."""

    path: str
    dimension: int
    slices: int
    centroids: list
    codebooks: list
    rows: list
    parts: list
    probes: int
    times: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, code binary, vector array<float>, cell int, part int").parquet(f"{self.path}/rows")

    def cells_of(self, vectors) -> np.ndarray:
        """The cells that a search for each vector reads."""
        v = np.atleast_2d(np.asarray(vectors, np.float64))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        return np.argsort(sphere.distances(v, np.array(self.centroids)), axis=1, kind="stable")[:, : self.probes]


def _encode(units: np.ndarray, cell: np.ndarray, centroids: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """A byte for each slice of each residual."""
    left = (units - centroids[cell]).reshape(len(units), len(codebooks), -1)
    codes = np.empty((len(units), len(codebooks)), np.uint8)
    for j, book in enumerate(codebooks):
        codes[:, j] = (np.square(book).sum(axis=1) - 2.0 * left[:, j] @ book.T).argmin(axis=1)
    return codes


def _codebook(pdf: pd.DataFrame, seed: int, rounds: int = 8) -> pd.DataFrame:
    """Codewords for one slice, by Lloyd's rounds over a bounded sample."""
    x = np.array(pdf["values"].tolist())
    x = x[np.lexsort(x.T[::-1])]
    random = np.random.default_rng(seed)
    book = x[random.choice(len(x), CODEWORDS, replace=len(x) < CODEWORDS)]
    for _ in range(rounds):
        near = (np.square(book).sum(axis=1) - 2.0 * x @ book.T).argmin(axis=1)
        count = np.bincount(near, minlength=CODEWORDS)
        sums = np.stack([np.bincount(near, weights=c, minlength=CODEWORDS) for c in x.T], axis=1)
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "book": [book.ravel()]})


def build(artworks: DataFrame, path: str, *, cells: int | None = None, slices: int = 16, recall: float = 0.97, k: int = 160, rows_per_part: int = 100_000, seed: int = 7) -> Index:
    """Index every eligible item under ``path``.

    Centroids are fitted on about 256 rows a cell and codebooks on about 16,384 rows. The number of cells to read and the length
    of short lists are settled on the exact neighbours of about 64 items, so that a search finds their ``k`` nearest with
    the recall asked for. All items are indexed. Vectors of another dimension than most have, and zero vectors, aren't found by any search.
    """
    spark = artworks.sparkSession
    items = artworks.where(eligible()).select(F.col("id").cast("long").alias("id"), "imgVec")
    sizes = items.groupBy(F.size("imgVec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        raise ValueError("there is no eligible item to index")
    dimension, n = sizes[0]
    if dimension % slices:
        raise ValueError(f"{slices} slices do not divide {dimension} dimensions")
    centroids = sphere.fit(items, n, dimension, cells or sphere.usual_number(n), seed=seed)

    def residuals(batches):
        for batch in batches:
            _, units = sphere.unit_matrix(batch.column(1), dimension)
            cell = sphere.distances(units, centroids).argmin(axis=1)
            left = (units - centroids[cell]).reshape(len(units) * slices, -1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1, dtype=np.int32) * left.shape[1]), pa.array(left.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(slices, dtype=np.int32), len(units))), values], names=["slice", "values"])

    some = sphere.drawn(items, "id", 64 * CODEWORDS / n).mapInArrow(residuals, "slice int, values array<double>")
    books = some.groupBy("slice").applyInPandas(lambda pdf: _codebook(pdf, seed), "slice int, book array<double>").orderBy("slice").collect()  # CODEWORDS x dimension numbers
    codebooks = np.array([r["book"] for r in books]).reshape(slices, CODEWORDS, dimension // slices)

    def assign(batches):
        for batch in batches:
            use, units = sphere.unit_matrix(batch.column(1), dimension)
            cell = sphere.distances(units, centroids).argmin(axis=1)
            codes = _encode(units, cell, centroids, codebooks)
            rows = batch.take(pa.array(use))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), rows.column(1), pa.array(cell.astype(np.int32))], names=["id", "code", "vector", "cell"])

    assigned = items.mapInArrow(assign, "id long, code binary, vector array<float>, cell int")
    count = np.zeros(len(centroids), np.int64)
    for cell, rows in assigned.groupBy("cell").agg(F.count("*")).collect():  # a row for each cell
        count[cell] = rows
    parts = np.maximum(1, -(-count // rows_per_part))
    of_cell = F.element_at(F.lit(parts.tolist()), F.col("cell") + 1)
    placed = assigned.withColumn("part", F.pmod(F.xxhash64("id"), of_cell).cast("int"))
    placed.repartition("cell", "part").write.mode("overwrite").partitionBy("cell", "part").parquet(f"{path}/rows")

    index = Index(path, dimension, slices, centroids.tolist(), codebooks.tolist(), count.tolist(), parts.tolist(), len(centroids), LONGEST)
    index = _settled(spark, index, items, n, k, recall)
    spark.createDataFrame([(json.dumps(asdict(index)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return index


def load(spark: SparkSession, path: str) -> Index:
    return Index(**(json.loads(spark.read.text(f"{path}/facts").first()[0]) | {"path": path}))


def _settled(spark: SparkSession, index: Index, items: DataFrame, n: int, k: int, recall: float) -> Index:
    """The index with the fewest cells to read, and then the shortest lists, that find this share of the ``k`` exact neighbours of
    about MOST_TRIED items (each of the two may lose half of what may be lost)."""
    share = 1 - (1 - recall) / 2
    stored = index.read(spark).select("id", "cell")
    tried = sphere.drawn(items, "id", min(1.0, MOST_TRIED / n)).join(stored, "id").select("id", "imgVec").orderBy("id").limit(4 * MOST_TRIED).collect()
    if not tried:
        return index
    vectors = [[float(x) for x in r["imgVec"]] for r in tried]
    exact = nearest_of_many(items, vectors, [k] * len(vectors)).select("query", "id").join(stored, "id").collect()  # k rows a target
    place = np.argsort(np.argsort(sphere.distances(np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True), np.array(index.centroids)), axis=1, kind="stable"), axis=1)
    needed = np.sort([place[r["query"], r["cell"]] for r in exact])
    index = replace(index, probes=int(needed[max(0, math.ceil(share * len(needed)) - 1)]) + 1)
    queries = spark.createDataFrame(list(enumerate(vectors)), "query long, vector array<double>")
    wanted = spark.createDataFrame([(r["query"], r["id"]) for r in exact], "query long, id long")
    places = [r["place"] for r in _listed(spark, index, queries, LONGEST * k).join(wanted, ["query", "id"]).select("place").collect()]
    places = np.sort(places + [LONGEST * k] * (int((needed < index.probes).sum()) - len(places)))
    return replace(index, times=max(1, math.ceil(places[max(0, math.ceil(share * len(places)) - 1)] / k)))


def _code_blocks(batches):
    """Codes as blocks of one cell."""
    for batch in batches:
        cell = batch.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        ids, codes = batch.column(0).to_numpy()[order], batch.column(1).take(pa.array(order))
        cell = cell[order]
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else np.zeros(1, np.int64)
        cuts = [(i, min(i + CODES_PER_BLOCK, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for i in range(a, b, CODES_PER_BLOCK)]
        blobs = [[ids[i:j].tobytes() for i, j in cuts], [b"".join(codes.slice(i, j - i).to_pylist()) for i, j in cuts]]
        yield pa.RecordBatch.from_arrays([pa.array([cell[i] for i, _ in cuts], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["cell", "ids", "codes"])


def _meet(index: Index, length: int):
    """A stream of query blocks, each followed by the code blocks of the cells that its queries probe: each query's best rows."""
    centroids, codebooks = np.array(index.centroids), np.array(index.codebooks)

    def run(batches):
        block = None

        def out():
            queries, best, near, cell = block[0], block[3], block[4], block[5]
            order = np.lexsort((best, -near), axis=1)
            best, near, cell = (np.take_along_axis(x, order, axis=1) for x in (best, near, cell))
            real = np.isfinite(near).ravel()
            place = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(best))
            columns = [np.repeat(queries, best.shape[1]), best.ravel(), cell.ravel(), place]
            return pa.RecordBatch.from_arrays([pa.array(c[real]) for c in columns], names=["query", "id", "cell", "place"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["queries"] is not None:
                    if block:
                        yield out()
                    n = len(row["queries"]) // 8
                    probes = np.frombuffer(row["probes"], np.int32).reshape(n, -1)
                    block = [np.frombuffer(row["queries"], np.int64), np.frombuffer(row["units"], np.float64).reshape(n, -1), probes, np.zeros((n, 0), np.int64), np.zeros((n, 0)), np.zeros((n, 0), np.int32)]
                    continue
                asks = np.flatnonzero((block[2] == row["cell"]).any(axis=1))
                ids = np.frombuffer(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                v = block[1][asks]
                near = np.full((len(block[0]), len(ids)), -np.inf)
                part = np.repeat((v @ centroids[row["cell"]])[:, None], len(ids), axis=1)
                for j, book in enumerate(codebooks):
                    part += (v.reshape(len(v), len(codebooks), -1)[:, j] @ book.T)[:, codes[:, j]]
                near[asks] = part
                near = np.concatenate([block[4], near], axis=1)
                best = np.concatenate([block[3], np.broadcast_to(ids, (len(near), len(ids)))], axis=1)
                cell = np.concatenate([block[5], np.full((len(near), len(ids)), row["cell"], np.int32)], axis=1)
                if near.shape[1] > 2 * length:  # a short list is cut when it has twice its length
                    top = np.argpartition(-near, length - 1, axis=1)[:, :length]
                    near, best, cell = (np.take_along_axis(x, top, axis=1) for x in (near, best, cell))
                block[3:] = best, near, cell
        if block:
            yield out()

    return run


def _listed(spark: SparkSession, index: Index, asked: DataFrame, length: int) -> DataFrame:
    """query, id, cell, place: each query's best rows by their codes, of the cells that it probes. Queries of like cells meet the
    codes of these together, in blocks, and hold their lists meanwhile."""
    probes, dimension = index.probes, index.dimension
    state = "block long, queries binary, units binary, probes binary"

    def route(batches):
        for batch in batches:
            use, units = sphere.unit_matrix(batch.column(1), dimension)
            near = np.argsort(sphere.distances(units, np.array(index.centroids)), axis=1, kind="stable")[:, :probes].astype(np.int32)
            columns = [batch.column(0).take(pa.array(use)), pa.array(near[:, 0]), pa.array([u.tobytes() for u in units], pa.binary()), pa.array([x.tobytes() for x in near], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "home", "unit", "near"])

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, QUERIES_PER_BLOCK):
                rows = batch.slice(i, QUERIES_PER_BLOCK)
                queries = rows.column(0).to_numpy().astype(np.int64)
                values = (int(queries[0]), queries.tobytes(), b"".join(rows.column(2).to_pylist()), b"".join(rows.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([values[0]]), *(pa.array([v], pa.binary()) for v in values[1:])], names=["block", "queries", "units", "probes"])

    def wanted(batches):
        for batch in batches:
            cells = [np.unique(np.frombuffer(x, np.int32)) for x in batch.column(1).to_pylist()]
            blocks = [np.full(len(c), b, np.int64) for b, c in zip(batch.column(0).to_pylist(), cells, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *blocks])), pa.array(np.concatenate([np.zeros(0, np.int32), *cells]))], names=["block", "cell"])

    routed = asked.mapInArrow(route, "query long, home int, unit binary, near binary")
    blocks = written(routed.repartitionByRange("home", "query").sortWithinPartitions("home", "query").mapInArrow(pack, state))
    pairs = blocks.select("block", "probes").mapInArrow(wanted, "block long, cell int")
    codes = index.read(spark).select("id", "code", "cell").mapInArrow(_code_blocks, "cell int, ids binary, codes binary")
    none = F.lit(None)
    sent = pairs.join(codes, "cell").select("block", "cell", "ids", "codes", *[none.cast("binary").alias(c) for c in ("queries", "units", "probes")])
    first = blocks.select("block", F.lit(-1).alias("cell"), *[none.cast("binary").alias(c) for c in ("ids", "codes")], "queries", "units", "probes")
    stream = first.unionByName(sent).repartition("block").sortWithinPartitions("block", "cell")
    return stream.mapInArrow(_meet(index, length), "query long, id long, cell int, place int").where(F.col("place") <= length)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 160) -> DataFrame:
    """query, rank, id, similarity: the ``k`` rows nearest to each query by the index. queries: query (long), vector; any number.

    Each query meets the codes of its nearest cells and keeps a short list, of which the exact similarity decides, ties by id. Numbers
    of queries are distinct. Queries of another dimension and zero vectors find nothing. The recall is below one.
    """
    dimension = index.dimension
    asked = queries.select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    listed = _listed(spark, index, asked, index.times * k).drop("place")

    def exact(batches):
        for batch in batches:
            _, own = sphere.unit_matrix(batch.column(2), dimension)
            _, other = sphere.unit_matrix(batch.column(3), dimension)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((own * other).sum(axis=1))], names=["query", "id", "similarity"])

    pairs = listed.join(index.read(spark).select("id", "cell", "vector"), ["cell", "id"]).join(asked.withColumnRenamed("vector", "wanted"), "query")
    similar = pairs.select("query", "id", F.col("vector").cast("array<double>").alias("vector"), "wanted").mapInArrow(exact, "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return similar.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def similar(artworks: DataFrame, index: Index, items: list[int], k: int = 160) -> tuple[DataFrame, dict]:
    """The items nearest to each of a few items, by the index, and what a search for them reads: cells, folders, rows of all.

    Only the folders of the cells that the items need are listed and read.
    """
    spark = artworks.sparkSession
    found = targets(artworks, items)
    wanted = sorted(set(index.cells_of([r["imgVec"] for r in found]).ravel().tolist()))
    queries = spark.createDataFrame([(r["id"], [float(x) for x in r["imgVec"]]) for r in found], "query long, vector array<double>")
    pruned = _Pruned(**asdict(index), cells=wanted)
    facts = {"cells": len(wanted), "folders": sum(index.parts[c] for c in wanted if index.rows[c]), "rows": sum(index.rows[c] for c in wanted), "of_rows": sum(index.rows)}
    return search(spark, pruned, queries, k), facts


@dataclass(frozen=True)
class _Pruned(Index):
    """An index of which only some cells are read."""

    cells: list

    def read(self, spark: SparkSession) -> DataFrame:
        return super().read(spark).where(F.col("cell").isin(self.cells))
