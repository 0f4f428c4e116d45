"""Chunks of the field for a whole table of requests, in one plan.

Targets come by a join. All vectors of all requests (one for a target, one for each chunk) meet the catalogue's blocks in one
exact k-nearest join, so the catalogue is read once whatever the number of requests. What a request leaves out is
taken from its lists afterwards, which are longer by as much. Each request is picked in a task of its own.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions import noise, scalars
from vecatlas.operators import field
from vecatlas.operators.catalogue import eligible, image_source, image_url
from vecatlas.operators.knn_join import knn_join
from vecatlas.sources.work import written

MOST_CHUNKS, MOST_EXCLUDED = 16, 1000
VECTORS = "request long, place int, x double, y double, seed long, skipped long, `offset` int, `limit` int, rand int, imgVec array<double>"
PICKED = "request long, place int, x double, y double, pos int, id long, source string, similarity double"
ITEMS_PER_BLOCK, SEEDS_PER_BLOCK = 4096, 64  # about, of the blocks that make the random pools


def _vectors(basis):
    """A request's plan: its target's vector (place -1), and of each chunk, nearest to the centre first, the perturbed vector."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                chunks = [(float(c["x"]), float(c["y"])) for c in r.chunks]
                limits = field.Limits.of_many(len(chunks))
                out.append((r.request, -1, 0.0, 0.0, 0, 0, 0, limits.sim, 0, [float(v) for v in r.imgVec]))
                for place, i in enumerate(sorted(range(len(chunks)), key=lambda i: math.hypot(*chunks[i]))):
                    x, y = chunks[i]
                    seed = noise.hash32(r.targetId, x, y, r.seed)
                    vector, skipped = noise.perturbed(r.imgVec, basis, x, y, seed)
                    offset = noise.hash32(x + 100, y + 100, r.seed, place) % 100 if math.hypot(x, y) < 3 else place * 25
                    out.append((r.request, place, x, y, seed, skipped, offset, limits.drift, limits.rand, vector.astype(float).tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0].strip("`") for c in VECTORS.split(", ")])

    return run


def _pick(plan: pd.DataFrame, pools: pd.DataFrame) -> pd.DataFrame:
    """One request: its plan with count, target and excluded ids, and its pools."""
    if not len(plan) or not len(pools):
        return pd.DataFrame(columns=[c.split()[0] for c in PICKED.split(", ")])
    first = plan.iloc[0]
    chunks = plan[plan["place"] >= 0].sort_values("place").to_dict("records")
    used = {int(first["targetId"]), *map(int, first["exclude"])}
    pools = pools.assign(similarity=pools["similarity"].astype(object).where(pools["similarity"].notna(), None))
    return field._pick(pools, chunks, int(first["count"]), used).assign(request=first["request"])[[c.split()[0] for c in PICKED.split(", ")]]


def _seed_blocks(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, SEEDS_PER_BLOCK):
            query, seed = (batch.column(c).slice(i, SEEDS_PER_BLOCK).to_numpy().astype(np.int64) for c in (0, 1))
            yield pa.RecordBatch.from_pydict({"block": [int(query[0])], "queries": [query.tobytes()], "seeds": [seed.tobytes()]})


def _first_by_hash(length: int):
    """A stream of blocks of seeds, each followed by the catalogue's blocks of ids: for each seed the first ids in the order of
    the MD5 of id and seed, ties by id. Only ids that come before the last one kept are looked at further."""

    def run(batches):
        block = None

        def out():
            sizes = [len(ids) for _, ids in block[2]]
            columns = (np.repeat(block[0], sizes), np.concatenate([ids for _, ids in block[2]]), np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "place"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["seeds"] is not None:
                    if block:
                        yield out()
                    queries = np.frombuffer(row["queries"], np.int64)
                    block = [queries, [b":%d" % s for s in np.frombuffer(row["seeds"], np.int64)], [(np.zeros((0, 2), ">u8"), np.zeros(0, np.int64)) for _ in queries]]
                    continue
                ids = np.array(row["ids"], np.int64)
                texts = [b"%d" % i for i in row["ids"]]
                for q, seed in enumerate(block[1]):
                    keys = np.frombuffer(b"".join([md5(t + seed).digest() for t in texts]), ">u8").reshape(-1, 2)
                    had, own = block[2][q]
                    use = np.flatnonzero(keys[:, 0] <= had[-1, 0]) if len(own) == length else slice(None)
                    had, own = np.concatenate([had, keys[use]]), np.concatenate([own, ids[use]])
                    first = np.lexsort((own, had[:, 1], had[:, 0]))[:length]
                    block[2][q] = had[first], own[first]
        if block:
            yield out()

    return run


def _dealt(vectors: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """query, id, place: the first ``length`` items for the seed of each chunk. Each seed orders all items anew, so the work is that of
    items times chunks; rows are made for the blocks of both, and for what is kept."""
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    ids = items.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("part")).agg(F.collect_list(F.col("id").cast("long")).alias("ids"))  # ITEMS_PER_BLOCK, about
    seeds = written(vectors.where("place >= 0").select("query", "seed").mapInArrow(_seed_blocks, "block long, queries binary, seeds binary"))
    met = seeds.select("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("part")).join(ids, "part")
    none = F.lit(None).cast("binary")
    stream = seeds.select("block", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("array<long>").alias("ids"), "queries", "seeds").unionByName(met.select("block", "part", "ids", none.alias("queries"), none.alias("seeds")))
    return stream.repartition("block").sortWithinPartitions("block", "part").mapInArrow(_first_by_hash(length), "query long, id long, place int")


def checked(requests: DataFrame) -> DataFrame:
    """The requests with whether each is ``valid``: a target, 1 to 16 chunks with both coordinates, at most 1000 excluded ids; and their
    count, seed and excluded ids as they count (count 1 to 50, default 1; seed default 0; nulls are not ids)."""
    number = F.filter("exclude", lambda i: i.isNotNull())
    ids = F.array_distinct(F.coalesce(number, F.array().cast("array<int>")))
    places = F.size("chunks").between(1, MOST_CHUNKS) & F.forall("chunks", lambda c: c["x"].isNotNull() & c["y"].isNotNull() & ~F.isnan(c["x"]) & ~F.isnan(c["y"]))
    valid = F.coalesce(F.col("request").isNotNull() & (F.coalesce("targetId", F.lit(0)) != 0) & places & (F.size(ids) <= MOST_EXCLUDED), F.lit(False))
    count = F.least(F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)), F.lit(50)).cast("int")
    return requests.select("request", "targetId", "chunks", count.alias("count"), F.coalesce("seed", F.lit(0)).cast("long").alias("seed"), ids.alias("exclude"), valid.alias("valid"))


def chunks_of_requests(artworks: DataFrame, requests: DataFrame, basis, *, cells: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """The items picked for each request, and a row of facts for each request.

    requests: request (distinct), targetId, chunks (array of x and y), count, seed, exclude (array of ids). Items:
    request, place, x, y, pos, id, title, imageUrl, imageSource, source, similarity. Facts: request, status (``ok``, ``invalid``, ``not
    found``), chunks, excluded, temperature (mean), and of each pool the candidates and the items picked. ``cells`` goes
    to the k-nearest join (None: as many as it would take).
    """
    asked = written(checked(requests))
    items = artworks.where(eligible()).select("id", "imgVec")
    known = asked.where("valid").join(items.select(F.col("id").alias("targetId"), "imgVec"), "targetId")
    vectors = written(known.select("request", "targetId", "chunks", "seed", "imgVec").mapInPandas(_vectors(basis), VECTORS))
    vectors = vectors.withColumn("query", F.xxhash64("request", "place"))
    left_out = asked.where("valid").select("request", F.explode(F.array_union("exclude", F.array("targetId"))).alias("id"))

    most = vectors.agg(F.max("limit")).first()[0] or 0
    longest = asked.where("valid").agg(F.max(F.size("exclude"))).first()[0] or 0
    found, _ = knn_join(vectors.select(F.col("query").alias("id"), "imgVec"), items, most + longest + 1, cells=cells)
    near = found.select("query", "id", "similarity").join(vectors.select("query", "request", "place", "limit"), "query").join(left_out, ["request", "id"], "left_anti")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= F.col("limit"))
    near = near.select("request", "place", F.when(F.col("place") < 0, "sim").otherwise("drift").alias("source"), "rank", "id", "similarity")

    some = _dealt(vectors, items, field.Limits.of_many(MOST_CHUNKS).rand + longest + 1).join(vectors.select(F.col("query"), "request", F.col("place").alias("chunk"), "rand"), "query")
    rand = some.join(left_out, ["request", "id"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("rank") <= F.col("rand"))
    rand = rand.select("request", F.col("chunk").alias("place"), "rank", "id")
    pools = written(near.unionByName(rand.select("request", "place", F.lit("rand").alias("source"), "rank", "id", F.lit(None).cast("double").alias("similarity"))))

    plan = vectors.drop("imgVec", "query", "limit", "rand").join(asked.select("request", "targetId", "count", "exclude"), "request")
    picked = written(plan.groupBy("request").cogroup(pools.groupBy("request")).applyInPandas(_pick, PICKED))  # 16 x 1700 rows a request at most
    facts = artworks.select(F.col("id").cast("long").alias("id"), "title", image_url().alias("imageUrl"), image_source().alias("imageSource"))
    rows = picked.join(facts, "id").select("request", "place", "x", "y", "pos", "id", "title", "imageUrl", "imageSource", "source", "similarity")
    return rows, _facts(asked, vectors, pools, picked)


def _facts(asked: DataFrame, vectors: DataFrame, pools: DataFrame, picked: DataFrame) -> DataFrame:
    t = scalars.temperature(scalars.radius(F.col("x"), F.col("y")))
    heat = vectors.where("place >= 0").groupBy("request").agg(F.avg(t).alias("t"), F.count("*").alias("n"))
    sources = ("sim", "drift", "rand")
    sizes = pools.groupBy("request").agg(*[F.count_if(F.col("source") == s).alias(f"{s}_candidates") for s in sources])
    taken = picked.groupBy("request").agg(*[F.count_if(F.col("source") == s).alias(f"{s}_picked") for s in sources])
    status = F.when(~F.col("valid"), "invalid").when(F.col("n").isNull(), "not found").otherwise("ok")
    joined = asked.join(heat, "request", "left").join(sizes, "request", "left").join(taken, "request", "left")
    return joined.select(
        "request", status.alias("status"), F.size("chunks").alias("chunks"), F.size(F.array_union("exclude", F.array("targetId"))).alias("excluded"), scalars.half_up(F.col("t"), 2).alias("temperature"),
        *[F.coalesce(F.col(f"{s}_{k}"), F.lit(0)).alias(f"{s}_{k}") for k in ("candidates", "picked") for s in sources],
    )
