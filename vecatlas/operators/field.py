"""Chunks of the field: pools of similar, drifted and random items around a target, blended by weight.

All similar and drifted pools of a request come from one scan, scored against the target's vector and the
chunks' perturbed vectors together; the random pools come from a second one. Only the truncated pools meet in one
task for the pick, which is sequential by nature: a chunk must not repeat what an earlier one took.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions import noise
from vecatlas.operators.catalogue import Response, clamped, eligible, image_source, image_url, random_key, target, without
from vecatlas.operators.knn import nearest_of_many

PICKED = "place int, x double, y double, pos int, id bigint, source string, similarity double"
# Which pool is tried next when the drawn one has nothing left.
ORDER = {"sim": ("sim", "drift", "rand"), "drift": ("drift", "sim", "rand"), "rand": ("rand", "drift", "sim")}


@dataclass(frozen=True)
class Limits:
    sim: int
    drift: int
    rand: int

    @staticmethod
    def of_one() -> Limits:
        return Limits(200, 400, 800)

    @staticmethod
    def of_many(chunks: int) -> Limits:
        return Limits(min(500, 125 * chunks), min(400, 800, 200 * chunks), min(800, 1200, 300 * chunks))


def _rounded(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def place_facts(x: float, y: float) -> dict:
    r = math.hypot(x, y)
    t = noise.temperature(r)
    w = noise.weights(t)
    return {"r": _rounded(r, 2), "theta": _rounded(math.atan2(y, x), 2), "t": _rounded(t, 2), "weights": {k: _rounded(v, 3) for k, v in zip(("sim", "drift", "rand"), w, strict=True)}}


def _rotated(ids: list, by: int) -> list:
    """The list from place ``by`` on, then what stands before; a place beyond the end leaves the list as it is."""
    return ids[by:] + ids[:by] if by < len(ids) else ids


def _pick(pools: pd.DataFrame, chunks: list[dict], count: int, used: set[int]) -> pd.DataFrame:
    """chunks: in the order of picking, with place, x, y, seed, skipped (uniform draws that their noise took) and offset."""
    tables = {key: list(zip(g["id"], g["similarity"], strict=True)) for key, g in pools.sort_values("rank").groupby(["place", "source"])}
    out = []
    for c in chunks:
        shares = noise.weights(noise.temperature(math.hypot(c["x"], c["y"])))
        waiting = {
            "sim": iter(_rotated(tables.get((-1, "sim"), []), c["offset"])),
            "drift": iter(_rotated(tables.get((c["place"], "drift"), []), c["offset"])),
            "rand": iter(tables.get((c["place"], "rand"), [])),
        }
        for pos, u in enumerate(noise.draws(c["seed"], count, c["skipped"]).tolist()):
            drawn = "sim" if u < shares[0] else "drift" if u < shares[0] + shares[1] else "rand"
            found = next(((i, s, source) for source in ORDER[drawn] for i, s in waiting[source] if i not in used), None)
            if found is None:
                break
            used.add(found[0])
            out.append((c["place"], c["x"], c["y"], pos, found[0], found[2], None if found[2] == "rand" else found[1]))
    return pd.DataFrame(out, columns=["place", "x", "y", "pos", "id", "source", "similarity"])


def _respond(artworks: DataFrame, item: int, basis, chunks: list[dict], count: int, seed: int, limits: Limits, left_out_before: list[int], left_out_after: list[int]) -> DataFrame:
    of = target(artworks, item)
    queries = [of["imgVec"]]
    for c in chunks:
        c["seed"] = noise.hash32(item, c["x"], c["y"], seed)
        vector, c["skipped"] = noise.perturbed(of["imgVec"], basis, c["x"], c["y"], c["seed"])
        queries.append(vector)
    candidates = without(artworks.where(eligible() & (F.col("id") != item)), left_out_before)
    ranked = nearest_of_many(candidates, queries, [limits.sim] + [limits.drift] * len(chunks))
    places = F.element_at(F.array(F.lit(-1), *[F.lit(c["place"]) for c in chunks]), F.col("query") + 1)
    near = ranked.select(places.alias("place"), F.when(F.col("query") == 0, "sim").otherwise("drift").alias("source"), "rank", "id", "similarity")
    seeds = F.array(*[F.struct(F.lit(c["place"]).alias("place"), F.lit(c["seed"]).cast("bigint").alias("seed")) for c in chunks])  # one for each chunk, 16 at most
    dealt = candidates.select("id", F.explode(seeds).alias("c")).select("id", "c.place", random_key(F.col("c.seed")).alias("key"))
    by = Window.partitionBy("place").orderBy("key", "id")
    rand = dealt.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limits.rand)
    pools = near.unionByName(rand.select("place", F.lit("rand").alias("source"), "rank", F.col("id").cast("bigint").alias("id"), F.lit(None).cast("double").alias("similarity")))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pick(pdf, chunks, count, {item, *left_out_after})

    picked = pools.groupBy(F.lit(item).alias("target")).applyInPandas(pick, PICKED)  # a few thousand rows at most
    facts = artworks.select("id", "objectId", "title", "artist", image_url().alias("imageUrl"), F.col("primaryImage").alias("originalImageUrl"), image_source().alias("imageSource"))
    return facts.join(F.broadcast(picked), "id").select(  # picked: 50 rows for each of 16 chunks at most
        "place", "x", "y", "pos", "id", "objectId", "title", "artist", "imageUrl", "originalImageUrl", "imageSource", "similarity", "source")


def one_chunk(artworks: DataFrame, item: int, x: float, y: float, basis, *, count: int = 20, seed: int = 0, exclude=()) -> Response:
    """One chunk. Excluded items are passed over while picking: the pools aren't refilled for them."""
    if not item or any(v is None or math.isnan(v) for v in (x, y)):
        raise ValueError("a target and the two coordinates of a chunk are needed")
    near = math.hypot(x, y) < 2
    chunk = {"place": 0, "x": float(x), "y": float(y), "offset": noise.hash32(x + 100, y + 100) % 50 if near else 0}
    data = _respond(artworks, item, basis, [chunk], clamped(count, 20, 1, 50), seed, Limits.of_one(), [], list(exclude)).drop("place", "x", "y")
    return Response(data, {"targetId": item, "chunk": {"x": x, "y": y}, "seed": noise.hash32(item, x, y, seed), **place_facts(x, y)})


def many_chunks(artworks: DataFrame, item: int, chunks: list[tuple[float, float]], basis, *, count: int = 20, seed: int = 0, exclude=()) -> Response:
    """Chunks of one request, nearest to the centre first, without a repeated item. Excluded items are left out of the pools."""
    if not item or not isinstance(chunks, list) or not 1 <= len(chunks) <= 16:
        raise ValueError("a target and 1 to 16 chunks are needed")
    if not all(isinstance(v, int | float) and not isinstance(v, bool) and not math.isnan(v) for c in chunks for v in c) or isinstance(count, bool) or not isinstance(count, int):
        raise ValueError("coordinates are numbers, and the count is an integer")
    exclude = [i for i in exclude if isinstance(i, int) and not isinstance(i, bool)]
    order = sorted(range(len(chunks)), key=lambda i: math.hypot(*chunks[i]))
    plan = []
    for place, i in enumerate(order):
        x, y = map(float, chunks[i])
        plan.append({"place": place, "x": x, "y": y, "offset": noise.hash32(x + 100, y + 100, seed, place) % 100 if math.hypot(x, y) < 3 else place * 25})
    data = _respond(artworks, item, basis, plan, min(50, max(1, count)), seed, Limits.of_many(len(chunks)), exclude, exclude)
    mean = sum(noise.temperature(math.hypot(*c)) for c in chunks) / len(chunks)
    meta = {"targetId": item, "totalChunks": len(chunks), "globalExcludes": len({item, *exclude}), "seed": seed, "t": _rounded(mean, 2)}
    return Response(data, meta | {"chunks": {f"{c['x']:g},{c['y']:g}": place_facts(c["x"], c["y"]) for c in plan}})
