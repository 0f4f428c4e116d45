"""Batch work queues: fetching images and computing vectors, with errors kept by item, and reports on the batches."""

from __future__ import annotations

import hashlib
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLIC_BASE = "https://img.example.org"


def stored_url(base: str = PUBLIC_BASE) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/artworks/"), F.col("id").cast("string"), F.lit(".jpg"))


class RateLimited(OSError):
    """The server asks for fewer requests: a task that meets this asks for nothing more."""


def http_fetcher(agent: str = "vecatlas/1.0 (batch ingest)", timeout: float = 10.0) -> Callable[[str], bytes]:
    """Gets an address's bytes; every answer outside 200-299 is an error, and 429 is RateLimited."""

    def fetcher(url: str) -> bytes:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                if not 200 <= answer.status < 300:
                    raise OSError(f"status {answer.status}")
                return answer.read()
        except urllib.error.HTTPError as e:
            raise RateLimited("status 429") if e.code == 429 else OSError(f"status {e.code}") from None

    return fetcher


def _tried(action: Callable, value, attempts: int, pause: float):
    """The action's result and None, or None and the last error's text; pauses double between attempts. RateLimited goes on to the caller."""
    for k in range(attempts):
        try:
            return action(value), None
        except RateLimited:
            raise
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                time.sleep(pause * 2**k)
    return None, error


def fetch(queue: DataFrame, fetcher: Callable[[str], bytes], store: Callable[[str, bytes], None], *, url: str = "primaryImage", base: str = PUBLIC_BASE, partitions: int | None = None, per_second: float | None = None, jitter: float = 0.0, concurrency: int = 1, attempts: int = 1, pause: float = 1.0) -> DataFrame:
    """id, ok, url, error, seconds for each queued item: ``fetcher`` gets the bytes and ``store`` takes them under the item's key.

    An item's error doesn't touch others. Each task has ``concurrency`` requests open at most; ``per_second`` limits it, with up
    to ``jitter`` random seconds more after each; ``attempts`` and ``pause`` retry with doubling pauses. After RateLimited, the
    rest of the task's items fail untried, and stay in the queue.
    """
    rows = queue.select(F.col("id"), F.col(url).alias("from"))
    rows = rows.repartition(partitions) if partitions else rows

    def run(frames):
        stopped = threading.Event()

        def one(i: int, source: str) -> tuple:
            if stopped.is_set():
                return i, False, None, "RateLimited: not tried", 0.0
            key, start = f"artworks/{i}.jpg", time.perf_counter()
            try:
                _, error = _tried(lambda u: store(key, fetcher(u)), source, attempts, pause)
            except RateLimited as e:
                stopped.set()
                error = f"RateLimited: {e}"
            if per_second or jitter:
                time.sleep((concurrency / per_second if per_second else 0.0) + random.uniform(0, jitter))
            return i, error is None, f"{base}/{key}" if error is None else None, error, time.perf_counter() - start

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in frames:
                yield pd.DataFrame(list(pool.map(one, pdf["id"].tolist(), pdf["from"].tolist())), columns=["id", "ok", "url", "error", "seconds"])

    return rows.mapInPandas(run, "id int, ok boolean, url string, error string, seconds double")


def embed(queue: DataFrame, encode: Callable[[str], np.ndarray], *, url: str = "localImageUrl") -> DataFrame:
    """id, ok, vector (of length one), error for each queued item. After RateLimited, the rest of the task's items fail untried."""

    def run(frames):
        limited = None
        for pdf in frames:
            out = []
            for i, source in zip(pdf["id"].tolist(), pdf[url].tolist(), strict=True):
                v, error = None, "RateLimited: not tried"
                if limited is None:
                    try:
                        v, error = _tried(encode, source, 1, 0)
                    except RateLimited as e:
                        limited = error = f"RateLimited: {e}"
                v = None if v is None else (np.asarray(v, dtype=np.float32) / (np.linalg.norm(v) or 1.0)).tolist()
                out.append((i, error is None, v, error))
            yield pd.DataFrame(out, columns=["id", "ok", "vector", "error"])

    return queue.select("id", url).mapInPandas(run, "id int, ok boolean, vector array<float>, error string")


def stub_encoder(dimension: int) -> Callable[[str], np.ndarray]:
    """A stand-in for an image or text encoder: the same normal vector for the same text."""

    def encode(text: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little")
        return np.random.default_rng(seed).standard_normal(dimension)

    return encode


def with_urls(artworks: DataFrame, results: DataFrame) -> DataFrame:
    """The catalogue with the results' addresses filled in."""
    done = results.where("ok").groupBy("id").agg(F.max("url").alias("__new"))
    return artworks.join(done, "id", "left").withColumn("localImageUrl", F.coalesce("__new", "localImageUrl")).drop("__new")


def with_vectors(artworks: DataFrame, results: DataFrame) -> DataFrame:
    done = results.where("ok").groupBy("id").agg(F.max("vector").alias("__new"))
    return artworks.join(done, "id", "left").withColumn("imgVec", F.coalesce("__new", "imgVec")).drop("__new")


def batch_number(order: Column, size: int) -> Column:
    """Batches of ``size`` from 1, for places from 1."""
    return (F.floor((order - 1) / size) + 1).cast("int")


def numbered(queue: DataFrame, size: int = 25, width: int = 100_000) -> DataFrame:
    """A queue with each item's batch, in the order of ids: places within ranges of ``width`` ids, after the counts of the ranges before."""
    rows = queue.withColumn("__range", F.floor(F.col("id") / width))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("__range").orderBy("id")) + F.col("__before")
    return rows.join(before, "__range").withColumn("batch", batch_number(place, size)).drop("__range", "__before")


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _numbered_by(rows: DataFrame, group: list[str], order: str, name: str, width: int) -> DataFrame:
    """Places from 1 within ``group`` in the order of a whole number, made within ranges of ``width`` of it and then over the ranges."""
    rows = rows.withColumn("range", F.floor(F.col(order) / width))
    counts = rows.groupBy(*group, "range").agg(F.count("*").alias("n"))
    before = counts.select(*group, "range", (F.sum("n").over(Window.partitionBy(*group).orderBy("range")) - F.col("n")).alias("before"))  # one row for each range
    within = F.row_number().over(Window.partitionBy(*group, "range").orderBy(order, "host", "id"))
    return rows.join(before, [*group, "range"]).withColumn(name, within + F.col("before")).drop("range", "before")


def fair_batches(queue: DataFrame, size: int = 25, *, url: str = "primaryImage", width: int = 100_000) -> DataFrame:
    """id, url, host, turn, batch: the queue in batches that interleave hosts.

    ``turn`` is an item's place within its host by id; batches take all first turns in the order of hosts, then all
    second turns, and so on, so no batch has a host twice while others wait for their first. A host with any share of all items is numbered in
    ranges of ids. Ids are distinct.
    """
    rows = queue.select("id", F.col(url).alias("url"), host_of(F.col(url)).alias("host"))
    turned = _numbered_by(rows, ["host"], "id", "turn", width)
    every = turned.withColumn("all", F.lit(0))
    placed = _numbered_by(every, ["all"], "turn", "place", max(1, width // 1000))
    return placed.select("id", "url", "host", F.col("turn").cast("long").alias("turn"), batch_number(F.col("place"), size).alias("batch"))


def fetch_by_host(queue: DataFrame, fetcher: Callable[[str], bytes], store: Callable[[str, bytes], None], *, per_second: float, base: str = PUBLIC_BASE, partitions: int | None = None) -> DataFrame:
    """id, ok, url, error, seconds for a queue from ``fair_batches``: no host gets more than ``per_second`` requests a second, whatever the
    number of tasks, as all of a host's items are dealt to one task. Within a task hosts take turns; an item's error doesn't touch
    others, and after RateLimited the rest of that host's items fail untried."""
    rows = queue.select("id", "url", "host", "turn")
    dealt = rows.repartition(partitions, "host") if partitions else rows.repartition("host")

    def run(frames):
        ready: dict[str, float] = {}
        closed: set[str] = set()
        for pdf in frames:
            out = []
            for i, source, host in zip(pdf["id"].tolist(), pdf["url"].tolist(), pdf["host"].tolist(), strict=True):
                if host in closed:
                    out.append((i, False, None, "RateLimited: not tried", 0.0))
                    continue
                now = time.monotonic()
                time.sleep(max(0.0, ready.get(host, now) - now))
                start = time.monotonic()
                ready[host] = start + 1.0 / per_second
                key = f"artworks/{i}.jpg"
                try:
                    _, error = _tried(lambda u, key=key: store(key, fetcher(u)), source, 1, 0)
                except RateLimited as e:
                    closed.add(host)
                    error = f"RateLimited: {e}"
                out.append((i, error is None, f"{base}/{key}" if error is None else None, error, time.monotonic() - start))
            yield pd.DataFrame(out, columns=["id", "ok", "url", "error", "seconds"])

    return dealt.sortWithinPartitions("turn", "host").mapInPandas(run, "id int, ok boolean, url string, error string, seconds double")


def report(results: DataFrame, rate: bool = False) -> DataFrame:
    """Successes, failures and their share by batch (batch 0: all); with ``rate`` also items per second of a request slot, from ``seconds``."""
    measures = [F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.avg(F.col("ok").cast("double")).alias("success_rate")]
    if rate:
        measures.append(F.try_divide(F.count("*").cast("double"), F.sum("seconds")).alias("items_per_second"))
    return results.rollup("batch").agg(*measures).withColumn("batch", F.coalesce("batch", F.lit(0)))
