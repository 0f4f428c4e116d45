"""Tables in parts, bitmaps of what was seen, merged sketches, fair batches and budgets of hosts."""

import datetime
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.operators import ingest, seen, telemetry
from vecatlas.sources import artworks as source
from vecatlas.sources import parts
from vecatlas.streaming import jobs


def small(spark, n):
    rows = [(i, i, None if i % 3 == 0 else [float(i), 1.0], None if i % 2 else f"u{i}") for i in range(1, n + 1)]
    return source.conform(spark.createDataFrame(rows, "id int, objectId int, imgVec array<float>, localImageUrl string"))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def addresses(spark, path):
    return {r["id"]: r["localImageUrl"] for r in parts.read(spark, path, source.SCHEMA).collect()}


def test_an_update_rewrites_only_what_it_touches(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    parts.create(small(spark, 60), path, width=10)
    before, old = files(f"{tmp_path}/table/rows"), addresses(spark, path)
    results = spark.createDataFrame([(11, "new11"), (13, "new13"), (13, "also13"), (15, None), (999, "of nobody"), (None, "x")], "id int, url string")
    assert parts.apply(spark, path, results, 1, {"localImageUrl": "url"}, width=10, schema=source.SCHEMA)
    after, now = files(f"{tmp_path}/table/rows"), addresses(spark, path)
    assert {k for k in before if k in after and after[k] == before[k]} == {k for k in before if "part=1/" not in k}
    assert now == old | {11: "new11", 13: "new13"}
    # the same batch again changes nothing, not even after a later one
    assert parts.apply(spark, path, spark.createDataFrame([(11, "later")], "id int, url string"), 2, {"localImageUrl": "url"}, width=10, schema=source.SCHEMA)
    settled = files(f"{tmp_path}/table/rows")
    assert not parts.apply(spark, path, results, 1, {"localImageUrl": "url"}, width=10, schema=source.SCHEMA)
    assert files(f"{tmp_path}/table/rows") == settled and addresses(spark, path)[11] == "later"
    assert parts.apply(spark, path, results.where("false"), 3, {"localImageUrl": "url"}, width=10, schema=source.SCHEMA)
    assert files(f"{tmp_path}/table/rows") == settled


def test_a_batch_that_failed_in_the_middle_goes_on(spark, tmp_path, monkeypatch):
    import shutil

    path = f"file://{tmp_path}/table"
    parts.create(small(spark, 30), path, width=10)
    old = addresses(spark, path)
    results = spark.createDataFrame([(i, f"new{i}") for i in range(8, 14)], "id int, url string")
    args = (spark, path, results, 7, {"localImageUrl": "url"})
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(OSError("killed before the note")))
    with pytest.raises(OSError):
        parts.apply(*args, width=10, schema=source.SCHEMA)
    monkeypatch.undo()
    assert real is not None and not parts.applied(spark, path, 7)
    shutil.rmtree(f"{tmp_path}/table/rows/part=1")  # as if the swap itself had stopped after taking the old part away
    assert parts.apply(*args, width=10, schema=source.SCHEMA)
    assert addresses(spark, path) == old | {i: f"new{i}" for i in range(8, 14)}
    assert not os.path.exists(f"{tmp_path}/table/pending/7")


def test_stream_into_parts(spark, tmp_path):
    table, inbox = f"file://{tmp_path}/table", f"{tmp_path}/inbox"
    works = small(spark, 40)
    parts.create(works, table, width=10)
    encode = ingest.stub_encoder(2)
    works.where("id <= 20").coalesce(1).write.parquet(inbox)
    run = lambda: jobs.embedding_into_parts(spark, inbox, table, f"{tmp_path}/checkpoint", encode, width=10).awaitTermination()
    run()
    first = files(f"{tmp_path}/table/rows")
    run()  # nothing new
    assert files(f"{tmp_path}/table/rows") == first
    works.where("id > 20").coalesce(1).write.mode("append").parquet(inbox)
    run()
    again = files(f"{tmp_path}/table/rows")
    assert all(again.get(k) == t for k, t in first.items() if re.search("part=[01]/", k))
    rows = {r["id"]: r for r in parts.read(spark, table, source.SCHEMA).collect()}
    assert {i for i, r in rows.items() if r["imgVec"] is None} == {i for i in rows if i % 3 == 0 and i % 2}
    v = encode("u6")
    assert np.allclose(rows[6]["imgVec"], v / np.linalg.norm(v), atol=1e-6) and rows[7]["imgVec"] == [7.0, 1.0]


def test_seen_sets(spark):
    rng = random.Random(1)
    ids = [1, 2, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, 10**9]
    views = [(rng.randint(1, 9), rng.choice(ids)) for _ in range(60)] + [(None, 5), (3, None), (3, 0), (3, -4)]
    lists = [(u, i, "x") for u in range(1, 12) for i in [*ids, 3, 32770]] + [(None, 1, "x"), (1, None, "x"), (1, -4, "x"), (1, 2, "again"), (1, 2, "again")]
    v = spark.createDataFrame(views, "user long, id long").repartition(3)
    asked = spark.createDataFrame(lists, "user long, id long, bucket string").repartition(3)
    sets = seen.merged(seen.bitmaps(v.where("id % 2 = 0")), seen.bitmaps(v.where("id % 2 = 1")), seen.bitmaps(v))
    have = {x for x in views if x[0] is not None and (x[1] or 0) > 0}
    got = sorted((tuple(r) for r in seen.unseen(asked, sets).collect()), key=repr)
    assert got == sorted((x for x in lists if x[:2] not in have), key=repr)
    plan = seen.unseen(asked, sets)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
    assert {r["user"]: r["n"] for r in seen.counts(sets).collect()} == {u: len({i for w, i in have if w == u}) for u in {u for u, _ in have}}


def test_sketches_merge_to_any_window(spark):
    rng = np.random.default_rng(2)
    start = datetime.datetime(2024, 1, 1)
    values = {k: rng.lognormal(1, s, 6000) for k, s in (("view", 1.0), ("click", 2.5))}
    rows = [(k, start + datetime.timedelta(minutes=i % 600), float(x)) for k, v in values.items() for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, ("view", start, None)], "event_type string, ts timestamp, value double").repartition(7)
    stored = telemetry.latency_sketches(df)
    assert stored.count() == 20
    for hours in ((0, 10), (2, 5)):
        a, b = (start + datetime.timedelta(hours=h) for h in hours)
        found = {r["kind"]: r for r in telemetry.latency_of_windows(stored, start=a, end=b).collect()}
        for k in values:
            own = np.sort([x for kind, t, x in rows if kind == k and a <= t < b])
            assert found[k]["n"] == len(own)
            for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                low, high = np.searchsorted(own, found[k][p], "left") / len(own), np.searchsorted(own, found[k][p], "right") / len(own)
                assert low - telemetry.RANK_ERROR <= q <= high + telemetry.RANK_ERROR


def test_fair_batches_interleave_hosts(spark):
    urls = [(i, f"https://busy.org/{i}") for i in range(1, 300)] + [(i, f"http://u@H{i % 7}.org:80/x?y#z") for i in range(300, 350)] + [(350, None), (351, "no address")]
    queue = spark.createDataFrame(urls, "id int, primaryImage string").repartition(5)
    rows = ingest.fair_batches(queue, 10, width=20).orderBy("batch", "turn", "host").collect()
    host = lambda u: (re.match(r"[a-z]+://(?:[^@/]*@)?([^/:?#]*)", u or "", re.I) or ["", ""])[1].lower()
    turns, want = {}, []
    for i, u in urls:
        turns[host(u)] = turns.get(host(u), 0) + 1
        want.append((turns[host(u)], host(u), i))
    assert [(r["turn"], r["host"], r["id"]) for r in rows] == sorted(want)
    assert [r["batch"] for r in rows] == [k // 10 + 1 for k in range(len(want))]


@pytest.mark.parametrize("tasks", [1, 4])
def test_a_hosts_budget_does_not_grow_with_tasks(spark, tmp_path, tasks):
    log = str(tmp_path / "log")
    queue = spark.createDataFrame([(i, f"http://h{i % 2}/{i}") for i in range(24)], "id int, primaryImage string").repartition(4)

    def fetcher(url):
        with open(log, "a") as f:
            f.write(f"{url[7:9]} {time.time()}\n")
        if url.endswith("/5"):
            raise OSError("refused")
        return b"x"

    numbered = ingest.fair_batches(queue)
    rows = ingest.fetch_by_host(numbered, fetcher, lambda key, data: None, per_second=20.0, partitions=tasks).collect()
    assert len(rows) == 24 and [r["id"] for r in rows if not r["ok"]] == [5]
    for h in ("h0", "h1"):
        times = [float(line.split()[1]) for line in open(log) if line.startswith(h)]
        assert len(times) == 12 and min(np.diff(times)) > 0.045  # 20 a second, with 1 and with 4 tasks


def test_a_host_that_says_429_is_left_alone(spark, tmp_path):
    queue = spark.createDataFrame([(i, f"http://{'full' if i % 2 else 'free'}/{i}") for i in range(10)], "id int, primaryImage string")

    def fetcher(url):
        if url == "http://full/3":
            raise ingest.RateLimited("status 429")
        return b"x"

    rows = ingest.fetch_by_host(ingest.fair_batches(queue), fetcher, lambda key, data: None, per_second=1000.0, partitions=3).collect()
    assert {r["id"]: r["ok"] for r in rows} == {i: i % 2 == 0 or i < 3 for i in range(10)}
    assert {r["error"] for r in rows if r["id"] > 3 and not r["ok"]} == {"RateLimited: not tried"}
