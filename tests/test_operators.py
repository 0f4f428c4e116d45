import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.functions import noise
from vecatlas.operators import catalogue, components, field, fusion, ingest, knn, telemetry
from vecatlas.sources import artworks as source
from vecatlas.sources import stores
from vecatlas.streaming import jobs


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return source.from_test_tables(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def basis(items):
    return components.fit(items)["basis"]


def small(spark, rows):
    """Rows of (id, vector, stored address)."""
    return source.conform(spark.createDataFrame([(i, i, v, u) for i, v, u in rows], "id int, objectId int, imgVec array<float>, localImageUrl string"))


def test_eligibility_and_ties(spark):
    df = small(spark, [(1, [1.0, 0.0], "u"), (2, [2.0, 0.0], "u"), (3, [0.0, 0.0], "u"), (4, None, "u"), (5, [1.0, 1.0], None), (6, [1.0, 1.0], ""), (7, [0.0, 1.0], "u"), (8, [1.0], "u")])
    rows = [(r["id"], round(r["similarity"], 6)) for r in knn.similar(df, 1).data.collect()]
    assert rows == [(1, 1.0), (2, 1.0), (7, 0.0)]
    many = knn.nearest_of_many(df.where(catalogue.eligible()), [[1.0, 0.0], [0.0, 1.0]], [2, 1]).orderBy("query", "rank").collect()
    assert [(r["query"], r["id"], r["rank"]) for r in many] == [(0, 1, 1), (0, 2, 2), (1, 7, 1)]
    for bad in (4, 5, 6, 99):
        with pytest.raises(catalogue.TargetNotFound):
            catalogue.target(df, bad)
    with pytest.raises(ValueError):
        catalogue.target(df, 0)


def test_sample_does_not_depend_on_partitions(items):
    a = [r["id"] for r in catalogue.random_sample(items, 42, 50).data.collect()]
    assert a == [r["id"] for r in catalogue.random_sample(items.repartition(7), 42, 50).data.collect()]
    assert a != [r["id"] for r in catalogue.random_sample(items, 43, 50).data.collect()]
    assert len(set(a)) == 50


def test_requests():
    assert [catalogue.clamped(x, 20, 1, 50) for x in (None, "x", 0, -3, 7, 99, "12", "12abc", "1e3", "inf")] == [20, 20, 20, 1, 7, 50, 12, 12, 1, 20]
    assert catalogue.id_list("1, 2,x,,-3,4.5,7abc,--5,²") == [1, 2, -3, 4, 7]
    for args in ((0, 1, 1), (3, float("nan"), 1)):
        with pytest.raises(ValueError):
            field.one_chunk(None, *args, basis=[])
    for chunks in ([], [(0, 0)] * 17, [("a", 0)], "no"):
        with pytest.raises(ValueError):
            field.many_chunks(None, 3, chunks, [])
    with pytest.raises(ValueError):
        field.many_chunks(None, 3, [(0, 0)], [], count="5")


def test_exclusion_before_and_after(spark, items):
    top = [r["id"] for r in knn.nearest_without(items, 3, 10, [], after=False).collect()]
    assert 3 not in top
    after = [r["id"] for r in knn.nearest_without(items, 3, 10, top[:2], after=True).collect()]
    before = [r["id"] for r in knn.nearest_without(items, 3, 10, top[:2], after=False).collect()]
    assert after == top[2:] and before[:8] == top[2:] and len(before) == 10
    wide = list(range(-2000, 0)) + top[:2]
    assert [r["id"] for r in catalogue.without(items.where(F.col("id").isin(top)), wide).orderBy("id").collect()] == sorted(top[2:])


def test_pca_against_svd(items):
    fitted = components.fit(items)
    x = np.array([r[0] for r in items.where(catalogue.eligible()).select("imgVec").collect()], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = np.array(fitted["basis"])
    assert np.abs(np.abs((got * v[:4]).sum(axis=1)) - 1).max() < 1e-9
    assert np.allclose(fitted["explained_variance_ratio"], (s**2 / (s**2).sum())[:4])
    assert (got[np.arange(4), np.abs(got).argmax(axis=1)] > 0).all() and fitted["n_samples"] == len(x)


def picks(response):
    return [tuple(r) for r in response.data.orderBy("pos").select("pos", "id", "source", "similarity").collect()]


def test_one_chunk(items, basis):
    near, far = field.one_chunk(items, 3, 0, 0, basis), field.one_chunk(items, 3, 12, 5, basis)
    assert {s for _, _, s, _ in picks(near)} == {"sim"} and {s for _, _, s, _ in picks(far)} == {"rand"}
    assert all(s is None for *_, s in picks(far))
    assert near.meta["t"] < far.meta["t"]
    mid = field.one_chunk(items.repartition(5), 3, -3, 8, basis, count=50, exclude=[5, 6])
    got = picks(mid)
    assert got == picks(field.one_chunk(items, 3, -3, 8, basis, count=50, exclude=[5, 6]))
    ids = [i for _, i, _, _ in got]
    assert len(ids) == len(set(ids)) == 50 and not {3, 5, 6} & set(ids)
    # the pick draws go on after the noise's
    drawn = noise.draws(noise.hash32(3, -3, 8, 0), 50, 2 * 64)
    share = noise.weights(noise.temperature(math.hypot(-3, 8)))
    assert [s for _, _, s, _ in got] == ["sim" if u < share[0] else "drift" if u < share[0] + share[1] else "rand" for u in drawn]


def test_many_chunks_never_repeat(items, basis):
    chunks = [(12, 0), (0, 0), (1, 0), (5, 5)] * 4
    rows = field.many_chunks(items, 3, chunks, basis, count=50, exclude=[5]).data.collect()
    ids = [r["id"] for r in rows]
    assert len(ids) == len(set(ids)) and not {3, 5} & set(ids)
    eligible = items.where(catalogue.eligible()).count() - 2
    assert len(ids) == min(eligible, 16 * 50)  # pools run out, and others stand in
    radii = {r["place"]: math.hypot(r["x"], r["y"]) for r in rows}
    assert [radii[p] for p in sorted(radii)] == sorted(radii.values())


def test_fallback_order():
    import pandas as pd

    pools = pd.DataFrame([(-1, "sim", 1, 1, 0.9), (0, "drift", 1, 2, 0.8), (0, "rand", 1, 3, None), (0, "rand", 2, 1, None)], columns=["place", "source", "rank", "id", "similarity"])
    chunk = {"place": 0, "x": 0.0, "y": 0.0, "seed": 1, "skipped": 0, "offset": 5}
    out = field._pick(pools, [chunk], 10, {9})
    assert out["id"].tolist() == [1, 2, 3] and out["source"].tolist() == ["sim", "drift", "rand"]
    assert field._rotated([1, 2, 3], 1) == [2, 3, 1] and field._rotated([1, 2, 3], 3) == [1, 2, 3]


def test_basis_document(spark, items, tmp_path):
    fitted = components.fit(items)
    path = str(tmp_path / "basis.json")
    stores.write_basis(spark, path, fitted["basis"], fitted["explained_variance_ratio"], fitted["n_samples"])
    assert np.allclose(stores.read_basis(spark, path), fitted["basis"])
    stores.write_basis(spark, path, [[1.0, 2.0]], [1.0], 3)
    with pytest.raises(ValueError):
        stores.read_basis(spark, path)


def test_vector_text(spark):
    df = spark.createDataFrame([("[1,2.5,-3]",), ("[1,x]",), (None,)], "t string").select(stores.vector_from_text("t").alias("v"))
    assert [r["v"] for r in df.collect()] == [[1.0, 2.5, -3.0], None, None]


def test_violations_and_old_files(spark, tmp_path):
    spark.createDataFrame([(1, 1, "d" * 201), (1, 2, "x")], "id int, objectId int, date string").write.parquet(str(tmp_path / "old"))
    df = source.read_parquet(spark, str(tmp_path / "old"))
    assert df.columns == source.SCHEMA.fieldNames() and df.where("importedAt is null or imgVec is not null").count() == 0
    assert {r["rule"]: r["n"] for r in source.violations(df).collect()} == {"date longer than 200": 1, "id repeated": 1}


def test_ingest_keeps_errors_apart_and_resumes(spark, items):
    def fetcher(u):
        if u.endswith("7"):
            raise OSError("no")
        return b"x"

    queue = catalogue.download_queue(items)
    results = ingest.fetch(queue, fetcher, lambda k, b: None, attempts=2, pause=0.0).cache()
    failed = results.where(~F.col("ok")).count()
    assert failed == queue.where("primaryImage like '%7'").count() and results.count() == queue.count()
    again = catalogue.download_queue(ingest.with_urls(items, results))
    assert again.count() == failed
    vectors = ingest.embed(catalogue.embedding_queue(items), ingest.stub_encoder(64))
    assert catalogue.embedding_queue(ingest.with_vectors(items, vectors)).count() == 0
    total = ingest.report(results.join(ingest.numbered(queue).select("id", "batch"), "id")).where("batch = 0").first()
    assert (total["succeeded"], total["failed"]) == (results.count() - failed, failed)


def test_ingest_stops_when_limited(spark):
    queue = spark.range(1, 41).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("u"), "id").alias("primaryImage")).coalesce(1)

    def fetcher(u):
        if u == "u11":
            raise ingest.RateLimited("status 429")
        return b"x"

    rows = {r["id"]: r for r in ingest.fetch(queue, fetcher, lambda k, b: None, attempts=3, pause=0.0).collect()}
    assert [i for i, r in rows.items() if r["ok"]] == list(range(1, 11))
    assert rows[11]["error"] == "RateLimited: status 429" and rows[40]["error"] == "RateLimited: not tried"
    several = ingest.fetch(queue, lambda u: b"x", lambda k, b: None, concurrency=4, jitter=0.001)
    total = ingest.report(several.join(ingest.numbered(queue, 25, 10), "id"), rate=True).orderBy("batch").collect()
    assert [(r["batch"], r["succeeded"]) for r in total] == [(0, 40), (1, 25), (2, 15)] and total[0]["items_per_second"] > 0


def test_embedding_stops_when_limited(spark):
    queue = spark.range(1, 6).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("u"), "id").alias("localImageUrl")).coalesce(1)

    def encode(u):
        if u == "u3":
            raise ingest.RateLimited("status 429")
        return np.ones(2)

    rows = [(r["id"], r["ok"], r["error"]) for r in ingest.embed(queue, encode).orderBy("id").collect()]
    assert rows[:3] == [(1, True, None), (2, True, None), (3, False, "RateLimited: status 429")] and rows[4] == (5, False, "RateLimited: not tried")


def test_http_fetcher():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(int(self.path[1:]))
            self.end_headers()
            self.wfile.write(self.headers["User-Agent"].encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    get, at = ingest.http_fetcher("a test"), f"http://127.0.0.1:{server.server_port}"
    assert get(f"{at}/200") == b"a test"
    with pytest.raises(ingest.RateLimited):
        get(f"{at}/429")
    with pytest.raises(OSError, match="status 404"):
        get(f"{at}/404")
    server.shutdown()


def test_response_is_counted(items):
    rows, meta = catalogue.random_sample(items, 42, 7).fetched()
    assert len(rows) == meta["totalItems"] == 7 and meta["processingTime"] >= 0 and meta["seed"] == 42


def test_no_results(spark):
    asked, given = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert tuple(telemetry.no_results(asked, given, "k").first()) == (4, 3, 0.75)


def test_embedding_stream_resumes(spark, items, tmp_path):
    where = {k: str(tmp_path / k) for k in ("in", "out", "check")}
    items.write.parquet(where["in"])
    for _ in range(2):
        jobs.embedding_job(spark, where["in"], where["out"], where["check"], ingest.stub_encoder(8)).awaitTermination()
    done = spark.read.parquet(where["out"])
    assert done.count() == done.select("id").distinct().count() == catalogue.embedding_queue(items).count()


def test_telemetry_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    jobs.telemetry_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from windows").first()[0] == events.count()


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    got = [(r["id"], r["score"], r["text_rank"], r["image_rank"]) for r in fusion.fuse(a, b).collect()]
    assert got == [(2, pytest.approx(1 / 62 + 1 / 61), 2, 1), (1, pytest.approx(1 / 61), 1, None), (3, pytest.approx(1 / 62), None, 2)]


def test_integrity(spark):
    df = small(spark, [(1, [1.0, float("nan")], "u"), (2, [0.0, 0.0], "u"), (3, None, "u"), (4, [1.0], "u")])
    assert tuple(telemetry.vector_integrity(df, 2).first()) == (4, 1, 1, 1, 1)
    assert tuple(telemetry.vector_coverage(df).first()) == (4, 3, 0.75)


def test_top_k_stays_in_the_scan_tasks(items):
    plan = knn.nearest(items.where(catalogue.eligible()), [1.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_jdbc(spark, items):
    url = "jdbc:derby:memory:catalogue;create=true"
    text = items.where("id <= 20").select("id", "objectId", "title", stores.vector_to_text("imgVec").alias("imgVec"))
    text.write.jdbc(url, "art", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = stores.read_jdbc(spark, url, "art", partitions=3, bounds=(1, 20), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.columns == source.SCHEMA.fieldNames() and got.rdd.getNumPartitions() == 3
    key = lambda df: sorted((r["id"], r["title"], r["imgVec"]) for r in df.select("id", "title", "imgVec").collect())
    assert key(got) == key(items.where("id <= 20"))


def test_ping(spark):
    assert stores.ping(spark).count() == 1
