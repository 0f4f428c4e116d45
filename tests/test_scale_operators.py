"""The vector index, the k-nearest join, tables of requests and moments, against exact answers by numpy and by single requests."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.operators import catalogue, components, field, fusion, knn_join, requests, vector_index
from vecatlas.sources import artworks as source

DIMENSION = 16


def catalogue_of(spark, rows):
    """Rows of (id, vector)."""
    return source.conform(spark.createDataFrame([(i, i, v, "u") for i, v in rows], "id int, objectId int, imgVec array<float>, localImageUrl string"))


@pytest.fixture(scope="module")
def clustered():
    """4000 vectors around 40 centres of very different sizes, some equal."""
    random = np.random.default_rng(3)
    centres = random.standard_normal((40, DIMENSION))
    of = np.minimum(random.geometric(0.08, 4000) - 1, 39)
    x = (centres[of] + 0.15 * random.standard_normal((4000, DIMENSION))).astype(np.float32)
    x[100:110] = x[100]
    return {i + 1: v for i, v in enumerate(x)}


@pytest.fixture(scope="module")
def items(spark, clustered):
    odd = [(9001, [0.0] * DIMENSION), (9002, None), (9003, [1.0, 2.0])]
    return catalogue_of(spark, [(i, v.tolist()) for i, v in clustered.items()] + odd).repartition(6).cache()


def exact(clustered, wanted, k, without_self=False):
    ids = np.array(sorted(clustered))
    x = np.array([clustered[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in wanted:
        s = x @ x[q - 1]
        order = np.lexsort((ids, -s))
        out[q] = [int(i) for i in ids[order] if not (without_self and i == q)][:k]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append(r["id"])
    return out


def near_enough(clustered, got, want):
    """The same ids in the same order, but for places of equal similarity to within rounding."""
    unit = lambda i: clustered[i].astype(np.float64) / np.linalg.norm(clustered[i].astype(np.float64))
    for q in want:
        assert len(got[q]) == len(want[q]) == len(set(got[q]))
        assert np.allclose([unit(q) @ unit(i) for i in got[q]], [unit(q) @ unit(i) for i in want[q]], atol=1e-12)


def test_index_recall_and_what_it_reads(spark, items, clustered, tmp_path):
    index = vector_index.build(items, f"file://{tmp_path}/index", cells=40, slices=4, rows_per_part=100)
    assert sum(index.rows) == len(clustered) and max(index.parts) > 1  # every item with a direction, large cells in parts
    targets = list(range(20, 4020, 20))
    asked = spark.createDataFrame([(t, [float(v) for v in clustered[t]]) for t in targets], "query long, vector array<double>")
    want = exact(clustered, targets, 160)
    got = lists(vector_index.search(spark, index, asked).collect())
    recall = [len(set(got[t]) & set(want[t])) / 160 for t in targets]
    assert len(targets) == 200 and np.mean(recall) >= 0.95
    assert all(got[t] == sorted(got[t], key=lambda i: want[t].index(i) if i in want[t] else 10**6) for t in targets[:20] if t not in range(100, 112))  # exact order

    few, facts = vector_index.similar(items, index, [20, 40], 50)
    again = vector_index.load(spark, index.path)
    assert again == index and facts["rows"] < 0.8 * facts["of_rows"]
    read = index.read(spark).where(F.col("cell").isin(sorted(set(index.cells_of([clustered[20], clustered[40]]).ravel().tolist()))))
    files = read.select(F.input_file_name()).distinct().count()
    assert files == facts["folders"] < sum(len(f) for _, _, f in os.walk(f"{tmp_path}/index/rows") if f)
    assert few.where("query = 20 and rank = 1").first()["similarity"] == pytest.approx(1.0)
    odd = spark.createDataFrame([(1, [0.0] * DIMENSION), (2, [1.0]), (3, None)], "query long, vector array<double>")
    assert vector_index.search(spark, index, odd).count() == 0


def test_index_of_nothing_and_of_little(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.build(catalogue_of(spark, [(1, None)]), f"file://{tmp_path}/none")
    index = vector_index.build(catalogue_of(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]), f"file://{tmp_path}/three", slices=2)
    got = vector_index.search(spark, index, spark.createDataFrame([(7, [1.0, 0.1])], "query long, vector array<double>"), 2).collect()
    assert lists(got) == {7: [1, 3]}
    with pytest.raises(ValueError):
        vector_index.build(catalogue_of(spark, [(1, [1.0, 0.0, 0.0])]), f"file://{tmp_path}/odd", slices=2)


def test_whole_catalogue_join_is_exact_and_skips(spark, items, clustered, monkeypatch):
    monkeypatch.setattr(knn_join, "BLOCK", 64)
    monkeypatch.setattr(knn_join, "ASKED", 64)
    monkeypatch.setattr(knn_join, "PART", 500)
    rows = items.where(catalogue.eligible()).select("id", "imgVec")
    found, facts = knn_join.knn_join(rows, rows, 7, cells=40)
    near_enough(clustered, lists(found.collect()), exact(clustered, clustered, 7))
    counts = facts.first()
    assert counts["joined"] < 0.4 * counts["pairs"]  # most pairs of blocks never meet
    # other numbers of cells, and without the item itself
    for cells in (1, 5):
        some = rows.where("id % 97 = 0")
        found, _ = knn_join.knn_join(some, rows, 9, cells=cells, without_self=True)
        got, want = lists(found.collect()), exact(clustered, range(97, 4001, 97), 9, without_self=True)
        near_enough(clustered, got, want)
        assert all(q not in ids for q, ids in got.items())


def test_join_of_few_rows(spark):
    df = catalogue_of(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0]), (6, [1.0])]).select("id", "imgVec")
    found, _ = knn_join.knn_join(df, df, 5)
    assert lists(found.collect()) == {1: [1, 2, 5], 2: [1, 2, 5], 5: [5, 1, 2]}
    assert knn_join.knn_join(df, df.where("false"), 5)[0].count() == 0
    assert knn_join.knn_join(df.where("false"), df, 5)[0].count() == 0


REQUESTS = "request long, targetId int, chunks array<struct<x double, y double>>, count int, seed long, exclude array<int>"


def test_requests_of_a_table_are_single_requests(spark, sf_dir):
    works = source.from_test_tables(spark, sf_dir).cache()
    basis = [r["imgVec"] for r in catalogue.targets(works, [3, 5])]
    rng = np.random.default_rng(5)
    ids = [r["id"] for r in works.where(catalogue.eligible()).orderBy("id").limit(40).collect()]
    rows = []
    for r in range(5):
        chunks = [(float(x), float(y)) for x, y in rng.integers(-12, 13, (int(rng.integers(1, 5)), 2))]
        rows.append((r, ids[r * 5], chunks, int(rng.integers(1, 50)), int(rng.integers(0, 99)), [ids[i] for i in rng.integers(0, 40, r)]))
    bad = [(100, 999_999, [(0.0, 0.0)], 5, 0, []), (101, None, [(0.0, 0.0)], 5, 0, []), (102, 3, [], 5, 0, None), (103, 3, [(None, 1.0)], 5, 0, None), (104, 3, None, 5, 0, None), (105, 0, [(0.0, 0.0)], 5, 0, [])]
    found, facts = requests.chunks_of_requests(works, spark.createDataFrame(rows + bad, REQUESTS), basis)
    got = {}
    for r in found.collect():
        got.setdefault(r["request"], set()).add((r["place"], r["x"], r["y"], r["pos"], r["id"], r["source"], None if r["similarity"] is None else round(r["similarity"], 9)))
    assert sorted(got) == [r[0] for r in rows]
    for number, item, chunks, count, seed, exclude in rows:
        single = field.many_chunks(works, item, chunks, basis, count=count, seed=seed, exclude=exclude).data.collect()
        assert got[number] == {(r["place"], r["x"], r["y"], r["pos"], r["id"], r["source"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in single}
    status = {r["request"]: r for r in facts.collect()}
    assert {k: status[k]["status"] for k in range(100, 106)} == {100: "not found", 101: "invalid", 102: "invalid", 103: "invalid", 104: "invalid", 105: "invalid"}
    for number, _, chunks, count, _, exclude in rows:
        s = status[number]
        assert s["status"] == "ok" and s["sim_picked"] + s["drift_picked"] + s["rand_picked"] == len(got[number]) == len(chunks) * count
        assert s["sim_candidates"] <= field.Limits.of_many(len(chunks)).sim and s["excluded"] == len({*exclude, ids[number * 5]})
    empty, none = requests.chunks_of_requests(works, spark.createDataFrame([], REQUESTS), basis)
    assert empty.count() == none.count() == 0


def test_moments_merge_and_repeat(spark, items, clustered, tmp_path):
    rows = items.where("id < 9001 or id = 9002")
    path = f"file://{tmp_path}/state"
    for batch in (0, 1, 2, 1):  # a repeated batch replaces itself
        components.update(path, batch, rows.where(F.col("id") % 3 == batch), DIMENSION)
    got, want = components.fit_state(components.state_at(spark, path)), components.fit(rows)
    assert got["n_samples"] == want["n_samples"] == len(clustered)
    assert np.allclose(got["basis"], want["basis"], atol=1e-9) and np.allclose(got["explained_variance_ratio"], want["explained_variance_ratio"])
    components.update(path, 3, rows.where("false"), DIMENSION)  # a batch without rows
    components.compact(spark, path, f"file://{tmp_path}/compact")
    assert np.allclose(components.fit_state(components.state_at(spark, f"file://{tmp_path}/compact"))["basis"], want["basis"], atol=1e-9)
    state = components.moments(rows, DIMENSION).orderBy("i").collect()
    x = np.array(list(clustered.values()), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose([r["products"] for r in state], x.T @ x) and np.allclose([r["total"] for r in state], x.sum(axis=0))
    with pytest.raises(ValueError):
        components.fit_state(components.moments(rows.where("false"), DIMENSION))
    with pytest.raises(Exception, match="dimensions"):
        components.moments(items.where("id = 9003"), DIMENSION).collect()
    assert math.isclose(sum(r["products"][r["i"]] for r in state), len(clustered))


def test_whole_fusion_against_full_sort(spark):
    rng = np.random.default_rng(3)
    for n, values, k, weights in ((400, 1000, 7, (1.0, 1.0)), (300, 5, 10, (3.0, 0.5)), (200, 1, 5, (1.0, 2.0)), (3, 9, 10, (1.0, 1.0)), (150, 40, 6, (1.0, 0.0))):
        a, b = rng.integers(0, values, (2, n)) / 8
        rows = [(int(i), None if i % 11 == 3 else float(a[i]), None if i % 7 == 2 else float(b[i])) for i in rng.permutation(n)]
        ranks = []
        for c in (1, 2):
            ranks.append({r[0]: p + 1 for p, r in enumerate(sorted((r for r in rows if r[c] is not None), key=lambda r: (-r[c], r[0])))})
        shares = {r[0]: sum(w / (60 + x[r[0]]) for w, x in zip(weights, ranks, strict=True) if r[0] in x) for r in rows}
        want = [(i, round(s, 12), ranks[0].get(i), ranks[1].get(i)) for i, s in sorted(shares.items(), key=lambda x: (-round(x[1], 12), x[0])) if s][:k]
        found, facts = fusion.fuse_whole(spark.createDataFrame(rows, "id long, text double, image double").repartition(3), k=k, w_text=weights[0], w_image=weights[1])
        assert [(r["id"], round(r["score"], 12), r["text_rank"], r["image_rank"]) for r in found.collect()] == want
        assert facts["candidates"] <= 2 * facts["depth"] and facts["depth"] <= 2 * (60 + k)
    none, _ = fusion.fuse_whole(spark.createDataFrame([], "id long, text double, image double"))
    assert none.count() == 0
    with pytest.raises(ValueError):
        fusion.depth_needed(5, 0.0, 0.0, 60)


def test_bootstrap_intervals_cover_known_rates(spark):
    rng = np.random.default_rng(8)
    rows = [(e, 1000 * e + q, int(rng.binomial(5, 0.2 + 0.006 * e)), 5) for e in range(100) for q in range(80)]
    found = fusion.intervals(spark.createDataFrame(rows, "trial int, query long, hits int, judged int"), ["trial"]).collect()
    inside = sum(r["low"] <= 0.2 + 0.006 * r["trial"] <= r["high"] for r in found)
    assert len(found) == 100 and 86 <= inside  # 95 expected
    for r in found:
        own = [x for x in rows if x[0] == r["trial"]]
        assert math.isclose(r["hit_rate"], sum(x[2] for x in own) / 400) and r["low"] < r["hit_rate"] < r["high"] < r["low"] + 0.2
