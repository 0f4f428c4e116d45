"""Decontamination, near-duplicates, fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecatlas.llm import common, components, decontam, imatch, order_minhash, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_words():
    for t in ("Ab-c1 É\x00x ÀB_9{~}", "", "日本 語a", None, "a\x0bb\x85c\xa0d"):
        assert [w.decode() for w in decontam.words_of(t)] == words(t)


def decontaminated(docs, items, window=10):
    out = {}
    patterns = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k : k + n])].add(i)
    sizes = {len(p) for p in patterns}
    for key, (i, t) in enumerate(docs):
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := patterns.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        found.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[key] = (i, len(w), len(hit), len(found), digest, bool(hit))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("max_bytes", [4 << 20, 60])
def test_decontamination_against_brute_force(spark, max_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "é", "D"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 4, 7, 12]))) for k in range(8)] + [(8, None), (9, ""), (9, text(6)), (None, text(3))]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(60, None), (None, text(30)), (5, text(9))]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, items string, n_words string")
    got = decontam.report(decontam.find(d, b, keep=["doc_id"], window=4, max_bytes=max_bytes), ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=str) == decontaminated(docs, items, 4)


def test_tables_have_bounded_memory():
    """What a worker holds for a group of the default size, if all its words differ."""
    import tracemalloc

    rng = random.Random(15)
    items = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(1000))) for k in range(30)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    tables = decontam.tables_of(items, 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert tables and held < 80 * size and peak < 120 * size


def test_decontamination_whole_table(spark, sf_dir):
    got = sorted(map(tuple, queries.op6_decontamination(spark, sf_dir).collect()), key=str)
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    assert got == decontaminated(docs, items)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    sql = c.sql(queries.OP6_SQL).df()[["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]]
    assert sorted(map(tuple, sql.itertuples(index=False, name=None)), key=str) == got


def test_decontamination_awkward(spark, awkward, nothing, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.find(awkward, b).count() == awkward.count() and decontam.find(nothing, b).count() == 0
    assert decontam.report(decontam.find(awkward, b.limit(0), keep=["doc_id"]), ["doc_id"]).where("contaminated").count() == 0


# Near-duplicates


def common_words(a, b):
    """Longest common subsequence by the textbook's table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def word_likeness(a, b):
    """Aligned words over all words; 0 if the words' counts alone forbid 0.8."""
    n, most = len(a) + len(b), sum((Counter(a) & Counter(b)).values())
    if not a or not b or most < 0.8 * (n - most):
        return 0.0
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    common = start + end + common_words(a[: len(a) - end], b[: len(b) - end])
    return common / (n - common)


def linked(rows, at_least=0.8):
    """All pairs of different texts that are alike, by comparing all."""
    texts = sorted({t or "" for _, t in rows})
    split = {t: words(t) for t in texts}
    order = sorted(texts, key=lambda t: len(split[t]))
    out = []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if len(split[a]) < at_least * len(split[b]):
                break
            if word_likeness(split[a], split[b]) >= at_least:
                out.append((a, b))
    return out


def classes(rows, links=None):
    """Classes of all rows by comparing all texts."""
    parent = {t or "": t or "" for _, t in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked(rows) if links is None else links:
        parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        r = find(t or "")
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, least[find(t or "")]) for i, t in rows), key=str)


def check_classes(rows, got, recall):
    """No class joins what links do not join; of the linked pairs of texts the given share is in one class."""
    links = linked(rows)
    text_of = {i: t or "" for i, t in rows}
    found = {(r["doc_id"]): r["class_id"] for r in got}
    want = dict(classes(rows, links))
    of_class = defaultdict(set)
    for i, c in found.items():
        of_class[c].add(want[i])
    assert all(len(x) == 1 for x in of_class.values())
    least = {}
    for i, t in text_of.items():
        least.setdefault(t, i)
    together = sum(found[least[a]] == found[least[b]] for a, b in links)
    assert together >= recall * len(links), (together, len(links))
    return len(links)


def near_texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    shared = " ".join(word() for _ in range(60))
    for size in (6, 12, 40, 200, 900):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 4, 9):
                t = base[:]
                for _ in range(edits):
                    at = rng.randrange(len(t))
                    rng.choice((lambda: t.insert(at, word()), lambda: t.__setitem__(at, word()), lambda: t.pop(at) if len(t) > 5 else None))()
                rows.append((k, " ".join(t) + (" " + shared if rng.random() < 0.2 else "")))
                k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, "!!"), (k + 3, "!!"), (k + 4, "one two"), (k + 5, "One, two"), (k + 5, "One, two"), (None, "null id with text"), (None, None)]


def test_classes_against_all_pairs(spark):
    rows = near_texts()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, class_id string").repartition(5)
    got = order_minhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert check_classes(rows, got, 0.95) > 100
    kept = order_minhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({r["class_id"] for r in got}, key=str)


def test_classes_whole_table(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert check_classes(rows, queries.op9_order_minhash(spark, sf_dir).collect(), 0.95) >= 3


def test_recall_of_edited_copies(spark):
    """Of copies with one word in ten to fifteen changed, put in or left out, nine in ten are found at least."""
    rng = random.Random(12)
    rows, pairs = [], []
    for k in range(300):
        base = [f"{k}w{rng.randrange(400)}" for _ in range(rng.randint(60, 600))]
        t = base[:]
        for _ in range(len(base) // rng.randint(11, 15)):
            at, new = rng.randrange(len(t)), f"{k}n{rng.randrange(10**6)}"
            rng.choice((lambda: t.insert(at, new), lambda: t.__setitem__(at, new), lambda: t.pop(at)))()
        if word_likeness(base, t) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(t))]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(pairs) > 250
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[i] // 2 == i // 2 for i, _ in rows)


def test_large_group_of_near_copies(spark):
    """Pairs grow with the group, not with its square, and the group is one class."""
    rng = random.Random(8)
    base = [str(i) for i in range(300)]
    rows = []
    for k in range(400):
        t = base[:]
        t[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(t)))
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), run_length=50)
    assert {r["class_id"] for r in got.collect()} == {0}
    assert got.agg(F.sum("n_links")).first()[0] / 2 < 400 * 2 * 32


def edited(rng, words, edits, mark):
    t = words[:]
    for at in rng.sample(range(len(t)), edits):
        t[at] = f"{mark}e{at}"
    return t


def test_star_of_independent_copies(spark):
    """2000 copies are alike to their original only, and all are of its class."""
    rng = random.Random(10)
    base = [str(i) for i in range(504)]
    rows = [(0, " ".join(base))] + [(k, " ".join(edited(rng, base, 40, k))) for k in range(1, 2001)]
    some = [words(t) for _, t in rows[:20]]
    assert all(word_likeness(some[0], s) >= 0.8 for s in some) and max(word_likeness(some[i], some[j]) for i in range(1, 20) for j in range(1, i)) < 0.8
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    own = sum(r["class_id"] == 0 for r in got.collect())
    assert own >= 0.97 * len(rows)
    assert got.agg(F.sum("n_links")).first()[0] / 2 < 2001 * 2 * 32


@pytest.mark.parametrize("block_words", [500_000, 5_000])
def test_pairs_in_a_bucket_without_an_original(spark, block_words):
    """Copies that are not alike share buckets with pairs that are: each pair is found, in one block and across blocks."""
    rng = random.Random(11)
    base = [str(i) for i in range(300)]
    copies = [edited(rng, base, 25, k) for k in range(120)]
    rows = [(k, " ".join(t)) for k, t in enumerate([*copies, *(edited(rng, t, 1, f"y{i}") for i, t in enumerate(copies[:60]))])]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_words=block_words)
    want = classes(rows)
    assert len({c for _, c in want}) > 30
    assert sorted(((r["doc_id"], r["class_id"]) for r in got.collect()), key=str) == want


def test_common_counts():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 5), (30, 40), (90, 3000)):
        sets = [np.unique(rng.integers(kinds, size=rng.integers(kinds))).astype(np.uint64) for _ in range(n)]
        got = order_minhash._common(np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets]), n)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)


def test_sketches_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "", None, "x y", "a b c d e f", " ".join(map(str, range(3000)))]
    together = order_minhash.band_keys(texts, bands=4, per_band=1, k=5)
    for t, row in zip(texts, together, strict=True):
        assert (order_minhash.band_keys([t], bands=4, per_band=1, k=5)[0] == row).all()
    assert not together[1].any() and not together[2].any() and (together[0] == together[4]).all()


def test_labelled_kmers_by_hand():
    found, counts = order_minhash.labelled_kmers(["a b a b a b a b a b c", "p q"])
    assert counts.tolist() == [7, 1] and len(set(found.tolist())) == 8
    again, _ = order_minhash.labelled_kmers(["p q", "a b a b a b a b a b c"])
    assert again.tolist() == [*found[7:], *found[:7]]


@pytest.mark.parametrize("anchored", [0, 10_000])
def test_alignment_is_the_longest_common_subsequence(monkeypatch, anchored):
    monkeypatch.setattr(order_minhash, "_ANCHORED", anchored)
    rng = random.Random(13)
    assert order_minhash._chain(np.array([3, 1, 2, 5, 4, 6])).tolist() in ([1, 2, 3, 5], [1, 2, 4, 5])
    hashed = lambda w: order_minhash.word_hashes([" ".join(w)])[0]
    for kinds in (3, 50, 5000):
        for n in (1, 3, 8, 40, 300):
            a = [str(rng.randrange(kinds)) for _ in range(n)]
            assert order_minhash.similarity(hashed(a), hashed(a), 0.8) == 1.0
            for edits in (1, n // 20, n // 10, n):
                b = a[:]
                for _ in range(edits):
                    at, new = rng.randrange(len(b) + 1), str(rng.randrange(kinds))
                    b[at:at] = [new] if rng.random() < 0.3 else []
                    if b and rng.random() < 0.6:
                        b[rng.randrange(len(b))] = new
                    if len(b) > 1 and rng.random() < 0.3:
                        b.pop(rng.randrange(len(b)))
                want, got = word_likeness(a, b), order_minhash.similarity(hashed(a), hashed(b), 0.8)
                assert order_minhash.common_subsequence(hashed(a), hashed(b)) == common_words(a, b)
                assert got <= want + 1e-9 and (want < (0.8 if anchored else 0.82) or got >= (1 if anchored else 0.98) * want - 1e-9), (want, got)
    half = [str(i) for i in range(100)]
    assert order_minhash.similarity(hashed(half), hashed(half[50:] + half[:50]), 0.8) == 0.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (102, 101), (7, 7), (50, 60), (60, 50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}, 50: 50, 60: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shuffled_tasks(spark, group, run):
    """Tasks of the stages that ran, where each exchange has 20 partitions."""
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    return sum(x.numCompletedTasks for i in stages if (x := tracker.getStageInfo(i)))


def test_rounds_of_components_deal_edges_out_twice(spark):
    """Two shuffles a round: with many partitions, what a round costs is its tasks."""
    edges = common.written(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").coalesce(1))
    found = []
    assert shuffled_tasks(spark, "components", lambda: found.extend(components.components(edges).collect())) <= 450
    assert {r["node"]: r["root"] for r in found} == dict.fromkeys(range(41), 0)


def test_components_of_random_edges(spark):
    """Repeated edges, loops, long chains and hubs against a search."""
    rng = random.Random(17)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i * 7 % 101, 1000 + (i + 1) * 7 % 101) for i in range(100)] + [(2000, 2000 + rng.randrange(60)) for _ in range(200)]
    beside = {}
    for a, b in edges:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(beside):
        todo = [] if node in want else [node]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo.extend(beside[x])
    alone = {x for x, others in beside.items() if others == {x}}
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert sorted((r["node"], r["root"]) for r in found) == sorted((x, root) for x, root in want.items() if x not in alone)


def test_blocks_without_rows(spark):
    """Blocks so small that many have no rows: each pair is found, within a block and across."""
    rng = random.Random(18)
    base = [str(i) for i in range(300)]
    copies = [edited(rng, base, 25, k) for k in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate([*copies, *(edited(rng, t, 1, f"y{i}") for i, t in enumerate(copies[:20]))])]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_words=1000)
    assert sorted(((r["doc_id"], r["class_id"]) for r in got.collect()), key=str) == classes(rows)


def test_near_duplicates_awkward(awkward, nothing):
    assert order_minhash.near_duplicates(awkward).count() == awkward.count() and order_minhash.near_duplicates(nothing).count() == 0
    assert order_minhash.deduplicate(nothing).columns == nothing.columns
    kept = order_minhash.deduplicate(awkward)
    assert kept.where("text like 'same text%'").count() == 1 and kept.where("coalesce(text, '') = ''").count() == 1


# Fingerprints


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(rows, max_share=0.05, min_docs=2):
    """I-Match by hand: rows in order of id."""
    split = re.compile(r"[^\w]+|_+")
    h = lambda b, seed=42: signed(xxhash.xxh64_intdigest(b, seed=seed & (1 << 64) - 1))
    number = lambda n, seed=42: h((n & (1 << 64) - 1).to_bytes(8, "little"), seed)
    small = lambda n, seed: h(n.to_bytes(4, "little"), seed)
    terms = lambda t: {h(x.encode()) for x in split.split(t.lower()) if x}
    seen = Counter(x for _, t in rows for x in terms(t))
    high = max(min_docs, int(max_share * len(rows)))
    known = {x for x, n in seen.items() if min_docs <= n <= high}  # the band itself: on few documents the filter lets nothing else pass

    def parts(t):
        kept, out = sorted(x for x in terms(t) if x in known), []
        nested = [kept for _ in imatch.FAMILIES]
        for level in range(len(imatch.FAMILIES[0])):
            for k, rates in enumerate(imatch.FAMILIES):
                nested[k] = [x for x in nested[k] if small(k, number(x)) % rates[level] == 0]
                value = 42
                for x in nested[k]:
                    value = number(x, value)
                out.append(value if nested[k] else None)
        return out

    def shown(p, t):
        return ":".join("-" if x is None else f"{x & 0xFFFFFFFF:08x}" for x in p) if any(x is not None for x in p) else "text:" + hashlib.md5(t.encode()).hexdigest()

    def near(p, q, a, b):
        either = sum(x is not None or y is not None for x, y in zip(p, q, strict=True))
        return sum(x is not None and x == y for x, y in zip(p, q, strict=True)) / either if either else float(a == b)

    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        p, q, n = parts(t), parts(edited), parts(nxt)
        f, e, g = shown(p, t), shown(q, edited), shown(n, nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, near(p, q, f, e), near(p, n, f, g)))
    return out


def test_fingerprints_against_hand_made(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()
    got = sorted(map(tuple, queries.op3_imatch_fingerprint(spark, sf_dir).collect()))
    assert got == sorted(fingerprints(rows))
    better = sum(r[5] > r[6] for r in got)
    assert better > 0.7 * len(got)


def test_lexicon_lets_few_other_terms_pass(spark, monkeypatch):
    monkeypatch.setattr(imatch, "LEAST_CELLS", 1)
    rows = [(i, " ".join([f"in{j}" for j in range(i // 2 * 80, i // 2 * 80 + 80)] + [f"out{i}x{j}" for j in range(400)])) for i in range(100)]  # 4000 terms stand in two documents
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    inside = imatch.band(docs)
    words, cells = imatch.lexicon(inside)
    assert inside.count() == 4000 and cells == 1 << 16 and imatch.lexicon(inside.where("false"))[1] == 1 << 16
    found = imatch.with_known(docs, ["text"], words, cells, "known").select(F.explode(F.col("known")[0]).alias("term"))
    n = Counter(bool(r["known"]) for r in found.join(inside.withColumn("known", F.lit(True)), "term", "left").collect())
    assert n[True] == 8000 and n[False] < 0.005 * 40_000
    monkeypatch.setattr(imatch, "MOST_CELLS", 1 << 15)
    with pytest.raises(ValueError, match="min_share"):
        imatch.lexicon(inside)


def test_fingerprints_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("ab cd ef gh ij kl é".split()) for _ in range(rng.randint(0, 12)))) for k in sorted(rng.sample(range(1000), 30)) ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, imatch.fingerprint_and_compare(df).collect())) == sorted(fingerprints(rows))
    one = imatch.fingerprint_and_compare(df.limit(1)).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("kind", ["signed", "outlier", "text", "null", "repeated"])
def test_fingerprints_of_any_ids(spark, monkeypatch, kind):
    """Wide, negative, far-off, text, null and repeated ids: right neighbours, and ranges of a few rows each."""
    monkeypatch.setattr(imatch, "RANGE_ROWS", 4)
    monkeypatch.setattr(imatch, "DRAWN_FOR_BOUND", 2)
    rng = random.Random(14)
    text = lambda: " ".join(rng.choice("ab cd ef gh ij kl é".split()) for _ in range(rng.randint(1, 12)))
    ids = {
        "signed": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)], "outlier": [*range(199), (1 << 63) - 1],
        "text": [f"d\"{rng.randrange(10**9)}é" for _ in range(200)], "null": [None] * 70 + [*range(130)], "repeated": [5] * 70 + [*range(130)],
    }[kind]
    rows = [(i, text()) for i in ids]
    rows += [rows[0]] * 40 if kind in ("null", "repeated") else []
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'text' else 'long'}, text string").repartition(4)
    tie = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0].encode() if kind == "text" else r[0]) if r[0] is not None else 0, tie(r[1])))
    got = Counter(map(tuple, imatch.fingerprint_and_compare(df).collect()))
    assert got == Counter(fingerprints(order))
    own = df.selectExpr("doc_id as key", "xxhash64(text) as tie").withColumn("lot", F.xxhash64(F.monotonically_increasing_id()))
    sizes = [r["count"] for r in imatch._with_range(own, ("key", "tie", "lot"), len(rows)).groupBy("range").count().collect()]
    assert max(sizes) <= 24 and len(sizes) > 15


def test_fingerprints_awkward(awkward, nothing):
    got = imatch.fingerprint_and_compare(awkward).toPandas()
    assert len(got) == awkward.count() and not got.drop(columns="doc_id").isna().any().any() and imatch.fingerprint_and_compare(nothing).count() == 0
    assert got[got["doc_id"].isin([7, 8])]["fingerprint"].nunique() == 1
