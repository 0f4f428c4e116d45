"""The prefix trie, importance resampling and exact duplicates against DuckDB and brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecatlas.llm import golomb_dedup, importance, prefix_trie, queries


def plain(x):
    return None if x is None else bool(x) if isinstance(x, bool | np.bool_) else int(x) if isinstance(x, int | float | np.integer) and x == x else x


def rows_of(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance_resampling", "op13_golomb_dedup"])
def test_query_is_its_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    want = duck.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got.toPandas(), list(want.columns)) == rows_of(want, list(want.columns))


# Exact duplicates


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda bits: st.tuples(st.just(1 << bits), st.sets(st.integers(0, (1 << bits) - 1), min_size=1, max_size=60))))
def test_golomb_code(case):
    span, values = case
    v = np.array(sorted(values), np.int64)
    k, quotients, remainders = golomb_dedup.encode(v, span)
    assert (golomb_dedup.decode(len(v), k, quotients, remainders) == v).all()


def test_golomb_code_is_short():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000))
    k, quotients, remainders = golomb_dedup.encode(v, 1 << 40)
    assert 8 * (len(quotients) + len(remainders)) / len(v) < math.log2((1 << 40) / len(v)) + 2.1


def brute_duplicates(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return Counter((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), len(groups)


@pytest.mark.parametrize(("per_owner", "hold"), [(1 << 20, 1 << 22), (2, 2)])
def test_duplicates_of_awkward_rows(spark, awkward, nothing, per_owner, hold):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(50, "a b"), (51, "a b"), (52, "a \t b"), (53, "A b"), (49, " a b"), (48, "a  b")] + [(100 + i % 7, "hot  text" if i % 2 else "hot text") for i in range(300)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, `row` string, sha string").repartition(5)
    got = golomb_dedup.duplicates(df, per_owner=per_owner, hold=hold).collect()
    want, groups = brute_duplicates(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert golomb_dedup.duplicates(nothing).count() == 0


def test_suspects_are_few_and_short_fingerprints_do_no_harm(spark, monkeypatch):
    df = spark.range(400).selectExpr("id as doc_id", "concat('text ', id % 390) as text").repartition(4)
    want = sorted(map(tuple, golomb_dedup.duplicates(df).collect()))
    monkeypatch.setattr(golomb_dedup, "SPARE_BITS", -6)  # most texts are suspected for nothing
    assert sorted(map(tuple, golomb_dedup.duplicates(df).collect())) == want
    assert sum(r[3] for r in want) == 390


def test_another_partition_ends_the_job(spark):
    """A row that was not there when the fingerprints were sent has no answer."""
    folder = "file:///tmp/no-such-folder-of-answers"
    with pytest.raises(Exception, match="write the documents to a table first"):
        spark.range(3).select(golomb_dedup._suspects(folder, 1 << 8)("id")).collect()


# Importance resampling


def brute_resample(docs, target, max_n, buckets, least, percent, seed):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    found, wanted = [(i, *features(t)) for i, t in docs], Counter(b for t in target for b in features(t)[1])
    source = Counter(b for _, _, f in found for b in f)
    s_all, t_all = sum(source.values()), sum(wanted.values())
    out = []
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted((tuple(r[:1] + r[2:]) for r in out), key=repr)


@pytest.mark.parametrize(("max_n", "percent", "least"), [(1, 50, 3), (2, 100, 0), (3, 10, 5)])
def test_resampling_against_brute_force(spark, awkward, max_n, percent, least):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(200 + i, f"alpha beta {'gamma ' * (i % 5)} delta{i % 3} Élan-VITAL 9x") for i in range(60)]
    target = ["gamma gamma delta1", None, "", "9X élan words here"]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, n_words string, weight int").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aim, max_n=max_n, percent=percent, least_words=least, buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, target, max_n, 97, least, percent, 2024)


def test_resampling_of_nothing(spark, nothing):
    aim = spark.createDataFrame([("a",)], "text string")
    assert importance.resample(nothing, aim).count() == 0
    some = spark.createDataFrame([("k2", "a b"), ("k1", "a b")], "doc_id string, text string")
    assert importance.resample(some, aim.where("false"), least_words=1, percent=100).where("rank is not null").count() == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ9 .-é\n\x7f日"), max_size=30), st.integers(1, 3))
def test_spans_are_the_runs_of_words(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [m[0].decode() for m in importance.ngrams(n).finditer(importance.collapsed(text.encode()), overlapped=True)]
    assert found == [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


# The prefix trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=repr
    )


def awkward_conversations():
    rows = [(1, 0, "user", "hi"), (1, None, "system", "first"), (2, 0, None, None), (2, 0, "a", "same turn"), (None, 0, "user", "of nobody"), (7, 0, "user", "hi"), (7, 0, "user", "hi")]
    rows += [(300, i, "user" if i % 2 else "bot", f"t{i}") for i in range(9)] + [(c, i, "user", f"own {i}") for c in range(301, 340) for i in range(c % 4)]
    rows += [(c, i, "user", "hello") for c in range(401, 480) for i in range(3)]  # copies of each other
    rows += [(c, 0, "user", "hot") for c in range(501, 560)] + [(c, 1, "user", f"then {c}") for c in range(501, 560)]  # one very common first turn
    rows += [(900, i, "user", f"long {i} é") for i in range(150)] + [(907, i, "user", f"long {i} é") for i in range(140)]  # deep, and a long way together
    return rows


@pytest.mark.parametrize("at_once", [40, 20_000])
def test_trie_against_brute_force(spark, at_once):
    rows = awkward_conversations()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, `range` string").repartition(5)
    got = prefix_trie.trie(df, at_once=at_once)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == brute_trie(rows)


def test_trie_of_the_table_in_small_rounds(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a, b = (sorted(map(tuple, prefix_trie.trie(conversations, at_once=k).collect()), key=repr) for k in (7, 20_000))
    assert a == b == brute_trie([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).count() == 0 and prefix_trie.trie(empty).columns == COLUMNS
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)  # its only turn is taken from conversation 0, which isn't there
    got = prefix_trie.trie(spark.createDataFrame([(c, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
