"""Packing, token files, HTML extraction, sharding and the pipeline against brute force and round trips."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from vecatlas.llm import common, html_extract, langid, packing, quality, queries, sharding, token_files
from vecatlas.llm.tokenization import BulkTokenizer

BYTE, WORDS = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")
TEXTS = [
    "", " ", "  a  b \n\n  c\t d\n", "it's 'tis don't  won't''s", "<|endoftext|> x <|startoftext|>", "Straße ÄÖ İ ſ ŉ 'Σ σς", "日本語 テスト", "a\xa0b c", "é é", "foo   \n bar\r\nbaz", "\n", " \n a",
    "naïve—“quote”…€5 12,345.67", "x\x1cy\x85z \U0001f600", "'S 'T DON'T I'LL", "ª µ º ²³¹ ¼½ × ÷ ¬ ªb x² 3½", "a\nb", "a b\nc d\n", "\na", "!'s x'll'd 'tis", "é Å", "...!? ,a a, a.b.", " a", "a ", "\ta",
]


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize(("path", "style"), [(BYTE, "byte"), (WORDS, "word")])
def test_bulk_tokenizer_is_the_library(path, style, sf_dir):
    texts = TEXTS + [r[0] for r in duckdb.sql(f"select text from '{sf_dir}/documents.parquet'").fetchall()]
    bulk, one = BulkTokenizer(path, style), plain(path)
    for t, got in zip(texts, bulk.encode(texts), strict=True):
        assert got == one(t).tobytes(), t[:80]


def test_special_tokens_and_other_vocabularies(tmp_path):
    """Ids are the library's plain ones for texts with added tokens, and for a file that cuts in another way."""
    import json

    bulk = BulkTokenizer(BYTE, "byte")
    assert np.frombuffer(bulk.encode(["x <|endoftext|> y"])[0], "<u4").tolist() == [87, 220, 50256, 331]
    with open(BYTE) as f:
        other = json.load(f)
    other["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(other, f)
    assert not BulkTokenizer(path, "byte").known and bulk.known and BulkTokenizer(WORDS, "word").known
    for t in TEXTS:
        assert BulkTokenizer(path, "byte").encode([t])[0] == plain(path)(t).tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'st. ,\n\t12é—ÿĀŁ!$"), max_size=40))
def test_bulk_tokenizer_on_any_text(text):
    for key, path, style in (("b", BYTE, "byte"), ("w", WORDS, "word")):
        if key not in CACHE:
            CACHE[key] = BulkTokenizer(path, style), plain(path)
        assert CACHE[key][0].encode([text])[0] == CACHE[key][1](text).tobytes()


CACHE: dict = {}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit(sizes):
    bins, n = packing.best_fit(np.array(sizes, dtype=np.int64), 32)
    load = Counter()
    for b, s in zip(bins.tolist(), sizes, strict=True):
        load[b] += s
    assert len(load) == n and all(v <= 32 for v in load.values())
    if sizes:
        assert n <= max(1, -(-sum(sizes) * 17 // (10 * 32)) + 1)
    free = []  # the same rule, written plainly
    for s in sorted(sizes, reverse=True):
        fit = min((f for f in free if f >= s), default=None)
        if fit is None:
            free.append(32 - s)
        else:
            free.remove(fit)
            free.append(fit - s)
    assert len(free) == n


def check_packed(rows, docs, capacity, encode):
    want = Counter()
    for i, t in docs:
        ids = np.append(encode(t), np.uint32(2)).astype("<u4")
        parts = packing.cut(len(ids), capacity)
        assert [n for _, n in parts[1:]] == [capacity] * (len(parts) - 1) and sum(n for _, n in parts) == len(ids)
        for p, (s, n) in enumerate(parts):
            want[(i, p, s, n, zlib.crc32(ids[s : s + n]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in at.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= capacity
    return len(at), sum(n for x in at.values() for _, n in x)


def test_packing_whole_table(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    n, total = check_packed(queries.op2_best_fit_packing(spark, sf_dir).collect(), docs, 1024, plain(BYTE))
    assert n <= 1.02 * total / 1024 + 1


def test_packing_as_a_tree(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(["w"] * rng.choice([1, 5, 9, 20, 40]))) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = packing.pack(df, BYTE, capacity=32, slack=0, items_per_task=20, with_ids=True).collect()
    n, total = check_packed(got, docs, 32, plain(BYTE))
    assert n <= 1.1 * total / 32
    encode = plain(BYTE)
    for at_once in (7, 1000):
        few = packing.pack(df, BYTE, capacity=32, slack=0, items_per_task=20, pieces_at_once=at_once, with_ids=False).collect()
        check_packed(few, docs, 32, plain(BYTE))
    for r in got[:50]:
        assert r["ids"] == np.append(encode(docs[r["doc_id"]][1]), 2)[r["start"] : r["start"] + r["length"]].tolist()


@pytest.mark.parametrize("partitions", [4, 64])
def test_packing_hardly_depends_on_partitions(spark, documents, partitions):
    """Within one percent of the least number of sequences that the pieces' lengths allow, in small and in large partitions."""
    lengths = [r["length"] for r in packing.pack(documents.repartition(partitions), BYTE, with_ids=False).select("sequence_id", "length").groupBy("sequence_id").sum("length").withColumnRenamed("sum(length)", "length").collect()]
    pieces = [r["length"] for r in packing.pack(documents, BYTE, with_ids=False).collect()]
    large = sum(n > 512 for n in pieces)
    assert len(lengths) <= 1.01 * max(large, sum(lengths) / 1024) + 1


def test_packing_awkward(awkward, nothing):
    rows = packing.pack(awkward, BYTE, with_ids=False).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in awkward.collect())
    assert packing.pack(nothing, BYTE).count() == 0


# Token files


def test_token_files_round_trip(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()
    encode, want, at = plain(WORDS), [], 0
    for i, t in docs:
        ids = np.append(encode(t), np.uint32(1)).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op7_token_files(spark, sf_dir).collect())) == want


def test_token_file_rows(spark, documents):
    folder = common.work_dir(spark)
    files = token_files.write(documents.limit(50), WORDS, folder, row_length=64, partitions=2).orderBy("place").collect()
    encode = plain(WORDS)
    ids = np.concatenate([np.append(encode(r["text"]), 1) for r in documents.limit(50).orderBy("doc_id").collect()])
    at = 0
    for f in files:
        tokens = token_files.TokenFile(f["tokens"])
        rows = [tokens.row(i) for i in range(len(tokens))]
        assert all(len(x) == len(m) == 64 for x, m in rows) and all(m.true_count == 64 for _, m in rows[:-1])
        found = np.concatenate([x[: m.true_count] for x, m in rows])
        assert (found == ids[at : at + f["n_tokens"]]).all() and not rows[0][0].flags.owndata
        at += f["n_tokens"]
    assert at == len(ids)


def test_token_files_awkward(spark, awkward, nothing):
    for df, n in ((awkward, awkward.count()), (nothing, 0)):
        manifest = token_files.write(df, WORDS, common.work_dir(spark), row_length=16)
        got = token_files.read(spark, manifest, "doc_id", df.schema["doc_id"].dataType).orderBy("start").collect()
        assert len(got) == n
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids)


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- c --> <div class=ad>Buy {n}</div>{main}
<section id="comments"><p>A reader said {n}</p></section><form><p>Sign up</p><input name=x></form><footer>&copy; {n}</footer></body></html>"""


def text_of(html, names=True):
    return "\n".join(html_extract.kept_blocks(html_extract.parse(html, names), set(), set(), None)[0])


def test_parse():
    main = "<article><h1>Ti&amp;tle</h1><p><b>One  two<br><p>three &lt;b&gt; &eacute;&#233;&nbsp;x</p><div class='share'>share</div><aside>no</aside><ul><li>i<li>j</ul>tail 1 < 2<script>x</script></article>"
    assert text_of(PAGE.format(n=1, main=main)) == "Ti&tle\nOne two\nthree <b> éé x\ni\nj\ntail 1 < 2"
    assert text_of("") == "" and text_of(None) == "" and text_of("plain") == "plain" and text_of("<p>unclosed <b>bold") == "unclosed bold"
    assert text_of("<script>never closed <p>x</p>") == "" and text_of("</p></div>a<p") == "a"
    assert text_of("<p title='a>b'>x</p><p>y") == "x\ny" and text_of("<!-- never closed <p>x") == ""
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>") == "a\nb\nc\nd\ne"


@pytest.mark.parametrize("start", ['<div style="overflow:hidden"><p>', '<p aria-hidden="false">', '<p title="hidden gems">', '<div id="search-history"><p>', '<p class="comment-free">', "<p data-x=\"a'b\" class=lead>", "<p 'odd' class=\"x>"])
def test_attributes_are_read_by_name(start):
    assert text_of(start + "Kept") == "Kept"


def test_names_do_not_take_the_content():
    assert text_of("<main><p>The main text is longer</p></main><article><p>a teaser</p></article>") == "The main text is longer\na teaser"
    assert text_of("<body class='has-sidebar'><form><p>A whole page in a form</p><nav>menu</nav></form>") == "A whole page in a form"
    assert text_of("<article><header><h1>Title</h1></header><p>Text</p><div class='commentList box'>said</div></article>") == "Title\nText"
    assert [html_extract._named_word(w) for w in ("ad-slot", "cookieNotice", "site-footer", "search-history", "adept", "")] == [True, True, True, False, False, False]


@pytest.mark.parametrize(
    "piece", ["<div>x", "<a '", '<a b="', "</div></b>", "<b>x</i>", "<ul><li>x", "<blockquote><li>x", "<h1><td>x", "<p>x", "<a>x", "< ", "<!x"],
)
def test_time_grows_with_length(piece):
    """100,000 repeats (nested elements, open quotes, end tags without a start) take about ten times what 10,000 do."""
    import time

    def seconds(n):
        began = time.perf_counter()
        text_of(piece * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 25 * seconds(10_000) + 1


def test_templates_are_deleted_by_host(spark):
    """What recurs on the host goes, and what is a page's own stays; on a host with one page nothing recurs."""
    page = "<body><div class='top'><p>Welcome to our site</p></div><div><p>Own text {n} of the page</p><p>Second {n}, which has some more words than all else</p></div><div><p>All rights</p></div></body>"
    rows = [(k, f"http://one.example/{k}", page.format(n=k)) for k in range(6)] + [(9, "http://two.example/", page.format(n=9)), (10, None, None), (11, "x", ""), (0, "http://one.example/0", page.format(n=0))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    for most in (100_000, 0):
        got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_extract.extract(df, broadcast_rows=most).collect()}
        assert got[(1, "http://one.example/1")][0] == "Own text 1 of the page\nSecond 1, which has some more words than all else"
        assert got[(9, "http://two.example/")][0] == "Welcome to our site\nOwn text 9 of the page\nSecond 9, which has some more words than all else\nAll rights"
        assert got[(10, None)] == ("", 0) and got[(11, "x")] == ("", 0)
    assert html_extract.extract(df).count() == len(rows) and html_extract.extract(df.limit(0)).count() == 0


def test_content_with_a_class_stays(spark):
    """Equal shapes are no template where they hold the text; lists of links and small parts around it are."""
    page = "<body><div class='top'><p>Welcome</p></div><div class='content'><h1>Title {n}</h1><p class='lead'>Own text {n} of the page</p><p>Second {n}, with more words of its own than all the rest of the page</p></div><div class='more'><a href='/{n}'>Go to {n}</a></div></body>"
    rows = [(k, f"http://one.example/{k}", page.format(n=k)) for k in range(6)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [f"Title {k}\nOwn text {k} of the page\nSecond {k}, with more words of its own than all the rest of the page" for k in range(6)]
    assert all(r["n_recurring"] == 2 and r["n_named"] == 0 for r in got)


def test_copies_of_a_page_are_one_page(spark):
    """A page that stands several times on a small host is no template of it."""
    page = "<body><div><p>Own text {n}</p><div><p>Second {n}</p></div></div></body>"
    inside = "<body><article><p>Own text {n}</p><ul><li>Item {n}</li></ul></article></body>"
    rows = [(k, f"http://{host}.example/{k}", form.format(n=max(k, 4))) for host, form in (("one", page), ("two", inside)) for k in range(12)]
    df = spark.createDataFrame([*rows, *((k, "http://three.example/", page.format(n=0)) for k in range(5))], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["url"], r["text"]) for r in html_extract.extract(df.repartition(3)).collect())
    want = [(k, u, f"Own text {max(k, 4)}\n{'Second' if 'one' in u else 'Item'} {max(k, 4)}") for k, u, _ in rows]
    assert got == Counter([*want, *((k, "http://three.example/", "Own text 0\nSecond 0") for k in range(5))])


def test_shared_paragraphs_of_articles_stay(spark):
    rows = [(k, f"http://one.example/{k}", PAGE.format(n=k, main=f"<article><p>Own {k}</p><p>A line that all share</p><div class='box'><p>Read our guide</p></div></article>")) for k in range(6)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [f"Own {k}\nA line that all share" for k in range(6)]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def pages_of(path):
    return duckdb.sql(f"select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), html from '{path}/pages.parquet'").fetchall()


def article_text(page):
    """The text of a test page's article, by hand."""
    import html
    import re

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d|li|ul|div)\b[^>]*>", inner)]
    return "\n".join(x for x in parts if x)


@pytest.mark.parametrize("names", [True, False])
def test_pages_whole_table(spark, sf_dir, names):
    """On hosts with three pages or more counts alone find the article; each page loses blocks to them."""
    pages = pages_of(sf_dir)
    many = {h for h, n in Counter(h for _, h, _ in pages).items() if n >= 3}
    got = {r["page_id"]: r for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), names=names).collect()}
    assert len(got) == len(pages)
    for i, host, page in pages:
        if host in many:
            assert got[i]["text"] == article_text(page) and got[i]["n_recurring"] >= 3 and got[i]["n_named"] == 0
        elif names:
            assert got[i]["text"] == article_text(page) and got[i]["n_named"] >= 3


def test_templates_against_brute_force(spark, sf_dir):
    """Counts of all hosts by hand."""
    seen, sizes = defaultdict(lambda: defaultdict(list)), defaultdict(dict)
    for _, host, page in pages_of(sf_dir):
        number, n, keys = html_extract.keys_of(html_extract.parse(page))
        if number not in sizes[host]:
            sizes[host][number] = n
            for k in keys:
                seen[host][k["kind"], k["key"]].append((k["text"], n, k["depth"]))
    want = {}
    for host, keys in seen.items():
        found, pages = ([], [], []), len(sizes[host])
        for (kind, key), x in keys.items():
            text, page_text = sum(t for t, _, _ in x), sum(n for _, n, _ in x)
            many = len(x) >= 3 and len(x) >= 0.2 * pages
            if (kind == 0 and many) or (kind == 1 and many and text <= 0.15 * page_text):
                found[kind].append(key)
            if kind == 2 and pages >= 3 and 2 * text > sum(sizes[host].values()):
                found[2].append((max(d for _, _, d in x), key))
        if any(found):
            want[host] = (sorted(found[0]), sorted(found[1]), max(found[2])[1] if found[2] else None)
    source = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) as host", "html")
    got = {r["host"]: (sorted(r["exact"]), sorted(r["forms"]), r["path"]) for r in html_extract.templates(source).collect()}
    assert got == want and any(f for _, f, _ in want.values())


# Sharding


def least_capacity(sizes, shards):
    low, high = max([*sizes, -(-sum(sizes) // shards)], default=0), sum(sizes)
    while low < high:
        mid, n, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                n, load = n + 1, 0
            load += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("cells", [5, 40, 20_000])
def test_minimax_cuts(spark, cells):
    rng = random.Random(7)
    for sizes in ([], [5], [1] * 100, [rng.randint(1, 400) for _ in range(300)], [7] * 50 + [900] + [3] * 80):
        ends = np.cumsum(sizes).tolist()
        groups = spark.createDataFrame(list(zip(ends, sizes, strict=True)), "end long, size long")
        capacity, cuts = sharding.minimax_cuts(groups, 8, cells)
        assert capacity == least_capacity(sizes, 8)
        edges = [0, *cuts, sum(sizes)]
        assert all(b - a <= capacity for a, b in zip(edges, edges[1:], strict=False)) and all(c in {0, *ends} for c in cuts)


@pytest.mark.parametrize(("at", "hot"), [(0, 0.34), (150, 0.34), (299, 0.34), (150, 0.1), (299, 0.1)])
def test_cuts_around_a_hot_group_are_even(spark, at, hot):
    """No shard stays empty or takes much more than its share of what the hot group leaves."""
    rng = random.Random(9)
    sizes = [rng.randint(100, 300) for _ in range(300)]
    sizes[at] = int(hot / (1 - hot) * sum(sizes))
    ends = np.cumsum(sizes).tolist()
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(list(zip(ends, sizes, strict=True)), "end long, size long"), 16)
    edges = [0, *cuts, ends[-1]]
    loads = sorted(b - a for a, b in zip(edges, edges[1:], strict=False))
    share = (sum(sizes) - sizes[at]) / 15
    assert capacity == least_capacity(sizes, 16) == sizes[at] == loads[-1]
    assert len(loads) == 16 and 0.4 * share < loads[0] and loads[-2] < 1.6 * share


def test_ends_are_found_by_refining(spark):
    """A summary of coarse cells answers as the whole list does, once what was asked for has been refined."""
    rng = random.Random(4)
    ends = sorted(rng.sample(range(1, 100_000), 600))
    groups = spark.createDataFrame([(e,) for e in ends], "end long").coalesce(1)
    cells = defaultdict(list)
    for e in ends:
        cells[e // 9000].append(e)
    summary = sharding.Ends(groups, [(min(x), max(x)) for x in cells.values()], fine=40)
    asked = [0, ends[0], ends[0] - 1, ends[-1], ends[-1] + 5, *rng.sample(range(100_000), 6)]
    for rounds in range(50):
        got = [(summary.up_to(x), summary.after(x)) for x in asked]
        if not summary.open:
            break
        summary.refine()
    assert 0 < rounds < 49
    assert got == [(max((e for e in ends if e <= x), default=None), min((e for e in ends if e > x), default=None)) for x in asked]


def test_sharding_settles_with_few_jobs(spark, sf_dir):
    spark.sparkContext.setJobGroup("shards", "shards")
    queries.op10_minimax_sharding(spark, sf_dir).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("shards")) <= 45  # two or three for each of some fifteen steps


def check_sharded(rows, docs):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in groups.values())


def test_sharding_whole_table(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    rows = queries.op10_minimax_sharding(spark, sf_dir).collect()
    check_sharded(rows, docs)
    import hashlib

    by_group = Counter()
    for _, t in docs:
        by_group[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == least_capacity([by_group[d] for d in sorted(by_group)], 16)


def test_sharding_awkward(awkward, nothing):
    check_sharded(sharding.shard(awkward).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert sharding.shard(nothing).count() == 0


def test_native_queries_run_no_python(spark, sf_dir):
    for q in (queries.op3_imatch_fingerprint, queries.op10_minimax_sharding):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# The pipeline


def test_pipeline_against_brute_force(spark, sf_dir, documents, labels):
    """Every stage's decisions, by hand from models fitted the same way."""
    from test_searches import classes, decontaminated

    model = quality.fit(documents, labels.where(~common.held_out("doc_id", 4, 2)))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    rows = [r for r in rows if quality.score_texts([r[1]], model)[0][0] >= 0.7]
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = langid.fit(kept.where(~common.held_out("doc_id", 4, 2)))
    rows = [r for r in rows if (found := langid.score_texts([r[1]], names))[0][0] != "und" and found[1][0] >= 0.5]
    chosen = {c for _, c in classes([r[:2] for r in rows])}
    rows = [r[:2] for r in rows if r[0] in chosen]
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    dirty = {r[0] for r in decontaminated(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in dirty]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    n, total = check_packed(got, rows, 1024, plain(BYTE))
    assert n <= 1.05 * total / 1024 + 1 and rows


def test_stages_keep_columns(spark, sf_dir, documents, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "near-duplicates", "benchmark decontamination", "best-fit packing"]
