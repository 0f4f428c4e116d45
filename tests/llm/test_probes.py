"""Pages whose words for parts stand inside the article, markup that parsers trip over, hosts with many sections; item ids of any
type, windows that many items share; and columns with the names that operators might use."""

import random
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vecatlas.llm import decontam, html_extract, imatch, langid, order_minhash, quality, toxicity

TEXT = "The harvest of the northern valleys began late this year, and the mills stood idle well into autumn."


def text_of(html):
    blocks, _, _ = html_extract.kept_blocks(html_extract.parse(html), set(), set(), None)
    return "\n".join(blocks)


@pytest.mark.parametrize("part", [
    '<h2 id="cookies">Cookies in the mill</h2>', '<h2 id="navigation">Navigation on the river</h2>', '<h2 id="login">Login</h2>', '<div class="section-header"><h2>A part</h2></div>',
    '<ul class="menu"><li>Soup</li><li>Bread</li></ul>', '<div class="market-share">Shares of the market</div>', '<div class="social">Social life</div>', '<footer>By the author</footer>',
    '<aside>A pull quote</aside>', '<p class="notice">Note this</p>', '<p id="comments">A word on comments</p>', '<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>',
])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>'])
def test_names_inside_the_content_decide_nothing(part, around):
    import re

    page = "<body><nav><a href='/'>Home</a></nav>" + around.format(f"<h1>Mills</h1><p>{TEXT}</p>{part}<p>{TEXT} Again.</p>") + "<footer>Imprint</footer></body>"
    inner = [" ".join(x.split()) for x in re.split(r"</?(?:p|li|ul|h2|div|footer|aside)[^>]*>", part) if x.strip()]
    inner = [re.sub("<[^>]+>", "", x) for x in inner]
    assert text_of(page) == "\n".join(["Mills", TEXT, *inner, f"{TEXT} Again."])


def test_names_around_the_content_still_decide():
    page = f"<body><div class='cookie-notice'>We use cookies</div><header>Site</header><article><h1>Mills</h1><p>{TEXT}</p><form><p>Your mail</p></form></article><section id='comments'><p>First!</p></section><aside>Ads</aside></body>"
    assert text_of(page) == f"Mills\n{TEXT}"


@pytest.mark.parametrize(("html", "want"), [
    ('<p>a</p><script src="a.js"/>alert(1)</script><p>b</p>', "a\nb"), ("<p>a</p><iframe src=http://x/>fallback</iframe><p>b</p>", "a\nb"), ("<p>a<svg><svg></svg>leak</svg></p><p>b</p>", "a\nb"),
    ("<p>a</p><!--><p>b</p>", "a\nb"), ("<p>a</p><!---><p>b</p>", "a\nb"), ("<p>a</p><!-- x --><p>b</p><!-- never closed <p>c</p>", "a\nb"), ("<p>a<svg width='1'/>b</p>", "ab"),
    ("<p>a<svg width=1/>leak</svg>b</p>", "ab"), ("<object><object>x</object>y</object><p>b</p>", "b"), ("<style>p {}</STYLE ><p>b</p>", "b"), ("<p>a<svg>never closed", "a"), ("<p>a<canvas/>x</canvas>b</p>", "ab"),
])
def test_markup(html, want):
    assert text_of(f"<body>{html}</body>") == want


def test_a_host_with_many_sections_loses_each_ones_blocks(spark):
    """No block stands on more than a tenth of the host's pages, but each on all of its own section's."""
    rows = []
    for i in range(200):
        section = i % 10
        menu = "".join(f"<li><a href='/{section}/{k}'>Topic {section} {k}</a></li>" for k in range(4))
        story = f"<p>{TEXT} This is report {i} of the series.</p><p>Line {i * 7} follows it with more words of its own.</p>"
        rows.append((i, f"https://farm.example.org/s{section}/post-{i}.html", f"<html><body><div class='rail'><p>All about section {section}</p><ul>{menu}</ul></div><div class='text'><h1>Report {i}</h1>{story}</div></body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in html_extract.extract(pages, names=False).collect()}
    assert all(r["text"] == f"Report {i}\n{TEXT} This is report {i} of the series.\nLine {i * 7} follows it with more words of its own." for i, r in got.items())
    assert all(r["n_recurring"] == 5 for r in got.values())


@pytest.mark.parametrize("kind", ["string", "decimal(12,2)", "int", "date", "double"])
def test_item_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "nothing"), (3, "short item and more")], "doc_id long, text string")
    items = spark.createDataFrame([(3, "zero one two three four five six seven eight nine ten"), (4, "short item"), (None, "nothing")], "n int, text string")
    own = {"string": "concat('item-', n)", "decimal(12,2)": "cast(n as decimal(12,2))", "int": "n", "date": "date_add(date'2024-01-01', n)", "double": "n / 2D"}[kind]
    items = items.select(F.expr(own).cast(kind).alias("item_id"), "text")
    found = decontam.find(docs, items, keep=["doc_id"])
    assert found.schema["items"].dataType.elementType == items.schema["item_id"].dataType
    names = {r["text"]: r["item_id"] for r in items.collect()}
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {1: [names["zero one two three four five six seven eight nine ten"]], 2: [], 3: [names["short item"]]}
    rows = {r["doc_id"]: r for r in decontam.report(found, ["doc_id"]).collect()}
    assert (rows[2]["n_items"], rows[2]["n_hit"]) == (0, 1) and rows[1]["n_items"] == 1
    assert kind != "decimal(12,2)" or names["short item"] == Decimal("4.00")


def test_windows_that_many_items_share():
    prompt = "answer the following question with one of the given letters and nothing else please now"
    items = [(i, f"{prompt} q{i}") for i in range(8000)]
    began = time.perf_counter()
    tables = decontam.tables_of(items, 10)
    assert time.perf_counter() - began < 2  # 0.2 s on an idle machine; by the square it would be 4.5 s
    _, ranges, found = decontam.search_text(f"x {prompt} y", tables)
    assert ranges == [(1, 16)] and found == set(range(8000))


@pytest.mark.parametrize("column", ["__text", "text_", "TEXT_", "text__", "hidden"])
def test_columns_of_clashing_names(spark, documents, labels, column):
    some = documents.limit(60).withColumn(column, F.lit("mine")).cache()
    benchmark = spark.createDataFrame([("a", "zzz yyy")], "item_id string, text string")
    assert {r[column] for r in decontam.find(some, benchmark).collect()} == {"mine"}
    if column == "__text":
        assert {r[column] for r in quality.classify(some, quality.fit(documents, labels)).collect()} == {"mine"}
        assert {r[column] for r in toxicity.score(some, toxicity.fit(documents, labels)).collect()} == {"mine"}
        assert {r[column] for r in langid.identify(some, langid.fit(documents)).collect()} == {"mine"}


# Rows that joins make


def rows_of_joins(spark, before, on):
    """Rows made by the inner joins on one column in the queries that were not among ``before``."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    for i in range(before, store.executionsCount()):
        number = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if re.search(rf"Join \[{on}#\d+\], \[{on}#\d+\], Inner", node.desc()):
                metrics = (node.metrics().apply(j) for j in range(node.metrics().size()))
                found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                total += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return total


def test_a_text_is_looked_up_once_for_all_its_buckets(spark):
    """Near copies beside strangers that share a passage with them: a text stands in up to 32 buckets of several classes,
    and its facts are joined once."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.sample(words, 60)
    texts = [" ".join([*passage, rng.choice(words), *passage[30:]]) for _ in range(300)] + [" ".join([*passage, *rng.sample(words, 60 + i)]) for i in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert order_minhash.deduplicate(docs).count() == 251
    assert rows_of_joins(spark, before, "node") < 6 * len(texts)


def test_each_text_is_fingerprinted_once(documents):
    """The row before takes the fingerprint over with the text, and does not make it again."""
    plan = imatch.fingerprint_and_compare(documents.limit(50))._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" in plan and re.search(r"struct\(text, [^\n]*fingerprint#", plan)
