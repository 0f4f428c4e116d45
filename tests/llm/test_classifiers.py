"""CRF arithmetic against enumeration, held-out accuracy, and awkward rows of the three classifiers."""

from itertools import product

import numpy as np
import pytest

from vecatlas.llm import crf, langid, quality, queries, toxicity
from vecatlas.llm.common import held_out, labelled_sample


def enumerated(score, trans):
    n, total, p, pairs = len(score), 0.0, np.zeros(len(score)), np.zeros((2, 2))
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(s for s, l in zip(score, y, strict=True) if l) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        p += w * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            pairs[a, b] += w
    return p / total, pairs / total


@pytest.mark.parametrize("few", [0, 2, 100])
def test_forward_backward_is_exact(monkeypatch, few):
    monkeypatch.setattr(crf, "FEW", few)
    rng = np.random.default_rng(1)
    lengths = np.array([5, 1, 8, 3, 8, 2])
    score, trans = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    p, pairs = crf.pair_sums(score, lengths, trans)
    at, want = 0, np.zeros((2, 2))
    for n in lengths:
        own, both = enumerated(score[at : at + n], trans)
        assert np.allclose(p[at : at + n], own)
        want, at = want + both, at + n
    assert np.allclose(pairs, want) and np.allclose(crf.marginals(score, lengths, trans), p)


def test_fit_climbs_to_zero_gradient():
    rng = np.random.default_rng(2)
    x, lengths = rng.normal(size=(60, 2)), np.array([10] * 6)
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(np.int64)
    w, trans = crf.fit(lambda w: x @ w, lambda g: x.T @ g, 2, y, lengths, steps=800, rate=0.05, l2=1e-3)
    p, _ = crf.pair_sums(x @ w, lengths, trans)
    assert np.abs(x.T @ (y - p) / 60 - 1e-3 * w).max() < 5e-3


def judged(spark, result, labels, column):
    return result.where("held_out").join(labels.where(f"{column} is not null"), "doc_id").selectExpr("predicted", column, "score").toPandas()


def test_quality_on_held_out(spark, sf_dir, labels):
    result = queries.op4_quality(spark, "/root/testdata/sf0.01" if sf_dir.endswith("sf0.001") else sf_dir)
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet") if sf_dir.endswith("sf0.001") else labels
    got = judged(spark, result, lab, "quality")
    assert (got["predicted"] == got["quality"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_toxicity_on_held_out(spark, sf_dir, labels):
    sf = "/root/testdata/sf0.1"
    result = queries.op1_toxicity(spark, sf).cache()
    got = judged(spark, result, spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert (got["predicted"] == got["toxic"]).mean() > 0.95 and got["score"].between(0, 1).all()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in result.where("size(toxic_spans) > 0").join(docs, "doc_id").limit(20).collect():
        for s in r["toxic_spans"]:
            assert toxicity.TOKEN.fullmatch(r["text"][s["start"] : s["end"]])


def test_language_on_held_out(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op8_language_id(spark, sf).where("held_out").join(docs, "doc_id").selectExpr("lang", "lang_pred").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98


def test_ngram_buckets_do_not_depend_on_the_batch():
    texts = ["abc def", "", "ßß", "x", "abc def"]
    model = langid.LanguageModel(("a", "b"), np.random.default_rng(3).normal(size=(1025, 2)).astype(np.float32), np.zeros(2), (1, 2, 3), 1024)
    names, scores = langid.score_texts(texts, model)
    for t, n, s in zip(texts, names, scores, strict=True):
        one = langid.score_texts([t], model)
        assert one[0] == [n] and one[1][0] == pytest.approx(s, abs=1e-9)
    assert names[1] == "und" and scores[1] == 0 and names[0] == names[4]


def test_naive_bayes_by_hand():
    """The matrix product is the sum over n-grams of their log-probabilities."""
    rng = np.random.default_rng(4)
    model = langid.LanguageModel(("a", "b", "c"), np.vstack([rng.normal(size=(512, 3)), np.zeros((1, 3))]).astype(np.float32), np.log([0.5, 0.3, 0.2]), (1, 2), 512)
    text = "hällo wörld"
    found, _ = langid.ngram_buckets([text], model.orders, model.buckets)
    want = model.log_prior + sum(model.log_prob[b] for bucket in found for b in bucket.tolist())
    names, scores = langid.score_texts([text], model)
    p = np.exp(want - want.max())
    assert names == ["abc"[want.argmax()]] and scores[0] == pytest.approx((p / p.sum()).max(), rel=1e-4)
    assert len(found[0]) == len(text) + 3 and (found[1] == 512).sum() == 2  # windows over the end


def test_awkward_rows(spark, awkward, nothing, documents, labels):
    q = quality.fit(documents, labels)
    x = toxicity.fit(documents, labels)
    lang = langid.fit(documents)
    for op, model, cols in ((quality.classify, q, {"score", "predicted"}), (toxicity.score, x, {"score", "predicted", "toxic_spans"}), (langid.identify, lang, {"lang_pred", "score"})):
        got = op(awkward, model)
        assert got.count() == awkward.count() and op(nothing, model).count() == 0
        assert set(got.columns) == (set(awkward.columns) | cols)
        assert op(awkward, model, keep=["doc_id"]).where("score is null or score < 0 or score > 1").count() == 0
    empty = quality.classify(awkward, q).where("trim(coalesce(text, '')) = '' and not text like '%\n%'").select("score").distinct().collect()
    assert [r["score"] for r in empty] == [0.0]
    und = langid.identify(awkward, lang).where("lang_pred = 'und'").select("text").collect()
    assert len(und) == 5
    same = langid.identify(awkward, lang).where("text like 'same text%'").select("lang_pred", "score").distinct().count()
    assert same == 1


def test_nothing_to_learn_from(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality.fit(awkward, labels) is None and toxicity.fit(awkward, labels) is None and quality.fit(nothing, labels.limit(0)) is None
    assert quality.classify(awkward, None).where("score <> 0").count() == 0 and toxicity.score(awkward, None).where("score <> 0").count() == 0
    model = langid.fit(awkward)
    assert model.languages == () and langid.identify(awkward, model).where("lang_pred <> 'und'").count() == 0


def test_matrix_is_bounded(spark, documents):
    """Buckets are halved until the matrix is within the bound; 300 dirty codes give a model too."""
    n = documents.where("lang is not null").select("lang").distinct().count()
    found = langid.fit(documents, max_matrix_bytes=1 << 16)
    assert (1 << 15) < found.buckets * n * 4 <= 1 << 16 and found.log_prob.shape == (found.buckets + 1, n)
    assert langid.fit(documents, buckets=1 << 12, max_matrix_bytes=1 << 16).buckets == min(1 << 12, found.buckets)
    own = [chr(97 + i // 20) + chr(97 + i % 20) for i in range(300)]
    rows = [(i, f"{own[i % 300]}zq {own[i % 300]}kk word", f"code{i % 300:03}") for i in range(900)]
    dirty = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(dirty)
    assert len(model.languages) == 300 and model.buckets == 1 << 15
    assert langid.identify(dirty, model).where("lang_pred = lang").count() > 600


def test_counts_by_hand(spark, documents):
    """The matrix of counts that Spark sums is that of all n-grams of the sample."""
    model = langid.fit(documents, orders=(2,), buckets=256)
    rows = documents.where("text is not null and lang is not null").select("text", "lang").collect()
    counts = np.full((257, len(model.languages)), 0.5)
    for r in rows:
        for b in langid.ngram_buckets([r["text"]], (2,), 256)[0][0].tolist():
            counts[b, model.languages.index(r["lang"])] += 1
    want = np.log(counts[:256]) - np.log(counts[:256].sum(axis=0))
    assert np.allclose(model.log_prob[:256], want, atol=1e-5) and not model.log_prob[256].any()


def test_sample_is_bounded_by_characters(spark):
    """Long texts are drawn like short ones; the sample ends with the text that goes beyond the bound."""
    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 1000)) for i in range(200)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 0)], "doc_id long, quality int")
    texts, y, totals = labelled_sample(docs, labels, "quality", max_chars_per_class=5000)
    assert totals.tolist() == [100, 99] and any(len(t) == 1000 for t in texts)
    for c in (0, 1):
        held = [len(t) for t, k in zip(texts, y, strict=True) if k == c]
        assert 5000 <= sum(held) < 6000
    again = labelled_sample(docs.repartition(7), labels, "quality", max_chars_per_class=5000)
    assert sorted(again[0]) == sorted(texts)


def plain_marginals(score, trans):
    """Forward-backward in probabilities, position by position."""
    e = np.exp(np.stack([np.zeros(len(score)), score], axis=1))
    t = np.exp(trans)
    ahead, back = [e[0] / e[0].sum()], [np.ones(2)]
    for x in e[1:]:
        a = (ahead[-1] @ t) * x
        ahead.append(a / a.sum())
    for x in e[:0:-1]:
        b = t @ (x * back[-1])
        back.append(b / b.sum())
    both = np.array(ahead) * np.array(back[::-1])
    return both[:, 1] / both.sum(axis=1)


def logistic(x):
    return 1 / (1 + np.exp(-x))


def test_quality_score_by_hand(documents, labels):
    """From a document's line features to its score: neighbours, marginals, length-weighted mean, calibration."""
    model = quality.fit(documents, labels)
    for r in documents.where("text is not null").limit(60).collect():
        lines = [x for x in r["text"].split("\n") if x.strip()]
        if not lines:
            continue
        x = quality.line_features(lines, np.array([float(l in lines[:i]) for i, l in enumerate(lines)])) @ model.weights
        unary = np.array([x[i, 0] + (x[i - 1, 1] if i else 0) + (x[i + 1, 2] if i + 1 < len(lines) else 0) for i in range(len(lines))])
        p, size = plain_marginals(unary, model.trans), np.array([len(x) for x in lines])
        mean = np.clip((p * size).sum() / size.sum(), 1e-4, 1 - 1e-4)
        want = logistic(model.calibration[0] + model.calibration[1] * np.log(mean / (1 - mean)))
        assert quality.score_texts([r["text"]], model)[0][0] == pytest.approx(want, abs=1e-3)


def test_toxicity_score_by_hand(documents, labels):
    """From a document's tokens to its score: weights of features, neighbours, marginals, aggregates, calibration."""
    rng = np.random.default_rng(5)
    words = sorted({w for r in documents.limit(40).collect() for c in toxicity._chains(r["text"]) for w in c})
    features = {f: tuple(rng.normal(size=3)) for w in words[::3] for f in toxicity.features_of(w)}
    model = toxicity.ToxicityModel(features, -1.0, rng.normal(size=(2, 2)), np.array([0.3, 0.5, 0.2]))
    for r in documents.limit(40).collect():
        p = []
        for c in toxicity._chains(r["text"]):
            w = [np.sum([features[f] for f in toxicity.features_of(x) if f in features] or [(0.0, 0.0, 0.0)], axis=0) for x in c]
            score = np.array([w[i][0] - 1.0 + (w[i - 1][1] if i else 0) + (w[i + 1][2] if i + 1 < len(c) else 0) for i in range(len(c))])
            p += plain_marginals(score, model.trans).tolist()
        if p:
            p = np.clip(p, 1e-9, 1 - 1e-9)
            want = logistic(0.3 + 0.5 * np.log(p / (1 - p)).max() + 0.2 * np.log(p.sum() + 1e-3))
            assert toxicity.score_texts([r["text"]], model)[0][0] == pytest.approx(want, abs=1e-4)


def test_held_out(spark):
    import zlib

    got = spark.range(50).select("id", held_out("id", 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
