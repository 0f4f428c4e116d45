"""Toxicity: a linear-chain CRF tags toxic spans; its marginals give document scores and offending offsets.

A chain is the tokens of one line. Features of a token are the word itself and its first four and five
characters, looked up among the features of the training sample, for the token, the one before and the one
after it. Labels exist for documents only, so training tokens are labelled from them: a token of a toxic
document is toxic if one of its features stands almost only in toxic documents. Forward-backward marginals
over all tokens of a text are aggregated to (highest log-odds, log of the expected number of toxic tokens)
and calibrated to the document's probability.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from vecatlas.llm import crf
from vecatlas.llm.common import labelled_sample, slices, unused

TOKEN = re.compile(r"\w+")
CACHED_TYPES = 300_000


@dataclass(frozen=True)
class ToxicityModel:
    features: dict[str, tuple[float, float, float]]  # weights for the token itself, for the one after and for the one before it
    bias: float
    trans: np.ndarray
    calibration: np.ndarray


def features_of(word: str) -> tuple[str, ...]:
    return ("w:" + word, "4:" + word[:4], "5:" + word[:5]) if len(word) > 4 else ("w:" + word, "4:" + word[:4])


def _chains(text: str | None) -> list[list[str]]:
    """The lower-cased tokens of each line that has any."""
    return [[*map(str.lower, t)] for line in (text or "").split("\n") if (t := TOKEN.findall(line))]


def _neighbours(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the positions that have a token before and after them in their chain."""
    total = int(lengths.sum())
    first, last = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
    ends = np.cumsum(lengths)
    last[ends - 1] = True
    first[0] = True
    first[ends[:-1]] = True
    return ~first, ~last


def _unary(types: np.ndarray, lengths: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """weights: token types x (itself, for the next token, for the token before)."""
    has_before, has_after = _neighbours(lengths)
    score = weights[types, 0] + bias
    at = np.flatnonzero(has_before)
    score[at] += weights[types[at - 1], 1]
    at = np.flatnonzero(has_after)
    score[at] += weights[types[at + 1], 2]
    return score


def _aggregates(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document: one, the highest log-odds, the log of the expected number of toxic tokens."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    top = np.full(n, -20.0)
    np.maximum.at(top, doc, np.log(p / (1 - p)))
    return np.stack([np.ones(n), top, np.log(np.bincount(doc, weights=p, minlength=n) + 1e-3)], axis=1)


def _toxic_features(texts: list[str], docs_chains: list, y: np.ndarray, purity: float, gain: int = 2):
    """Features that stand almost only in toxic documents, and the number of documents of either class with each feature.

    What near copies share is left out: a feature's neighbouring words must vary from document to document. The
    commonest feature is taken first; a rare one only if it explains ``gain`` toxic documents that none before
    it does.
    """
    first = {t: k for k, t in reversed([*enumerate(texts)])}
    once = [k for k, t in enumerate(texts) if first[t] == k]
    seen = (Counter(), Counter())
    for k in once:
        seen[y[k]].update({f for c in docs_chains[k] for w in c for f in features_of(w)})
    n0, n1 = np.maximum(np.bincount(y, minlength=2), 1)
    least = max(3, min(5, n1 // 20))
    pure = {f for f, k in seen[1].items() if k >= least and k / n1 >= purity * (k / n1 + seen[0][f] / n0)}
    of: dict[str, set[int]] = {f: set() for f in pure}
    beside: dict[str, set[tuple[str, str]]] = {f: set() for f in pure}
    for k in once:
        if y[k]:
            for c in docs_chains[k]:
                for before, w, after in zip(["", *c], c, [*c[1:], ""], strict=False):
                    for f in features_of(w):
                        if f in pure:
                            of[f].add(k)
                            beside[f].add((before, after))
    marked, explained = set(), set()
    for f in sorted(pure, key=lambda f: (-seen[1][f], f)):
        k = seen[1][f]
        if 2 * len(beside[f]) >= k and (len(of[f] - explained) >= gain or k >= 4 * least):
            marked.add(f)
            explained |= of[f]
    return marked, seen


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_docs_per_class: int = 2500, max_chars_per_class: int = 5_000_000, steps: int = 100, purity: float = 0.99, **columns: str) -> ToxicityModel | None:
    """Fit on a bounded sample (see ``labelled_sample``); None where either class has no row."""
    texts, y, totals = labelled_sample(docs, labels, label, max_docs_per_class=max_docs_per_class, max_chars_per_class=max_chars_per_class, **columns)
    n0, n1 = np.bincount(y, minlength=2)
    if not n0 or not n1:
        return None
    same: dict[str, str] = {}  # one string object for all occurrences of a token
    docs_chains = [[[same.setdefault(w, w) for w in c] for c in _chains(t)] for t in texts]
    marked, seen = _toxic_features(texts, docs_chains, y, purity)
    known = {f: i for i, f in enumerate(sorted(f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= 3))}
    del seen
    types: dict[str, int] = {}
    flat, lengths, target, of_doc = [], [], [], []
    for k, (chains, toxic) in enumerate(zip(docs_chains, y.tolist(), strict=True)):
        for c in chains:
            hits = [toxic and any(f in marked for f in features_of(w)) for w in c]
            if toxic and not any(hits):
                continue  # what in this line may be toxic is not known
            flat += [types.setdefault(w, len(types)) for w in c]
            target += hits
            lengths.append(len(c))
            of_doc += [k] * len(c)
    if not any(target):
        return None
    flat, lengths, target, of_doc = np.array(flat), np.array(lengths), np.array(target, dtype=np.int64), np.array(of_doc)
    pairs = np.array([(i, known[f]) for w, i in types.items() for f in features_of(w) if f in known])
    k = len(known)
    has_before, has_after = (np.flatnonzero(x) for x in _neighbours(lengths))

    def table(w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(pairs[:, 0], weights=w[j * k : (j + 1) * k][pairs[:, 1]], minlength=len(types)) for j in range(3)], axis=1)

    def gradient(g: np.ndarray) -> np.ndarray:
        by_type = (np.bincount(flat, g, len(types)), np.bincount(flat[has_before - 1], g[has_before], len(types)), np.bincount(flat[has_after + 1], g[has_after], len(types)))
        return np.concatenate([*(np.bincount(pairs[:, 1], x[pairs[:, 0]], k) for x in by_type), [g.sum()]])

    w, trans = crf.fit(lambda w: _unary(flat, lengths, table(w), w[-1]), gradient, 3 * k + 1, target, lengths, steps=steps, l2=1e-6)
    rows = w[:-1].reshape(3, k)
    kept = {f: tuple(rows[:, i].tolist()) for f, i in known.items() if np.abs(rows[:, i]).max() > 0.05}
    model = ToxicityModel(kept, float(w[-1]), trans, np.zeros(3))
    x = np.concatenate([_document_aggregates(texts[i : i + 500], model)[0] for i in range(0, len(texts), 500)])
    weight = (totals / np.array([n0, n1]))[y]
    return ToxicityModel(kept, model.bias, trans, crf.logistic(x, y, weight / weight.mean()))


class _Types(dict):
    """Token -> its number; a new token's weights are looked up once."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model, self.new, self.table = model, [], np.zeros((0, 3))

    def weights(self) -> np.ndarray:
        """The weights of all tokens met, by number."""
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new)])
            self.new = []
        return self.table

    def __missing__(self, word: str) -> int:
        found = [x for f in features_of(word) if (x := self.model.features.get(f))]
        self.new.append(tuple(map(sum, zip(*found, strict=True))) if found else (0.0, 0.0, 0.0))
        self[word] = at = len(self)
        return at


def _document_aggregates(texts: list[str | None], model: ToxicityModel, types: _Types | None = None):
    """Aggregates of each text, its tokens' marginals, and the number of tokens of each text."""
    types = _Types(model) if types is None else types
    flat: list[int] = []
    lengths, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        for c in _chains(text):
            flat += map(types.__getitem__, c)
            lengths.append(len(c))
            counts[i] += len(c)
    if not flat:
        return _aggregates(np.zeros(0), np.zeros(0, dtype=np.int64), len(texts)), np.zeros(0), counts
    lengths = np.array(lengths)
    p = crf.marginals(_unary(np.array(flat), lengths, types.weights(), model.bias), lengths, model.trans)
    return _aggregates(p, np.repeat(np.arange(len(texts)), counts), len(texts)), p, counts


def score_texts(texts: list[str | None], model: ToxicityModel | None, types: _Types | None = None, span_at: float = 0.5):
    """Scores of the texts, and for each its toxic spans as (start, end) code-point offsets."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if model is None:
        return np.zeros(len(texts)), spans
    x, p, counts = _document_aggregates(texts, model, types)
    scores = 1.0 / (1.0 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
    scores[counts == 0] = 0.0
    ends = np.cumsum(counts)
    hits = np.flatnonzero(p > span_at)
    for i in sorted(set(np.searchsorted(ends, hits, side="right").tolist())):
        own = p[ends[i] - counts[i] : ends[i]]
        for m, q in zip(TOKEN.finditer(texts[i]), own.tolist(), strict=True):
            if q > span_at:
                spans[i].append((m.start(), m.end()))
    return scores, spans


def score(docs: DataFrame, model: ToxicityModel | None, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5, with_spans: bool = True) -> DataFrame:
    """Add ``score``, ``predicted`` (1 if score >= threshold) and ``toxic_spans`` (start and end offsets in code
    points of the tokens tagged as toxic) to the ``keep`` columns.

    Null and empty texts, and texts without a token, score 0 and have no span. Each row is scored by itself, in
    full, whatever its length: repeated rows get equal results, and an empty table gives an empty result. Input
    columns with the names of results are replaced. Without a model (no labels of either class) all score 0.
    """
    own = ["score", "predicted", *(["toxic_spans"] if with_spans else [])]
    keep = [c for c in (keep or docs.columns) if c not in own]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = StructType().add("start", "long").add("end", "long")

    def run(batches):
        types = None
        for batch in slices(batches, hidden, 2_000_000):
            if shared.value is not None and (types is None or len(types) > CACHED_TYPES):
                types = _Types(shared.value)
            scores, spans = score_texts(batch.column(len(keep)).to_pylist(), shared.value, types)
            more = []
            if with_spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                more = [pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *more], names=[*keep, *own])

    hidden = unused("text", keep)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    schema = given.drop(hidden).schema.add("score", "double").add("predicted", "integer")
    return given.mapInArrow(run, schema.add("toxic_spans", ArrayType(span)) if with_spans else schema)
