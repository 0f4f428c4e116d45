"""Document quality: a linear-chain CRF labels every line good or bad, and its marginals are aggregated.

The chain of a document is its lines that are not blank. The features of a line are shares of character
classes, repetition and shape, cut into bins, of the line itself and of the lines before and after it.
Forward-backward gives each line's probability of being good; their mean, weighted by the lines' lengths, is
calibrated to the document's probability. Labels exist for documents only: a line starts with its document's
label, and lines of bad documents that the first fit takes for clearly good are relabelled before the second.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from vecatlas.llm import crf
from vecatlas.llm.common import labelled_sample, slices, unused

# Classes of characters.
LOWER, UPPER, DIGIT, SPACE, EXCLAIM, BAR, ODD, MARK, OTHER = range(9)
ODD_CHARACTERS = "#$%&*+<=>@\\^_`{}~"
# Lower ends of the bins that the shares are cut into.
BINS = (0.0, 0.02, 0.06, 0.12, 0.25, 0.5, 0.8)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # features x (line itself, line before, line after)
    trans: np.ndarray
    calibration: np.ndarray


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    of = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            of[i] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            of[i] = DIGIT
        elif c.isspace():
            of[i] = SPACE
        elif i < 0x250:
            of[i] = EXCLAIM if c == "!" else BAR if c == "|" else ODD if c in ODD_CHARACTERS else MARK
    of[0x3000:0xD800] = LOWER  # scripts without case
    return of


def line_features(lines: list[str], repeated: np.ndarray) -> np.ndarray:
    """One row of features for each line; ``repeated`` marks lines that stand in their document already."""
    n = len(lines)
    points = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[np.minimum(points, 0x10FFFF)].astype(np.int64)
    ends = np.flatnonzero(points == 10)
    line = np.repeat(np.arange(n), np.diff(np.concatenate(([-1], ends))))
    counts = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9).astype(np.float64)
    counts[:, SPACE] -= 1  # the joining line feed
    closes = np.zeros(len(kind), dtype=bool)  # a mark that ends a word
    closes[:-1] = (kind[:-1] >= EXCLAIM) & (kind[1:] == SPACE)
    closing = np.bincount(line[closes], minlength=n)
    words, distinct, adjacent = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, x in enumerate(lines):
        w = x.split()
        words[i], distinct[i], adjacent[i] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
    chars, total = np.maximum(counts.sum(axis=1), 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    shares = np.stack([
        counts[:, UPPER] / letters, counts[:, DIGIT] / chars, counts[:, EXCLAIM] / chars, counts[:, BAR] / chars, counts[:, ODD] / chars,
        counts[:, MARK] / chars, counts[:, OTHER] / chars, 1 - distinct / total, adjacent / total, closing / total, np.minimum(1.0, letters / total / 16), np.minimum(1.0, words / 64),
    ], axis=1)
    binned = np.zeros((n, shares.shape[1], len(BINS)))
    cell = np.searchsorted(np.array(BINS), shares, side="right") - 1
    np.put_along_axis(binned, np.clip(cell, 0, None)[:, :, None], 1.0, axis=2)
    return np.concatenate([np.ones((n, 1)), shares, repeated[:, None], binned.reshape(n, -1)], axis=1).astype(np.float32)


def _documents(texts: list[str | None]):
    """Lines that are not blank, the number of them in each text, their lengths, and which are repeated."""
    lines: list[str] = []
    counts, repeated = np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        own = [x for x in (text or "").split("\n") if not x.isspace() and x]
        seen: set[str] = set()
        for x in own:
            repeated.append(x in seen)
            seen.add(x)
        counts[i] = len(own)
        lines += own
    return lines, counts, np.fromiter(map(len, lines), dtype=np.float64, count=len(lines)), np.array(repeated, dtype=np.float64)


def _shifted(x: np.ndarray, counts: np.ndarray, by: int) -> np.ndarray:
    """Rows moved by one within each document; where there is no neighbour, zeros."""
    out = np.zeros_like(x)
    edges = np.cumsum(counts[counts > 0])
    if by > 0:
        out[1:] = x[:-1]
        out[np.concatenate(([0], edges[:-1]))] = 0
    else:
        out[:-1] = x[1:]
        out[edges - 1] = 0
    return out


def _weighted_mean(p: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(doc, weights=p * lengths, minlength=len(counts)) / np.maximum(np.bincount(doc, weights=lengths, minlength=len(counts)), 1)


def _design(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(mean)), np.log(mean / (1 - mean))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_docs_per_class: int = 2500, max_chars_per_class: int = 5_000_000, steps: int = 80, **columns: str) -> QualityModel | None:
    """Fit on a bounded sample (see ``labelled_sample``); None where either class has no row."""
    texts, y, totals = labelled_sample(docs, labels, label, max_docs_per_class=max_docs_per_class, max_chars_per_class=max_chars_per_class, **columns)
    lines, counts, lengths, repeated = _documents(texts)
    if not len(lines) or len(set(y[counts > 0].tolist())) < 2:
        return None
    x = line_features(lines, repeated)
    all_x = np.concatenate([x, _shifted(x, counts, 1), _shifted(x, counts, -1)], axis=1)
    of_doc = np.repeat(y, counts)
    target, start = of_doc.copy(), None
    for _ in range(2):
        start = crf.fit(lambda w: all_x @ w.astype(np.float32).astype(np.float64), lambda g: all_x.T @ g, all_x.shape[1], target, counts, steps=steps, start=start)
        p = crf.marginals(all_x @ start[0], counts, start[1])
        target = np.where((of_doc == 0) & (p > 0.8), 1, of_doc)
    w, trans = start
    has = counts > 0
    mean = _weighted_mean(p, lengths, counts)[has]
    drawn = np.maximum(np.bincount(y[has], minlength=2), 1)
    weight = (totals / drawn)[y[has]]
    calibration = crf.logistic(_design(mean), y[has], weight / weight.mean())
    return QualityModel(w.reshape(3, -1).T.astype(np.float32), trans, calibration)


def score_texts(texts: list[str | None], model: QualityModel | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The score of each text, and its lines' probabilities of being good."""
    lines, counts, lengths, repeated = _documents(texts)
    scores = np.zeros(len(texts))
    if not lines or model is None:
        return scores, [np.zeros(n) for n in counts]
    each = line_features(lines, repeated) @ model.weights
    unary = each[:, 0] + _shifted(each[:, 1], counts, 1) + _shifted(each[:, 2], counts, -1)
    p = crf.marginals(unary, counts, model.trans)
    mean = _weighted_mean(p, lengths, counts)
    scores = 1.0 / (1.0 + np.exp(-np.clip(_design(mean) @ model.calibration, -30, 30)))
    scores[counts == 0] = 0.0
    return scores, np.split(p, np.cumsum(counts)[:-1])


def classify(docs: DataFrame, model: QualityModel | None, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7, with_lines: bool = False) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 if score >= threshold) to the ``keep`` columns; with_lines: also
    ``line_scores``, the probability of each line that is not blank.

    Null, empty and blank texts score 0. Each row is scored by itself: repeated rows get equal results, and an
    empty table gives an empty result. Input columns with the names of results are replaced. Without a model
    (no labels of either class) all score 0.
    """
    own = ["score", "predicted", *(["line_scores"] if with_lines else [])]
    keep = [c for c in (keep or docs.columns) if c not in own]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, hidden, 1_000_000):
            scores, parts = score_texts(batch.column(len(keep)).to_pylist(), shared.value)
            more = [pa.array([x.tolist() for x in parts], pa.list_(pa.float64()))] if with_lines else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *more], names=[*keep, *own])

    hidden = unused("text", keep)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    schema = given.drop(hidden).schema.add("score", "double").add("predicted", "integer")
    return given.mapInArrow(run, schema.add("line_scores", ArrayType(DoubleType())) if with_lines else schema)
