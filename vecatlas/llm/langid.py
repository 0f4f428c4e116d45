"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of a bounded sample of labelled documents in Spark. The log-probability
matrix (buckets x languages, of checked size) is broadcast, and batches of texts are scored in numpy: the
n-gram buckets of a document select rows of the matrix, which are summed document by document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import slices, unused

UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities: one row for a bucket and a zero row for windows that cross texts."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]
    buckets: int


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> itself for letters, space for all else (0 stays the separator)."""
    points = np.arange(0x110000, dtype=np.uint32)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    points[~letters] = 32
    points[0] = 0
    return points


def ngram_buckets(texts: list[str], orders: tuple[int, ...], buckets: int):
    """Yield, for each order, the bucket of the n-gram that starts at each position, and the texts' starts.

    A window that reaches past its own text gets the bucket ``buckets``, so a text's n-grams depend on
    nothing else in the batch.
    """
    parts = [" " + t.lower().replace("\0", " ") + " \0" for t in texts]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _folding()[np.minimum(codes, 0x10FFFF)].astype(np.uint64)
    found = []
    for n in orders:
        h = np.full(len(codes), n, dtype=np.uint64)
        crosses = np.zeros(len(codes), dtype=bool)
        for k in range(n):
            moved = np.zeros(len(codes), dtype=np.uint64)
            moved[: len(codes) - k] = codes[k:]
            h = (h ^ moved) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            crosses |= moved == 0
        bucket = (h >> np.uint64(20)).astype(np.int64) % buckets
        bucket[crosses] = buckets
        found.append(bucket)
    return found, starts


def fit(
    labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs_per_language: int = 8000,
    orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 16, max_matrix_bytes: int = 64 << 20, smoothing: float = 0.5,
) -> LanguageModel:
    """Fit on the rows of ``labelled`` that have a text, a language and a key.

    The sample is bounded: a language with more than ``max_docs_per_language`` rows gives about that many,
    chosen by a hash of the key. The matrix has buckets x languages float32 entries; ``buckets`` is halved until that is at
    most ``max_matrix_bytes`` (with 2^16 buckets and 64 MiB that begins at 257 languages), so any number of languages or
    of dirty codes gives a model, n-grams share buckets where there are many, and what the driver holds and broadcasts
    is bounded. The model's ``buckets`` tells.
    With no usable row the model has no language and every text is undetermined.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("key")).where(
        "text is not null and lang is not null and key is not null"
    )
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(totals))
    while buckets > 1 and buckets * len(languages) * 4 > max_matrix_bytes:
        buckets //= 2
    if not languages:
        return LanguageModel((), np.zeros((buckets + 1, 0), np.float32), np.zeros(0), orders, buckets)
    rates = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, max_docs_per_language / totals[name]))])
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < rates[F.col("lang")] * float(1 << 30)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1_000_000):
            names = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for name in set(names):
                into = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                for bucket in ngram_buckets([t for t, x in zip(texts, names, strict=True) if x == name], orders, buckets)[0]:
                    into += np.bincount(bucket, minlength=buckets + 1)
        for name, into in sums.items():
            at = np.flatnonzero(into[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(into[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = rows.where(drawn).select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    counts = counts.select("bucket", place.alias("place"), "n").toArrow()  # buckets x languages rows at most
    matrix = np.full((buckets + 1, len(languages)), smoothing)
    matrix[counts.column("bucket").to_numpy(), counts.column("place").to_numpy()] += counts.column("n").to_numpy()
    matrix = np.log(matrix) - np.log(matrix[:-1].sum(axis=0))
    matrix[-1] = 0
    prior = np.array([totals[name] for name in languages], dtype=float)
    return LanguageModel(languages, matrix.astype(np.float32), np.log(prior / prior.sum()), orders, buckets)


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not use or not model.languages:
        return names, scores
    found, starts = ngram_buckets([texts[i] for i in use], model.orders, model.buckets)
    total = np.tile(model.log_prior, (len(use), 1))
    for k in range(len(model.languages)):
        column = np.ascontiguousarray(model.log_prob[:, k])
        for bucket in found:
            total[:, k] += np.add.reduceat(column[bucket].astype(np.float64), starts)
    best = total.argmax(axis=1)
    total -= total.max(axis=1, keepdims=True)
    top = 1.0 / np.exp(total).sum(axis=1)
    for i, b, s in zip(use, best.tolist(), top.tolist(), strict=True):
        names[i], scores[i] = model.languages[b], s
    return names, scores


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the ``keep`` columns (all but clashing ones by default).

    A null text, an empty text and one with no letter are ``und`` with score 0. Ties go to the language that
    sorts first. Rows are scored one by one, so repeated rows get equal results; an empty table gives an
    empty result. Input columns named ``lang_pred`` or ``score`` are replaced.
    """
    own = ("lang_pred", "score")
    keep = [c for c in (keep or docs.columns) if c not in own]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, hidden, 1_000_000):
            names, scores = score_texts(batch.column(len(keep)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *own])

    hidden = unused("text", keep)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    schema = given.drop(hidden).schema.add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(run, schema)
