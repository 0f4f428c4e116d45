"""The corpus pipeline: quality classifier, language ID, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.llm import decontam, langid, order_minhash, packing, quality
from vecatlas.llm.common import held_out, table, written
from vecatlas.llm.queries import vocabulary

LEAST_LANGUAGE_SCORE = 0.5


def _whole(docs: DataFrame) -> DataFrame:
    """The rows as one struct column, so that no column of theirs can clash with an operator's, and their text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    if model is None:  # nothing to learn from: nothing is rejected
        return docs
    return quality.classify(_whole(docs), model, keep=["row"]).where("predicted = 1").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with a probability of LEAST_LANGUAGE_SCORE or more."""
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    if not model.languages:
        return docs
    found = langid.identify(_whole(docs), model, keep=["row"])
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of least id."""
    return order_minhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontam.find(_whole(docs), table(spark, sf_dir, "benchmark"), keep=["row"])
    return found.where(F.size("hit_ranges") == 0).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
#: Models, tokens and alignments are beyond SQL: tests/llm holds run() against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
