import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, lang_pred string, n_words string, items string, key string, node string, digest string, `range` string, size string, sequence_id string, `row` string"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def awkward_rows():
    words = " ".join(f"w{i % 9973}" for i in range(60_000))
    texts = [None, "", "   \n\n ", "!!! ...", "one", "Ünï çödé ß 日本語 \U0001f600", words, "same text here, five words and more", "same text here, five words and more", "a\nb\n\nc\r\nd\t e  f"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(7, "same text here, five words and more"), (None, "no id at all but several words"), (None, None), (3, "another text under a used id")]
    return [(i, t, None, "s", None, *["x"] * 12) for i, t in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, equal texts, repeated rows and ids, and clashing column names."""
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
