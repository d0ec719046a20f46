import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, held_out string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, very long texts, repeated rows and ids, and columns whose names operators use themselves."""
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (4, "one two three four five six"), (4, "another text under the same id"), (5, "one two three four five six"),
            (6, "word"), (7, long), (8, "x" * 100_000), (None, "text without an id"), (9, "日本語のテキスト é <|endoftext|> it's"), (10, "퟿\u0000nul")]
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
