"""Small documents with the awkward cases that every operator must define."""

import pytest
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __p string, id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    rows = [
        (1, "plain words in a row", "en", "a", 20, "x", "y"),
        (1, "plain words in a row", "en", "a", 20, "x", "y"),
        (2, "plain words in a row", "en", None, 20, None, None),
        (3, None, "en", "b", None, "x", "y"),
        (4, "", None, "b", 0, "x", "y"),
        (5, long_text, "en", "c", len(long_text), "x", "y"),
        (None, "a row without an id", "en", "a", 19, "x", "y"),
        (7, "Ünïcödé \U0001f600 text with\tmany\x0bkinds\nof space", "de", "ä", 40, "x", "y"),
    ]
    return spark.createDataFrame([Row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
