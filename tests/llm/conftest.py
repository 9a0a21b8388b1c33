from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, component long, __spans string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"passage{i}" for i in range(70))
ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "one two", "en"),
    (5, "one two", "de"),
    (6, "One TWO", "en"),
    (7, LONG, "en"),
    (8, LONG, "en"),
    (8, LONG, "en"),
    (9, "Start of ninth " + PASSAGE + " and the ninth goes on alone " + " ".join(f"nine{i}" for i in range(40)), "en"),
    (10, "The tenth begins otherwise " + PASSAGE + " and ends otherwise", "en"),
    (11, "11 22 33 !!", "en"),
    (None, "a row without an id", "en"),
    (None, PASSAGE, None),
    (12, "ünï côde \U0001f600 漢字 end", "fr"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, copies, repeated rows and ids, a very long text, columns with clashing names."""
    return spark.createDataFrame([(i, t, g, "s", None, "w", 1, "x") for i, t, g in ODD], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
