from __future__ import annotations

import pytest

LONG = "word " * 60_000 + "x" * 70_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "fr"),
    (6, LONG, "en"),
    (7, "Grüße 😀 aus Köln: ünïcödé, 漢字!", "de"),
    (7, "Grüße 😀 aus Köln: ünïcödé, 漢字!", "de"),
    (7, "another text under a repeated id", "de"),
    (None, "a row without an id", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names operators use inside."""
    rows = [(*r, "src0", 1, 2, "h", 0.5, "uid") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, h int, s string, score double, uid string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
