from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("needs the given tables")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Null id and text, empty and very long texts, repeated rows, clashing column names."""

    rows = [
        (1, None, "a", 0, 0, "x"),
        (2, "", None, 0, 0, "x"),
        (3, " \t\n ", "a", 0, 0, "x"),
        (None, "some words without an id, said twice", "a", None, 0, None),
        (4, "word " * 60_000, "a", 0, 0, "x"),
        (5, "x" * 200_000, "a", 0, 0, "x"),
        (6, "The same row, twice as it is: ünïcode ✓ 漢字", "a", 1, 1, "x"),
        (6, "The same row, twice as it is: ünïcode ✓ 漢字", "a", 1, 1, "x"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, body string, id int, n int, row string"
    )
