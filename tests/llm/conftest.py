from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one"), (4, "one"), (5, long), (6, long), (None, "one two three four five six"), (7, "x" * 200_000), (8, "a\nb\na\nb\na\nb\n")]
    full = [(i, t, None, None, None, "m", 1.5, "k", 3) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, marked string, score double, h string, n long")
