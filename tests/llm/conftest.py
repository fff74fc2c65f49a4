"""Small tables with the odd cases that every operator must stand."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, size string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, one id with two texts, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 1, "x", "y"),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 1, "x", "y"),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", None, None, None, None),
        (3, None, None, None, None, None, None), (4, "", "en", "s1", 0, "", ""), (5, " \t\n ", "en", "s2", 4, "", ""),
        (None, "an id that is null", "en", "s2", 1, "", ""), (6, long, "en", "s1", 1, "", ""), (7, "one two", "en", "s2", 7, "", ""),
        (7, "another text of the same id", "en", "s3", 7, "", ""), (8, "é ü ß Ω 漢字 \U0001f600 <|endoftext|> İstanbul", "de", "s3", 7, "", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
