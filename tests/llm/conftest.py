"""Odd tables that every training-data operator must meet."""

import pytest
from odd_tables import CLASHES, DOCS, ODD_TEXTS
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", ["s1", None, ""][i % 3], len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[9], (None, "no id at all", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
