from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import SF  # noqa: E402

CONTROL = "<|im_end|><|endoftext|> á İ   x"


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of the smallest table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((row["doc_id"], row["text"]) for row in rows)


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and names that clash with results."""
    long = " ".join(f"word{n % 977}" for n in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "a", "en"),
        (1, "alpha beta gamma delta epsilon zeta", "a", "en"),
        (2, None, None, None),
        (3, "", "b", "en"),
        (4, " \t\n ", "b", "en"),
        (5, long, "a", "en"),
        (6, "x" * 100_000, "a", None),
        (7, CONTROL, None, "de"),
        (8, "Two words", "c", "en"),
        (9, "ALPHA beta  gamma\ndelta epsilon zeta", "a", "en"),
    ]
    schema = "doc_id long, text string, source string, lang string"
    frame = spark.createDataFrame(rows, schema)
    for clash in ("size", "key", "shard", "slot", "node", "row", "n", "ids", "toxic_score", "copies", "mix_source"):
        frame = frame.selectExpr("*", f"'clash' AS {clash}")
    return frame


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.where("doc_id < 0")
