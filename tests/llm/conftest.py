"""Small documents with the cases that operators have to define: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "en"),
    (2, "The quick brown fox jumps over the lazy dog again", "en"),
    (3, "The  quick brown\tfox jumps over the lazy dog again ", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \n\t ", "en"),
    (7, LONG, "en"),
    (7, LONG, "en"),
    (None, "no key here at all", "de"),
    (8, "one two", "fr"),
    (9, "ONE two", "fr"),
    (10, "Ünïcode 日本語 🙂 text\x0b with\x0cspaces", "ja"),
    (-11, "negative key", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows, with columns that operators use for themselves."""
    schema = "doc_id bigint, text string, lang string"
    from pyspark.sql import functions as F

    clashing = {c: F.lit("mine") for c in ("n", "key", "handle", "chunk", "block", "norm", "shard", "size", "secrets", "toxicity", "label", "ids", "length", "copy")}
    return spark.createDataFrame(ROWS, schema).repartition(3).withColumns(clashing)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
