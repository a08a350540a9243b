"""Tables that are upserted by buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.lifecycle import upsert_memories
from tessera.sources import stored

SCHEMA = "slug string, body string"


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def content(spark, path):
    return sorted(((r.slug, r.body) for r in stored.read(spark, path).collect()), key=str)


def files(tmp_path):
    return {f for f in (tmp_path / "t").rglob("*.parquet")}


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.upsert(rows(spark, *[(f"s{i}", "old") for i in range(50)], (None, "null")), path, "slug", buckets=16)
    before = files(tmp_path)
    batch = rows(spark, ("s3", "new"), ("t", "added"), (None, "null again"))
    for _ in range(2):  # a replayed batch changes nothing
        stored.upsert(batch, path, "slug")
        found = dict(content(spark, path))
        assert len(found) == 52 and found["s3"] == "new" and found["t"] == "added" and found["s4"] == "old"
    assert len(before - files(tmp_path)) <= 3 and {f.parent.parent.name for f in files(tmp_path)} == {"buckets=16"}
    stored.upsert(batch.limit(0), path, "slug")
    assert len(content(spark, path)) == 52


def test_rows_are_removed_and_buckets_may_be_left_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(rows(spark, ("a", "1"), ("b", "2"), ("c", "3")), path, "slug", 4)
    stored.remove(rows(spark, ("a", ""), ("x", "")), path, "slug")
    assert content(spark, path) == [("b", "2"), ("c", "3")]
    stored.remove(rows(spark, ("b", "")).unionByName(rows(spark, ("a", ""))), path, "slug")
    stored.upsert(rows(spark, ("b", "back")), path, "slug")
    assert content(spark, path) == [("b", "back"), ("c", "3")]


def test_another_merge(spark, tmp_path):
    """Memories keep the time they were made at and their recalls."""
    path = str(tmp_path / "t")
    make = lambda at, n, body: spark.createDataFrame([("a", at, at, n, body)], "slug string, created_at long, updated_at long, recall_count long, body string")
    stored.upsert(make(1, 5, "one"), path, "slug", upsert_memories)
    stored.upsert(make(2, 0, "two"), path, "slug", upsert_memories)
    assert [tuple(r) for r in stored.read(spark, path).select("slug", "created_at", "updated_at", "recall_count", "body").collect()] == [("a", 1, 2, 5, "two")]


def test_columns_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "t")
    made = spark.range(20).select(F.col("id"), F.array("id").alias("ids"), F.struct("id").alias("s"))
    stored.create(made, path, "id", 3)
    assert stored.read(spark, path).dtypes == made.dtypes
