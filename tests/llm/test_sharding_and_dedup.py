"""Jump hashing and the content sort against plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tessera.llm.exact_dedup import deduplicated, exact_groups
from tessera.llm.sharding import jump_shards, shard


def jump(key: int, shards: int) -> int:
    key &= 2**64 - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=30), st.integers(1, 200))
def test_jump(spark, keys, n):
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", jump_shards(F.col("k"), [n, n + 1]).alias("at")).collect()
    assert all(list(r.at) == [jump(r.k, n), jump(r.k, n + 1)] for r in rows)


def test_shards_of_odd_rows(odd, none):
    rows = shard(odd, 5).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, 5) and r.grown_shard in (r.shard, 5) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert Counter((i, zlib.crc32(t.encode()), len(t.encode()) + 16) for i, t in texts.elements()) == Counter((r.doc_id, r.text_crc32, r.size) for r in rows)
    assert shard(none, 5).count() == 0
    with pytest.raises(ValueError):
        shard(odd, 0)


def groups(rows):
    kept = {}
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        kept.setdefault(norm, []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {n: (min(x)[3], len(x)) for n, x in kept.items()}


@pytest.mark.parametrize("rows_of_a_part", [1, 1_000])
def test_groups_of_odd_rows(odd, none, monkeypatch, rows_of_a_part):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", rows_of_a_part)
    rows = exact_groups(odd).collect()
    wanted = groups([(r.doc_id, r.text) for r in odd.collect()])
    assert len(rows) == odd.count() and sum(r.kept for r in rows) == len(wanted)
    assert Counter((r.keep_id, r.group_size) for r in rows if r.kept) == Counter(wanted.values())
    assert exact_groups(none).count() == 0


@pytest.mark.parametrize("rows_of_a_part", [1, 1_000])
def test_one_row_of_each_group_stays(odd, monkeypatch, rows_of_a_part):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", rows_of_a_part)
    left = deduplicated(odd)
    assert left.columns == odd.columns
    assert left.count() == len(groups([(r.doc_id, r.text) for r in odd.collect()]))
    assert 3 in {r.doc_id for r in left.collect()}  # the longest original


def test_clashing_columns_pass_unchanged(spark):
    names = ["norm", "hash", "hash_", "head", "part", "parts", "place", "place_", "points", "key", "kept_key_", "kept_hash_", "c0"]
    df = spark.createDataFrame([(1, "a b", *names), (2, "ab", *names), (3, "c", *names)], f"doc_id int, text string, {', '.join(f'{n} string' for n in names)}")
    rows = deduplicated(df).collect()
    assert {r.doc_id for r in rows} == {1, 3} and all(r[n] == n for r in rows for n in names)


def test_a_text_that_most_rows_have_is_cut_into_parts(spark):
    df = spark.range(9000, numPartitions=6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.concat(F.lit("hot text"), F.repeat(F.lit(" "), (F.col("id") % 2).cast("int")))).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    parts = exact_dedup._sorted(df.select("doc_id", exact_dedup.normalised(F.col("text")).alias("norm"))).groupBy("norm", "part").count()
    assert parts.where("norm = 'hottext'").count() == 6
    found = exact_groups(df).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.count_if("kept")).first()
    assert tuple(found) == (6000, 1, 1, 6000, 1)
    assert {r.doc_id for r in deduplicated(df).where("text like 'hot%'").collect()} == {1}


def test_keys_that_most_rows_have_get_slots_without_gaps(spark, monkeypatch):
    """One key, and one row, of which there are very many; keys that are texts."""
    monkeypatch.setattr("tessera.llm.sharding.BLOCK_ROWS", 100)
    monkeypatch.setattr("tessera.llm.sharding.REPEATS", 64)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.when(F.col("id") % 3 == 1, F.lit(6)).otherwise(F.col("id"))).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    for keyed in (df, df.withColumn("doc_id", F.col("doc_id").cast("string"))):
        slots = defaultdict(list)
        for r in shard(keyed, 7).collect():
            slots[r.shard].append((r.slot, r.doc_id, r.text_crc32))
        assert sum(map(len, slots.values())) == 3000
        assert all([s for s, _, _ in sorted(x)] == list(range(len(x))) for x in slots.values())
        assert all([y for _, *y in sorted(x)] == sorted(y for _, *y in x) for x in slots.values())
