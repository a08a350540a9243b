"""The inverted index against scores by plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import index

TOKEN = re.compile(r"\w+")
SCHEMA = "doc_id bigint, text string"


def scores(docs, queries, k):
    words = {i: TOKEN.findall((t or "").lower()) for i, t in docs.items()}
    mean = max(sum(map(len, words.values())), 1) / max(1, len(words))
    counts = {i: Counter(w) for i, w in words.items()}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, text in queries:
        found = []
        for i, c in counts.items():
            terms = [t for t in dict.fromkeys(TOKEN.findall((text or "").lower())) if t in c]
            if terms:
                found.append((-round(sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for t in terms), 6), i))
        out |= {(q, i): (-s, r) for r, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def found(spark, path, queries, k):
    asked = spark.createDataFrame(queries, "query int, text string")
    return {(r.query, r.id): (r.score, r["rank"]) for r in index.search(spark, path, asked, k).collect()}


def same(got, wanted):
    assert got.keys() == wanted.keys()
    assert all(got[x][1] == wanted[x][1] and got[x][0] == pytest.approx(wanted[x][0], abs=2e-6) for x in got)


def test_searches_updates_and_merges(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(40)))
    docs = {i: text() for i in range(300)} | {300: None, 301: "", 302: "Same Same w1", 303: "same same W1"}
    queries = [(i, text()) for i in range(20)] + [(90, "absent"), (91, None), (92, "w1"), (93, "same w1 w1")]
    path = str(tmp_path / "index")
    make = lambda d: spark.createDataFrame([*d.items()], SCHEMA).repartition(3)
    index.build(make(docs), path, block=8)
    for k in (1, 3, 500):
        same(found(spark, path, queries, k), scores(docs, queries, k))
    changed = {i: text() for i in range(0, 60, 4)} | {400: "w1 new same", 7: None}
    gone = [*range(100, 140), 999]
    for _ in range(2):  # a batch that comes twice changes nothing
        index.update(path, make(changed), spark.createDataFrame([(i,) for i in gone], "doc_id bigint"), block=8)
        docs = {i: t for i, t in (docs | changed).items() if i not in gone}
        same(found(spark, path, queries, 3), scores(docs, queries, 3))
    index.merged(path, str(tmp_path / "one"), spark)
    same(found(spark, str(tmp_path / "one"), queries, 3), scores(docs, queries, 3))
    assert spark.read.parquet(str(tmp_path / "one")).select("segment").distinct().count() == 1


def test_only_segments_with_changes_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(spark.createDataFrame([(1, "a b"), (2, "b")], SCHEMA), path)
    index.update(path, spark.createDataFrame([(3, "c")], SCHEMA))
    files = lambda n: sorted(f.name for f in (tmp_path / "index" / f"segment={n}").glob("*.parquet"))
    before = files(0)
    index.update(path, spark.createDataFrame([(3, "b d")], SCHEMA))
    assert files(0) == before and not files(1)
    same(found(spark, path, [(1, "b")], 5), scores({1: "a b", 2: "b", 3: "b d"}, [(1, "b")], 5))


def test_no_texts_and_string_keys(spark, tmp_path):
    path = str(tmp_path / "none")
    index.build(spark.createDataFrame([], SCHEMA), path)
    assert not found(spark, path, [(1, "a")], 5)
    index.build(spark.createDataFrame([("x", "a"), ("y", "a b")], "doc_id string, text string"), path)
    assert [k for k, _ in sorted(found(spark, path, [(1, "a")], 5).items(), key=lambda x: x[1][1])] == [(1, "x"), (1, "y")]


def test_bounds_hold_for_any_mean(spark, tmp_path):
    """The kept pairs of counts and lengths have the largest score of a row, whatever the mean."""
    rng = random.Random(2)
    path = str(tmp_path / "index")
    index.build(spark.createDataFrame([(i, "w " * rng.randrange(1, 9) + "x " * rng.randrange(30)) for i in range(50)], SCHEMA), path)
    row = spark.read.parquet(path).where("term = 'w'").first()
    part = lambda tf, n, mean: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    for mean in (0.5, 5, 500):
        assert max(part(*x, mean) for x in zip(row.front_tf, row.front_length, strict=True)) == max(part(*x, mean) for x in zip(row.tfs, row.lengths, strict=True))
    assert len(row.front_tf) < len(row.tfs) == row.n


def test_a_few_terms_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(spark.createDataFrame([(1, "alpha beta")], SCHEMA), path)
    rows = index._of_terms(spark.read.parquet(path), spark.createDataFrame([("beta",)], "term string"))
    plan = rows.select("n")._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(term,beta)" in plan.replace("IsNotNull(term), ", "") and "ids" not in plan.rpartition("ReadSchema")[2]
    assert rows.select(F.sum("n")).first()[0] == 1


def test_postings_are_dropped_by_blocks(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(spark.createDataFrame([(i, f"a w{i % 3}") for i in range(30)], SCHEMA).coalesce(1), path, block=8)
    old = spark.read.parquet(path)
    lost = old.where("term = '' AND block <> -1").selectExpr("segment AS of_segment", "block AS of_block", "explode(ids) AS id").where("id % 3 = 1 OR id < 8")
    stays = index._without(old, lost)
    # no row carries, nor is searched through, all that its block loses
    assert "array_contains" not in stays._jdf.queryExecution().toString()
    rows = {(r.term, r.block): r for r in stays.collect()}
    assert sorted(i for (t, _), r in rows.items() if t == "a" for i in r.ids) == [i for i in range(8, 30) if i % 3 != 1]
    assert not any(t == "w1" for t, _ in rows) and any(b == index.NOTHING for _, b in rows)
    was = {(r.term, r.block): {k: x for k, *x in zip(r.ids, r.tfs, r.lengths, strict=True)} for r in old.collect()}
    for key, r in rows.items():
        assert r.n == len(r.ids) and {k: x for k, *x in zip(r.ids, r.tfs, r.lengths, strict=True)} == {k: x for k, x in was[key].items() if k in r.ids}
