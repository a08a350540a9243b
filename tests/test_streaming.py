"""Streams over files, run to their end, against the batch results."""

from __future__ import annotations

import json
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.sources import stored
from tessera.streaming import streams


def drained(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_capture_upserts_by_slug(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda s, d, b: json.dumps({"slug": s, "created_at": f"2024-01-0{d}T00:00:00", "body": b})
    (folder / "a.jsonl").write_text("\n".join([line("a", 1, "x"), line("a", 1, "again"), "bad", line("b", 1, "y")]))
    rows = streams.captured(streams.file_lines(spark, str(folder)))
    streams.into_table(rows, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    found = stored.read(spark, str(tmp_path / "table")).collect()
    assert sorted(r.slug for r in found) == ["a", "b"] and {r.scope_hash for r in found} == {"_unscoped"}
    (folder / "b.jsonl").write_text("\n".join([line("b", 3, "within the watermark"), line("c", 2, "new")]))
    streams.into_table(rows, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    (folder / "c.jsonl").write_text(line("b", 5, "later"))
    streams.into_table(rows, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    after = {r.slug: r.body for r in stored.read(spark, str(tmp_path / "table")).collect()}
    assert after.pop("a") in ("x", "again") and after == {"b": "later", "c": "new"}


def test_daily_hits_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("trigger"), F.lit(None).cast("string").alias("scope_hash"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    found = drained(spark, streams.daily_hits(stream), "daily_hits", "complete")
    batch = events.groupBy("trigger", F.to_date("ts").alias("day")).agg(F.count("*").alias("hits"))
    assert {(r.trigger, r.day, r.hits) for r in found.collect()} == {(r.trigger, r.day, r.hits) for r in batch.collect()}
    spells = drained(spark, streams.sliding_hits(stream), "sliding", "complete")
    assert spells.agg(F.sum("hits")).first()[0] == 7 * events.count()


def test_threshold_fires_and_starts_anew(spark, tmp_path):
    spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(3)], "key string, n int").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("key string, n int").parquet(str(tmp_path / "e"))
    assert [tuple(r) for r in drained(spark, streams.threshold_fires(stream), "fires").collect()] == [("a", 2, 5)]


def by_hand(events, threshold, pause):
    """Fires of (key, ts, seq, n) in order."""
    counts, last, out = {}, {}, []
    for key, ts, _, n in sorted(events, key=lambda e: e[1:3]):
        if threshold <= 0 or n <= 0:
            continue
        counts[key] = counts.get(key, 0) + n
        if counts[key] >= threshold:
            passed = key not in last or (ts - last[key]).total_seconds() >= pause
            out.append((key, ts, counts[key], passed))
            counts[key] = 0
            if passed:
                last[key] = ts
    return sorted(out)


def test_fires_reset_pause_and_go_on_over_batches(spark, tmp_path):
    start, rng = datetime(2024, 1, 1), random.Random(4)
    events = [(rng.choice("abc"), start + timedelta(seconds=40 * i + rng.randrange(30)), i, rng.randrange(-1, 4)) for i in range(400)]
    schema = "key string, ts timestamp, seq long, n long"
    for i, part in enumerate((events[:150], events[150:170], events[170:])):  # in order of time, a batch each
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for threshold in (5, 0):
        with streams.rocks(spark):
            rows = drained(spark, streams.due(stream, threshold, 300), f"due_{threshold}").collect()
        assert sorted((r.key, r.ts, r.n, r.passed) for r in rows) == by_hand(events, threshold, 300)
    assert {p for *_, p in by_hand(events, 5, 300)} == {True, False}


def test_sessions_end_and_late_events_are_left_out(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 12) + timedelta(minutes=m)
    schema = "user_id long, ts timestamp"
    for i, minutes in enumerate(([0, 10, 50], [200, 205], [1, 400])):  # minute 1 comes after the watermark has passed it
        spark.createDataFrame([(7, at(m)) for m in minutes], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = drained(spark, streams.sessions(stream, "30 minutes", "10 minutes"), "spells").collect()
    assert sorted((r.start, r.end, r.n) for r in found) == [(at(0), at(40), 2), (at(50), at(80), 1), (at(200), at(235), 2)]


def test_sliding_windows_equal_the_batch(spark, tmp_path):
    rows = [("a", datetime(2024, 1, d)) for d in (1, 3, 3, 9)]
    spark.createDataFrame(rows, "trigger string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trigger string, ts timestamp").parquet(str(tmp_path / "in"))
    found = {(r.start.day if r.start.month == 1 else r.start.day - 31): r.hits for r in drained(spark, streams.sliding_hits(stream), "windows", "complete").collect()}
    expected = Counter(d - back for _, t in rows for d in [t.day] for back in range(7))
    assert found == dict(expected)
