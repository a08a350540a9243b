"""Structured Streaming: capture from files, daily counters, sessions, and a threshold counter with a state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.lifecycle import upsert_memories
from tessera.sources import stored


def file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path, line of the text files that come into a folder."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def captured(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """slug, scope_hash, created_at, body of JSON lines; bad lines are left out, each slug comes once within the watermark, no scope is _unscoped."""
    field = lambda k: F.get_json_object("line", f"$.{k}")
    rows = lines.select(field("slug").alias("slug"), F.coalesce(field("scope_hash"), F.lit("_unscoped")).alias("scope_hash"), F.try_to_timestamp(field("created_at")).alias("created_at"), field("body").alias("body"))
    return rows.where("slug IS NOT NULL AND created_at IS NOT NULL").withWatermark("created_at", late).dropDuplicatesWithinWatermark(["slug"])


def daily_hits(events: DataFrame, late: str = "2 days") -> DataFrame:
    """trigger, scope_hash, day, hits by day; late days add to theirs until the watermark passes. events: trigger, scope_hash, ts."""
    return (
        events.withWatermark("ts", late)
        .groupBy("trigger", F.coalesce("scope_hash", F.lit("_global")).alias("scope_hash"), F.window("ts", "1 day").alias("w"))
        .agg(F.count("*").alias("hits"))
        .select("trigger", "scope_hash", F.to_date("w.start").alias("day"), "hits")
    )


def sliding_hits(events: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """trigger, start, end, hits of sliding windows."""
    counted = events.withWatermark("ts", late).groupBy("trigger", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("hits"))
    return counted.select("trigger", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hits")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: spells of activity that a gap ends."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def threshold_fires(events: DataFrame, threshold: int = 10) -> DataFrame:
    """key, fired_at_count, rest: each time a key's events reach the threshold its counter fires and starts anew; 0 or less never fires."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(map(len, batches))
        fires = n // threshold if threshold > 0 else 0
        state.update((n - fires * threshold,))
        if fires:
            yield pd.DataFrame({"key": [key[0]], "fires": [fires], "rest": [n - fires * threshold]})

    return events.groupBy("key").applyInPandasWithState(count, "key string, fires long, rest long", "n long", "append", GroupStateTimeout.NoTimeout)


class Fires(StatefulProcessor):
    """A counter of each key that starts anew when it reaches a threshold, with a pause after each time that it counts.

    An event-time timer at the end of a pause removes what is known of it, so that keys that fall silent keep a number alone.
    """

    def __init__(self, threshold: int, pause: float) -> None:
        self.threshold, self.pause = threshold, int(pause * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count, self.last = handle.getValueState("count", "n long"), handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        n = self.count.get()[0] if self.count.exists() else 0
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts, more in zip(frame["ts"], frame["n"], strict=True):
            if self.threshold <= 0 or more <= 0:
                continue
            n += int(more)
            if n >= self.threshold:
                now = ts.value // 1_000_000
                passed = last is None or now - last >= self.pause
                out.append((key[0], ts, n, passed))
                n, last = 0, now if passed else last
        self.count.update((n,))
        if any(x[3] for x in out):
            self.last.update((last,))
            self.handle.registerTimer(last + self.pause)
        yield pd.DataFrame(out, columns=["key", "ts", "n", "passed"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.pause <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame([], columns=["key", "ts", "n", "passed"])

    def close(self) -> None:
        pass


def due(events: DataFrame, threshold: int = 10, pause: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """key, ts, n, passed: each time that the sum of a key's increments reaches the threshold; it starts anew then, whatever is over.

    events: key, ts, seq, n; an increment of 0 or less counts as none, and a threshold of 0 or less is never reached. passed is false
    within `pause` seconds of the last that passed. A batch's events are taken in the order of ts and seq. Run with ROCKS.
    """
    rows = events.select("key", "ts", "seq", "n").withWatermark("ts", late)
    kind = "key string, ts timestamp, n long, passed boolean"
    return rows.groupBy("key").transformWithStateInPandas(Fires(threshold, pause), T.StructType.fromDDL(kind), "append", "eventTime")


#: The setting that a stream with `due` starts under, as its state has timers.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.set(ROCKS[0], before)


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch of memories by slug into a stored table, of which it writes its slugs' buckets; a batch that runs again changes nothing."""

    def upsert(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["slug"])
        fresh = fresh.withColumn("updated_at", F.col("created_at")) if "updated_at" not in fresh.columns else fresh
        stored.upsert(fresh, path, "slug", upsert_memories)

    return run_available(stream, upsert, checkpoint)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a function over what has come so far, in batches that survive a restart."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
