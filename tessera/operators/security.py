"""Sensitive scopes, grants, the gate, and the hash-chained log."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordered import before

ZERO = "0" * 64
# Seconds that a grant lasts ("task" is bound to its task alone).
GRANT_SECONDS = {"once": 90, "session": 8 * 3600, "task": 9999 * 86400}


def open_memories(memories: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Memories of scopes that aren't on the deny list."""
    return memories.join(sensitive.select("scope_hash"), "scope_hash", "left_anti")


def valid_grants(grants: DataFrame, now: str) -> DataFrame:
    return grants.where(F.col("expires_at") > F.expr(f"TIMESTAMP_NTZ '{now}'"))


def gate(requests: DataFrame, sensitive: DataFrame, grants: DataFrame, now: str) -> DataFrame:
    """requests (scope_hash, ...) with result: allow, or deny for a sensitive scope without a valid grant."""
    marked = sensitive.select("scope_hash", F.lit(True).alias("sensitive_")).distinct()
    granted = valid_grants(grants, now).select("scope_hash", F.lit(True).alias("granted_")).distinct()
    rows = requests.join(marked, "scope_hash", "left").join(granted, "scope_hash", "left")
    return rows.withColumn("result", F.when(F.col("sensitive_").isNotNull() & F.col("granted_").isNull(), "deny").otherwise("allow")).drop("sensitive_", "granted_")


@F.pandas_udf(T.StringType())
def event_hash(line: pd.Series) -> pd.Series:
    """SHA-256 of an event (JSON) without prev_hash, keys sorted, in Python's own JSON form; null for bad JSON."""

    def one(text: str) -> str | None:
        try:
            event = json.loads(text)
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(json.dumps({k: v for k, v in event.items() if k != "prev_hash"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    return line.map(one)


def _hash_before() -> Column:
    return F.when(F.col("before_").isNull(), ZERO).otherwise(F.col("before_.value"))


def broken_links(log: DataFrame) -> DataFrame:
    """log, line: the first broken line (from 1) of each log; logs that hold have no row. log: log, n, line.

    Each event's hash needs no other; only the neighbours' hashes are compared, in the order of lines. A log of any length is
    cut into blocks of lines, of which only the last hashes meet.
    """
    rows = log.where(F.trim("line") != "").select("log", "n", event_hash("line").alias("own_"), F.get_json_object("line", "$.prev_hash").alias("said_"))
    checked = before(rows, "log", "n", "own_").withColumn("wanted_", _hash_before())
    return checked.where(F.col("own_").isNull() | ~F.col("said_").eqNullSafe(F.col("wanted_"))).groupBy("log").agg(F.min("n").alias("line"))


def chained(events: DataFrame) -> DataFrame:
    """log, n, line: events (log, n, event as JSON without prev_hash) with the hash of the one before."""
    rows = before(events.withColumn("own_", event_hash("event")), "log", "n", "own_")
    line = F.concat(F.lit('{"prev_hash": "'), _hash_before(), F.lit('", '), F.substring("event", 2, 1 << 30))
    return rows.select("log", "n", line.alias("line"))


def audit_events(log: DataFrame, scope: str | None = None, kind: str | None = None, since: str | None = None) -> DataFrame:
    """n, event_type, scope_hash, ts, line of well-formed events; a bad time drops a row only if `since` is asked for."""
    rows = log.select("n", "line", F.get_json_object("line", "$.event_type").alias("event_type"), F.get_json_object("line", "$.scope_hash").alias("scope_hash"), F.get_json_object("line", "$.ts").alias("ts"))
    rows = rows.where("event_type IS NOT NULL")
    rows = rows if scope is None else rows.where(F.col("scope_hash") == scope)
    rows = rows if kind is None else rows.where(F.col("event_type") == kind)
    return rows if since is None else rows.where(F.try_to_timestamp("ts") >= F.lit(since).cast("timestamp"))


def audit_tail(log: DataFrame, limit: int = 50, scope: str | None = None, kind: str | None = None) -> DataFrame:
    """The last well-formed events of a log, the newest first."""
    return audit_events(log, scope, kind).orderBy(F.desc("n")).limit(limit)


def encrypted(df: DataFrame, column: str, key: str, aad: str = "scope_hash") -> DataFrame:
    """A text column as AES-GCM in base 64, bound to the scope. key: 32 bytes in hexadecimal."""
    return df.withColumn(column, F.expr(f"base64(aes_encrypt({column}, unhex('{key}'), 'GCM', 'DEFAULT', '', {aad}))"))


def decrypted(df: DataFrame, column: str, key: str, aad: str = "scope_hash") -> DataFrame:
    return df.withColumn(column, F.expr(f"cast(aes_decrypt(unbase64({column}), unhex('{key}'), 'GCM', 'DEFAULT', {aad}) AS string)"))


def opened(df: DataFrame, column: str, keys: DataFrame, aad: str = "scope_hash") -> DataFrame:
    """df with a text column decrypted by its scope's key (keys: scope_hash, key); where a sensitive row has no key here, the column is null."""
    joined = df.join(keys.select("scope_hash", F.col("key").alias("key_")), "scope_hash", "left")
    plain = F.expr(f"cast(try_aes_decrypt(unbase64({column}), unhex(key_), 'GCM', 'DEFAULT', {aad}) AS string)")
    return joined.withColumn(column, F.when(F.coalesce("scope_sensitive", F.lit(False)), plain).otherwise(F.col(column))).select(*df.columns)


def register_scopes(registry: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The deny list (scope_hash, scope_root, at) with scopes added (a later row replaces its hash's) and removed."""
    rows = registry.withColumn("new_", F.lit(0)).unionByName(added.withColumn("new_", F.lit(1)))
    last = rows.groupBy("scope_hash").agg(F.max(F.struct("new_", "at", "scope_root")).alias("last")).select("scope_hash", "last.scope_root", "last.at")
    return last if removed is None else last.join(removed.select("scope_hash"), "scope_hash", "left_anti")
