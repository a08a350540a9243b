"""Filtered lists, timelines, neighbours, pages and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered
from tessera.schemas import GLOBAL_SCOPES, MEMORY_TYPES

VISIBLE = "decay_state <> 'soft-forgotten'"


def scoped(df: DataFrame, scope: str | None) -> DataFrame:
    """Rows of a scope; a global scope (or none) is no filter."""
    return df if scope is None or scope in GLOBAL_SCOPES else df.where(F.col("scope_hash") == scope)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order that ends in a key; a sort with a limit needs no full sort."""
    return df.orderBy(*order).limit(n)


def top_of(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank from 1; groups' lists are cut map-side by Spark's group limit."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def list_by_type(memories: DataFrame, kind: str, scope: str | None = None, *, include_decayed: bool = False, limit: int = 100) -> DataFrame:
    rows = scoped(memories.where(F.col("type") == kind), scope)
    return top(rows if include_decayed else rows.where(VISIBLE), [F.desc("created_at"), F.asc("slug")], limit)


def list_memories(memories: DataFrame, fallback: DataFrame | None = None, kind: str | None = None, scope: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first; rows that only the fallback (a directory scan) has are added."""
    if fallback is not None:
        memories = memories.unionByName(fallback.join(memories, "slug", "left_anti"), allowMissingColumns=True)
    rows = scoped(memories, scope)
    return top(rows if kind is None else rows.where(F.col("type") == kind), [F.desc("created_at"), F.asc("slug")], limit)


def get_memory(memories: DataFrame, slug: str) -> DataFrame:
    return memories.where(F.col("slug") == slug)


def find_by_fingerprint(memories: DataFrame, fingerprint: Column) -> DataFrame:
    return memories.where(F.col("fingerprint") == fingerprint)


def window_days(spec: str | None) -> int:
    """Days of 30d, 2w, 6m (30 days each) or 1y (365); 30 for anything else."""
    import re

    found = re.fullmatch(r"\s*(\d+)\s*([dwmyDWMY])\s*", spec or "")
    return int(found[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[found[2].lower()] if found else 30


def timeline(memories: DataFrame, now: str, since: str = "30d", scope: str | None = None, types: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Memories of the last days, newest first; the limit is held between 1 and 500."""
    rows = scoped(memories.where(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {window_days(since)} DAYS")), scope)
    return top(rows.where(F.col("type").isin(*types)) if types else rows, [F.desc("created_at"), F.asc("slug")], max(1, min(500, limit)))


def recent_memories(memories: DataFrame, scope: str | None = None, types: tuple[str, ...] = ("decision", "preference", "fact"), limit: int = 5) -> DataFrame:
    """Newest visible memories of scopes that aren't sensitive."""
    rows = scoped(memories.where(F.col("type").isin(*types) & ~F.coalesce("scope_sensitive", F.lit(False))).where(VISIBLE), scope)
    return top(rows, [F.desc("created_at"), F.asc("slug")], limit)


def recent_typed(memories: DataFrame, kind: str, now: str, days: int, limit: int, scope: str | None = None) -> DataFrame:
    """Newest visible memories of a type in a window, but for sensitive scopes', the body without its front matter."""
    rows = memories.where((F.col("type") == kind) & (F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {int(days)} DAYS")) & ~F.coalesce("scope_sensitive", F.lit(False)))
    rows = rows.where(VISIBLE) if scope is None else rows.where(VISIBLE).where(F.col("scope_hash") == scope)
    return top(rows.withColumn("body", F.regexp_replace("body", r"(?sU)\A---.*?---\s*", "")), [F.desc("created_at"), F.asc("slug")], limit)


def paginate(df: DataFrame, order: list[Column], page: int, per_page: int = 50) -> DataFrame:
    return df.orderBy(*order).offset((max(1, page) - 1) * per_page).limit(per_page)


def neighbours(memories: DataFrame, anchors: DataFrame | None = None, n: int = 3) -> DataFrame:
    """n memories before and after each anchor (all memories without any) in its scope, strictly earlier or later: anchor, side, rank, slug.

    The nearest come first, by slug where times are equal. Memories of one scope and time have the same neighbours, so each such
    group looks up the n places before and after it in the order of its scope; no scope is read once for each anchor, nor
    is it one task's. Memories without a scope or time have no neighbours.
    """
    rows = memories.where("scope_hash IS NOT NULL AND created_at IS NOT NULL").select("slug", "scope_hash", F.col("created_at").alias("at"))
    wanted = (memories if anchors is None else anchors).select(F.col("slug").alias("anchor"), "scope_hash", F.col("created_at").alias("at"))
    if anchors is not None:
        rows = rows.join(wanted.select("scope_hash").distinct(), "scope_hash", "left_semi")
    # of a group no more than its first n are anyone's neighbours
    heads = top_of(rows, ["scope_hash", "at"], [F.asc("slug")], n).drop("rank")
    lists = []
    for side, slug, edge, step in (("before", F.desc("slug"), F.min, -1), ("after", F.asc("slug"), F.max, 1)):
        places = numbered(heads, "scope_hash", [F.asc("at"), slug], "slug").select("scope_hash", "at", "slug", "pos")
        groups = places.groupBy("scope_hash", "at").agg(edge("pos").alias("edge"))
        asked = groups.select("scope_hash", "at", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"), "edge").withColumn("pos", F.col("edge") + step * F.col("rank"))
        lists.append(asked.join(places.select("scope_hash", "pos", "slug"), ["scope_hash", "pos"]).select("scope_hash", "at", F.lit(side).alias("side"), "rank", "slug"))
    return wanted.join(lists[0].unionByName(lists[1]), ["scope_hash", "at"]).select("anchor", "side", "rank", "slug")


def top_of_scopes(memories: DataFrame, per_scope: int, limit: int) -> DataFrame:
    """The newest of each scope, joined in the order of scopes and cut once (not ranked again)."""
    rank = F.row_number().over(Window.partitionBy("scope_hash").orderBy(F.desc("created_at"), "slug"))
    return top(memories.withColumn("rank", rank).where(F.col("rank") <= per_scope), [F.asc("scope_hash"), F.asc("rank")], limit)


def stats(memories: DataFrame) -> DataFrame:
    """Counts in all, by type, by scope and by decay state in one pass: dimension, value, n."""
    dimensions = {"type": "type", "scope_hash": "scope", "decay_state": "decay"}
    of = F.lit("total")
    for column, name in dimensions.items():
        of = F.when(F.col(f"{column}_out") == 0, name).otherwise(of)
    sets = memories.groupingSets([*([F.col(c)] for c in dimensions), []], *dimensions)
    rows = sets.agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"{c}_out") for c in dimensions])
    return rows.select(of.alias("dimension"), F.coalesce(*dimensions, F.lit("")).alias("value"), "n")


def counts_by_type(memories: DataFrame, types: tuple[str, ...] = MEMORY_TYPES) -> DataFrame:
    """Counts of each type, with zeros, and the time of the last write."""
    wanted = memories.sparkSession.createDataFrame([(t,) for t in types], "type string")
    found = memories.groupBy("type").agg(F.count("*").alias("n"), F.max("updated_at").alias("last"))
    return F.broadcast(wanted).join(found, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"), "last")


def duplicates(memories: DataFrame) -> DataFrame:
    """fingerprint, n, slug: the memories of each fingerprint that two or more (n) have, a row each."""
    repeated = memories.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n >= 2")
    return memories.select("fingerprint", "slug").join(repeated, "fingerprint").select("fingerprint", "n", "slug")


def digest_counts(memories: DataFrame, promotions: DataFrame) -> DataFrame:
    """Pending candidates, repeated fingerprints and decayed memories: name, n."""
    pending = promotions.agg(F.count_if(F.col("status") == "pending").alias("n")).select(F.lit("pending").alias("name"), "n")
    repeated = memories.groupBy("fingerprint").count().agg(F.count_if(F.col("count") >= 2).alias("n")).select(F.lit("duplicates").alias("name"), "n")
    decayed = memories.agg(F.count_if(F.col("decay_state").isin("dim", "soft-forgotten")).alias("n")).select(F.lit("decayed").alias("name"), "n")
    return pending.unionByName(repeated).unionByName(decayed)


def decayed(memories: DataFrame) -> DataFrame:
    """Decayed memories, those never recalled first."""
    return memories.where(F.col("decay_state").isin("dim", "soft-forgotten")).orderBy(F.asc_nulls_first("last_recalled_at"), "slug")


def recall_hot(memories: DataFrame, least: int = 2, limit: int = 5) -> DataFrame:
    rows = memories.where((F.col("recall_count") >= least) & (F.col("type") != "session") & ~F.coalesce("scope_sensitive", F.lit(False))).where(VISIBLE)
    return top(rows, [F.desc("recall_count"), F.desc_nulls_last("last_recalled_at"), F.asc("slug")], limit)


def backfill_candidates(memories: DataFrame, promotions: DataFrame) -> DataFrame:
    """Sessions that no candidate comes from."""
    return memories.where("type = 'session'").join(promotions.select(F.col("source_session_slug").alias("slug")), "slug", "left_anti")


def resolve_slug(files: DataFrame) -> DataFrame:
    """Of the files of a slug, the plain one before the encrypted: slug, path."""
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.col("path").endswith(".enc"), "path"))
    return files.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def wanted_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The wanted columns that the table has."""
    return df.select(*[c for c in names if c in df.columns])


def last_turns(turns: DataFrame, most: int = 8, clip: int = 6000) -> DataFrame:
    """The newest user and assistant turns of five characters or more of each conversation, the assistant's clipped."""
    rows = turns.where(F.col("role").isin("user", "assistant") & (F.length(F.trim("text")) >= 5))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    clipped = F.when(F.col("role") == "assistant", F.substring("text", 1, clip)).otherwise(F.col("text"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("text", clipped)


def transcript(turns: DataFrame, most: int = 8000) -> DataFrame:
    """conv_id, body: the turns as '**role**: text' joined by blank lines, cut at `most` characters."""
    # a line has nine characters at least with what parts it from the next, so that later turns can't be in reach
    near = top_of(turns.where(F.col("text") != ""), ["conv_id"], [F.asc("turn")], most // 8 + 1)
    lines = near.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), F.coalesce("role", F.lit("?")), F.lit("**: "), F.col("text")).alias("line")))).alias("rows"))
    return lines.select("conv_id", F.substring(F.array_join(F.col("rows.line"), "\n\n"), 1, most).alias("body"))
