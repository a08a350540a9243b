"""Bundles of lists and counts for dashboards, handoffs and trends, and versions of written pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import top_entities
from tessera.operators.listing import VISIBLE, recall_hot, recent_typed
from tessera.operators.trends import rising_triggers, top_triggers


def dashboard_counts(memories: DataFrame, promotions: DataFrame, entities: DataFrame, sensitive: DataFrame, relations: DataFrame, versions: DataFrame) -> DataFrame:
    """name, n: memories, those shown, decayed and sensitive ones, scopes, pending candidates, entities, relations, profile versions and sensitive scopes."""
    wide = memories.agg(
        F.count("*").alias("memories"),
        F.count_if(F.expr(VISIBLE)).alias("shown"),
        F.count_if(F.col("decay_state") != "alive").alias("decayed"),
        F.count_if("scope_sensitive").alias("sensitive"),
        F.count_distinct("scope_hash").alias("scopes"),
    )
    rows = wide.unpivot([], wide.columns, "name", "n")
    for name, df in (("pending", promotions.where("status = 'pending'")), ("entities", entities), ("relations", relations), ("profile_versions", versions), ("sensitive_scopes", sensitive)):
        rows = rows.union(df.agg(F.count("*").alias("n")).select(F.lit(name), "n"))
    return rows


def handoff_signals(memories: DataFrame, entities: DataFrame, now: str, days: int = 14, decisions: int = 12, warnings: int = 8, sessions: int = 5, top: int = 10, scope: str | None = None) -> DataFrame:
    """kind, item, rank: the newest decisions, warnings and sessions of a window, and the entities seen in it that are mentioned most; of one scope if given."""
    parts = []
    for kind, most in (("decision", decisions), ("warning", warnings), ("session", sessions)):
        found = recent_typed(memories, kind, now, days, most, scope).select("slug", "created_at")
        rank = F.row_number().over(Window.orderBy(F.desc("created_at"), "slug"))  # of `most` rows
        parts.append(found.select(F.lit(kind).alias("kind"), F.col("slug").alias("item"), rank.alias("rank")))
    best = seen_since(entities, now, days, top, scope)
    parts.append(best.select(F.lit("entity"), "id", F.row_number().over(Window.orderBy(F.desc("mention_count"), F.desc("last_seen_at"), "id"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def seen_since(entities: DataFrame, now: str, days: int, limit: int, scope: str | None = None) -> DataFrame:
    """The entities mentioned most of those seen in the last days."""
    recent = entities.where(F.col("last_seen_at") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {int(days)} DAYS"))
    return top_entities(recent, scope=scope, limit=limit)


def trend_page(stats: DataFrame, memories: DataFrame, entities: DataFrame, now: str, days: int = 7) -> DataFrame:
    """kind, item, n: ten top triggers, eight that rise over the two windows before, the eight memories recalled most, and ten entities of four windows."""
    rows = top_triggers(stats, now, days, limit=10).select(F.lit("top").alias("kind"), F.col("trigger").alias("item"), F.col("total").alias("n"))
    rows = rows.union(rising_triggers(stats, now, days, 2 * days, limit=8).select(F.lit("rising"), "trigger", F.col("recent") - F.col("prior")))
    rows = rows.union(recall_hot(memories, limit=8).select(F.lit("hot"), "slug", "recall_count"))
    return rows.union(seen_since(entities, now, 4 * days, 10).select(F.lit("entity"), "id", "mention_count"))


def list_versions(versions: DataFrame, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Versions written from `since` up to but without `until`, by number."""
    rows = versions if since is None else versions.where(F.col("written_at") >= F.expr(f"TIMESTAMP_NTZ '{since}'"))
    rows = rows if until is None else rows.where(F.col("written_at") < F.expr(f"TIMESTAMP_NTZ '{until}'"))
    rows = rows.orderBy("version_num")
    return rows.limit(limit) if limit else rows


def newest_versions(versions: DataFrame, limit: int = 50) -> DataFrame:
    return versions.orderBy(F.desc("version_num")).limit(limit)


def version_changes(versions: DataFrame, page: str = "page", content: str = "content_md") -> DataFrame:
    """page, version_num, before, after, changed: the sizes of each version and the one before it on its page, and whether they differ."""
    by = Window.partitionBy(page).orderBy("version_num")
    rows = versions.select(page, "version_num", F.length(content).alias("after"), F.sha1(content).alias("own_"))
    rows = rows.withColumns({"before": F.lag("after").over(by), "was_": F.lag("own_").over(by)})
    return rows.select(page, "version_num", "before", "after", (~F.col("was_").eqNullSafe(F.col("own_"))).alias("changed"))


def import_by_type(imported: DataFrame, old: DataFrame) -> DataFrame:
    """type, written, skipped: imported rows (slug, type) by type; slugs that are there already are skipped."""
    known = old.select("slug", F.lit(True).alias("known_")).distinct()
    rows = imported.join(known, "slug", "left")
    return rows.groupBy("type").agg(F.count_if(F.col("known_").isNull()).alias("written"), F.count_if("known_").alias("skipped"))
