"""Daily counters, moving windows and period reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.listing import VISIBLE, scoped
from tessera.schemas import LONG_TERM_TYPES


def increment(stats: DataFrame | None, hits: DataFrame) -> DataFrame:
    """Daily counters with hits (trigger, scope_hash, day) added; empty triggers are ignored, no scope is _global."""
    fresh = hits.where(F.coalesce("trigger", F.lit("")) != "").select("trigger", F.coalesce("scope_hash", F.lit("_global")).alias("scope_hash"), "day", F.lit(1).cast("bigint").alias("hits"))
    rows = fresh if stats is None else stats.unionByName(fresh)
    return rows.groupBy("trigger", "scope_hash", "day").agg(F.sum("hits").alias("hits"))


def _day(now: str, days: int) -> F.Column:
    return F.to_date(F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {int(days)} DAYS"))


def top_triggers(stats: DataFrame, now: str, days: int = 7, scope: str | None = None, limit: int = 10) -> DataFrame:
    """Hits since the day of the cutoff, which counts too: the most first, then by name."""
    rows = scoped(stats.where(F.col("day") >= _day(now, days)), scope)
    return rows.groupBy("trigger").agg(F.sum("hits").alias("total")).orderBy(F.desc("total"), "trigger").limit(limit)


def rising_triggers(stats: DataFrame, now: str, recent_days: int = 7, baseline_days: int = 21, scope: str | None = None, limit: int = 5) -> DataFrame:
    """Triggers with more hits in the recent days than in the baseline before them, in one pass over both windows."""
    recent, prior = _day(now, recent_days), _day(now, recent_days + baseline_days)
    rows = scoped(stats.where(F.col("day") >= prior), scope)
    sums = rows.groupBy("trigger").agg(F.sum(F.when(F.col("day") >= recent, F.col("hits")).otherwise(0)).alias("recent"), F.sum(F.when(F.col("day") < recent, F.col("hits")).otherwise(0)).alias("prior"))
    return sums.where("recent > prior").orderBy(F.desc(F.col("recent") - F.col("prior")), "trigger").limit(limit)


def with_bars(totals: DataFrame, width: int = 20) -> DataFrame:
    """Bars scaled by the largest total (one at least), which is a single broadcast row."""
    most = totals.agg(F.greatest(F.max("total"), F.lit(1)).alias("most"))
    return totals.join(F.broadcast(most)).withColumn("bar", F.repeat(F.lit("#"), F.ceil(F.col("total") * width / F.col("most")).cast("int"))).drop("most")


def month_window(year: int, month: int) -> tuple[str, str]:
    """The bounds of a month: the end is the last microsecond and one second more, exclusive."""
    following = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01 00:00:00.999999"
    return f"{year:04d}-{month:02d}-01 00:00:00", following


def month_report(memories: DataFrame, promotions: DataFrame, sensitive: DataFrame, year: int, month: int) -> DataFrame:
    """name, n: long-term memories added, memories dropped, and approved replacements in a month."""
    start, end = (F.expr(f"TIMESTAMP_NTZ '{t}'") for t in month_window(year, month))
    within = lambda c: (c >= start) & (c < end)
    open_ = ~F.coalesce("scope_sensitive", F.lit(False))
    counts = memories.where(open_).agg(
        F.count_if(F.col("type").isin(*LONG_TERM_TYPES) & within(F.col("created_at"))).alias("added"), F.count_if((F.col("decay_state") == "soft-forgotten") & within(F.coalesce("last_recalled_at", "created_at"))).alias("dropped")
    )
    replaced = (
        promotions.where((F.col("status") == "approved") & within(F.col("created_at")) & (F.size(F.from_json("proposed_supersedes", "array<string>")) > 0))
        .join(sensitive.select("scope_hash"), "scope_hash", "left_anti")
        .agg(F.count("*").alias("supersedes"))
    )
    wide = counts.join(F.broadcast(replaced))
    return wide.unpivot([], ["added", "dropped", "supersedes"], "name", "n")


def weekly_signals(memories: DataFrame, promotions: DataFrame, triggers: DataFrame, entities: DataFrame, stats: DataFrame, now: str, days: int = 7) -> DataFrame:
    """kind, item, title, detail, n: what a week's profile is written from.

    new: the 50 newest long-term memories of the window with their triggers; recurring: the 20 that are recalled most, twice at least;
    replaced: the titles of 20 approved candidates of 14 days with what they replace; entity: the 15 mentioned most in 30 days;
    trigger: the 15 top ones of the window; sources: the number of new and recurring memories. Sensitive and forgotten ones are left out.
    """
    before = lambda n: F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {int(n)} DAYS")
    long_term = memories.where(~F.coalesce("scope_sensitive", F.lit(False)) & F.col("type").isin(*LONG_TERM_TYPES)).where(VISIBLE)
    new = long_term.where(F.col("created_at") >= before(days)).orderBy(F.desc("created_at"), "slug").limit(50).select("slug", "title", "recall_count")
    # only the triggers of these few
    words = triggers.join(F.broadcast(new.select("slug")), "slug", "left_semi").groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("trigger")), ",").alias("triggers"))
    recurring = long_term.where("recall_count >= 2").orderBy(F.desc("recall_count"), F.desc_nulls_last("last_recalled_at"), "slug").limit(20)
    replaced = promotions.where((F.col("status") == "approved") & (F.col("created_at") >= before(14)) & (F.col("proposed_supersedes") != "[]")).orderBy(F.desc("created_at"), "id").limit(20)
    gone = F.from_json("proposed_supersedes", "array<string>")
    seen = entities.where(F.col("last_seen_at") >= before(30)).orderBy(F.desc("mention_count"), F.desc("last_seen_at"), "id").limit(15)
    none, n = F.lit(""), F.col("recall_count")
    rows = new.join(words, "slug", "left").select(F.lit("new").alias("kind"), F.col("slug").alias("item"), "title", F.coalesce("triggers", none).alias("detail"), n.alias("n"))
    again = recurring.select(F.lit("recurring"), "slug", "title", none, n)
    count = new.select("slug").union(recurring.select("slug")).agg(F.count("*").alias("n")).select(F.lit("sources"), none, none, none, "n")
    parts = [
        again,
        replaced.where(F.size(gone) > 0).select(F.lit("replaced"), F.col("id").cast("string"), "proposed_title", F.array_join(gone, ","), F.size(gone).cast("bigint")),
        seen.select(F.lit("entity"), "id", "name", none, "mention_count"),
        top_triggers(stats, now, days, limit=15).select(F.lit("trigger"), "trigger", none, none, "total"),
        count,
    ]
    for part in parts:
        rows = rows.union(part)
    return rows
