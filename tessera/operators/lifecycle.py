"""Decay, recall, duplicates, candidates and their promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.listing import scoped
from tessera.schemas import SCORE_KEYS

#: Days after the TTL, since the last touch of a dim memory, and since that of a soft-forgotten one.
AFTER_TTL, AFTER_DIM, AFTER_FORGOTTEN = 0, 30, 90
APPROVE, REJECT, GATE = 0.85, 0.5, 0.6


def age_days(now: str, touched: Column) -> Column:
    """Days as a fraction; a missing time is endlessly old."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return F.coalesce((seconds(F.expr(f"TIMESTAMP_NTZ '{now}'")) - seconds(touched)) / 86400.0, F.lit(float("inf")))


def decay_sweep(memories: DataFrame, now: str) -> DataFrame:
    """memories with action: to_dim, to_soft_forgotten, to_forgotten_dir or null; one step a sweep, all bounds exclusive."""
    age = age_days(now, F.coalesce("last_recalled_at", "created_at"))
    state = F.col("decay_state")
    action = (
        F.when((state == "alive") & F.col("ttl_days").isNotNull() & (age > F.col("ttl_days") + AFTER_TTL), "to_dim")
        .when((state == "dim") & (age > AFTER_DIM), "to_soft_forgotten")
        .when((state == "soft-forgotten") & (age > AFTER_FORGOTTEN), "to_forgotten_dir")
    )
    return memories.withColumn("action", action)


def swept(memories: DataFrame, now: str) -> DataFrame:
    """The table after a sweep: states and the paths of moved files."""
    file = F.substring_index("body_path", "/", -1)
    return (
        decay_sweep(memories, now)
        .withColumn("decay_state", F.when(F.col("action") == "to_dim", "dim").when(F.col("action") == "to_soft_forgotten", "soft-forgotten").otherwise(F.col("decay_state")))
        .withColumn("body_path", F.when(F.col("action") == "to_forgotten_dir", F.concat_ws("/", F.lit("scopes"), "scope_hash", F.lit("forgotten"), file)).otherwise(F.col("body_path")))
        .drop("action")
    )


def decay_counts(memories: DataFrame, now: str) -> DataFrame:
    return decay_sweep(memories, now).where("action IS NOT NULL").groupBy("action").agg(F.count("*").alias("n"))


def record_recall(memories: DataFrame, hits: DataFrame, *, revive: bool = False) -> DataFrame:
    """Add hits (slug, at) to counts and last times; states change only if asked for."""
    delta = hits.groupBy("slug").agg(F.count("*").alias("n_"), F.max("at").alias("at_"))
    joined = memories.join(delta, "slug", "left")
    out = joined.withColumns({"recall_count": F.col("recall_count") + F.coalesce("n_", F.lit(0)), "last_recalled_at": F.greatest("last_recalled_at", "at_")})
    if revive:
        out = out.withColumn("decay_state", F.when(F.col("n_").isNotNull(), "alive").otherwise(F.col("decay_state")))
    return out.select(*memories.columns)


def merge_duplicates(memories: DataFrame, merges: DataFrame) -> DataFrame:
    """The sections of memories after merges (keep, drop, pos): slug, pos, merged_from, section.

    A memory's own body is at 0 (merged_from null), those merged into it follow at their pos; dropped memories have no row of their
    own, and missing slugs are ignored. Sections stay rows, as one fingerprint may have any number of copies;
    `merged_bodies` puts together those that a writer needs.
    """
    kept = memories.join(merges.select(F.col("drop").alias("slug")).distinct(), "slug", "left_anti")
    own = kept.select("slug", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("merged_from"), F.col("body").alias("section"))
    dropped = merges.join(memories.select(F.col("slug").alias("drop"), "body"), "drop").join(kept.select(F.col("slug").alias("keep")), "keep", "left_semi")
    return own.unionByName(dropped.select(F.col("keep").alias("slug"), F.col("pos").cast("bigint").alias("pos"), F.col("drop").alias("merged_from"), F.col("body").alias("section")))


def merged_bodies(sections: DataFrame) -> DataFrame:
    """slug, body of files to be written: sections of merge_duplicates in order, those merged in under '## merged-from <slug>'."""
    body = F.coalesce("section", F.lit(""))
    own = F.regexp_replace(body, r"(?U)\s+$", "")
    text = F.when(F.col("merged_from").isNull(), own).otherwise(F.concat(F.lit("\n\n\n## merged-from "), "merged_from", F.lit("\n\n"), body))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "merged_from", text.alias("text"))))
    return sections.groupBy("slug").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "").alias("body"))


def merge_triggers(triggers: DataFrame, merges: DataFrame) -> DataFrame:
    """Triggers after a merge: those of dropped slugs go to the kept one, once."""
    moved = triggers.join(merges.select(F.col("drop").alias("slug"), "keep"), "slug", "left")
    return moved.select(F.coalesce("keep", "slug").alias("slug"), "trigger").distinct()


def numeric_scores(score: Column) -> Column:
    """The numbers of a JSON object of scores; values of other kinds (and bad JSON) are left out one by one."""
    fields = F.from_json(score, "map<string,string>")
    return F.filter(F.transform(F.map_values(fields), lambda v: v.try_cast("double")), lambda v: v.isNotNull())


def score_mean(score: Column) -> Column:
    """Their mean; null without any."""
    numbers = numeric_scores(score)
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(numbers), F.lit(0))


def gated(score: Column, gate: float = GATE) -> Column:
    """All four of the scores are there and at least the gate."""
    fields = F.from_json(score, "map<string,string>")
    ok = F.lit(True)
    for key in SCORE_KEYS:
        ok = ok & F.coalesce(F.element_at(fields, F.lit(key)).try_cast("double") >= gate, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def parse_candidates(raw: DataFrame, column: str = "raw", gate: float = GATE) -> DataFrame:
    """Candidates of model answers: the JSON array in each (fenced or embedded) is unnested, and gated by its scores."""
    item = "array<struct<type:string,title:string,body:string,triggers:array<string>,dura:string,score:string,reasoning:string,supersedes:array<string>>>"
    array = F.regexp_extract(column, r"(?s)\[.*\]", 0)
    rows = raw.select("*", F.explode(F.from_json(array, item)).alias("candidate")).select(*raw.columns, "candidate.*")
    return rows.withColumn("score", F.coalesce("score", "dura")).drop("dura").where(gated(F.col("score"), gate))


def with_status(candidates: DataFrame, score: str = "dura_score", approve: float = APPROVE, reject: float = REJECT) -> DataFrame:
    """mean and band: approved, rejected or pending by the mean."""
    mean = score_mean(F.col(score))
    return candidates.withColumn("mean", mean).withColumn("band", F.when(F.col("mean") >= approve, "approved").when(F.col("mean") < reject, "rejected").otherwise("pending"))


def insert_promotions(candidates: DataFrame, now: str) -> DataFrame:
    """Clipped candidates with their status; auto-approved ones are decided now."""
    rows = with_status(candidates)
    return rows.select(
        *[c for c in candidates.columns if c not in ("proposed_title", "proposed_body", "reasoning", "status", "decided_at")],
        F.substring("proposed_title", 1, 200).alias("proposed_title"),
        *[F.substring(c, 1, n).alias(c) for c, n in (("proposed_body", 5000), ("reasoning", 500)) if c in candidates.columns],
        F.col("band").alias("status"),
        F.when(F.col("band") == "approved", F.expr(f"TIMESTAMP_NTZ '{now}'")).alias("decided_at"),
    )


def decide(promotions: DataFrame, ids: DataFrame, status: str, now: str | None = None) -> DataFrame:
    """Set the status of pending candidates; only a rejection by tool (with `now`) sets the time."""
    chosen = promotions.join(ids.select("id", F.lit(True).alias("hit_")), "id", "left")
    hit = F.coalesce("hit_", F.lit(False)) & (F.col("status") == "pending")
    out = chosen.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    if now and "decided_at" in promotions.columns:
        out = out.withColumn("decided_at", F.when(hit, F.expr(f"TIMESTAMP_NTZ '{now}'")).otherwise(F.col("decided_at")))
    return out.select(*promotions.columns)


def promoted_memories(promotions: DataFrame) -> DataFrame:
    """The long-term memories of approved candidates: promoted-<id>-<source>, without TTL."""
    return promotions.where("status = 'approved'").select(
        F.concat(F.lit("promoted-"), F.col("id"), F.lit("-"), F.col("source_session_slug")).alias("slug"), F.col("proposed_type").alias("type"), "scope_hash", F.col("proposed_title").alias("title"), F.lit("alive").alias("decay_state"), "created_at"
    )


def review_pending(promotions: DataFrame, low: float = 0.0, high: float = 1.0, types: tuple[str, ...] = (), limit: int = 20, scope: str | None = None) -> DataFrame:
    """Pending candidates of a scope (a global one: of all) with a mean in a range, the lowest first."""
    rows = with_status(scoped(promotions.where("status = 'pending'"), scope)).withColumn("mean", F.bround("mean", 3)).where(F.col("mean").between(low, high))
    rows = rows.where(F.col("proposed_type").isin(*types)) if types else rows
    return rows.orderBy("mean", "id").limit(limit)


def grey_zone(promotions: DataFrame, newest: int = 200, limit: int = 5) -> DataFrame:
    """Of the newest pending candidates, those with the lowest mean."""
    recent = promotions.where("status = 'pending'").orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    return recent.withColumn("mean", F.bround(score_mean(F.col("dura_score")), 3)).orderBy("mean", "id").limit(limit)


def upsert_memories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newer rows replace those of their slug; created_at and recall counts of the old row stay."""
    both = old.withColumn("rank_", F.lit(0)).unionByName(new.withColumn("rank_", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy("slug").orderBy(F.desc("rank_"), F.desc_nulls_last("updated_at"))
    first = Window.partitionBy("slug").orderBy("rank_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = {c: F.first(c, ignorenulls=True).over(first) for c in ("created_at", "recall_count", "last_recalled_at") if c in old.columns}
    return both.withColumns(kept).withColumn("n_", F.row_number().over(latest)).where("n_ = 1").select(*old.columns)


def delete_memories(slugs: DataFrame, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Tables without the rows of the slugs: (memories, 'slug'), (triggers, 'slug'), (promotions, 'source_session_slug')."""
    return [t.join(slugs.select(F.col("slug").alias(c)), c, "left_anti") for t, c in tables]


def retag_scope(memories: DataFrame, old: str, new: str) -> DataFrame:
    """Memories with a scope merged into another."""
    return memories.withColumn("scope_hash", F.when(F.col("scope_hash") == old, new).otherwise(F.col("scope_hash")))


def mark_sensitive(memories: DataFrame, scopes: DataFrame) -> DataFrame:
    """The flag and the .enc path of memories in sensitive scopes; others are plain."""
    joined = memories.join(scopes.select("scope_hash", F.lit(True).alias("hit_")).distinct(), "scope_hash", "left")
    plain = F.regexp_replace("body_path", r"\.enc$", "")
    hit = F.coalesce("hit_", F.lit(False))
    return joined.withColumn("body_path", F.when(hit, F.concat(plain, F.lit(".enc"))).otherwise(plain)).withColumn("scope_sensitive", hit).select(*memories.columns)


def list_promotions(promotions: DataFrame, sensitive: DataFrame, granted: DataFrame | None = None, status: str | None = "pending", scope: str | None = None, limit: int = 50) -> DataFrame:
    """Candidates of a status and scope, the newest first; those of sensitive scopes only where they are granted."""
    rows = promotions if status is None else promotions.where(F.col("status") == status)
    rows = rows if scope is None else rows.where(F.col("scope_hash") == scope)
    hidden = sensitive.select("scope_hash") if granted is None else sensitive.select("scope_hash").join(granted.select("scope_hash"), "scope_hash", "left_anti")
    return rows.join(hidden, "scope_hash", "left_anti").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def list_pending(promotions: DataFrame, limit: int = 200) -> DataFrame:
    """Pending candidates by id, the last first."""
    return promotions.where("status = 'pending'").orderBy(F.desc("id")).limit(limit)
