"""Diffs, merges and mirrors between two copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALARS = ("content", "content_hash", "memory_type", "scope", "source", "decay_state", "sensitive")
LISTS = ("tags", "entities", "supersedes", "superseded_by")
SPILL_BYTES = 5 << 20


def diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """id, status of each remote entry: new, unchanged, update (the remote is newer) or conflict."""
    own = local.select("id", F.col("content_hash").alias("own_hash"), F.col("updated_at").alias("own_time"))
    status = F.when(F.col("own_time").isNull(), "new").when(F.col("content_hash") == F.col("own_hash"), "unchanged").when(F.col("updated_at") > F.col("own_time"), "update").otherwise("conflict")
    return remote.join(own, "id", "left").select("id", status.alias("status"))


def union_lists(a: Column, b: Column) -> Column:
    """Both lists' items, each once, in the order of their first."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def union_relations(a: Column, b: Column) -> Column:
    """Relations by (subject_id, predicate, object_id): the place of the first, the values (of any other fields) of the last."""
    nothing = lambda x: F.filter(x, lambda _: F.lit(False))
    both = F.concat(F.coalesce(a, nothing(b)), F.coalesce(b, nothing(a)))
    key = lambda r: F.struct(r["subject_id"], r["predicate"], r["object_id"])
    last = lambda k: F.element_at(F.filter(both, lambda r: key(r) == k), -1)
    return F.transform(F.array_distinct(F.transform(both, key)), last)


def field_winners(audit: DataFrame) -> DataFrame:
    """target_id, field, value, seq, has_value: the last write of each field in the order of the log.

    audit: seq, ts, action, target_id, changed_fields, after (a map).
    """
    rows = audit.where(F.col("action").isin("create", "update", "merge") & F.col("target_id").isNotNull())
    fields = rows.select("target_id", "seq", "ts", "after", F.explode(F.when(F.size("changed_fields") > 0, F.col("changed_fields")).otherwise(F.map_keys("after"))).alias("field"))
    last = fields.groupBy("target_id", "field").agg(F.max_by(F.struct("seq", F.element_at("after", F.col("field")).alias("value"), F.map_contains_key("after", F.col("field")).alias("has_value")), F.struct("seq", "ts")).alias("w"))
    return last.select("target_id", "field", "w.*")


def merge_entries(local: DataFrame, remote: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Entries of both sides by id. Fields that differ take the audit log's last value, else the later side's (the remote's if equal).

    updated_at is the later, created_at the earlier; lists are joined; a differing content leaves a note. Entries that one side alone has stay.
    """
    columns = [c for c in local.columns if c != "id"]
    scalars = [c for c in columns if c in SCALARS]
    left, right = local.select("id", *[F.col(c).alias(f"l_{c}") for c in columns]), remote.select("id", *[F.col(c).alias(f"r_{c}") for c in columns])
    rows = left.join(right, "id", "full_outer")
    if audit is not None:
        wins = field_winners(audit).where(F.col("field").isin(*scalars)).groupBy(F.col("target_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("seq", "value", "has_value")))).alias("wins"))
        rows = rows.join(wins, "id", "left")
    one = F.col("l_updated_at").isNull() | F.col("r_updated_at").isNull()
    later = F.col("r_updated_at") >= F.col("l_updated_at")

    def pick(c: str) -> Column:
        mine, theirs = F.col(f"l_{c}"), F.col(f"r_{c}")
        value = F.when(later, theirs).otherwise(mine)
        if audit is not None:
            win = F.element_at("wins", F.lit(c))
            value = F.when(F.coalesce(win["has_value"], F.lit(False)), win["value"].cast(local.schema[c].dataType)).otherwise(value)
        return F.when(one, F.coalesce(mine, theirs)).when(mine.eqNullSafe(theirs), mine).otherwise(value).alias(c)

    hashed = "content" if "content" in columns else "content_hash"
    differs = ~one & ~F.col(f"l_{hashed}").eqNullSafe(F.col(f"r_{hashed}"))
    note = F.concat(F.lit("content-conflict: kept "), F.when(later, "remote").otherwise("local"), F.lit(" (local_updated_at="), F.col("l_updated_at").cast("string"), F.lit(", remote_updated_at="), F.col("r_updated_at").cast("string"), F.lit(")"))
    if audit is not None:
        seq = F.element_at("wins", F.lit("content"))["seq"]
        note = F.when(seq.isNotNull(), F.concat(F.lit("content-conflict: audit seq="), seq.cast("string"), F.lit(" decided"))).otherwise(note)
    out = [F.col("id"), *[pick(c) for c in scalars], F.least("l_created_at", "r_created_at").alias("created_at"), F.greatest("l_updated_at", "r_updated_at").alias("updated_at")]
    out += [union_lists(F.col(f"l_{c}"), F.col(f"r_{c}")).alias(c) for c in LISTS if c in columns]
    if "relations" in columns:
        out.append(union_relations(F.col("l_relations"), F.col("r_relations")).alias("relations"))
    return rows.select(*out, F.when(differs, F.array(note)).otherwise(F.array().cast("array<string>")).alias("merge_notes"))


def import_bundle(local: DataFrame, remote: DataFrame, strategy: str = "merge") -> DataFrame:
    """id, action of each remote entry under merge, prefer-local, prefer-remote or ask."""
    after = {"merge": "merged", "prefer-local": "skipped", "prefer-remote": "replaced", "ask": "pending"}[strategy]
    status = diff(local, remote)
    return status.select("id", F.when(F.col("status") == "new", "imported").when(F.col("status") == "unchanged", "unchanged").otherwise(after).alias("action"))


def export_actions(files: DataFrame, state: DataFrame) -> DataFrame:
    """key, action: copy files whose fingerprint isn't that of the state."""
    known = state.select("key", F.col("fingerprint").alias("known"))
    return files.join(known, "key", "left").select("key", F.when(F.col("fingerprint").eqNullSafe(F.col("known")), "skip").otherwise("copy").alias("action"))


def import_actions(files: DataFrame, remote: DataFrame) -> DataFrame:
    """key, action of each remote file: copy a new one, skip an equal one, and back up the local and take the remote of any other."""
    own = files.select("key", F.col("fingerprint").alias("own"))
    return remote.join(own, "key", "left").select("key", F.when(F.col("own").isNull(), "copy").when(F.col("own") == F.col("fingerprint"), "skip").otherwise("conflict").alias("action"))


def status(files: DataFrame, remote: DataFrame) -> DataFrame:
    """scope, local, remote, differing: files of each scope on both sides."""
    rows = files.select("key", F.col("fingerprint").alias("l")).join(remote.select("key", F.col("fingerprint").alias("r")), "key", "full_outer").where(~F.col("key").startswith("_conflicts/"))
    return rows.groupBy(F.split("key", "/")[1].alias("scope")).agg(F.count("l").alias("local"), F.count("r").alias("remote"), F.count_if(F.col("l") != F.col("r")).alias("differing"))


def export_bundle(entries: DataFrame, spill: int = SPILL_BYTES) -> DataFrame:
    """id, line: each entry as JSON; contents over `spill` bytes are named by their hash in place of the text."""
    big = F.octet_length("content") > spill
    spilled = entries.withColumns({"content_ref": F.when(big, F.concat(F.lit("chunks/"), F.sha2("content", 256))), "content": F.when(~big, F.col("content"))})
    return spilled.select("id", F.to_json(F.struct(*spilled.columns)).alias("line"))


def local_entries(entries: DataFrame, local: DataFrame, landing: DataFrame) -> DataFrame:
    """id, content_hash, found_in: what a bundle's entries meet: the own entry, else one that an earlier import left in the landing table."""
    own = local.select("id", F.struct("content_hash").alias("own_"))
    other = landing.select("id", F.struct("content_hash").alias("landed_"))
    rows = entries.select("id").join(own, "id", "left").join(other, "id", "left")
    where = F.when(F.col("own_").isNotNull(), "memories").when(F.col("landed_").isNotNull(), "landing")
    return rows.select("id", F.coalesce("own_", "landed_")["content_hash"].alias("content_hash"), where.alias("found_in"))


def imported(local: DataFrame, landing: DataFrame, remote: DataFrame, strategy: str = "merge", audit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The landing table after an import under a strategy, and counts: imported, conflicts_resolved, merged, skipped.

    An entry meets the own one of its id, else one that landed before. New ones land under all strategies. Of the others prefer-local
    lands none, prefer-remote all, ask all with the note pending-user-decision, and merge those whose fields, joined with the
    help of the audit log, have other content or tags than the own. What lands replaces what had landed under its id. All sides have
    the columns of remote, with merge_notes.
    """
    columns = remote.columns
    hashed = "content" if "content" in columns else "content_hash"
    twins = local.unionByName(landing.join(local.select("id"), "id", "left_anti")).select(*columns)
    new = remote.join(twins.select("id"), "id", "left_anti")
    met = remote.join(twins.select("id"), "id", "left_semi")
    none = F.array().cast("array<string>")
    if strategy == "prefer-local":
        changed = met.limit(0)
    elif strategy == "prefer-remote":
        changed = met
    elif strategy == "ask":
        changed = met.withColumn("merge_notes", F.concat(F.coalesce("merge_notes", none), F.array(F.lit("pending-user-decision"))))
    elif strategy == "merge":
        own = twins.select("id", F.struct(F.col(hashed).alias("value"), "tags").alias("own_"))
        joined = merge_entries(twins.join(met.select("id"), "id", "left_semi"), met, audit).join(own, "id")
        same = F.col(hashed).eqNullSafe(F.col("own_.value")) & F.col("tags").eqNullSafe(F.col("own_.tags"))
        rest = [c for c in columns if c not in joined.columns]
        changed = joined.where(~same).select(*joined.columns).join(met.select("id", *rest), "id").select(*columns)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    fresh = new.unionByName(changed)
    after = landing.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
    n = new.agg(F.count("*").alias("imported")).crossJoin(changed.agg(F.count("*").alias("changed"))).crossJoin(met.agg(F.count("*").alias("met")))  # one row each
    merged = F.col("changed") if strategy == "merge" else F.lit(0).cast("bigint")
    return after, n.select("imported", F.col("changed").alias("conflicts_resolved"), merged.alias("merged"), (F.col("met") - F.col("changed")).alias("skipped"))
