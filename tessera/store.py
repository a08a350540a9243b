"""The tools of a memory store as methods over DataFrames: each returns a result envelope, and writes make new tables.

Writes are lazy: a store is a set of DataFrames, and saving it is the caller's (see sources.sinks). Results of tools are bounded
lists, so that their rows may be collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import graph, lifecycle, listing, search, security
from tessera.schemas import LONG_TERM_TYPES, MEMORY, MEMORY_TYPES


def ok(**values: Any) -> dict[str, Any]:
    return {"ok": True, **values}


def failed(code: str, message: str) -> dict[str, Any]:
    return {"ok": False, "error": {"code": code, "message": message}}


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.collect()]


@dataclass(frozen=True)
class MemoryStore:
    """memories, triggers (slug, trigger), promotions, relations, vectors, sensitive scopes (scope_hash), grants (scope_hash, expires_at) and prompts (name, content)."""

    memories: DataFrame
    triggers: DataFrame | None = None
    promotions: DataFrame | None = None
    relations: DataFrame | None = None
    vectors: DataFrame | None = None
    sensitive: DataFrame | None = None
    grants: DataFrame | None = None
    prompts: DataFrame | None = None

    def _gated(self, scope: str | None, now: str) -> dict | None:
        """A refusal if the scope is sensitive and no grant holds now."""
        if self.sensitive is None or scope is None:
            return None
        spark = self.memories.sparkSession
        grants = self.grants if self.grants is not None else spark.createDataFrame([], "scope_hash string, expires_at timestamp_ntz")
        asked = spark.createDataFrame([(scope,)], "scope_hash string")
        denied = security.gate(asked, self.sensitive, grants, now).first().result == "deny"
        return failed("authorization_required", f"scope {scope} is sensitive and not granted") if denied else None

    # writes

    def mem_save(self, *, title: str = "", body: str, kind: str, scope_hash: str, now: str, ttl_days: int | None = None, triggers: tuple[str, ...] = ()) -> tuple[MemoryStore, dict]:
        """A new memory; the title is the first line that isn't blank, and a session without a TTL has one of 7 days."""
        if kind not in MEMORY_TYPES:
            return self, failed("invalid_type", kind)
        title = title or next((x.strip()[:80] for x in body.split("\n") if x.strip()), "untitled")
        spark = self.memories.sparkSession
        at = F.expr(f"TIMESTAMP_NTZ '{now}'")
        row = spark.range(1).select(F.lit(title).alias("title"), F.lit(body).alias("body"), at.alias("created_at"), at.alias("updated_at"))
        ttl = ttl_days if ttl_days is not None else 7 if kind == "session" else None
        row = row.withColumns({"slug": ids.dated_slug(F.col("title"), F.col("created_at")), "type": F.lit(kind), "scope_hash": F.lit(scope_hash), "source": F.lit("tool"), "ttl_days": F.lit(ttl).cast("int"), "decay_state": F.lit("alive"), "last_recalled_at": F.lit(None).cast("timestamp_ntz"), "recall_count": F.lit(0).cast("bigint"), "fingerprint": ids.fingerprint(F.col("body")), "scope_sensitive": F.lit(False)})
        row = row.withColumn("body_path", F.concat_ws("/", F.lit("scopes"), "scope_hash", "type", F.concat("slug", F.lit(".md"))))
        row = row.select(*[F.col(f.name).cast(f.dataType) for f in MEMORY.fields])
        slug = row.first().slug
        return self._with(row.withColumn("slug", F.lit(slug)), triggers), ok(slug=slug)

    def _with(self, rows: DataFrame, triggers: tuple[str, ...] = ()) -> MemoryStore:
        memories = lifecycle.upsert_memories(self.memories, rows)
        if self.triggers is None or not triggers:
            return replace(self, memories=memories)
        words = rows.select("slug", F.explode(F.array(*[F.lit(t) for t in triggers])).alias("trigger"))
        return replace(self, memories=memories, triggers=self.triggers.join(rows.select("slug"), "slug", "left_anti").unionByName(words))

    def mem_update(self, slug: str, now: str, **patch: Any) -> tuple[MemoryStore, dict]:
        """The fields given replace the old ones."""
        if self.memories.where(F.col("slug") == slug).isEmpty():
            return self, failed("not_found", slug)
        hit = F.col("slug") == slug
        changes = {c: F.when(hit, F.lit(v).cast(self.memories.schema[c].dataType)).otherwise(F.col(c)) for c, v in patch.items() if v is not None and c in self.memories.columns}
        changes["updated_at"] = F.when(hit, F.expr(f"TIMESTAMP_NTZ '{now}'")).otherwise(F.col("updated_at"))
        memories = self.memories.withColumns(changes)
        if "body" in patch:
            memories = memories.withColumn("fingerprint", F.when(hit, ids.fingerprint(F.col("body"))).otherwise(F.col("fingerprint")))
        return replace(self, memories=memories), ok(slug=slug)

    def mem_delete(self, slug: str) -> tuple[MemoryStore, dict]:
        """The memory with its triggers and candidates."""
        gone = self.memories.where(F.col("slug") == slug).select("slug")
        if gone.isEmpty():
            return self, failed("not_found", slug)
        anti = lambda t, c: None if t is None else t.where(F.col(c) != slug)
        return replace(self, memories=anti(self.memories, "slug"), triggers=anti(self.triggers, "slug"), promotions=anti(self.promotions, "source_session_slug")), ok(slug=slug)

    def mem_capture_passive(self, *, title: str, body: str, kind: str, scope_hash: str, now: str) -> tuple[MemoryStore, dict]:
        """A long-term memory; sessions are refused."""
        if kind not in LONG_TERM_TYPES:
            return self, failed("invalid_type", kind)
        return self.mem_save(title=title, body=body, kind=kind, scope_hash=scope_hash, now=now)

    def mem_session_start(self, *, title: str, scope_hash: str, now: str) -> tuple[MemoryStore, dict]:
        return self.mem_save(title=title, body=f"# {title}\n", kind="session", scope_hash=scope_hash, now=now)

    def mem_session_end(self, slug: str, summary: str, now: str) -> tuple[MemoryStore, dict]:
        """A closing block after the body."""
        row = self.memories.where((F.col("slug") == slug) & (F.col("type") == "session")).first()
        if row is None:
            return self, failed("not_found", slug)
        return self.mem_update(slug, now, body=f"{row.body or ''}\n\n## Session end\n\n{summary}\n")

    def mem_promote(self, ids_: list[int], now: str, *, auto_high: bool = False, threshold: float = 0.85) -> tuple[MemoryStore, dict]:
        """Approve candidates, or all pending ones with a mean of the threshold or more; their memories are added."""
        wanted = self.promotions.where(F.col("id").isin(ids_))
        if auto_high:
            wanted = lifecycle.with_status(self.promotions.where("status = 'pending'")).where(F.col("mean") >= threshold)
        wanted = wanted.where("status = 'pending'").select("id")
        decided = lifecycle.decide(self.promotions, wanted, "approved")
        made = lifecycle.promoted_memories(decided.join(wanted, "id", "left_semi"))
        return replace(self, promotions=decided, memories=self.memories.unionByName(made, allowMissingColumns=True)), ok(approved=[r.id for r in wanted.collect()])

    def mem_reject(self, ids_: list[int], now: str) -> tuple[MemoryStore, dict]:
        wanted = self.promotions.where(F.col("id").isin(ids_)).select("id")
        return replace(self, promotions=lifecycle.decide(self.promotions, wanted, "rejected", now)), ok(rejected=ids_)

    def mem_merge_projects(self, old: str, new: str, *, dry_run: bool = True) -> tuple[MemoryStore, dict]:
        """Memories of one scope given to another; a dry run shows twenty."""
        moved = self.memories.where(F.col("scope_hash") == old)
        told = ok(count=moved.count(), preview=[r.slug for r in moved.orderBy("slug").limit(20).collect()], dry_run=dry_run)
        return (self if dry_run else replace(self, memories=lifecycle.retag_scope(self.memories, old, new))), told

    def record_long_term(self, *, kind: str, title: str, body: str, triggers: tuple[str, ...], scope_hash: str, now: str) -> tuple[MemoryStore, dict]:
        """A long-term memory that was told as such, without a candidate."""
        if refused := self._gated(scope_hash, now):
            return self, refused
        if kind not in LONG_TERM_TYPES:
            return self, failed("invalid_type", kind)
        store, told = self.mem_save(title=title, body=body, kind=kind, scope_hash=scope_hash, now=now, triggers=triggers)
        return store, told | {"type": kind, "title": title}

    def promote_to_long_term(self, session_slug: str, *, kind: str, title: str, now: str, body: str | None = None, triggers: tuple[str, ...] | None = None, reason: str = "") -> tuple[MemoryStore, dict]:
        """A long-term memory from a memory at hand: its body (5,000 characters at most) and triggers unless others are given."""
        if kind not in LONG_TERM_TYPES:
            return self, failed("invalid_type", kind)
        row = listing.get_memory(self.memories, session_slug).first()
        if row is None:
            return self, failed("not_found", session_slug)
        if refused := self._gated(row.scope_hash, now):
            return self, refused
        if triggers is None:
            own = [] if self.triggers is None else self.triggers.where(F.col("slug") == session_slug).collect()
            triggers = tuple(sorted(r.trigger for r in own))
        store, told = self.mem_save(title=title, body=(row.body or "")[:5000] if body is None else body, kind=kind, scope_hash=row.scope_hash, now=now, triggers=triggers)
        return store, told | {"promoted_from": session_slug, "reason": reason}

    def merge_duplicates(self, keep: str, drops: list[str], now: str) -> tuple[MemoryStore, dict]:
        """Bodies of the dropped memories are put after the kept one's, and triggers joined; from a sensitive scope none of another may come."""
        row = listing.get_memory(self.memories, keep).first()
        if row is None:
            return self, failed("not_found", keep)
        if refused := self._gated(row.scope_hash, now):
            return self, refused
        spark = self.memories.sparkSession
        there = self.memories.where(F.col("slug").isin(drops) & (F.col("slug") != keep))
        hidden = self.sensitive is not None and not self.sensitive.where(F.col("scope_hash") == row.scope_hash).isEmpty()
        if hidden and not there.where(F.col("scope_hash") != row.scope_hash).isEmpty():
            return self, failed("cross_scope", f"memories of other scopes can't be merged into {keep}")
        known = {r.slug for r in there.select("slug").collect()}
        order = [d for d in dict.fromkeys(drops) if d in known]
        merges = spark.createDataFrame([(keep, d, i) for i, d in enumerate(order, 1)], "keep string, drop string, pos long")
        sections = lifecycle.merge_duplicates(self.memories.where(F.col("slug").isin([keep, *order])), merges)
        whole = lifecycle.merged_bodies(sections).select("slug", F.col("body").alias("whole_"))
        left = self.memories.join(merges.select(F.col("drop").alias("slug")), "slug", "left_anti").join(F.broadcast(whole), "slug", "left")
        memories = left.withColumn("body", F.coalesce("whole_", "body")).select(*self.memories.columns)
        triggers = None if self.triggers is None else lifecycle.merge_triggers(self.triggers, merges)
        return replace(self, memories=memories, triggers=triggers), ok(kept=keep, dropped=drops)

    def mem_save_prompt(self, name: str, content: str) -> tuple[MemoryStore, dict]:
        """A prompt under a name of letters, digits, _ and -; one that is there is replaced."""
        if not name.strip() or not content.strip():
            return self, failed("invalid_argument", "name and content are required")
        safe = re.sub(r"[^A-Za-z0-9_-]", "_", name.strip())[:60]
        row = self.memories.sparkSession.createDataFrame([(safe, content)], "name string, content string")
        prompts = row if self.prompts is None else self.prompts.where(F.col("name") != safe).unionByName(row)
        return replace(self, prompts=prompts), ok(name=safe, bytes=len(content.encode()))

    # reads

    def get_memory(self, slug: str, now: str) -> dict:
        """A memory, if its scope isn't sensitive or is granted."""
        found = self.mem_get(slug)
        return self._gated(found["memory"]["scope_hash"], now) or found if found["ok"] else found

    def list_promotions(self, now: str, scope: str | None = None, status: str = "pending") -> dict:
        """Candidates of a scope (refused where it isn't granted), or of all scopes but those that aren't."""
        if scope is not None and (refused := self._gated(scope, now)):
            return refused
        spark = self.memories.sparkSession
        sensitive = self.sensitive if self.sensitive is not None and scope is None else spark.createDataFrame([], "scope_hash string")
        granted = None if self.grants is None else security.valid_grants(self.grants, now).select("scope_hash").distinct()
        return ok(promotions=_rows(lifecycle.list_promotions(self.promotions, sensitive, granted, status, scope)))

    def request_sensitive_read(self, root: str, now: str) -> dict:
        """Whether a folder's scope may be read now."""
        row = self.memories.sparkSession.createDataFrame([(root,)], "t string").select(ids.scope_hash(F.col("t")).alias("scope")).first()
        refused = self._gated(row.scope, now)
        return ok(granted=False, scope_hash=row.scope, reason=refused["error"]["message"]) if refused else ok(granted=True, scope_hash=row.scope, scope_root=root)

    def mem_get(self, slug: str) -> dict:
        row = listing.get_memory(self.memories, slug).first()
        return failed("not_found", slug) if row is None else ok(memory=row.asDict())

    def mem_search(self, query: str, *, scope: str | None = None, top_k: int = 10, types: tuple[str, ...] = (), vector_hits: DataFrame | None = None, entity_slugs: DataFrame | None = None) -> dict:
        """Keyword (a regular expression) and vector hits (id, rank) fused; types are a filter of the top k."""
        from pyspark.sql import Window

        rows = listing.scoped(self.memories, scope)
        best = search.keyword_lines(rows, query).orderBy("slug").limit(2 * top_k)
        keyword = best.withColumn("rank", F.row_number().over(Window.orderBy("slug"))).select(F.col("slug").alias("id"), "rank")
        vector = keyword.limit(0) if vector_hits is None else vector_hits
        kinds = self.memories.select(F.col("slug").alias("id"), "type")
        return ok(results=_rows(search.hybrid(vector, keyword, entity_slugs, top_k, types=kinds, kinds=types)))

    def search_memory(self, query: str, *, scope: str | None = None, kind: str | None = None, limit: int = 20) -> dict:
        triggers = self.triggers if self.triggers is not None else self.memories.select("slug", F.lit("").alias("trigger"))
        return ok(results=_rows(search.session_search(self.memories, triggers, query, scope, kind, limit)))

    def mem_context(self, slug: str, neighbours: int = 3) -> dict:
        anchor = self.memories.where(F.col("slug") == slug)
        return failed("not_found", slug) if anchor.isEmpty() else ok(neighbours=_rows(listing.neighbours(self.memories, anchor, neighbours)))

    def mem_timeline(self, now: str, since: str = "30d", scope: str | None = None, types: tuple[str, ...] = (), limit: int = 100) -> dict:
        return ok(memories=_rows(listing.timeline(self.memories, now, since, scope, types, limit).select("slug", "type", "title", "created_at")))

    def mem_session_summary(self, slug: str, most: int = 2000) -> dict:
        row = self.memories.where(F.col("slug") == slug).select(text.summarise(F.col("body"), most).alias("summary")).first()
        return failed("not_found", slug) if row is None else ok(summary=row.summary)

    def list_by_type(self, kind: str, scope: str | None = None, limit: int = 100) -> dict:
        return ok(memories=_rows(listing.list_by_type(self.memories, kind, scope, limit=limit).select("slug", "title", "created_at")))

    def mem_review_pending(self, low: float = 0.0, high: float = 1.0, types: tuple[str, ...] = (), limit: int = 20) -> dict:
        return ok(pending=_rows(lifecycle.review_pending(self.promotions, low, high, types, limit)))

    def mem_compare(self, one: str, other: str) -> dict:
        """The unified diff of two bodies."""
        a, b = (self.memories.where(F.col("slug") == s).select(F.col("body").alias(n)) for s, n in ((one, "a"), (other, "b")))
        row = a.join(F.broadcast(b)).select(text.unified_diff("a", "b").alias("diff")).first()
        return failed("not_found", f"{one}, {other}") if row is None else ok(diff=list(row["diff"]))

    def mem_judge(self, decision: str, confidence: float) -> dict:
        row = graph.judged(self.memories.sparkSession.createDataFrame([(decision, float(confidence))], "decision string, confidence double")).first()
        return ok(action=row.action)

    def mem_stats(self, scope: str | None = None) -> dict:
        return ok(stats=_rows(listing.stats(listing.scoped(self.memories, scope))))

    def mem_suggest_topic_key(self, content: str) -> dict:
        row = self.memories.sparkSession.createDataFrame([(content,)], "t string").select(text.topic_key(F.col("t")).alias("key")).first()
        return ok(topic_key=row.key, source="heuristic")

    def mem_current_project(self, root: str) -> dict:
        row = self.memories.sparkSession.createDataFrame([(root,)], "t string").select(ids.scope_hash(F.col("t")).alias("scope")).first()
        return ok(scope_hash=row.scope, memories=self.memories.where(F.col("scope_hash") == row.scope).count())

    def mem_doctor(self) -> dict:
        return ok(counts=_rows(listing.counts_by_type(self.memories)), duplicates=listing.duplicates(self.memories).count())
