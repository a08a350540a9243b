"""The tools, one after the other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.schemas import MEMORY
from tessera.store import MemoryStore

NOW = "2024-06-01 10:00:00"


@pytest.fixture(scope="module")
def store(spark):
    memories = spark.createDataFrame([], MEMORY)
    triggers = spark.createDataFrame([], "slug string, trigger string")
    promotions = spark.createDataFrame([(1, "s", "fact", "T", '{"D":0.9}', "x", "pending", None), (2, "s", "fact", "U", '{"D":0.3}', "x", "pending", None)], "id bigint, source_session_slug string, proposed_type string, proposed_title string, dura_score string, scope_hash string, status string, created_at timestamp_ntz")
    return MemoryStore(memories, triggers, promotions)


def test_save_search_update_delete(store):
    store, told = store.mem_save(body="\n First line\nneedle here", kind="fact", scope_hash="x", now=NOW, triggers=("alpha",))
    slug = told["slug"]
    assert told["ok"] and slug.startswith("2024-06-01-First_line")
    assert store.mem_get(slug)["memory"]["title"] == "First line"
    assert [r["id"] for r in store.mem_search("needle")["results"]] == [slug]
    assert store.mem_search("needle", types=("decision",))["results"] == []
    assert store.search_memory("alph")["results"][0]["stage"] == 1
    store, told = store.mem_update(slug, NOW, title="New")
    assert store.mem_get(slug)["memory"]["title"] == "New"
    assert store.mem_timeline(NOW)["memories"][0]["slug"] == slug
    store, _ = store.mem_delete(slug)
    assert store.mem_get(slug)["error"]["code"] == "not_found" and store.triggers.count() == 0
    assert store.mem_delete("zz")[1]["ok"] is False


def test_sessions_and_candidates(store):
    store, told = store.mem_session_start(title="Talk", scope_hash="x", now=NOW)
    store, _ = store.mem_session_end(told["slug"], "done", NOW)
    row = store.mem_get(told["slug"])["memory"]
    assert row["ttl_days"] == 7 and row["body"].endswith("## Session end\n\ndone\n")
    assert store.mem_capture_passive(title="t", body="b", kind="session", scope_hash="x", now=NOW)[1]["ok"] is False
    assert [r["id"] for r in store.mem_review_pending()["pending"]] == [2, 1]
    store, told = store.mem_promote([], NOW, auto_high=True)
    assert told["approved"] == [1] and store.mem_get("promoted-1-s")["memory"]["type"] == "fact"
    store, _ = store.mem_reject([2], NOW)
    assert {r.status for r in store.promotions.collect()} == {"approved", "rejected"}
    assert store.mem_judge("supersedes", 0.9)["action"] == "apply"
    assert store.mem_merge_projects("x", "y")[1]["count"] >= 1


def test_long_term_merges_prompts_and_gates(spark, store):
    from datetime import datetime
    from dataclasses import replace

    sensitive = spark.createDataFrame([("hidden",), ("open",)], "scope_hash string")
    grants = spark.createDataFrame([("open", datetime(2024, 6, 1, 11)), ("hidden", datetime(2024, 6, 1, 9))], "scope_hash string, expires_at timestamp_ntz")
    store = replace(store, sensitive=sensitive, grants=grants)
    assert store.record_long_term(kind="fact", title="T", body="b", triggers=(), scope_hash="hidden", now=NOW)[1]["error"]["code"] == "authorization_required"
    assert store.record_long_term(kind="session", title="T", body="b", triggers=(), scope_hash="x", now=NOW)[1]["error"]["code"] == "invalid_type"
    slugs = []
    for i, (scope, body) in enumerate([("open", "one \n"), ("open", "two"), ("x", "three")]):
        store, told = store.record_long_term(kind="decision", title=f"T{i}", body=body, triggers=(f"t{i}", "both"), scope_hash=scope, now=NOW)
        slugs.append(told["slug"])
    assert store.get_memory(slugs[0], NOW)["memory"]["body"] == "one \n"
    assert store.get_memory(slugs[0], "2024-06-02 00:00:00")["error"]["code"] == "authorization_required"
    assert store.merge_duplicates(slugs[0], [slugs[2]], NOW)[1]["error"]["code"] == "cross_scope"
    store, told = store.merge_duplicates(slugs[0], [slugs[1], "absent"], NOW)
    assert told["kept"] == slugs[0] and store.mem_get(slugs[1])["error"]["code"] == "not_found"
    assert store.mem_get(slugs[0])["memory"]["body"] == f"one\n\n\n## merged-from {slugs[1]}\n\ntwo"
    assert {r.trigger for r in store.triggers.where(F.col("slug") == slugs[0]).collect()} == {"t0", "t1", "both"}
    store, told = store.promote_to_long_term(slugs[2], kind="fact", title="Made", now=NOW)
    made = store.mem_get(told["slug"])["memory"]
    assert told["promoted_from"] == slugs[2] and (made["body"], made["type"], made["scope_hash"]) == ("three", "fact", "x")
    assert {r.trigger for r in store.triggers.where(F.col("slug") == told["slug"]).collect()} == {"t2", "both"}
    assert store.promote_to_long_term("zz", kind="fact", title="x", now=NOW)[1]["error"]["code"] == "not_found"
    store, told = store.mem_save_prompt(" a b/c ", "first")
    store, told = store.mem_save_prompt("a b/c", "sécond")
    assert told["name"] == "a_b_c" and told["bytes"] == 7 and [r.content for r in store.prompts.collect()] == ["sécond"]
    assert store.mem_save_prompt(" ", "x")[1]["error"]["code"] == "invalid_argument"


def test_promotions_of_sensitive_scopes_need_a_grant(spark, store):
    from datetime import datetime
    from dataclasses import replace

    gated = replace(store, sensitive=spark.createDataFrame([("x",)], "scope_hash string"))
    assert len(store.list_promotions(NOW)["promotions"]) == 2
    assert gated.list_promotions(NOW)["promotions"] == [] and gated.list_promotions(NOW, "x")["error"]["code"] == "authorization_required"
    granted = replace(gated, grants=spark.createDataFrame([("x", datetime(2024, 6, 2))], "scope_hash string, expires_at timestamp_ntz"))
    assert len(granted.list_promotions(NOW)["promotions"]) == len(granted.list_promotions(NOW, "x")["promotions"]) == 2
    assert granted.request_sensitive_read("/srv/a", NOW)["granted"] is True
    root = granted.request_sensitive_read("/srv/a", NOW)["scope_hash"]
    assert replace(gated, sensitive=spark.createDataFrame([(root,)], "scope_hash string")).request_sensitive_read("/srv/a", NOW)["granted"] is False
