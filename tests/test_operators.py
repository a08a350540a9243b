"""Small frames: ties, nulls, bounds and empty tables."""

from __future__ import annotations

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import graph, lifecycle, listing, ordered, reports, search, security, sync, trends
from tessera.sources import readers, sinks


def one(spark, column, **values):
    """The value of an expression over a row."""
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("title, wanted", [("Hello World!", "hello-world"), ("  ", "untitled"), ("", "untitled"), ("Ünï çode", "n-ode"), ("x" * 80, "x" * 60)])
def test_kebab(spark, title, wanted):
    assert one(spark, ids.kebab(F.col("t")), t=title) == wanted


@pytest.mark.parametrize("heading, kind", [("Warning: hot", "warning"), ("How to deploy", "playbook"), ("We chose X", "decision"), ("I prefer tabs", "preference"), ("Other", "fact"), ("避免 this", "warning")])
def test_infer_type(spark, heading, kind):
    assert one(spark, text.infer_type(F.col("h")), h=heading) == kind


def test_topic_key_and_triggers(spark):
    assert one(spark, text.topic_key(F.col("t")), t="The Quick, brown fox") == "the_quick_brown"
    assert one(spark, text.topic_key(F.col("t")), t="!!") == "memory"
    assert one(spark, text.derive_triggers(F.col("t")), t="Go") == ["imported", "go"]
    assert one(spark, text.derive_triggers(F.col("t")), t="alpha beta gamma delta epsilon zeta") == ["alpha", "beta", "gamma", "delta", "epsilon"]


def test_count_words_and_cleaning(spark):
    assert one(spark, text.count_words(F.col("t")), t="two words 中文") == 4
    assert one(spark, text.count_words(F.col("t")), t=None) == 0
    assert one(spark, text.clean_for_embedding(F.col("t")), t="a<!-- x\ny -->b\n\n\n\nc ") == "ab\n\nc"
    assert one(spark, text.meaningful(F.col("t")), t="## Only a heading") is False


def test_truncation(spark):
    cut = lambda t, n: one(spark, text.truncate_by_paragraph(F.col("t"), n), t=t)
    assert cut("short", 10) == "short"
    assert cut("aaaaaa\n\nbbbb", 9) == "aaaaaa\n"
    assert cut("aa\nbbbbbbbb", 6) == "aa\n"
    assert cut("abcdefgh", 4) == "abcd"
    assert one(spark, text.truncate_by_words(F.col("t"), 3), t="a b\n\nc d\n\ne") == "a b\n"


def test_window_days():
    assert [listing.window_days(x) for x in ("30d", "2w", "6m", "1y", "bad", None)] == [30, 14, 180, 365, 30, 30]


def test_chunks_cover_headings_and_lines():
    found = list(text.chunks_of("intro text\n# One\nbody one\n## Empty\n\n# Two\nbody two"))
    assert [(c[1], c[2], c[3], c[4]) for c in found] == [("", 0, 1, 1), ("One", 1, 2, 3), ("Two", 1, 6, 7)]


def test_long_sections_are_split_with_overlap():
    lines = [f"line {i} " + "x" * 40 for i in range(60)]
    found = list(text.chunks_of("\n".join(lines), most=500, overlap=2))
    assert all(len(c[0]) <= 500 for c in found)
    assert all(b[3] <= a[4] for a, b in zip(found, found[1:], strict=False))
    assert found[-1][4] == 60


def test_split_long_keeps_all_text():
    whole = "One. Two! v1.2.3 three? " * 20
    parts = text.split_long(whole, 50)
    assert "".join(parts) == whole and all(len(p) <= 50 for p in parts)
    assert text.split_long("user@example.com" * 4, 20)[0] == "user@example.comuser"


def memories(spark, *rows):
    schema = "slug string, decay_state string, ttl_days int, created_at timestamp_ntz, last_recalled_at timestamp_ntz, body_path string, scope_hash string"
    return spark.createDataFrame([(s, d, t, c, r, f"scopes/x/{s}.md", "sc") for s, d, t, c, r in rows], schema)


def test_decay_bounds_are_exclusive(spark):
    now, day = "2024-06-01 00:00:00", lambda d, m=5: datetime(2024, m, d)
    m = memories(
        spark,
        ("on_ttl", "alive", 7, day(25), None),
        ("over_ttl", "alive", 7, day(24), None),
        ("no_ttl", "alive", None, day(1, 1), None),
        ("recalled", "alive", 7, day(1), day(30)),
        ("dim", "dim", None, day(1, 1), None),
        ("gone", "soft-forgotten", None, day(1, 1), None),
        ("timeless", "dim", None, None, None),
    )
    found = {r.slug: r.action for r in lifecycle.decay_sweep(m, now).collect()}
    assert found == {"on_ttl": None, "over_ttl": "to_dim", "no_ttl": None, "recalled": None, "dim": "to_soft_forgotten", "gone": "to_forgotten_dir", "timeless": "to_soft_forgotten"}
    assert lifecycle.swept(m, now).where("slug = 'gone'").first().body_path == "scopes/sc/forgotten/gone.md"


def test_scores_keep_the_numbers_among_others(spark):
    mean = lambda s: one(spark, lifecycle.score_mean(F.col("s")), s=s)
    assert mean('{"D": 0.5, "U": "high", "R": 1}') == 0.75
    assert mean("{}") is None and mean("nonsense") is None and mean(None) is None
    gate = lambda s: one(spark, lifecycle.gated(F.col("s")), s=s)
    assert gate('{"D":0.6,"U":0.6,"R":0.6,"A":0.6}') and not gate('{"D":0.9,"U":0.9,"R":0.9}') and not gate('{"D":0.5,"U":1,"R":1,"A":1}')


def test_candidates_of_fenced_answers(spark):
    answer = 'Sure:\n```json\n[{"type":"fact","title":"T","score":"{\\"D\\":0.9,\\"U\\":0.9,\\"R\\":0.9,\\"A\\":0.9}"},{"title":"low","score":"{}"}]\n```'
    found = lifecycle.parse_candidates(spark.createDataFrame([(1, answer), (2, "no json")], "id int, raw string")).collect()
    assert [(r.id, r.title) for r in found] == [(1, "T")]


def test_bands(spark):
    rows = spark.createDataFrame([(1, '{"D":0.85}'), (2, '{"D":0.49}'), (3, '{"D":0.5}')], "id int, dura_score string")
    assert {r.id: r.band for r in lifecycle.with_status(rows).collect()} == {1: "approved", 2: "rejected", 3: "pending"}


def test_recall_and_upsert(spark):
    schema = "slug string, recall_count bigint, last_recalled_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, decay_state string"
    old = spark.createDataFrame([("a", 1, None, datetime(2024, 1, 1), datetime(2024, 1, 1), "dim")], schema)
    hits = spark.createDataFrame([("a", datetime(2024, 2, 1)), ("a", datetime(2024, 1, 2)), ("zz", datetime(2024, 1, 2))], "slug string, at timestamp_ntz")
    row = lifecycle.record_recall(old, hits).first()
    assert (row.recall_count, row.last_recalled_at, row.decay_state) == (3, datetime(2024, 2, 1), "dim")
    assert lifecycle.record_recall(old, hits, revive=True).first().decay_state == "alive"
    new = spark.createDataFrame([("a", 0, None, datetime(2024, 3, 1), datetime(2024, 3, 1), "alive"), ("b", 0, None, datetime(2024, 3, 1), datetime(2024, 3, 1), "alive")], schema)
    found = {r.slug: (r.recall_count, r.created_at.month, r.updated_at.month, r.decay_state) for r in lifecycle.upsert_memories(old, new).collect()}
    assert found == {"a": (1, 1, 3, "alive"), "b": (0, 3, 3, "alive")}


def test_predicates(spark):
    rows = spark.createDataFrame([("a", "Used By", "b", 2.0), ("a", "owns", "b", 0.1), ("a", "weird", "b", None)], "subject_id string, predicate string, object_id string, confidence double")
    found = [(r.subject_id, r.predicate, r.object_id, r.confidence) for r in graph.normalise_relations(rows, 0.5).collect()]
    assert found == [("b", "uses", "a", 1.0)]
    assert graph.normalise_relations(rows, drop_unknown=False).count() == 3


def relations(spark, *rows):
    return spark.createDataFrame([(*r, True, i) for i, r in enumerate(rows)], "subject_id string, predicate string, object_id string, source_memory_id string, active boolean, ord bigint")


def test_null_sources_are_never_equal(spark):
    r = relations(spark, ("a", "uses", "b", "m"), ("a", "uses", "b", "m"), ("a", "uses", "b", None), ("a", "uses", "b", None))
    assert graph.distinct_relations(r).count() == 3


def test_n_hop(spark):
    r = relations(spark, ("a", "uses", "b", None), ("b", "uses", "c", None), ("c", "uses", "d", None), ("b", "cites", "a", None), ("a", "prefers", "b", None))
    nodes, edges = graph.n_hop(r, spark.createDataFrame([("a",)], "seed string"), 2)
    assert {(n.node, n.hops) for n in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(e.subject_id, e.object_id, e.predicate) for e in edges.collect()} == {("a", "b", "prefers"), ("b", "a", "cites"), ("b", "c", "uses")}
    assert graph.n_hop(r, spark.createDataFrame([("zz",)], "seed string"), 0)[1].count() == 0


def test_chains_and_cycles(spark):
    rows = [("e", "m1", "m2", 1), ("e", "m2", "m3", 2), ("f", "x", "y", 1), ("f", "y", "x", 2)]
    df = spark.createDataFrame(rows, "entity_id string, older string, newer string, decided_at bigint")
    found = {(r.entity_id, r.pos): r.memory_id for r in graph.evolution_chain(df).collect()}
    assert [found["e", i] for i in range(3)] == ["m1", "m2", "m3"] and [found["f", i] for i in range(3)] == ["x", "y", "x"]


def test_conflicts_are_groups_with_members(spark):
    r = relations(spark, ("e", "prefers", "a", "m1"), ("e", "prefers", "b", "m2"), ("e", "prefers", "b", "m2"), ("e", "cites", "z", "m3"), ("e", "prefers", "c", None))
    assert sorted(tuple(x) for x in graph.conflicts(r).collect()) == [("e", "prefers", "a", "m1"), ("e", "prefers", "b", "m2")]


def test_entities_and_aliases(spark):
    m = spark.createDataFrame([("tool", " Big Tool ", "s", 1, 1, ""), ("tool", "big tool", "t", 2, 2, "new"), ("tool", "big tool", "t", 3, 3, ""), ("alien", "x", "s", 1, 1, "")], "type string, name string, scope_hash string, at int, seq int, context string")
    row = graph.upsert_entities(m).collect()
    assert [(r.id, r.mention_count, r.scope_hash, r.context) for r in row] == [("entity:tool:big_tool", 3, "s", "new")]
    a = spark.createDataFrame([("e", 1, ["b", "a"]), ("e", 2, ["a", "c"])], "id string, seq int, aliases array<string>")
    assert graph.merge_aliases(a).first().aliases == ["b", "a", "c"]


def test_fusion_and_scores(spark):
    v = spark.createDataFrame([("m1", 1), ("m2", 2), ("m1", 3)], "id string, rank int")
    k = spark.createDataFrame([("m2", 1)], "id string, rank int")
    found = {r.id: r.score for r in search.fuse((v, 1.0), (k, 1.0)).collect()}
    assert found["m1"] == pytest.approx(1 / 61 + 1 / 63) and found["m2"] == pytest.approx(1 / 62 + 1 / 61)
    semantic = spark.createDataFrame([("a", 0.9), ("b", 0.1), (None, 1.0)], "id string, score double")
    assert [tuple(r) for r in search.score_and_rank(semantic, None, None, 0.2, 5).collect()] == [("a", 0.9)]
    boosts = spark.createDataFrame([("a", 0.5)], "id string, boost double")
    assert search.score_and_rank(semantic, None, boosts, 0.2, 5).first().score == pytest.approx(1.4 / 1.5, abs=1e-6)


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    queries = spark.createDataFrame([(1, "word")], "query int, text string")
    assert search.bm25(docs, queries, "id", "text", 3).count() == 0


def test_vector_index_is_incremental(spark):
    schema = "source string, content string, start_line int, end_line int"
    embed = search.hashing_embedder(8)
    first = search.vector_upsert(None, spark.createDataFrame([("d", "one", 1, 1), ("d", "two", 2, 2), ("e", "three", 1, 1)], schema), embed, "m")
    second = search.vector_upsert(first, spark.createDataFrame([("d", "one", 1, 1), ("d", "new", 2, 2)], schema), embed, "m")
    assert sorted(r.content for r in second.collect()) == ["new", "one", "three"]


def test_merge_entries_by_audit(spark):
    schema = "id string, content string, created_at double, updated_at double, tags array<string>"
    local = spark.createDataFrame([("a", "old", 1.0, 5.0, ["x"]), ("l", "only", 1.0, 1.0, [])], schema)
    remote = spark.createDataFrame([("a", "new", 2.0, 5.0, ["y", "x"])], schema)
    row = sync.merge_entries(local, remote).where("id = 'a'").first()
    assert (row.content, row.created_at, row.updated_at, row.tags, len(row.merge_notes)) == ("new", 1.0, 5.0, ["x", "y"], 1)
    audit = spark.createDataFrame([(1, 1.0, "update", "a", ["content"], {"content": "said"}), (2, 2.0, "read", "a", ["content"], {"content": "no"})], "seq bigint, ts double, action string, target_id string, changed_fields array<string>, after map<string,string>")
    row = sync.merge_entries(local, remote, audit).where("id = 'a'").first()
    assert row.content == "said" and row.merge_notes == ["content-conflict: audit seq=1 decided"]
    assert sync.merge_entries(local, remote).count() == 2


def test_chain_verifies_and_breaks(spark):
    events = spark.createDataFrame([("log", i, json.dumps({"event_type": "read", "n": i, "text": "ü"}, ensure_ascii=False)) for i in range(1, 6)], "log string, n bigint, event string")
    lines = security.chained(events)
    assert security.broken_links(lines).count() == 0
    broken = lines.withColumn("line", F.when(F.col("n") == 3, F.replace("line", F.lit("read"), F.lit("write"))).otherwise(F.col("line")))
    assert security.broken_links(broken).first().line == 4
    bad = lines.withColumn("line", F.when(F.col("n") == 2, "{").otherwise(F.col("line")))
    assert security.broken_links(bad).first().line == 2


def test_gate_and_encryption(spark):
    requests = spark.createDataFrame([("open",), ("shut",), ("granted",)], "scope_hash string")
    sensitive = spark.createDataFrame([("shut",), ("granted",)], "scope_hash string")
    grants = spark.createDataFrame([("granted", datetime(2024, 6, 2)), ("shut", datetime(2024, 5, 1))], "scope_hash string, expires_at timestamp_ntz")
    assert {r.scope_hash: r.result for r in security.gate(requests, sensitive, grants, "2024-06-01 00:00:00").collect()} == {"open": "allow", "shut": "deny", "granted": "allow"}
    key, df = "11" * 32, spark.createDataFrame([("s", "secret")], "scope_hash string, body string")
    hidden = security.encrypted(df, "body", key)
    assert hidden.first().body != "secret" and security.decrypted(hidden, "body", key).first().body == "secret"


def test_rising_needs_more_than_before(spark):
    from datetime import date

    s = spark.createDataFrame([("a", "s", date(2024, 1, 30), 5), ("a", "s", date(2024, 1, 20), 5), ("b", "s", date(2024, 1, 24), 2), ("c", "t", date(2024, 1, 23), 9)], "trigger string, scope_hash string, day date, hits bigint")
    assert [tuple(r) for r in trends.rising_triggers(s, "2024-01-31 00:00:00").collect()] == [("b", 2, 0)]
    assert [r.trigger for r in trends.top_triggers(s, "2024-01-31 00:00:00").collect()] == ["a", "b"]
    assert trends.top_triggers(s.limit(0), "2024-01-31 00:00:00").count() == 0
    assert trends.increment(s, spark.createDataFrame([("", "s", date(2024, 1, 1)), ("z", None, date(2024, 1, 1))], "trigger string, scope_hash string, day date")).where("trigger = 'z'").first().scope_hash == "_global"


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "scopes/x/fact").mkdir(parents=True)
    (tmp_path / "scopes/x/fact/good.md").write_text("---\ntitle: Good one\ntype: fact\nscope_hash: x\nttl_days: 7\ntriggers: [alpha, beta]\ncreated_at: 2024-01-02T03:04:05\n---\n\n\nBody here\n")
    (tmp_path / "scopes/x/fact/plain.md").write_text("no front matter")
    (tmp_path / "scopes/x/fact/bad.md").write_text("---\n[unclosed\n---\nx")
    parsed = readers.parse_markdown(readers.scan_text(spark, str(tmp_path)))
    report = readers.index_report(parsed).first()
    assert (report.indexed, report.errors) == (2, 1)
    found = {r.slug: r for r in readers.memories_of(parsed).collect()}
    assert found["good"].title == "Good one" and found["good"].ttl_days == 7 and found["good"].triggers == ["alpha", "beta"] and found["good"].body == "Body here\n"
    assert found["plain"].type == "session"
    again = sinks.markdown(readers.memories_of(parsed)).where("slug = 'good'").first().text
    meta, lists, body, error = readers.front_matter(again)
    assert meta["title"] == "Good one" and lists["triggers"] == ["alpha", "beta"] and body == "Body here\n" and error is None
    assert {tuple(r) for r in readers.layout(readers.scan_text(spark, str(tmp_path))).select("scope_hash", "type", "slug").collect()} == {("x", "fact", "good"), ("x", "fact", "plain"), ("x", "fact", "bad")}


def test_transcripts(spark):
    lines = [("f", 1, '{"role":"user","content":"hi"}'), ("f", 2, "bad"), ("f", 3, '{"author":"bot","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}'), ("g", 1, "{}")]
    df = spark.createDataFrame(lines, "file string, n bigint, line string")
    found = {r.file: r.body for r in readers.scan_session(df).collect()}
    assert found == {"f": "**user**: hi\n\n**bot**: a\nb", "g": "(empty session)"}
    wrapped = spark.createDataFrame([("f", 1, '{"message":{"content":"x"}}'), ("f", 2, '{"message":{"content":"y"}}')], "file string, n bigint, line string")
    assert [r.text for r in readers.scan_transcript(wrapped, last=1).collect()] == ["y"]


def test_sections_number_repeated_slugs(spark):
    doc = "# Top\n## Same\nbody one\n### Empty\n\n## Same\nbody two"
    found = readers.import_sections(spark.createDataFrame([("f", doc)], "file string, text string"), "import", "2024-01-01").orderBy("slug").collect()
    assert [(r.slug, r.body) for r in found] == [("2024-01-01-same", "body one"), ("2024-01-01-same-1", "body two")]


def test_json_imports_and_rollouts(spark):
    raw = spark.createDataFrame([('{"memories":[{"title":"A","content":"x","type":"User Preference","tags":["t","u"]},{"text":"only text"}]}',), ('[{"name":"B","text":"y"}]',)], "raw string")
    found = {r.title: (r.type, r.body, r.triggers) for r in readers.import_memories_json(raw).collect()}
    assert found["A"] == ("preference", "x", ["t", "u"]) and found["B"][:2] == ("fact", "y") and "only text" in found
    row = spark.createDataFrame([("thread: 1\ncwd: /x\n\nBody\n",), ("Just text",)], "t string").select(readers.rollout("t").alias("r")).select("r.*").collect()
    assert row[0].header == {"thread": "1", "cwd": "/x"} and row[0].body == "Body\n" and row[1].header == {} and row[1].body == "Just text"


def test_scope_of_content(spark):
    rows = spark.createDataFrame([(1, "edit /home/a/proj/x.py now"), (2, "see /home/a/proj/x and /srv/b/y"), (3, "none")], "id int, text string")
    roots = spark.createDataFrame([("/home/a",), ("/home/a/proj",), ("/srv/b",)], "root string")
    assert {r.id: r.root for r in readers.scope_of_content(rows, roots).collect()} == {1: "/home/a/proj", 2: None, 3: None}


def test_versions_and_reports(spark):
    old = spark.createDataFrame([(4, "x", datetime(2024, 1, 1))], "version_num int, content_md string, written_at timestamp_ntz")
    new = spark.createDataFrame([("y", datetime(2024, 1, 2))], "content_md string, written_at timestamp_ntz")
    assert sorted(r.version_num for r in sinks.next_version(old, new).collect()) == [4, 5]
    assert sinks.next_version(old.limit(0), new).first().version_num == 1
    reports = spark.createDataFrame([("2024-01", 1, "a")], "period string, generated_at int, content_md string")
    assert sinks.save_report(reports, spark.createDataFrame([("2024-01", 2, "b")], reports.schema)).collect()[0].content_md == "b"


def test_save_and_read_memories(spark, tmp_path):
    m = spark.createDataFrame([("a", "s", "fact", True, "hidden"), ("b", "s", "fact", False, "plain")], "slug string, scope_hash string, type string, scope_sensitive boolean, body string")
    sinks.save_memories(m, str(tmp_path / "t"), key="22" * 32)
    found = {r.slug: r.body for r in spark.read.parquet(str(tmp_path / "t")).where("type = 'fact'").collect()}
    assert found["b"] == "plain" and found["a"] != "hidden"


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as many as asked for, however few rows they have."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_neighbours_of_all_rows(spark, many_ranges):
    import random

    rng = random.Random(3)
    data = [(f"m{rng.randrange(1000)}-{i}", rng.choice(["a", "a", "a", "b", None]), None if i % 40 == 0 else datetime(2024, 1, 1 + rng.randrange(25))) for i in range(160)]
    rows = spark.createDataFrame(data, "slug string, scope_hash string, created_at timestamp_ntz")
    expected = set()
    for slug, scope, at in data:
        for side in (-1, 1):
            others = [(abs(t - at), s) for s, sc, t in data if scope and sc == scope and t and at and (t - at) * side > t - t]
            expected |= {(slug, "before" if side < 0 else "after", i + 1, s) for i, (_, s) in enumerate(sorted(others)[:3])}
    found = listing.neighbours(rows).collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected
    some = rows.where("scope_hash = 'b'")
    slugs = {r.slug for r in some.collect()}
    assert {tuple(r) for r in listing.neighbours(rows, some).collect()} == {x for x in expected if x[0] in slugs}
    assert listing.neighbours(rows.limit(0)).count() == 0


def test_ordered_over_ranges(spark, many_ranges):
    """Numbers and predecessors against plain Python, where a group has many ranges, orders are far apart, and groups or orders are null."""
    data = [("hot", i, f"v{i}") for i in range(0, 60) if i % 7] + [(None, i * 5, None) for i in range(4)] + [("one", -3, "x")] + [("gap", None, "n"), ("gap", 9, "a"), ("gap", 1000, "b")]
    rows = spark.createDataFrame(data, "log string, n bigint, value string")
    groups = {}
    for log, n, value in sorted(data, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0)):
        groups.setdefault(log, []).append((n, value))
    got = {(r.log, r.n): r.before_ for r in ordered.before(rows, "log", "n", "value").collect()}
    assert len(got) == len(data)
    for log, own in groups.items():
        for i, (n, _) in enumerate(own):
            assert (got[log, n] is None) == (i == 0) and (i == 0 or got[log, n].value == own[i - 1][1])
    got = {(r.log, r.n): (r.pos, r.first_) for r in ordered.numbered(rows, "log", "n", "value").collect()}
    assert got == {(log, n): (i + 1, own[0][1]) for log, own in groups.items() for i, (n, _) in enumerate(own)}
    none = rows.limit(0)
    assert ordered.before(none, "log", "n", "value").count() == ordered.numbered(none, "log", "n", "value").count() == 0


def test_merge_duplicates_sections(spark):
    memories = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None), ("d", "D")], "slug string, body string")
    merges = spark.createDataFrame([("a", "c", 2), ("a", "b", 3), ("a", "gone", 4), ("lost", "d", 2)], "keep string, drop string, pos int")
    sections = lifecycle.merge_duplicates(memories, merges)
    assert sorted((r.slug, r.pos, r.merged_from, r.section) for r in sections.collect()) == [("a", 0, None, "A"), ("a", 2, "c", None), ("a", 3, "b", "B")]
    assert [tuple(r) for r in lifecycle.merged_bodies(sections).collect()] == [("a", "A\n\n\n## merged-from c\n\n\n\n\n## merged-from b\n\nB")]


def test_knn_by_packs(spark, monkeypatch):
    """Nearest vectors against plain Python: many packs, ties, repeated rows, other widths, and vectors without a cosine."""
    monkeypatch.setattr(search, "PACK", 8)
    data = [(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (62, []), (63, [1.0, 2.0]), (64, [1.0, None, 2.0]), (5, [2.0, 0.0, 1.0])]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    asked = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 1.0, 1.0]), (2, [3.0, 4.0]), (3, None), (4, [0.0, 0.0, 0.0])]
    found = search.knn(vectors, spark.createDataFrame(asked, "query bigint, vector array<double>"), 5).collect()
    got = {q: [(r.id, r.score) for r in sorted((r for r in found if r["query"] == q), key=lambda r: r["rank"])] for q, _ in asked}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)), 6)

    good = [(i, v) for i, v in data if v and None not in v and any(v)]
    for q, a in asked[:3]:
        want = sorted(((i, cosine(a, v)) for i, v in good if len(v) == len(a)), key=lambda r: (-r[1], r[0]))[:5]
        assert got[q] == want
    assert got[3] == got[4] == []
    assert search.knn(vectors.limit(0), vectors.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 5).count() == 0


def test_headings_are_told_by_line(spark):
    for body, kept in (("##\nabc", True), ("## Title\n  ", False), ("# a\r\n# b", False), ("<!-- x\n# y -->ab", True), ("#\tT\n x ", False), ("####### seven", True)):
        assert one(spark, text.meaningful(F.col("t")), t=body) is kept


def test_sensitive_memories_are_not_handed_over(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [("a", "decision", day(9), False, "---\nx: 1\n---\n\n body"), ("b", "decision", day(8), True, "b"), ("c", "decision", day(7), None, "no --- front"), ("d", "decision", day(1), False, "old")]
    made = spark.createDataFrame([(s, k, at, "alive", flag, body, "sc") for s, k, at, flag, body in rows], "slug string, type string, created_at timestamp_ntz, decay_state string, scope_sensitive boolean, body string, scope_hash string")
    found = listing.recent_typed(made, "decision", "2024-01-10 00:00:00", 5, 10).collect()
    assert [(r.slug, r.body) for r in found] == [("a", "body"), ("c", "no --- front")]
    people = spark.createDataFrame([("e1", "E", 3, day(9), "sc"), ("e2", "E", 9, day(1), "sc"), ("e3", "E", 5, day(9), "other")], "id string, name string, mention_count bigint, last_seen_at timestamp_ntz, scope_hash string")
    signals = [(r.kind, r.item) for r in reports.handoff_signals(made, people, "2024-01-10 00:00:00", 5, scope="sc").collect()]
    assert signals == [("decision", "a"), ("decision", "c"), ("entity", "e1")]


ENTITIES = "memory_id string, type string, name string, pos int, context string, confidence double"
RELATIONS = "memory_id string, subject_type string, subject string, predicate string, object_type string, object string, confidence double, pos int"


def ingested(spark, entities, relations, memories=(("m1", "s", datetime(2024, 1, 1), 1), ("m2", "s", datetime(2024, 1, 2), 2)), **how):
    return graph.ingest(spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(relations, RELATIONS), spark.createDataFrame(list(memories), "memory_id string, scope_hash string, at timestamp_ntz, seq bigint"), **how)


def test_ends_that_are_told_are_not_counted_again(spark):
    ann = ("m1", "person", "Ann", 0, "", 0.9)
    relations = [("m1", "person", "Ann", "uses", "tool", "Vim", 0.9, 0), ("m1", "person", "Ann", "likes", "tool", "Emacs", 0.9, 1), ("m1", "person", "Ann", "uses", "tool", "Vim", 0.8, 2), ("m1", "person", "Ann", "uses", "tool", "Ed", 0.1, 3)]
    entities, edges, counts = ingested(spark, [ann], relations, least=0.3, drop_unknown=True)
    assert {r.id: r.mention_count for r in entities.collect()} == {"entity:person:ann": 1, "entity:tool:vim": 1}
    assert sorted((r.subject_id, r.predicate, r.object_id, r.confidence) for r in edges.collect()) == [("entity:person:ann", "uses", "entity:tool:vim", 0.9), ("memory:m1", "mentions", "entity:person:ann", 0.9)]
    assert tuple(counts.first()) == (1, 0, 2, 2)


def test_an_end_counts_before_it_is_told(spark):
    """m1 names Vim as an end, m2 tells it: two mentions; the other way round it is one. Old entities aren't counted as ends."""
    relation = ("tool", "Vim", "used by", "person", "Ann", None, 0)
    for first, second, n in (("m1", "m2", 2), ("m2", "m1", 1)):
        entities, edges, counts = ingested(spark, [(second, "tool", "vim", 0, "c", 0.5)], [(first, *relation)])
        assert {r.id: r.mention_count for r in entities.collect()} == {"entity:person:ann": 1, "entity:tool:vim": n}
        assert ("entity:person:ann", "uses", "entity:tool:vim") in {(r.subject_id, r.predicate, r.object_id) for r in edges.collect()}
        assert tuple(counts.first()) == (2 - n, n - 1, 1, 0)
    old, _, _ = ingested(spark, [("m1", "tool", "Vim", 0, "", 0.5)], [])
    entities, _, counts = ingested(spark, [("m1", "place", "", 0, "", 0.5), ("m1", "thing", "x", 1, "", 0.5)], [("m1", *relation)], old=old)
    assert {r.id: r.mention_count for r in entities.collect()} == {"entity:person:ann": 1, "entity:tool:vim": 1}
    assert tuple(counts.first()) == (0, 0, 1, 0)


def test_versions_are_listed_by_the_time_they_were_written(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 5)), (2, datetime(2024, 1, 1)), (3, datetime(2024, 1, 9))], "version_num bigint, written_at timestamp_ntz")
    assert [r.version_num for r in reports.list_versions(rows, "2024-01-01 00:00:00", "2024-01-09 00:00:00").collect()] == [1, 2]
    assert [r.version_num for r in reports.list_versions(rows, limit=2).collect()] == [1, 2]


def test_what_an_import_lands(spark):
    columns = "id string, content string, tags array<string>, created_at double, updated_at double, relations array<struct<subject_id:string,predicate:string,object_id:string>>, merge_notes array<string>"
    make = lambda rows: spark.createDataFrame([(i, c, t, 0.0, at, None, n) for i, c, t, at, n in rows], columns)
    local = make([("same", "x", ["a"], 2.0, None), ("mine", "old", ["a"], 1.0, None), ("tags", "x", ["a"], 9.0, None)])
    landing = make([("landed", "was", [], 1.0, ["n"])])
    remote = make([("same", "x", ["a"], 1.0, None), ("mine", "new", ["a"], 2.0, None), ("tags", "x", ["b"], 1.0, None), ("landed", "is", [], 2.0, None), ("new", "n", [], 1.0, None)])
    expected = {
        "prefer-local": ({"landed": "was", "new": "n"}, (1, 0, 0, 4)),
        "prefer-remote": ({"same": "x", "mine": "new", "tags": "x", "landed": "is", "new": "n"}, (1, 4, 0, 0)),
        "ask": ({"same": "x", "mine": "new", "tags": "x", "landed": "is", "new": "n"}, (1, 4, 0, 0)),
        "merge": ({"mine": "new", "tags": "x", "landed": "is", "new": "n"}, (1, 3, 3, 1)),
    }
    for strategy, (rows, told) in expected.items():
        after, counts = sync.imported(local, landing, remote, strategy)
        assert {r.id: r.content for r in after.collect()} == rows and tuple(counts.first()) == told
        if strategy == "ask":
            assert {tuple(r.merge_notes) for r in after.where("id <> 'new'").collect()} == {("pending-user-decision",)}
    with pytest.raises(ValueError, match="strategy"):
        sync.imported(local, landing, remote, "guess")


def test_transcripts_are_cut_however_many_turns(spark):
    """A conversation of short turns beyond the cut, and one of none: the same as of all turns joined."""
    turns = [(1, i, "u" if i % 3 else None, "x" * (i % 4)) for i in range(400)] + [(2, 5, "a", "long " * 100), (2, 3, "b", "first")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    whole = lambda c: "\n\n".join(f"**{r or '?'}**: {t}" for k, _, r, t in sorted(turns, key=lambda x: x[:2]) if k == c and t)
    assert {r.conv_id: r.body for r in listing.transcript(df, 200).collect()} == {c: whole(c)[:200] for c in (1, 2)}
    lines = [(str(c), i, json.dumps({"role": r or "?", "content": t})) for c, i, r, t in turns] + [("none", 1, "{}"), ("none", 2, "bad")]
    found = {r.file: r.body for r in readers.scan_session(spark.createDataFrame(lines, "file string, n int, line string"), 200).collect()}
    assert found == {"1": whole(1)[:200], "2": whole(2)[:200], "none": "(empty session)"}
