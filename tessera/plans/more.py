"""More queries, each beside its SQL twin: readers, writers' tables, lists, graph, versions and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import diffs, graph, lifecycle, listing, reports, search, security, sync, trends
from tessera.plans import adapt
from tessera.plans.adapt import EVENTS_NOW, read, stamp
from tessera.plans.oracles import STAMP, _with
from tessera.shared import fresh_path
from tessera.sources import bundles, readers, sinks, stored
from tessera.streaming import streams

PERSON = "entity:person:customer_7"
GONE = "SELECT slug FROM memories WHERE doc_id % 5 = 0"
FILES = "SELECT *, '/root/scopes/' || scope_hash || '/' || type || '/' || CASE WHEN doc_id % 7 = 0 THEN '_' ELSE '' END || slug || '.md' AS path FROM memories"
#: Of the extracted: who is told, which relations are taken, and their ends, each with its place.
TOLD = """SELECT o_orderdate AS seen, o_orderkey AS k, 0 AS kind, 0 AS pos, 'entity:person:customer_' || o_custkey AS id FROM orders UNION ALL SELECT o_orderdate, o_orderkey, 0, 1, 'entity:tool:tool_' || (o_orderkey % 10) FROM orders WHERE o_orderkey % 7 = 0"""
TAKEN = "SELECT o_orderdate AS seen, o_orderkey AS k, 'entity:person:customer_' || o_custkey AS person, 'entity:tool:tool_' || (o_orderkey % 10) AS tool FROM orders WHERE o_orderkey % 5 >= 2 AND o_orderkey % 4 < 2"
ENDS = f"SELECT seen, k, 1 AS kind, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS pos, person AS id FROM ({TAKEN}) UNION ALL SELECT seen, k, 1, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END, tool FROM ({TAKEN})"
MENTION_EDGES = "SELECT 'memory:o' || o_orderkey AS subject_id, 'mentions' AS predicate, 'entity:person:customer_' || o_custkey AS object_id, o_orderkey % 10 <> 0 AS active, o_orderkey AS ord FROM orders"


def _stamped(df: DataFrame) -> DataFrame:
    return df.select(*[stamp(c).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


def _files(spark: SparkSession, d: str) -> DataFrame:
    m = adapt.memories(spark, d)
    hidden = F.when(F.col("doc_id") % 7 == 0, "_").otherwise("")
    return m.select(F.concat(F.lit("/root/scopes/"), "scope_hash", F.lit("/"), "type", F.lit("/"), hidden, "slug", F.lit(".md")).alias("path"), F.col("updated_at").alias("modified"), "slug", "type", "scope_hash", "ttl_days", "recall_count", "body")


def _front(spark: SparkSession, d: str) -> DataFrame:
    lines = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("slug", "type", "scope_hash", "ttl_days", "recall_count")]
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))
    return readers.parse_markdown(_files(spark, d).select("path", F.concat(head, "body").alias("text")))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return readers.memories_of(_front(spark, d)).select("slug", "type", F.length("scope_hash").alias("n_scope"), "ttl_days", "recall_count", F.sha1("body").alias("body_sha1"))


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message")))
    lines = read(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("n"), line.alias("line"))
    return readers.scan_transcript(lines, 3).select("file", "n", F.sha1("text").alias("said"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    body = F.concat(F.lit("# Top\n\n## Decision "), i, F.lit("\n\nalpha "), i, F.lit("\n\n### How to "), i, F.lit("\nbeta\n\n## Decision "), i, F.lit("\ngamma\n## Empty\n\n"))
    return readers.import_sections(read(spark, d, "documents").select(F.col("doc_id").alias("file"), body.alias("text")), "notes", "2024-01-01").select("file", "slug", "type", "title", "body")


def _json_memories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    one = F.struct(F.concat(F.lit("Title "), i).alias("title"), F.concat(F.lit("x"), F.col("text")).alias("content"), F.when(i % 2 == 0, "user-decision").otherwise("warnings").alias("type"))
    raw = F.when(i % 3 == 0, F.to_json(F.array(one))).otherwise(F.to_json(F.struct(F.array(one).alias("memories"))))
    return readers.import_memories_json(read(spark, d, "documents").select(raw.alias("raw"))).select("title", "type", F.length("body").alias("n"))


def _auto(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 5 == 0, "MEMORY").otherwise(F.concat(F.lit("Note "), i))
    files = read(spark, d, "documents").select(F.concat(F.lit("/m/"), i, F.lit("/"), name, F.lit(".md")).alias("path"), F.concat(F.lit("---\nname: N"), i, F.lit("\ntype: playbook\n---\nbody "), i).alias("text"))
    return readers.import_auto_memory(files).select("slug", "title", "type", "body")


def _spilled(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = read(spark, d, "documents").select(i.alias("id"), F.when(i % 2 == 0, F.concat(F.lit("own "), i)).alias("content"), F.concat(F.lit("chunks/"), i).alias("content_ref"))
    side = read(spark, d, "documents").where(i % 3 == 0).select(F.concat(F.lit("chunks/"), i).alias("name"), F.concat(F.lit("side "), i).alias("content"))
    return readers.resolve_spilled(docs, side).select("id", "content")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/h/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.col("o_orderkey"), F.lit(".md"))
    return readers.handoffs(read(spark, d, "orders").select(path.alias("path")), 12)


def _roots(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" see /srv/a"), i % 4, F.lit("/b/file.py and more"), F.when(i % 5 == 0, " and /opt/z/q.txt").otherwise(""))
    roots = spark.createDataFrame([("/srv/a0",), ("/srv/a0/b",), ("/srv/a1",), ("/opt/z",)], "root string")
    return readers.scope_of_content(read(spark, d, "documents").select(i.alias("id"), body.alias("text")), roots).select("id", "root")


def _mention_edges(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return read(spark, d, "orders").select(F.concat(F.lit("memory:o"), o).alias("subject_id"), F.lit("mentions").alias("predicate"), F.concat(F.lit("entity:person:customer_"), "o_custkey").alias("object_id"), (o % 10 != 0).alias("active"), o.alias("ord"))


def _superseded(spark: SparkSession, d: str) -> DataFrame:
    rows = adapt.relations(spark, d)
    marked = graph.mark_superseded(rows, rows.where("ord % 5 = 0").select("ord"), "2024-01-01 00:00:00")
    return marked.groupBy("active", F.col("superseded_at").isNotNull().alias("marked")).agg(F.count("*").alias("n"))


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    rows = adapt.supersedes(spark, d)
    return rows.unionByName(rows.withColumn("decided_at", F.col("decided_at") + F.expr("INTERVAL 1 DAY"))).unionByName(rows.withColumn("older", F.col("newer")))


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From orders: the customer is told, now and then a tool too, and a relation between them (some unknown, some weak, some without a name)."""
    o = F.col("o_orderkey")
    orders = read(spark, d, "orders")
    told = orders.select(
        o.alias("memory_id"),
        F.explode(F.array(F.struct(F.lit("Person").alias("type"), F.concat(F.lit(" Customer "), "o_custkey").alias("name")), F.struct(F.when(o % 7 == 0, "tool").otherwise("thing").alias("type"), F.concat(F.lit("Tool "), o % 10).alias("name")))).alias("e"),
    )
    entities = told.select("memory_id", "e.type", "e.name", F.when(F.col("e.type") == "tool", 1).otherwise(0).alias("pos"), F.lit("").alias("context"), F.lit(0.9).alias("confidence"))
    names = F.get(F.array(*[F.lit(x) for x in ("used", "used by", "likes", "")]), (o % 4).cast("int"))
    relations = orders.select(
        o.alias("memory_id"), F.lit("person").alias("subject_type"), F.concat(F.lit("Customer "), "o_custkey").alias("subject"), names.alias("predicate"), F.lit("tool").alias("object_type"), F.concat(F.lit("Tool "), o % 10).alias("object"), (o % 5 / 5).alias("confidence"), F.lit(0).alias("pos")
    )
    memories_ = orders.select(o.alias("memory_id"), F.lit("s").alias("scope_hash"), F.col("o_orderdate").alias("at"), o.alias("seq"))
    return graph.ingest(entities, relations, memories_, 0.3, drop_unknown=True)


def _versions(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return read(spark, d, "orders").select((F.col("o_custkey") % 20).cast("string").alias("page"), o.alias("version_num"), F.repeat(F.lit("x"), (o % 3 + 1).cast("int")).alias("content_md"), F.col("o_orderdate").alias("written_at"))


def _next_versions(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("version_num"), F.col("r_name").alias("content_md"), F.lit(0).cast("bigint").alias("written_at"))
    new = read(spark, d, "nation").select(F.col("n_name").alias("content_md"), F.col("n_nationkey").cast("bigint").alias("written_at"))
    return sinks.next_version(old, new).select("version_num", "content_md")


def _saved_reports(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderkey").alias("generated_at"))
    return sinks.save_report(orders.where("generated_at % 2 = 0"), orders.where("generated_at % 2 = 1"))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    m = adapt.memories(spark, d).select("slug", "title", "created_at", "updated_at", "recall_count", "doc_id")
    new = m.where("doc_id % 4 = 0").withColumns({"title": F.lit("new"), "created_at": F.col("updated_at"), "recall_count": F.lit(99).cast("bigint")})
    added = m.where("doc_id % 4 = 1").withColumn("slug", F.concat(F.lit("more-"), "slug"))
    return _stamped(lifecycle.upsert_memories(m, new.unionByName(added)).select("slug", "title", "created_at", "recall_count"))


def _rebuilt(versions: DataFrame) -> DataFrame:
    """page, version_num, patched_sha1, changed: each version put together from the one before and its hunks."""
    text_ = diffs.patched_text(*[F.col(c) for c in ("before", "after", "hunks")])
    return diffs.version_rows(versions, {"patched_sha1": F.sha1(text_), "changed": F.size("hunks") > 0})


def _document_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the one before it of its source."""
    rows = read(spark, d, "documents").select(F.col("source").alias("page"), F.col("doc_id").alias("version_num"), F.coalesce("text", F.lit("")).alias("content_md"))
    return _rebuilt(rows)


def _version_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Four versions of each document: one whose short lines change, one that loses its first line, and one that gains two."""
    text_ = F.coalesce("text", F.lit(""))
    changed = F.regexp_replace(text_, r"(?m)^(.{1,60})$", "short: $1")
    first = F.regexp_replace(changed, r"^[^\n]*\n", "")
    versions = F.posexplode(F.array(text_, changed, first, F.concat(F.lit("new\n"), first, F.lit("\nlast")))).alias("version_num", "content_md")
    return _rebuilt(read(spark, d, "documents").select(F.col("doc_id").alias("page"), versions))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The same upsert into a stored table of buckets, by a batch that comes twice; then some rows are removed."""
    path = fresh_path(spark, "memories")
    m = adapt.memories(spark, d).select("slug", "title", "created_at", "updated_at", "recall_count", "doc_id")
    stored.create(m, path, "slug", 16)
    new = m.where("doc_id % 4 = 0").withColumns({"title": F.lit("new"), "created_at": F.col("updated_at"), "recall_count": F.lit(99).cast("bigint")})
    batch = new.unionByName(m.where("doc_id % 4 = 1").withColumn("slug", F.concat(F.lit("more-"), "slug")))
    for _ in range(2):
        stored.upsert(batch, path, "slug", lifecycle.upsert_memories)
    stored.remove(m.where("doc_id % 5 = 2").select("slug"), path, "slug")
    return _stamped(stored.read(spark, path).select("slug", "title", "created_at", "recall_count"))


def _fires(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: each type's counter starts anew at 7, and half a day passes between those that count."""
    out, given = fresh_path(spark, "fires"), read(spark, d, "events")
    rows = spark.readStream.schema(given.schema).parquet(f"{d}/events*.parquet")
    events = rows.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("user_id") % 3).alias("n"))
    with streams.rocks(spark):
        query = streams.due(events, 7, 43_200).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return _stamped(spark.read.parquet(out))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(F.concat(F.lit("m"), o).alias("memory_id"), F.when(o % 3 == 0, "session").otherwise("fact").alias("type"), F.lit("s").alias("scope_hash"), F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("created_at"), F.lit(0).alias("pos"), (o % 11 != 0).alias("active"))
    return graph.supersede_candidates(rows, rows.where(F.substring("memory_id", 2, 20).cast("bigint") % 7 == 0).select("memory_id"))


def _view(spark: SparkSession, d: str) -> DataFrame:
    edges = adapt.relations(spark, d).where("predicate = 'belongs_to'")
    return graph.cytoscape(edges.select(F.col("subject_id").alias("node")), edges)


def _registered(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = read(spark, d, "nation").select(F.concat(F.lit("h"), n % 10).alias("scope_hash"), F.col("n_name").alias("scope_root"), n.cast("bigint").alias("at"))
    return security.register_scopes(rows.where("at < 10"), rows.where("at >= 10"), rows.where("at = 3").select("scope_hash"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The own entries, those that landed before, a bundle, and its audit log, which decides the type of some."""
    i = F.substring("id", 5, 20).cast("bigint")
    none = F.array().cast("array<string>")
    local, remote = (adapt.entries(spark, d, remote=r).withColumns({"tags": F.when(i % 3 == 0, F.array(F.lit("all"))).otherwise(F.col("tags")), "merge_notes": none}) for r in (False, True))
    landing = remote.where((i % 13 == 0) & (i % 2 == 0)).withColumns({"content_hash": F.lit("landed"), "updated_at": i * 10.0})
    audit = remote.where(i % 16 == 1).select(i.alias("seq"), F.lit(1.0).alias("ts"), F.lit("update").alias("action"), F.col("id").alias("target_id"), F.array(F.lit("content_hash")).alias("changed_fields"), F.create_map(F.lit("content_hash"), F.lit("audited")).alias("after"))
    return local, landing, remote, audit


def _imported(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        local, landing, remote, audit = _sides(spark, d)
        after, counts = sync.imported(local, landing, remote, strategy, audit)
        wide = counts.unpivot([], counts.columns, "id", "n").select("id", F.col("n").cast("string").alias("content_hash"), F.lit("").alias("notes"), F.lit("count").alias("place"))
        noted = F.when(F.array_contains("merge_notes", "pending-user-decision"), "pending").when(F.size("merge_notes") > 0, F.substring(F.col("merge_notes")[0], 1, 25)).otherwise("")
        return after.select("id", "content_hash", noted.alias("notes"), F.lit("landing").alias("place")).union(wide)

    return query


def _import_twin(changed: str, merged: str = "0 * count(*)") -> str:
    """changed: id, content_hash, notes of the met entries that land. Own entries are met before those that landed."""
    return _with(
        "mine theirs",
        f""", landed AS (SELECT id, 'landed' AS content_hash, doc_id * 10.0::DOUBLE AS updated_at, doc_id FROM theirs WHERE doc_id % 26 = 0),
        twins AS (SELECT id, content_hash, updated_at FROM mine UNION ALL SELECT id, content_hash, updated_at FROM landed WHERE id NOT IN (SELECT id FROM mine)),
        met AS (SELECT t.id, t.doc_id, t.content_hash AS theirs_hash, w.content_hash AS own_hash, t.updated_at AS their_time, w.updated_at AS own_time FROM theirs t JOIN twins w ON w.id = t.id),
        fresh AS (SELECT id, content_hash, '' AS notes FROM theirs WHERE id NOT IN (SELECT id FROM twins)), changed AS ({changed}), lands AS (SELECT * FROM fresh UNION ALL SELECT * FROM changed)
        SELECT id, content_hash, notes, 'landing' AS place FROM lands UNION ALL SELECT id, content_hash, '', 'landing' FROM landed WHERE id NOT IN (SELECT id FROM lands)
        UNION ALL SELECT 'imported', CAST(count(*) AS VARCHAR), '', 'count' FROM fresh UNION ALL SELECT 'conflicts_resolved', CAST(count(*) AS VARCHAR), '', 'count' FROM changed
        UNION ALL SELECT 'merged', CAST({merged} AS VARCHAR), '', 'count' FROM changed UNION ALL SELECT 'skipped', CAST((SELECT count(*) FROM met) - count(*) AS VARCHAR), '', 'count' FROM changed""",
    )


def _bundled(spark: SparkSession, d: str) -> DataFrame:
    """section, id, value: what a bundle of all tables holds after it was read, exported again and read again."""
    i = F.col("doc_id")
    tags = F.to_json(F.struct(F.col("lang"), (i % 7).alias("week"), F.array(i % 3, F.lit(None).cast("bigint")).alias("seen")))
    memories_ = read(spark, d, "documents").select(
        F.concat(F.lit("doc-"), i).alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("scope"), F.col("source").isin("src0", "src1").alias("sensitive"), F.parse_json(tags).alias("metadata")
    )
    given = {"memories": memories_, "entities": graph.upsert_entities(adapt.mentions(spark, d)).select("id", "name", "mention_count"), "relations": adapt.relations(spark, d).drop("active", "ord"), "versions": _versions(spark, d), "audit": read(spark, d, "events").select("event_id", "props")}
    for _ in range(2):
        path = fresh_path(spark, "bundle")
        bundles.export(spark, path, **given, passphrase="passphrase", spill=4096, compression="gzip")
        given = bundles.read(spark, path, "passphrase")
        given["versions"] = given.pop("profile")
    part = lambda name, id_, value: given[name].select(F.lit(name).alias("section"), id_.cast("string").alias("id"), value.cast("string").alias("value"))
    out = part("memories", F.col("id"), F.concat_ws("|", F.sha2("content", 256), "scope", F.col("sensitive").cast("string"), F.to_json("metadata")))
    out = out.union(part("entities", F.col("id"), F.concat_ws("|", "name", "mention_count")))
    out = out.union(part("relations", F.col("subject_id"), F.concat_ws("|", "predicate", "object_id", "source_memory_id", F.col("confidence") * 100)))
    return out.union(part("versions", F.col("version_num"), F.col("content_md"))).union(part("audit", F.col("event_id"), F.sha1("props")))


def _local_entries(spark: SparkSession, d: str) -> DataFrame:
    local, remote = (adapt.entries(spark, d, remote=r) for r in (False, True))
    return sync.local_entries(remote, local, remote.where(F.substring("id", 5, 20).cast("bigint") % 2 == 0))


def _by_type(spark: SparkSession, d: str) -> DataFrame:
    m = adapt.memories(spark, d)
    return reports.import_by_type(m.select("slug", "type"), m.where("doc_id % 3 = 0"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = read(spark, d, "documents")
    return graph.ingest_stats(docs.where(i % 4 != 0).select(i.alias("id"), "text", "lang"), docs.select(i.alias("id"), F.when(i % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" b"))).otherwise(F.col("text")).alias("text"), "lang"))


def _diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines added and taken away by diffs of texts whose second line is replaced."""
    i = F.col("doc_id").cast("string")
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("one\ntwo "), i, F.lit("\nthree")).alias("before"), F.concat(F.lit("one\n"), F.when(F.col("doc_id") % 2 == 0, "two ").otherwise("other "), i, F.lit("\nthree")).alias("after"))
    return rows.select("doc_id", F.array_join(text.unified_diff("before", "after"), "|").alias("diff"))


def _handoff(spark: SparkSession, d: str) -> DataFrame:
    return reports.handoff_signals(adapt.memories(spark, d), adapt.recent_entities(spark, d), "2024-01-12 00:00:00", 14)


def _dashboard(spark: SparkSession, d: str) -> DataFrame:
    return reports.dashboard_counts(adapt.memories(spark, d), adapt.promotions(spark, d), graph.upsert_entities(adapt.mentions(spark, d)), adapt.sensitive_scopes(spark, d), adapt.relations(spark, d), _versions(spark, d))


def _of_text(name: str, f) -> object:
    return lambda spark, d: read(spark, d, "documents").select("doc_id", f(F.coalesce("text", F.lit(""))).alias(name))


def _increment(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select(F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("trigger"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id") % 3)).alias("scope_hash"), F.to_date("ts").alias("day"))
    return trends.increment(None, events).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _insert(spark: SparkSession, d: str) -> DataFrame:
    return _stamped(lifecycle.insert_promotions(adapt.promotions(spark, d), "2024-03-01 00:00:00").select("id", "proposed_title", "status", "decided_at"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("s"), F.col("vec_id") % 17).alias("source"), "label")


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    ranked = lambda order: read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank")).where("rank <= 50")
    return search.dense_bm25(ranked([F.desc("p_retailprice"), F.col("p_partkey")]), ranked([F.desc("p_size"), F.col("p_partkey")])).withColumn("score", F.round("score", 6))


def _sensitive(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.mark_sensitive(adapt.memories(spark, d), adapt.sensitive_scopes(spark, d)).select("slug", "body_path", "scope_sensitive")


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("id"), o.alias("seq"), F.array(F.concat(F.lit("a"), o % 3), F.lit("z")).alias("aliases"))
    return graph.merge_aliases(rows).select("id", F.array_join("aliases", ",").alias("aliases"))


def _grants(spark: SparkSession, d: str) -> DataFrame:
    grants = read(spark, d, "events").select("event_id", F.col("ts").alias("expires_at"))
    return security.valid_grants(grants, "2024-01-20 00:00:00").select("event_id")


def _queries() -> dict[str, tuple[object, str]]:
    memory = lambda f: lambda spark, d: _stamped(f(adapt.memories(spark, d)))
    entities = lambda spark, d: graph.upsert_entities(adapt.mentions(spark, d))
    brand = "entity:tool:brand_11"
    deltas = "'--- prev|+++ new|@@ -1,3 +1,3 @@| one|-two ' || doc_id || '|+other ' || doc_id || '| three'"
    return {
        "parse_markdown": (_markdown, _with("memories", "SELECT slug, type, CAST(length(scope_hash) AS INTEGER) AS n_scope, CAST(ttl_days AS INTEGER) AS ttl_days, recall_count, sha1(ltrim(body, chr(10))) AS body_sha1 FROM memories")),
        "rebuild_index": (lambda s, d: readers.index_report(_front(s, d)), "SELECT count(*) AS indexed, CAST(0 AS BIGINT) AS errors FROM documents"),
        "file_layout": (lambda s, d: readers.layout(_files(s, d).select("path")), _with("memories", f"SELECT path, scope_hash, type, slug FROM ({FILES}) WHERE doc_id % 7 <> 0")),
        "files_of_type": (lambda s, d: readers.files_of_type(_files(s, d).select("path"), "fact"), _with("memories", f"SELECT scope_hash, slug, path FROM ({FILES}) WHERE doc_id % 7 <> 0 AND type = 'fact'")),
        "recent_files": (lambda s, d: _stamped(readers.recent_files(_files(s, d).select("path", "modified"))), _with("memories", f"SELECT path, slug, {STAMP.format('updated_at')} AS modified FROM ({FILES}) WHERE doc_id % 7 <> 0 ORDER BY updated_at DESC, path LIMIT 5")),
        "scan_transcript": (_transcripts, "SELECT conv_id AS file, turn AS n, sha1(text) AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3 AND text <> ''"),
        "import_sections": (
            _sections,
            """SELECT doc_id AS file, '2024-01-01-' || s AS slug, type, title, body FROM documents, LATERAL (VALUES ('decision-' || doc_id, 'decision', 'Decision ' || doc_id, 'alpha ' || doc_id),
            ('how-to-' || doc_id, 'playbook', 'How to ' || doc_id, 'beta'), ('decision-' || doc_id || '-1', 'decision', 'Decision ' || doc_id, 'gamma')) t(s, type, title, body)""",
        ),
        "import_memories_json": (_json_memories, "SELECT 'Title ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'decision' ELSE 'warning' END AS type, CAST(least(length(text) + 1, 8000) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL"),
        "import_auto_memory": (_auto, "SELECT 'auto-note-' || doc_id AS slug, 'N' || doc_id AS title, 'playbook' AS type, 'body ' || doc_id AS body FROM documents WHERE doc_id % 5 <> 0"),
        "resolve_chunk": (_spilled, "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'own ' || doc_id WHEN doc_id % 3 = 0 THEN 'side ' || doc_id END AS content FROM documents"),
        "handoff_snapshots": (_snapshots, "SELECT '/h/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey || '.md' AS path, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders ORDER BY 2 DESC, 1 LIMIT 12"),
        "scope_of_content": (_roots, "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 AND doc_id % 5 > 0 THEN '/srv/a0/b' WHEN doc_id % 4 = 1 AND doc_id % 5 > 0 THEN '/srv/a1' WHEN doc_id % 4 > 1 AND doc_id % 5 = 0 THEN '/opt/z' END AS root FROM documents"),
        "upsert_memory": (
            _upserted,
            _with("memories", f"SELECT slug, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE title END AS title, {STAMP.format('created_at')} AS created_at, recall_count FROM memories UNION ALL SELECT 'more-' || slug, title, {STAMP.format('created_at')}, recall_count FROM memories WHERE doc_id % 4 = 1"),
        ),
        "stored_upsert": (
            _stored,
            _with("memories", f"SELECT slug, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE title END AS title, {STAMP.format('created_at')} AS created_at, recall_count FROM memories WHERE doc_id % 5 <> 2 UNION ALL SELECT 'more-' || slug, title, {STAMP.format('created_at')}, recall_count FROM memories WHERE doc_id % 4 = 1"),
        ),
        "stream_fires": (
            _fires,
            f"""WITH RECURSIVE e AS (SELECT event_type AS key, ts, user_id % 3 AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE user_id % 3 > 0),
            walk AS (SELECT key, CAST(0 AS BIGINT) AS i, NULL::TIMESTAMP AS ts, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS rest, NULL::TIMESTAMP AS last, FALSE AS passed FROM (SELECT DISTINCT key FROM e)
            UNION ALL SELECT key, i, ts, n, CASE WHEN n >= 7 THEN 0 ELSE n END, CASE WHEN n >= 7 AND free THEN ts ELSE last END, free
            FROM (SELECT e.key, e.i, e.ts, walk.rest + e.n AS n, walk.last, walk.last IS NULL OR epoch(e.ts) - epoch(walk.last) >= 43200 AS free FROM walk JOIN e ON e.key = walk.key AND e.i = walk.i + 1))
            SELECT key, {STAMP.format('ts')} AS ts, n, passed FROM walk WHERE n >= 7""",
        ),
        "delete_memory": (lambda s, d: lifecycle.delete_memories(adapt.memories(s, d).where("doc_id % 5 = 0").select("slug"), (adapt.triggers(s, d), "slug"))[0].select("slug", "trigger"), _with("triggers", f"SELECT slug, trigger FROM triggers WHERE slug NOT IN ({GONE})")),
        "merge_scopes": (memory(lambda m: lifecycle.retag_scope(m.select("slug", F.col("source").alias("scope_hash")), "src3", "src4")), "SELECT 'doc-' || doc_id AS slug, CASE WHEN source = 'src3' THEN 'src4' ELSE source END AS scope_hash FROM documents"),
        "mark_sensitive": (_sensitive, _with("memories", "SELECT slug, CASE WHEN scope_sensitive THEN body_path || '.enc' ELSE body_path END AS body_path, scope_sensitive FROM memories")),
        "register_sensitive_scope": (_registered, "SELECT 'h' || (n_nationkey % 10) AS scope_hash, arg_max(n_name, n_nationkey) AS scope_root, CAST(max(n_nationkey) AS BIGINT) AS at FROM nation WHERE n_nationkey % 10 <> 3 GROUP BY 1"),
        "increment_trigger": (_increment, "SELECT event_type AS trigger, CASE WHEN user_id % 3 <> 0 THEN 'u' || (user_id % 3) ELSE '_global' END AS scope_hash, strftime(ts, '%Y-%m-%d') AS day, count(*) AS hits FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2, 3"),
        "save_profile_version": (_next_versions, "SELECT CAST(r_regionkey + 1 AS BIGINT) AS version_num, r_name AS content_md FROM region UNION ALL SELECT (SELECT max(r_regionkey) + 1 FROM region) + row_number() OVER (ORDER BY n_nationkey), n_name FROM nation"),
        "save_change_report": (_saved_reports, "SELECT strftime(o_orderdate, '%Y-%m') AS period, max(o_orderkey) AS generated_at FROM orders GROUP BY 1"),
        "insert_promotion": (
            _insert,
            _with("promotions", "SELECT id, 'Candidate ' || id AS proposed_title, CASE WHEN mean >= 0.85 THEN 'approved' WHEN mean < 0.5 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN mean >= 0.85 THEN '2024-03-01 00:00:00' END AS decided_at FROM promotions"),
        ),
        "list_promotions": (
            lambda s, d: lifecycle.list_promotions(adapt.promotions(s, d), adapt.sensitive_scopes(s, d)).select("id", "status", "scope_hash"),
            _with("promotions sensitive", "SELECT id, status, scope_hash FROM promotions WHERE status = 'pending' AND scope_hash NOT IN (SELECT scope_hash FROM sensitive) ORDER BY created_at DESC, id DESC LIMIT 50"),
        ),
        "list_pending": (lambda s, d: lifecycle.list_pending(adapt.promotions(s, d)).select("id"), _with("promotions", "SELECT id FROM promotions WHERE status = 'pending' ORDER BY id DESC LIMIT 200")),
        "find_by_fingerprint": (memory(lambda m: listing.find_by_fingerprint(m.withColumn("fingerprint", F.sha1("source")), F.sha1(F.lit("src5"))).select("slug")), "SELECT 'doc-' || doc_id AS slug FROM documents WHERE source = 'src5'"),
        "scope_filter": (memory(lambda m: listing.scoped(m.withColumn("scope_hash", F.col("source")), "src5").select("slug")), "SELECT 'doc-' || doc_id AS slug FROM documents WHERE source = 'src5'"),
        "wanted_columns": (memory(lambda m: listing.wanted_columns(m, ["slug", "missing", "type"])), _with("memories", "SELECT slug, type FROM memories")),
        "list_entities": (lambda s, d: _stamped(graph.list_entities(entities(s, d), "person", "n3").select("id", "last_seen_at")), _with("entities", f"SELECT id, {STAMP.format('entities.last_seen_at')} AS last_seen_at FROM entities WHERE scope_hash = 'n3'")),
        "top_open_entities": (
            lambda s, d: graph.top_open_entities(entities(s, d), s.createDataFrame([("n3",), ("n7",)], "scope_hash string"), "1998-06-01 00:00:00").select("id", "mention_count"),
            _with("entities", "SELECT id, mention_count FROM (SELECT * FROM entities WHERE last_seen_at >= TIMESTAMP '1998-06-01' ORDER BY mention_count DESC, last_seen_at DESC, id LIMIT 20) WHERE scope_hash NOT IN ('n3', 'n7') ORDER BY mention_count DESC, last_seen_at DESC, id LIMIT 10"),
        ),
        "alias_union": (
            _aliases,
            """SELECT id, string_agg(alias, ',' ORDER BY seq, pos) AS aliases FROM (SELECT id, alias, min(seq) AS seq, arg_min(pos, seq) AS pos FROM (SELECT o_custkey % 50 AS id, o_orderkey AS seq, 'a' || (o_orderkey % 3) AS alias, 0 AS pos FROM orders
            UNION ALL SELECT o_custkey % 50, o_orderkey, 'z', 1 FROM orders) GROUP BY id, alias) GROUP BY id""",
        ),
        "get_relations": (lambda s, d: graph.get_relations(adapt.relations(s, d), object_=brand, predicate="uses").select("subject_id", "ord"), _with("relations", f"SELECT subject_id, ord FROM relations WHERE active AND object_id = '{brand}' AND predicate = 'uses'")),
        "memories_about": (lambda s, d: graph.memories_about(_mention_edges(s, d), PERSON), f"SELECT DISTINCT replace(subject_id, 'memory:', '') AS slug FROM ({MENTION_EDGES}) WHERE active AND object_id = '{PERSON}'"),
        "mark_superseded": (_superseded, _with("relations", "SELECT active AND ord % 5 <> 0 AS active, ord % 5 = 0 AS marked, count(*) AS n FROM relations GROUP BY 1, 2")),
        "add_supersede": (lambda s, d: _stamped(graph.add_supersedes(_doubled(s, d)).select("newer", "older", "decided_at")), _with("chain", f"SELECT newer, older, {STAMP.format('max(o_orderdate) + INTERVAL 1 DAY')} AS decided_at FROM chain WHERE before IS NOT NULL GROUP BY 1, 2")),
        "supersedes_for": (
            lambda s, d: _stamped(graph.supersedes_for(adapt.supersedes(s, d), "memory:o7").select(F.lit("for").alias("side"), F.col("older").alias("other"), "decided_at").union(graph.superseded_by(adapt.supersedes(s, d), "memory:o7").select(F.lit("by"), "newer", "decided_at"))),
            _with("chain", f"SELECT CASE WHEN newer = 'memory:o7' THEN 'for' ELSE 'by' END AS side, CASE WHEN newer = 'memory:o7' THEN older ELSE newer END AS other, {STAMP.format('o_orderdate')} AS decided_at FROM chain WHERE before IS NOT NULL AND 'memory:o7' IN (newer, older)"),
        ),
        "supersede_candidates": (
            _candidates,
            """SELECT 'm' || n.o_orderkey AS new, 'm' || o.o_orderkey AS old, n.o_custkey AS entity_id FROM orders n JOIN orders o USING (o_custkey) WHERE n.o_orderkey % 7 = 0 AND o.o_orderkey % 7 <> 0 AND o.o_orderkey % 3 <> 0 AND o.o_orderkey % 11 <> 0""",
        ),
        "ingest_entities": (
            lambda s, d: _extracted(s, d)[0].select("id", "mention_count"),
            f"""WITH told AS ({TOLD}), ends AS ({ENDS}), firsts AS (SELECT id, arg_min(kind, (seen, k, kind, pos)) AS kind FROM (SELECT seen, k, kind, pos, id FROM told UNION ALL SELECT seen, k, kind, pos, id FROM ends) GROUP BY id)
            SELECT id, (SELECT count(*) FROM told WHERE told.id = firsts.id) + kind AS mention_count FROM firsts""",
        ),
        "ingest_edges": (
            lambda s, d: _extracted(s, d)[1].select("subject_id", "predicate", "object_id", "source_memory_id", "ord"),
            f"""WITH told AS ({TOLD}) SELECT 'memory:' || k AS subject_id, 'mentions' AS predicate, id AS object_id, CAST(k AS VARCHAR) AS source_memory_id, k AS ord FROM told
            UNION ALL SELECT CASE WHEN k % 4 = 0 THEN person ELSE tool END, 'uses', CASE WHEN k % 4 = 0 THEN tool ELSE person END, CAST(k AS VARCHAR), k FROM ({TAKEN})""",
        ),
        "ingest_counts": (
            lambda s, d: _extracted(s, d)[2],
            f"""WITH told AS ({TOLD}), ends AS ({ENDS}), firsts AS (SELECT id, arg_min(kind, (seen, k, kind, pos)) AS kind FROM (SELECT seen, k, kind, pos, id FROM told UNION ALL SELECT seen, k, kind, pos, id FROM ends) GROUP BY id)
            SELECT (SELECT count(*) FROM firsts WHERE kind = 0) AS entities_added, (SELECT count(*) FROM told) - (SELECT count(*) FROM firsts WHERE kind = 0) AS entities_updated,
            (SELECT count(*) FROM ({TAKEN})) AS relations_added, (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 3) - (SELECT count(*) FROM ({TAKEN})) AS relations_skipped""",
        ),
        "ingest_stats": (_stats, "SELECT count(*) FILTER (doc_id % 4 = 0) AS added, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 3 = 0) AS updated, count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 3 <> 0) AS unchanged FROM documents"),
        "to_cytoscape": (
            _view,
            """, e AS (SELECT * FROM relations WHERE predicate = 'belongs_to') SELECT '{"data":{"id":"' || subject_id || '"}}' AS element FROM e
            UNION ALL SELECT '{"data":{"id":"' || subject_id || '--belongs_to->' || object_id || '","source":"' || subject_id || '","target":"' || object_id || '","label":"belongs_to"}}' FROM e""",
        ),
        "list_versions": (lambda s, d: reports.list_versions(_versions(s, d), "1995-03-01 00:00:00", "1996-01-15 12:00:00").select("version_num", "page"), "SELECT o_orderkey AS version_num, CAST(o_custkey % 20 AS VARCHAR) AS page FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-01-15 12:00:00'"),
        "profile_list": (lambda s, d: reports.newest_versions(_versions(s, d), 24).select("version_num"), "SELECT o_orderkey AS version_num FROM orders ORDER BY 1 DESC LIMIT 24"),
        "version_diff": (
            lambda s, d: reports.version_changes(_versions(s, d)),
            """SELECT page, version_num, lag(after) OVER w AS before, after, lag(after) OVER w IS DISTINCT FROM after AS changed FROM (SELECT CAST(o_custkey % 20 AS VARCHAR) AS page, o_orderkey AS version_num, CAST(o_orderkey % 3 + 1 AS INTEGER) AS after FROM orders)
            WINDOW w AS (PARTITION BY page ORDER BY version_num)""",
        ),
        "document_hunks": (
            _document_hunks,
            "SELECT source AS page, doc_id AS version_num, sha1(coalesce(text, '')) AS patched_sha1, coalesce(text, '') IS DISTINCT FROM lag(coalesce(text, '')) OVER (PARTITION BY source ORDER BY doc_id) AS changed FROM documents",
        ),
        "version_hunks": (
            _version_hunks,
            r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS a, regexp_replace(coalesce(text, ''), '(?m)^([^\n]{1,60})$', 'short: \1', 'g') AS b FROM documents), u AS (SELECT *, regexp_replace(b, '^[^\n]*\n', '') AS c FROM t),
            v AS (SELECT doc_id AS page, unnest([0, 1, 2, 3]) AS version_num, unnest([a, b, c, 'new' || chr(10) || c || chr(10) || 'last']) AS x, unnest([NULL, a, b, c]) AS was FROM u)
            SELECT page, version_num, sha1(x) AS patched_sha1, x IS DISTINCT FROM was AS changed FROM v""",
        ),
        "diff_lines": (_diff_counts, f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE {deltas} END AS diff FROM documents"),
        "import_prefer_remote": (_imported("prefer-remote"), _import_twin("SELECT id, theirs_hash AS content_hash, '' AS notes FROM met")),
        "import_prefer_local": (_imported("prefer-local"), _import_twin("SELECT id, theirs_hash AS content_hash, '' AS notes FROM met WHERE FALSE")),
        "import_ask": (_imported("ask"), _import_twin("SELECT id, theirs_hash AS content_hash, 'pending' AS notes FROM met")),
        "import_merge": (
            _imported("merge"),
            _import_twin(
                """SELECT id, kept AS content_hash, CASE WHEN own_hash = theirs_hash THEN '' ELSE 'content-conflict: kept ' || CASE WHEN their_time >= own_time THEN 're' ELSE 'lo' END END AS notes
                FROM (SELECT *, CASE WHEN own_hash = theirs_hash THEN own_hash WHEN doc_id % 16 = 1 THEN 'audited' WHEN their_time >= own_time THEN theirs_hash ELSE own_hash END AS kept FROM met)
                WHERE kept <> own_hash OR (doc_id % 3 <> 0 AND id IN (SELECT id FROM mine))""",
                "count(*)",
            ),
        ),
        "bundle_round_trip": (
            _bundled,
            _with(
                "entities relations",
                """SELECT 'memories' AS section, 'doc-' || doc_id AS id, sha256(coalesce(text, '')) || '|' || source || '|' || (source IN ('src0', 'src1')) || '|{"lang":"' || lang || '","seen":[' || (doc_id % 3) || ',null],"week":' || (doc_id % 7) || '}' AS value FROM documents
                UNION ALL SELECT 'entities', id, name || '|' || mention_count FROM entities
                UNION ALL SELECT 'relations', subject_id, concat_ws('|', predicate, object_id, source_memory_id, CASE predicate WHEN 'located_at' THEN '90.0' WHEN 'belongs_to' THEN '100.0' ELSE '70.0' END) FROM relations
                UNION ALL SELECT 'versions', CAST(max(o_orderkey) AS VARCHAR), repeat('x', CAST(max(o_orderkey) % 3 + 1 AS BIGINT)) FROM orders UNION ALL SELECT 'audit', CAST(event_id AS VARCHAR), sha1(props) FROM events""",
            ),
        ),
        "local_entries": (
            _local_entries,
            _with("mine theirs", "SELECT r.id, coalesce(l.content_hash, CASE WHEN r.doc_id % 2 = 0 THEN r.content_hash END) AS content_hash, CASE WHEN l.id IS NOT NULL THEN 'memories' WHEN r.doc_id % 2 = 0 THEN 'landing' END AS found_in FROM theirs r LEFT JOIN mine l ON l.id = r.id"),
        ),
        "import_by_type": (_by_type, _with("memories", "SELECT type, count(*) FILTER (doc_id % 3 <> 0) AS written, count(*) FILTER (doc_id % 3 = 0) AS skipped FROM memories GROUP BY 1")),
        "handoff_signals": (
            _handoff,
            _with(
                "memories recent",
                """, r AS (SELECT type AS kind, slug AS item, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, slug) AS rank FROM memories WHERE type IN ('decision', 'warning', 'session') AND created_at >= TIMESTAMP '2023-12-29' AND NOT scope_sensitive AND decay_state <> 'soft-forgotten')
                SELECT kind, item, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE kind WHEN 'decision' THEN 12 WHEN 'warning' THEN 8 ELSE 5 END
                UNION ALL SELECT 'entity', id, CAST(rank AS INTEGER) FROM (SELECT id, row_number() OVER (ORDER BY mention_count DESC, last_seen_at DESC, id) AS rank FROM recent WHERE last_seen_at >= TIMESTAMP '2023-12-29') WHERE rank <= 10""",
            ),
        ),
        "dashboard_counts": (
            _dashboard,
            _with(
                "memories promotions entities sensitive relations",
                """SELECT 'memories' AS name, count(*) AS n FROM memories UNION ALL SELECT 'shown', count(*) FROM memories WHERE decay_state <> 'soft-forgotten' UNION ALL SELECT 'decayed', count(*) FROM memories WHERE decay_state <> 'alive'
                UNION ALL SELECT 'sensitive', count(*) FROM memories WHERE scope_sensitive UNION ALL SELECT 'scopes', count(DISTINCT scope_hash) FROM memories UNION ALL SELECT 'pending', count(*) FROM promotions WHERE status = 'pending'
                UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'profile_versions', count(*) FROM orders UNION ALL SELECT 'sensitive_scopes', count(*) FROM sensitive""",
            ),
        ),
        "trend_page": (
            lambda s, d: reports.trend_page(adapt.trigger_stats(s, d), adapt.memories(s, d), adapt.recent_entities(s, d), EVENTS_NOW),
            _with(
                "trigger_stats memories recent",
                """, t AS (SELECT trigger, CAST(sum(hits) AS BIGINT) AS total FROM trigger_stats WHERE day >= DATE '2024-01-24' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
                r AS (SELECT trigger, coalesce(sum(hits) FILTER (day >= DATE '2024-01-24'), 0) - coalesce(sum(hits) FILTER (day >= DATE '2024-01-10' AND day < DATE '2024-01-24'), 0) AS n FROM trigger_stats GROUP BY 1 HAVING n > 0 ORDER BY 2 DESC, 1 LIMIT 8),
                h AS (SELECT slug, recall_count FROM memories WHERE recall_count >= 2 AND type <> 'session' AND NOT scope_sensitive AND decay_state <> 'soft-forgotten' ORDER BY recall_count DESC, last_recalled_at DESC NULLS LAST, slug LIMIT 8),
                e AS (SELECT id, mention_count FROM recent WHERE last_seen_at >= TIMESTAMP '2024-01-03' ORDER BY mention_count DESC, last_seen_at DESC, id LIMIT 10)
                SELECT 'top' AS kind, trigger AS item, total AS n FROM t UNION ALL SELECT 'rising', trigger, CAST(n AS BIGINT) FROM r UNION ALL SELECT 'hot', slug, recall_count FROM h UNION ALL SELECT 'entity', id, mention_count FROM e""",
            ),
        ),
        "grant_valid": (_grants, "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20'"),
        "vector_query": (lambda s, d: search.vector_query(_vectors(s, d), "source = 's3' AND label > 2").select("chunk_id", "label"), "SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id % 17 = 3 AND label > 2"),
        "vector_delete": (lambda s, d: search.vector_count(search.vector_delete(_vectors(s, d), s.createDataFrame([("s3",), ("s4",)], "source string"))), "SELECT 's' || (vec_id % 17) AS source, count(*) AS n FROM embeddings WHERE vec_id % 17 NOT IN (3, 4) GROUP BY 1"),
        "dense_bm25_rrf": (
            _scaled,
            """SELECT id, round(sum(1.0::DOUBLE / (60 + rank)) / (2.0::DOUBLE / 61), 6) AS score FROM (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part
            UNION ALL SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) FROM part) WHERE rank <= 50 GROUP BY 1""",
        ),
        "summarize": (_of_text("n", lambda c: F.sha1(text.summarise(c))), "SELECT doc_id, sha1(CASE WHEN length(coalesce(text, '')) > 2000 THEN substr(text, 1, 2000) || chr(10) || chr(10) || '…(truncated)' ELSE coalesce(text, '') END) AS n FROM documents"),
        "quote_block": (_of_text("quoted", lambda c: F.sha1(text.quote_block(c))), "SELECT doc_id, sha1(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '>' ELSE '> ' || x END), chr(10))) AS quoted FROM documents"),
        "format_date": (lambda s, d: read(s, d, "orders").select("o_orderkey", text.format_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("date")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders"),
        "change_summary": (
            lambda s, d: read(s, d, "orders").select("o_orderkey", text.change_summary(F.concat(F.lit("intro\n**Change summary**: moved "), "o_orderpriority", F.lit("\nend"))).alias("summary")),
            "SELECT o_orderkey, 'moved ' || o_orderpriority AS summary FROM orders",
        ),
        "map_type": (lambda s, d: read(s, d, "part").select("p_partkey", text.map_type(F.concat(F.lit("My-"), F.get(F.array(*[F.lit(x) for x in ("Decisions", "prefs", "note", "Process")]), (F.col("p_partkey") % 4).cast("int")))).alias("type")), "SELECT p_partkey, ['decision', 'preference', 'fact', 'playbook'][p_partkey % 4 + 1] AS type FROM part"),
        "meaningful": (
            _of_text("kept", lambda c: text.meaningful(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Head "), "doc_id", F.lit("\n<!-- x -->\n "), F.when(F.col("doc_id") % 2 == 0, F.lit("a ")).otherwise("##\nab"))).otherwise(c))),
            r"""SELECT doc_id, length(trim(array_to_string(list_filter(string_split_regex(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '\r\n|[\n\r\x0b\x0c]'), lambda x: NOT regexp_matches(x, '^#{1,6}\s+.+$')), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 2 AS kept
            FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Head ' || doc_id || chr(10) || '<!-- x -->' || chr(10) || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'a ' ELSE '##' || chr(10) || 'ab' END ELSE coalesce(text, '') END AS t FROM documents)""",
        ),
    }


def queries() -> dict[str, object]:
    return {name: query for name, (query, _) in _queries().items()}


def sql() -> dict[str, str]:
    fixed = {"to_cytoscape": "relations"}
    return {name: (_with(fixed[name], twin) if name in fixed else twin) for name, (_, twin) in _queries().items()}
