"""The queries of the memory operators, on tables derived from the driver's."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import extract, graph, index, lifecycle, listing, ordered, search, security, sync, trends
from tessera.plans import adapt, more, oracles, others
from tessera.plans.adapt import EVENTS_NOW, NOW, read, stamp
from tessera.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
KEY = "00" * 31 + "07"
BRAND = "entity:tool:brand_11"


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, times as text."""
    kinds = dict(df.dtypes)
    return df.select(*[stamp(c).alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in columns])


def _memory_query(f: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(adapt.memories(spark, sf_dir))
        return _shown(out, *(columns or out.columns))

    return query


def _text_query(name: str, f: Callable[[], F.Column], table: str = "documents", key: str = "doc_id", column: str = "text") -> Query:
    return lambda spark, d: read(spark, d, table).select(key, f(F.coalesce(column, F.lit(""))).alias(name))


def _two(f: Callable[..., DataFrame], *tables: Callable, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> Query:
    return lambda spark, d: then(f(*[t(spark, d) for t in tables]))


def _title_line(column: F.Column) -> F.Column:
    return text.first_line(column)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return listing.neighbours(adapt.memories(spark, d), adapt.memories(spark, d).where(F.col("slug").isin("doc-50", "doc-100", "doc-131")), 3)


def _gate(spark: SparkSession, d: str) -> DataFrame:
    requests = adapt.memories(spark, d).select("slug", "scope_hash")
    sensitive = adapt.sensitive_scopes(spark, d)
    grants = sensitive.where("scope_root = 'src1'").select("scope_hash", F.expr("TIMESTAMP_NTZ '2024-06-01 00:01:00'").alias("expires_at"))
    return security.gate(requests, sensitive, grants, NOW).groupBy("scope_hash", "result").agg(F.count("*").alias("n"))


def _raw_predicates(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Used By", "owns", "located", "cited-by", "mentions", "likes", "part of")])
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("s"), F.col("o_custkey")).alias("subject_id"), F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("predicate"), F.concat(F.lit("o"), F.col("o_orderkey") % 10).alias("object_id"), (F.col("o_totalprice") % 100 / 50).alias("confidence"))
    return graph.normalise_relations(rows, 0.3, drop_unknown=False).withColumn("confidence", F.round("confidence", 6))


def _n_hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph.n_hop(adapt.relations(spark, d), spark.createDataFrame([(BRAND,)], "seed string"), 2)
    return nodes.select("node", "hops", F.lit("").alias("other"), F.lit("").alias("predicate")).union(edges.select("subject_id", F.lit(-1), "object_id", "predicate"))


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    hits = read(spark, d, "events").select(F.concat(F.lit("doc-"), i % 200).alias("slug"), F.col("ts").alias("at"))
    return _shown(lifecycle.record_recall(adapt.memories(spark, d), hits), "slug", "recall_count", "last_recalled_at", "decay_state")


def _merges(spark: SparkSession, d: str) -> DataFrame:
    """Drops of repeated fingerprints: all but the smallest slug of each."""
    rows = ordered.numbered(adapt.memories(spark, d).select("slug", "fingerprint", "doc_id"), "fingerprint", "doc_id", "slug")
    return rows.select(F.col("first_").alias("keep"), F.col("slug").alias("drop"), "pos").where("pos > 1")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = lifecycle.merge_duplicates(adapt.memories(spark, d), _merges(spark, d))
    return rows.select("slug", "pos", "merged_from", F.sha1("section").alias("section_sha1"), F.length("section").alias("n"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


def _bm25(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return search.bm25(read(spark, d, "documents"), _questions(spark, d), "doc_id", "text", k)


def _updated_index(spark: SparkSession, d: str) -> DataFrame:
    """A search after a third of the documents is revised and an eleventh goes."""
    path, docs, i = fresh_path(spark, "index"), read(spark, d, "documents"), F.col("doc_id")
    index.build(docs, path)
    revised = docs.where((i % 3 == 0) & (i % 11 != 0)).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" revised edition of was")))
    index.update(path, revised, docs.where(i % 11 == 0).select("doc_id"))
    return index.search(spark, path, _questions(spark, d), 10)


def _links(spark: SparkSession, d: str) -> DataFrame:
    return extract.linked(adapt.texts(spark, d), adapt.names(spark, d))


def _ingested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = adapt.texts(spark, d)
    return graph.ingest(*extract.extract(texts, adapt.names(spark, d)), texts.select(F.col("slug").alias("memory_id"), "scope_hash", "at", "seq"))


def _global_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph.global_graph(adapt.recent_entities(spark, d, tools=True), adapt.relations(spark, d), "2024-01-12 00:00:00", top=30, kind="tool")
    none = F.lit("")
    return nodes.select("node", "name", "type", "mention_count", none.alias("other"), none.alias("predicate")).union(edges.select("subject_id", none, none, F.lit(None).cast("bigint"), "object_id", "predicate"))


def _knn(spark: SparkSession, d: str, k: int = 10, which: str = "vec_id % 50 = 0") -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return search.knn(vectors, vectors.where(which).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), k)


def _keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    found = search.keyword_lines(adapt.memories(spark, d), r"\bwas\b").orderBy("line", "slug").limit(40)  # those that say it first
    return found.withColumn("rank", F.row_number().over(Window.orderBy("line", "slug"))).select(F.regexp_extract("slug", r"(\d+)$", 1).cast("bigint").alias("id"), "rank")


def _vector_hits(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, 40, "vec_id = 0").select("id", "rank")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    boosts = spark.createDataFrame([(3,), (7,), (11,)], "id bigint")
    types = adapt.memories(spark, d).select(F.col("doc_id").alias("id"), "type")
    return search.hybrid(_vector_hits(spark, d), _keyword_hits(spark, d), boosts, 20, 0.7, 1.0, types, ("decision", "fact", "session"))


def _score_and_rank(spark: SparkSession, d: str) -> DataFrame:
    mid, steep = search.bm25_curve(F.lit(8))
    raw = _bm25(spark, d, 100).where("query = 1").select("id", search.normalised_bm25(F.col("score"), mid, steep).alias("score"))
    boosts = spark.createDataFrame([(2, 0.5), (5, 0.5)], "id bigint, boost double")
    return search.score_and_rank(_knn(spark, d, 200, "vec_id = 50").select("id", "score"), raw, boosts, 0.05, 25)


def _bm25_normalised(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 20 + 1
    mid, steep = search.bm25_curve(n)
    return read(spark, d, "orders").select("o_orderkey", F.round(search.normalised_bm25(F.col("o_totalprice") / 20000, mid, steep), 6).alias("score"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = text.chunk_markdown(adapt.memories(spark, d))
    hashed = rows.withColumn("content_hash", ids.content_hash(F.col("content")))
    return hashed.withColumn("chunk_id", ids.chunk_id(F.col("source"), F.col("start_line"), F.col("end_line"), F.col("content_hash"), "hash-64"))


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """A log for each event type: an event's line as JSON."""
    event = F.to_json(F.struct(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("scope_hash"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_id").alias("seq")))
    return read(spark, d, "events").select(F.col("event_type").alias("log"), F.col("event_id").alias("n"), event.alias("event"))


def _audit_filter(spark: SparkSession, d: str) -> DataFrame:
    return security.audit_events(_audit(spark, d).withColumnRenamed("event", "line"), scope="u3", since="2024-01-15T00:00:00").select("n", "event_type", "scope_hash", "ts")


def _audit_verify(spark: SparkSession, d: str) -> DataFrame:
    """The first line broken by an edit: every log's thousandth event (or none) has another time."""
    lines = security.chained(_audit(spark, d))
    edited = lines.withColumn("line", F.when(F.col("n") % 1000 == 999, F.replace("line", F.lit("2024-"), F.lit("2023-"))).otherwise(F.col("line")))
    return security.broken_links(edited)


def _files(spark: SparkSession, d: str, side: str) -> DataFrame:
    e = adapt.entries(spark, d, remote=side == "remote")
    return e.select(F.concat_ws("/", F.lit("scopes"), F.replace("scope", F.lit("scope-"), F.lit("")), "id").alias("key"), F.substring("content_hash", 1, 16).alias("fingerprint"))


def _entries(side: str) -> Callable:
    return lambda spark, d: adapt.entries(spark, d, remote=side == "remote")


def _merge_fields(spark: SparkSession, d: str) -> DataFrame:
    out = sync.merge_entries(_entries("local")(spark, d), _entries("remote")(spark, d))
    return out.select("id", "content_hash", "memory_type", "scope", "created_at", "updated_at", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("relations", lambda r: r["object_id"]), ",").alias("objects"), F.size("merge_notes").alias("notes"))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the one before of its source: ids are put in order, texts are fetched by them."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    pairs = ordered.before(docs.select("doc_id", "source"), "source", "doc_id", "doc_id").select("doc_id", F.col("before_.value").alias("earlier"))
    texts = docs.select(F.col("doc_id").alias("earlier"), F.col("text").alias("before"))
    rows = docs.join(pairs, "doc_id").join(texts, "earlier", "left")
    return rows.select("doc_id", F.size(text.unified_diff("before", F.col("text").alias("after"))).alias("lines"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    found = search.vector_upsert(None, text.chunk_markdown(adapt.memories(spark, d)), search.hashing_embedder(), "hash-64")
    return found.select("chunk_id", "source", F.size("embedding").alias("size"))


def _supersede_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = adapt.supersedes(spark, d).withColumn("decision", F.when(F.col("confidence") < 0.9, "supersedes").otherwise("unrelated"))
    return graph.judged(rows).groupBy("action").agg(F.count("*").alias("n"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    p = adapt.promotions(spark, d)
    return lifecycle.decide(p, p.where("id % 3 = 0").select("id"), "approved").select("id", "status")


def _title(spark: SparkSession, d: str, name: str, f: Callable) -> DataFrame:
    return adapt.memories(spark, d).select("slug", f(F.col("title")).alias(name))


def queries() -> dict[str, Query]:
    memory, now = _memory_query, NOW
    found: dict[str, Query] = {
        "top_triggers": _two(partial(trends.top_triggers, now=EVENTS_NOW), adapt.trigger_stats),
        "rising_triggers": _two(partial(trends.rising_triggers, now=EVENTS_NOW, recent_days=7, baseline_days=7, limit=20), adapt.trigger_stats),
        "daily_trigger_stats": _two(lambda s: s, adapt.trigger_stats, then=lambda df: df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))),
        "trigger_bars": _two(lambda s: trends.with_bars(trends.top_triggers(s, EVENTS_NOW, 30)), adapt.trigger_stats),
        "list_by_type": memory(lambda m: listing.list_by_type(m, "decision"), "slug", "title", "created_at"),
        "list_memories": memory(lambda m: listing.list_memories(m, kind="fact"), "slug", "type", "created_at"),
        "get_memory": memory(lambda m: listing.get_memory(m, "doc-7"), "slug", "title", "fingerprint", "updated_at"),
        "timeline": memory(lambda m: listing.timeline(m, "2024-02-01 00:00:00", "2w", types=("fact", "session"), limit=200), "slug", "type", "created_at"),
        "recent_memories": memory(listing.recent_memories, "slug", "type", "created_at"),
        "recent_typed": memory(lambda m: listing.recent_typed(m, "warning", "2024-02-01 00:00:00", 20, 12), "slug", "created_at"),
        "recall_hot": memory(listing.recall_hot, "slug", "type", "recall_count", "last_recalled_at"),
        "paginate": memory(lambda m: listing.paginate(m, [F.desc("created_at"), F.asc("slug")], 2), "slug", "created_at"),
        "decayed_list": memory(listing.decayed, "slug", "decay_state", "last_recalled_at"),
        "context_neighbors": _anchors,
        "all_neighbors": memory(listing.neighbours),
        "cross_scope_topn": memory(lambda m: listing.top_of_scopes(m, 3, 20), "scope_hash", "rank", "slug"),
        "stats_rollup": memory(listing.stats),
        "health_counts": memory(listing.counts_by_type),
        "duplicates": memory(listing.duplicates),
        "digest_counts": _two(listing.digest_counts, adapt.memories, adapt.promotions),
        "decay_sweep": memory(lambda m: lifecycle.decay_sweep(m, "2024-02-10 00:00:00"), "slug", "decay_state", "action"),
        "decay_swept": memory(lambda m: lifecycle.swept(m, now), "slug", "decay_state", "body_path"),
        "decay_counts": memory(lambda m: lifecycle.decay_counts(m, "2024-02-10 00:00:00")),
        "record_recall": _recalls,
        "merge_duplicates": _merged,
        "merge_triggers": _two(lifecycle.merge_triggers, adapt.triggers, _merges),
        "promotion_bands": _two(lifecycle.with_status, adapt.promotions, then=lambda df: df.select("id", F.round("mean", 6).alias("mean"), "band")),
        "gated_candidates": _two(lambda p: p.where(lifecycle.gated(F.col("dura_score"))), adapt.promotions, then=lambda df: df.select("id", "proposed_type")),
        "review_pending": _two(partial(lifecycle.review_pending, low=0.3, high=0.9), adapt.promotions, then=lambda df: df.select("id", F.round("mean", 3).alias("mean"))),
        "grey_zone": _two(lifecycle.grey_zone, adapt.promotions, then=lambda df: df.select("id", F.round("mean", 3).alias("mean"))),
        "decide_promotions": _decided,
        "promoted_memories": _two(lifecycle.promoted_memories, adapt.promotions, then=lambda df: df.select("slug", "type", "title")),
        "backfill_candidates": _two(listing.backfill_candidates, adapt.memories, adapt.promotions, then=lambda df: df.select("slug")),
        "sensitive_anti": _two(security.open_memories, adapt.memories, adapt.sensitive_scopes, then=lambda df: df.groupBy("scope_hash").agg(F.count("*").alias("n"))),
        "gate_status": _gate,
        "entity_rollup": _two(graph.upsert_entities, adapt.mentions, then=lambda df: _shown(df, "id", "name", "mention_count", "first_seen_at", "last_seen_at", "scope_hash", "context")),
        "top_entities": _two(lambda m: graph.top_entities(graph.upsert_entities(m), "1998-01-01 00:00:00"), adapt.mentions, then=lambda df: _shown(df, "id", "mention_count", "last_seen_at")),
        "find_entities": _two(lambda m: graph.find_entities(graph.upsert_entities(m), "99"), adapt.mentions, then=lambda df: df.select("id", "mention_count")),
        "predicate_normalize": _raw_predicates,
        "relation_dedupe": _two(graph.distinct_relations, adapt.relations, then=lambda df: df.select("subject_id", "predicate", "object_id", "source_memory_id", "ord")),
        "kg_conflicts": _two(graph.conflicts, adapt.relations),
        "neighborhood": _two(partial(graph.neighbourhood, node=BRAND), adapt.relations),
        "n_hop_2": _n_hop,
        "evolution_chain": _two(graph.evolution_chain, adapt.supersedes),
        "supersede_bands": _supersede_bands,
        "knn_cosine": _knn,
        "extract_links": _links,
        "extract_entities": lambda spark, d: _ingested(spark, d)[0].select("id", "mention_count"),
        "extract_relations": lambda spark, d: _ingested(spark, d)[1].where("predicate <> 'mentions'").select("subject_id", "predicate", "object_id", "source_memory_id"),
        "global_graph": _global_graph,
        "bm25_topk": _bm25,
        "index_update": _updated_index,
        "rrf_fusion": lambda spark, d: search.fuse((_vector_hits(spark, d), 1.0), (_keyword_hits(spark, d), 1.0)).withColumn("score", F.round("score", 6)),
        "hybrid_search": _hybrid,
        "score_and_rank": _score_and_rank,
        "bm25_normalize": _bm25_normalised,
        "session_search": _two(lambda m, t: search.session_search(m, t, "was", limit=50), adapt.memories, adapt.triggers),
        "keyword_lines": memory(lambda m: search.keyword_lines(m, r"\bthe\b")),
        "contains_search": memory(lambda m: search.contains_search(m, "licensed")),
        "fingerprint": _text_query("fingerprint", ids.fingerprint),
        "content_hash": _text_query("content_hash", ids.content_hash),
        "entity_id": lambda spark, d: read(spark, d, "part").select("p_partkey", ids.entity_id(F.lit("tool"), F.col("p_name")).alias("entity_id")),
        "kebab": lambda spark, d: _title(spark, d, "kebab", ids.kebab),
        "infer_type": lambda spark, d: _title(spark, d, "kind", text.infer_type),
        "derive_triggers": lambda spark, d: _title(spark, d, "triggers", lambda c: F.array_join(text.derive_triggers(c), ",")),
        "topic_key": lambda spark, d: _title(spark, d, "topic_key", text.topic_key),
        "clean_text": lambda spark, d: read(spark, d, "pages").select("page_id", F.sha1(text.clean_for_embedding(F.col("html"))).alias("cleaned")),
        "count_words": _text_query("words", text.count_words),
        "chunk_markdown": _chunks,
        "vector_upsert": _embedded,
        "unified_diff": _diffs,
        "sync_diff": _two(sync.diff, _entries("local"), _entries("remote")),
        "merge_fields": _merge_fields,
        "import_bundle": _two(sync.import_bundle, _entries("local"), _entries("remote"), then=lambda df: df.groupBy("action").agg(F.count("*").alias("n"))),
        "export_actions": _two(sync.export_actions, partial(_files, side="local"), partial(_files, side="remote")),
        "import_actions": _two(sync.import_actions, partial(_files, side="local"), partial(_files, side="remote")),
        "sync_status": _two(sync.status, partial(_files, side="local"), partial(_files, side="remote")),
        "audit_filter": _audit_filter,
        "audit_verify": _audit_verify,
        "last_turns": lambda spark, d: listing.last_turns(read(spark, d, "conversations")).select("conv_id", "turn", "role", "rank"),
        "session_transcript": lambda spark, d: listing.transcript(read(spark, d, "conversations")),
        "month_report": _two(partial(trends.month_report, year=2024, month=1), adapt.memories, adapt.promotions, adapt.sensitive_scopes),
        "weekly_signals": _two(partial(trends.weekly_signals, now="2024-01-12 00:00:00"), adapt.memories, adapt.promotions, adapt.triggers, adapt.recent_entities, adapt.trigger_stats),
    }
    return found | more.queries() | others.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | more.sql() | others.sql()
