"""Queries of readers, writers and lookups over whole texts, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import graph, listing, packs, search, security, sync
from tessera.plans import adapt
from tessera.plans.adapt import read
from tessera.plans.oracles import KEBAB, _with
from tessera.shared import fresh_path
from tessera.sources import readers, sinks

#: A sensitive scope's key, by the scope's name.
KEY = {"src0": "11" * 32, "src1": "2f" * 32}
PERSON = "entity:person:customer_7"


def _about(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and facts that mention a customer."""
    o = F.col("o_orderkey")
    orders = read(spark, d, "orders")
    edges = orders.select(F.concat(F.lit("memory:o"), o).alias("subject_id"), F.lit("mentions").alias("predicate"), F.concat(F.lit("entity:person:customer_"), F.col("o_custkey") % 20).alias("object_id"), (o % 10 != 0).alias("active"))
    kinds = F.get(F.array(*[F.lit(k) for k in ("session", "decision", "fact", "warning")]), (o % 4).cast("int"))
    return graph.memories_about(edges, PERSON, orders.select(F.concat(F.lit("o"), o).alias("slug"), kinds.alias("type")), ("decision", "fact"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Some memories have a plain file, some an encrypted one, some both, and some in two places."""
    i, m = F.col("doc_id"), adapt.memories(spark, d)
    ends = F.when(i % 3 == 0, F.array(F.lit(".md"))).when(i % 3 == 1, F.array(F.lit(".md.enc"))).otherwise(F.array(F.lit(".md.enc"), F.lit(".md")))
    places = F.when(i % 4 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("c")))
    rows = m.select("slug", F.explode(ends).alias("end"), places.alias("places")).withColumn("place", F.explode("places"))
    return rows.select("slug", F.concat(F.lit("/"), "place", F.lit("/"), "slug", "end").alias("path"))


def _opened(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that are encrypted by their scope's key are written, and loaded by the keys at hand."""
    m = adapt.memories(spark, d).select("slug", "source", "scope_hash", "scope_sensitive", "body")
    path = fresh_path(spark, "sealed")
    for scope, key in KEY.items():
        security.encrypted(m.where(F.col("source") == scope), "body", key).write.mode("append").parquet(path)
    m.where("NOT scope_sensitive").write.mode("append").parquet(path)
    keys = spark.createDataFrame([("src0", KEY["src0"])], "scope string, key string").select(F.substring(F.sha1("scope"), 1, 12).alias("scope_hash"), "key")
    return security.opened(spark.read.parquet(path), "body", keys).select("slug", F.sha1("body").alias("body_sha1"))


def _merged_by_audit(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ take what the log says last: of the types, and of some hashes."""
    local, remote = (adapt.entries(spark, d, remote=r) for r in (False, True))
    i = F.substring("id", 5, 20).cast("bigint")
    rows = remote.select(i.alias("i"), F.col("id").alias("target_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    rows = rows.select(
        (F.col("i") * 10 + F.col("k")).alias("seq"), F.lit(0.0).alias("ts"), F.when(F.col("i") % 6 == 0, "delete").otherwise("update").alias("action"), "target_id",
        F.when(F.col("k") == 1, F.array(F.lit("memory_type"))).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        F.when((F.col("k") == 2) & (F.col("i") % 8 == 1), F.create_map(F.lit("content_hash"), F.lit("said"))).otherwise(F.create_map(F.lit("memory_type"), F.concat(F.lit("kind-"), "k"))).alias("after"),
    )
    return sync.merge_entries(local, remote, rows).select("id", "content_hash", "memory_type")


def _united(spark: SparkSession, d: str) -> DataFrame:
    """Relations with a confidence on both sides of a merge."""
    told = [adapt.entries(spark, d, remote=r) for r in (False, True)]
    sure = F.substring("id", 5, 20).cast("bigint") % 10
    sides = []
    for entries, more in zip(told, (0, 100), strict=True):
        rows = entries.withColumn("sure", sure + more)
        sides.append(rows.withColumn("relations", F.transform("relations", lambda r: r.withField("confidence", F.col("sure")))).drop("sure"))
    one = F.explode("relations").alias("r")
    return sync.merge_entries(*sides).select("id", one).select("id", F.col("r.object_id").alias("object_id"), F.col("r.confidence").alias("confidence"))


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """Memories are written by scope and type, those of sensitive scopes encrypted, and read again."""
    path = fresh_path(spark, "saved")
    m = adapt.memories(spark, d).select("slug", "type", "scope_hash", "scope_sensitive", "body")
    sinks.save_memories(m, path, KEY["src0"])
    rows = spark.read.parquet(path).withColumn("scope_hash", F.col("scope_hash").cast("string"))
    hidden = rows.where("scope_sensitive")
    plain = security.decrypted(hidden.drop("body").join(hidden.select("slug", "body"), "slug"), "body", KEY["src0"]).select("slug", "type", F.sha1("body").alias("body_sha1"), F.lit(True).alias("sealed"))
    return rows.where("NOT scope_sensitive").select("slug", "type", F.sha1("body").alias("body_sha1"), F.lit(False).alias("sealed")).union(plain)


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """Memories as Markdown with front matter, read back."""
    m = adapt.memories(spark, d).withColumn("triggers", F.array(F.col("source"), F.lit('say "x"')))
    parsed = readers.parse_markdown(sinks.markdown(m).select(F.col("slug").alias("path"), "text"))
    meta = lambda k: F.element_at("meta", F.lit(k))
    triggers = F.array_join(F.element_at("lists", F.lit("triggers")), "|")
    return parsed.select(F.col("path").alias("slug"), meta("title").alias("title"), meta("type").alias("type"), meta("decay_state").alias("decay_state"), triggers.alias("triggers"), F.sha1("body").alias("body_sha1"))


def _document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes: the first line is a heading, what follows its section, and a second section tells the source."""
    text_ = F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("Note "), F.col("doc_id").cast("string"), F.lit(": "), F.col("lang"))
    whole = F.concat(F.lit("# All\n\n## "), head, F.lit("\n\n"), text_, F.lit("\n\n### How to read\n"), F.col("source"))
    found = readers.import_sections(read(spark, d, "documents").select(F.col("doc_id").alias("file"), whole.alias("text")), "notes", "2024-01-01")
    return found.select("file", "slug", "type", "title", F.sha1("body").alias("body_sha1"))


def _spilled(spark: SparkSession, d: str) -> DataFrame:
    """Texts of more than 1,000 characters stand in side files."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("whole"))
    big = F.char_length("whole") > 1000
    rows = docs.select("id", F.when(~big, F.col("whole")).alias("content"), F.when(big, F.concat(F.lit("chunks/"), F.sha2("whole", 256))).alias("content_ref"))
    side = docs.where(big).select(F.concat(F.lit("chunks/"), F.sha2("whole", 256)).alias("name"), F.col("whole").alias("content")).dropDuplicates(["name"])
    return readers.resolve_spilled(rows, side).select("id", F.sha1("content").alias("content_sha1"))


def _two_retrievers(spark: SparkSession, d: str) -> DataFrame:
    """Vector and BM25 hits of one question, fused and scaled."""
    vectors = read(spark, d, "embeddings")
    dense = search.knn(vectors, vectors.where("vec_id = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 40).select("id", "rank")
    asked = read(spark, d, "benchmark").where("item_id = 0").select(F.col("item_id").alias("query"), "text")
    sparse = search.bm25(read(spark, d, "documents"), asked, "doc_id", "text", 40).select("id", "rank")
    return search.dense_bm25(dense, sparse).withColumn("score", F.round("score", 6))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on each third document and the one before it, applied to memories and written down."""
    i = F.col("doc_id")
    verdicts = read(spark, d, "documents").where((i % 3 == 0) & (i > 0)).select(
        F.concat(F.lit("doc-"), i).alias("new"), F.concat(F.lit("doc-"), i - 1).alias("old"), F.col("source").alias("entity_id"), F.when(i % 4 == 0, "unrelated").when(i % 4 == 1, " Supersedes").otherwise("supersedes").alias("decision"),
        F.when(i % 7 > 0, (i % 13) / 10).alias("confidence"), F.col("text").alias("reason"),
    )
    memories_, told = graph.applied_judgements(adapt.memories(spark, d), adapt.supersedes(spark, d).limit(0), verdicts, "2024-05-01 00:00:00")
    rows = memories_.select(F.lit("memory").alias("kind"), "slug", F.col("decay_state").alias("value"), F.lit(None).cast("double").alias("confidence"))
    return rows.union(told.select(F.lit("replaced"), F.col("older"), F.concat_ws("|", "newer", "decided_by", "entity_id", F.length("reason").cast("string")), "confidence"))


def _packed(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Nearest vectors by packs that are written first."""
    path, vectors = fresh_path(spark, "packs"), read(spark, d, "embeddings")
    packs.build(vectors, path)
    return packs.search(spark, path, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), k)


def _tail(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("scope_hash"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")))
    log = read(spark, d, "events").select(F.col("event_id").alias("n"), F.when(F.col("event_id") % 9 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))
    return security.audit_tail(log, 30).select("n", "event_type")


def _cut(f, name: str):
    return lambda spark, d: read(spark, d, "documents").select("doc_id", F.sha1(f(F.coalesce("text", F.lit("")))).alias(name))


def _paragraphs(column):
    """Lines as paragraphs."""
    return F.replace(column, F.lit("\n"), F.lit("\n\n"))


def _queries() -> dict[str, tuple[object, str]]:
    files = "SELECT slug, '/' || place || '/' || slug || e AS path, e FROM (SELECT slug, unnest(CASE doc_id % 3 WHEN 0 THEN ['.md'] WHEN 1 THEN ['.md.enc'] ELSE ['.md', '.md.enc'] END) AS e, CASE WHEN doc_id % 4 = 0 THEN ['a', 'b'] ELSE ['c'] END AS places FROM memories), unnest(places) t(place)"
    count = "len(list_filter(regexp_split_to_array(p, '\\s+'), lambda t: regexp_matches(t, '[\\x00-\\x7F]')))"
    return {
        "memories_about_types": (_about, "SELECT 'o' || o_orderkey AS slug FROM orders WHERE o_custkey % 20 = 7 AND o_orderkey % 10 <> 0 AND o_orderkey % 4 IN (1, 2)"),
        "resolve_slug": (lambda s, d: listing.resolve_slug(_files(s, d)), _with("memories", f"SELECT slug, path FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY e = '.md.enc', path) AS r FROM ({files})) WHERE r = 1")),
        "recent_slugs": (
            lambda s, d: readers.recent_slugs(adapt.memories(s, d).select(F.concat(F.lit("/root/scopes/"), "scope_hash", F.lit("/"), "type", F.lit("/"), "slug", F.lit(".md")).alias("path")), "session", 25).select("slug"),
            _with("memories", "SELECT slug FROM memories WHERE type = 'session' ORDER BY slug DESC LIMIT 25"),
        ),
        "opened_bodies": (_opened, _with("memories", "SELECT slug, CASE WHEN source = 'src1' THEN NULL ELSE sha1(body) END AS body_sha1 FROM memories")),
        "merge_fields_audit": (
            _merged_by_audit,
            _with(
                "mine theirs",
                """SELECT coalesce(l.id, r.id) AS id,
                CASE WHEN l.id IS NULL THEN r.content_hash WHEN r.id IS NULL OR l.content_hash = r.content_hash THEN l.content_hash WHEN r.doc_id % 8 = 1 AND r.doc_id % 6 <> 0 THEN 'said' WHEN r.updated_at >= l.updated_at THEN r.content_hash ELSE l.content_hash END AS content_hash,
                CASE WHEN l.id IS NULL THEN r.memory_type WHEN r.id IS NULL OR l.memory_type = r.memory_type THEN l.memory_type WHEN r.doc_id % 6 = 0 THEN CASE WHEN r.updated_at >= l.updated_at THEN r.memory_type ELSE l.memory_type END
                WHEN r.doc_id % 8 = 1 THEN 'kind-1' ELSE 'kind-2' END AS memory_type FROM mine l FULL JOIN theirs r ON l.id = r.id""",
            ),
        ),
        "merge_relations": (
            _united,
            _with(
                "mine theirs",
                """SELECT coalesce(l.id, r.id) AS id, unnest(CASE WHEN r.id IS NULL THEN ['l' || (l.doc_id % 2), 'both'] WHEN l.id IS NULL THEN ['r' || (r.doc_id % 2), 'both'] ELSE ['l' || (l.doc_id % 2), 'both', 'r' || (r.doc_id % 2)] END) AS object_id,
                unnest(CASE WHEN r.id IS NULL THEN [l.doc_id % 10, l.doc_id % 10] WHEN l.id IS NULL THEN [r.doc_id % 10 + 100, r.doc_id % 10 + 100] ELSE [l.doc_id % 10, r.doc_id % 10 + 100, r.doc_id % 10 + 100] END) AS confidence FROM mine l FULL JOIN theirs r ON l.id = r.id""",
            ),
        ),
        "saved_memories": (_saved, _with("memories", "SELECT slug, type, sha1(body) AS body_sha1, scope_sensitive AS sealed FROM memories")),
        "markdown_round_trip": (
            _rendered,
            _with("memories", "SELECT slug, CASE WHEN title <> '' THEN title END AS title, type, CASE WHEN decay_state <> 'alive' THEN decay_state END AS decay_state, source || '|say \"x\"' AS triggers, sha1(ltrim(body, chr(10))) AS body_sha1 FROM memories"),
        ),
        "document_sections": (
            _document_sections,
            f"""SELECT doc_id AS file, '2024-01-01-' || {KEBAB.format(c="'Note ' || doc_id || ': ' || lang")} AS slug, 'fact' AS type, 'Note ' || doc_id || ': ' || lang AS title, sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body_sha1 FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''
            UNION ALL SELECT doc_id, '2024-01-01-how-to-read', 'playbook', 'How to read', sha1(source) FROM documents""",
        ),
        "spilled_texts": (_spilled, "SELECT doc_id AS id, sha1(coalesce(text, '')) AS content_sha1 FROM documents"),
        "dense_bm25_search": (
            _two_retrievers,
            _with("nearest bm25_ranked", "SELECT id, round(sum(1.0::DOUBLE / (60 + rank)) / (2.0::DOUBLE / 61), 6) AS score FROM (SELECT id, rank FROM nearest WHERE query = 0 AND rank <= 40 UNION ALL SELECT id, rank FROM bm25_ranked WHERE query = 0 AND rank <= 40) GROUP BY id"),
        ),
        "supersede_apply": (
            _judged,
            _with(
                "memories",
                """, v AS (SELECT *, CASE WHEN doc_id % 7 > 0 THEN least(doc_id % 13 / 10.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END AS sure FROM documents WHERE doc_id % 3 = 0 AND doc_id > 0 AND doc_id % 4 <> 0)
                SELECT 'memory' AS kind, slug, CASE WHEN doc_id + 1 IN (SELECT doc_id FROM v WHERE sure >= 0.85) THEN 'dim' ELSE decay_state END AS value, CAST(NULL AS DOUBLE) AS confidence FROM memories
                UNION ALL SELECT 'replaced', 'doc-' || (doc_id - 1), 'doc-' || doc_id || '|' || CASE WHEN sure >= 0.85 THEN 'auto' ELSE 'digest' END || '|' || source || '|' || least(length(coalesce(text, '')), 500), sure FROM v WHERE sure >= 0.5""",
            ),
        ),
        "bm25_params": (
            lambda s, d: read(s, d, "benchmark").select("item_id", F.sha1(search.lemmatised(F.col("text"))).alias("words"), *[c.alias(n) for c, n in zip(search.bm25_parameters(F.substring("text", F.lit(1), (F.col("item_id") * 3).cast("int"))), ("midpoint", "steepness"), strict=True)]),
            r"""SELECT item_id, sha1(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')) AS words, CAST(CASE WHEN n <= 3 THEN 5 WHEN n <= 6 THEN 7 WHEN n <= 9 THEN 9 WHEN n <= 15 THEN 10 ELSE 12 END AS DOUBLE) AS midpoint,
            CAST(CASE WHEN n <= 3 THEN 0.7 WHEN n <= 6 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS steepness FROM (SELECT *, len(regexp_extract_all(lower(substr(text, 1, item_id * 3)), '[\p{L}\p{N}_]+')) AS n FROM benchmark)""",
        ),
        "knn_packs": (_packed, _with("nearest", "SELECT query, id, score, rank FROM nearest WHERE rank <= 10")),
        "audit_tail": (_tail, "SELECT event_id AS n, event_type FROM events WHERE event_id % 9 <> 0 ORDER BY event_id DESC LIMIT 30"),
        "truncate_words": (
            _cut(lambda c: text.truncate_by_words(_paragraphs(c), 60), "kept"),
            f"""SELECT doc_id, sha1(regexp_replace(array_to_string(list_filter(ps, lambda p, i: i = 1 OR (ns[i] <= 60 AND ns[i - 1] < 60)), chr(10) || chr(10)), '\\s+$', '') || chr(10)) AS kept
            FROM (SELECT doc_id, ps, list_transform(range(1, len(ps) + 1), lambda k: list_sum(list_transform(ps[1:k], lambda p: {count}))) AS ns FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents))""",
        ),
        "truncate_paragraphs": (
            _cut(lambda c: text.truncate_by_paragraph(_paragraphs(c), 400), "kept"),
            """SELECT doc_id, sha1(CASE WHEN length(t) <= 400 THEN t WHEN blank > 200 THEN rtrim(substr(p, 1, blank), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10)
            WHEN line > 0 THEN rtrim(substr(p, 1, line), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) ELSE p END) AS kept
            FROM (SELECT *, CASE WHEN contains(p, chr(10) || chr(10)) THEN 400 - strpos(reverse(p), chr(10) || chr(10)) - 1 ELSE -1 END AS blank, CASE WHEN contains(p, chr(10)) THEN 400 - strpos(reverse(p), chr(10)) ELSE -1 END AS line
            FROM (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t, substr(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), 1, 400) AS p FROM documents))""",
        ),
    }


def queries() -> dict[str, object]:
    return {name: query for name, (query, _) in _queries().items()}


def sql() -> dict[str, str]:
    return {name: twin for name, (_, twin) in _queries().items()}
