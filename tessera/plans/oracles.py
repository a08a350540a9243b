"""SQL twins of the queries for DuckDB, written apart from them."""

from __future__ import annotations

from tessera.operators.graph import ALIASES, REVERSED
from tessera.schemas import PREDICATES

#: The names of predicates, as a list in SQL.
NAMES = str((*PREDICATES, *ALIASES))
TABLES = {
    "memories": """SELECT 'doc-' || doc_id AS slug, ['session','decision','preference','fact','playbook','warning'][doc_id % 6 + 1] AS type,
      substr(sha1(source), 1, 12) AS scope_hash, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS title, source,
      TIMESTAMP '2024-01-01' + INTERVAL (doc_id) HOUR AS created_at, TIMESTAMP '2024-01-01' + INTERVAL (doc_id + doc_id % 48) HOUR AS updated_at,
      CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 5 + 1) * 7 END AS ttl_days,
      CASE WHEN doc_id % 10 < 7 THEN 'alive' WHEN doc_id % 10 < 9 THEN 'dim' ELSE 'soft-forgotten' END AS decay_state,
      CASE WHEN doc_id % 7 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (doc_id + doc_id % 20 * 24) HOUR END AS last_recalled_at,
      doc_id % 7 AS recall_count, sha1(substr(coalesce(text, ''), 1, 500)) AS fingerprint,
      'scopes/' || source || '/doc-' || doc_id || '.md' AS body_path, source IN ('src0', 'src1') AS scope_sensitive, coalesce(text, '') AS body, doc_id
      FROM documents""",
    "triggers": """SELECT slug, unnest(w[1:3]) AS trigger FROM (SELECT slug, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS w
      FROM (SELECT slug, regexp_extract_all(lower(title), '\\p{L}{3,}') AS ws FROM memories))""",
    "trigger_stats": """SELECT event_type || ':' || json_extract_string(props, '$.k') AS trigger, 'u' || (user_id % 10) AS scope_hash,
      CAST(ts AS DATE) AS day, count(*) AS hits FROM events GROUP BY 1, 2, 3""",
    "scored": """SELECT doc_id AS id, quality * 0.5::DOUBLE + (doc_id % 5) / 10.0::DOUBLE AS d, (doc_id % 10) / 10.0::DOUBLE AS u, (doc_id % 7) / 10.0::DOUBLE + 0.3::DOUBLE AS r,
      1.0::DOUBLE - toxic * 0.5::DOUBLE AS a, ['decision','preference','fact','playbook','warning'][doc_id % 5 + 1] AS proposed_type,
      ['pending','approved','rejected','merged'][doc_id % 4 + 1] AS status, substr(sha1(source), 1, 12) AS scope_hash,
      TIMESTAMP '2024-01-01' + INTERVAL (doc_id) HOUR AS created_at, doc_id % 3 = 0 AS replaces
      FROM labels JOIN documents USING (doc_id)""",
    "promotions": "SELECT *, (d + u + r + a) / 4 AS mean FROM scored",
    "sensitive": "SELECT substr(sha1(s), 1, 12) AS scope_hash FROM (VALUES ('src0'), ('src1')) t(s)",
    "mentions": """SELECT 'entity:person:' || replace(lower(trim(c_name)), ' ', '_') AS id, c_name AS name, 'n' || c_nationkey AS scope_hash, o_orderdate AS seen, o_orderkey AS seq, o_orderpriority AS context
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "entities": """SELECT id, arg_min(name, (seen, seq)) AS name, count(*) AS mention_count, min(seen) AS first_seen_at, max(seen) AS last_seen_at,
      arg_min(scope_hash, (seen, seq)) AS scope_hash, arg_max(context, (seen, seq)) AS context FROM mentions GROUP BY id""",
    "recent": "SELECT id, name, mention_count, last_seen_at + INTERVAL 9300 DAY AS last_seen_at, scope_hash FROM entities",
    "relations": """SELECT 'entity:person:customer_' || c_custkey AS subject_id, 'located_at' AS predicate, 'entity:place:' || replace(lower(n_name), ' ', '_') AS object_id,
      'memory:c' || (c_custkey % 50) AS source_memory_id, c_custkey % 11 <> 0 AS active, c_custkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 'entity:place:' || replace(lower(n_name), ' ', '_'), 'belongs_to', 'entity:place:' || replace(lower(r_name), ' ', '_'), NULL, TRUE, n_nationkey
      FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'entity:person:customer_' || o_custkey, 'uses', 'entity:tool:' || replace(lower(p_brand), '#', '_'), 'memory:o' || o_orderkey, l_linenumber <> 3, l_orderkey * 10 + l_linenumber
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
    "chain": """SELECT 'memory:o' || o_orderkey AS newer, 'memory:o' || lag(o_orderkey) OVER w AS older, 'entity:person:customer_' || o_custkey AS entity_id, (o_orderkey % 100) / 100.0::DOUBLE AS confidence,
      o_orderkey, o_orderdate, o_custkey, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "mine": """SELECT 'doc-' || doc_id AS id, sha256(coalesce(text, '')) AS content_hash, 'scope-' || source AS scope, CASE WHEN doc_id % 5 = 0 THEN 'l-kind' ELSE 'fact' END AS memory_type,
      doc_id * 10.0::DOUBLE AS created_at, doc_id * 10.0::DOUBLE + 5 AS updated_at, lang, doc_id FROM documents WHERE doc_id % 13 <> 0 OR doc_id % 9 = 0""",
    "theirs": """SELECT 'doc-' || doc_id AS id, sha256(coalesce(text, '') || CASE WHEN doc_id % 4 = 1 THEN ' edited' ELSE '' END) AS content_hash, 'scope-' || source AS scope,
      CASE WHEN doc_id % 5 = 0 THEN 'r-kind' ELSE 'fact' END AS memory_type, doc_id * 10.0::DOUBLE AS created_at,
      doc_id * 10.0::DOUBLE + 5 + CASE WHEN doc_id % 8 = 1 THEN 100 WHEN doc_id % 4 = 1 THEN -100 ELSE 0 END AS updated_at, lang, doc_id FROM documents WHERE doc_id % 9 <> 0""",
    "names": """SELECT * FROM (SELECT ['person','organization','place','library','tool','project','concept'][doc_id % 7 + 1] AS type, w[1] || ' ' || w[2] AS name, w[3] AS alias
      FROM (SELECT doc_id, regexp_extract_all(lower(title), '\\p{L}{3,}') AS w FROM memories) WHERE len(w) >= 2)""",
    "texts": """SELECT slug, body FROM memories UNION ALL SELECT 'conv-' || conv_id || '-' || turn, coalesce(text, '') FROM conversations""",
    "phrases": """SELECT phrase, n, min((type, name)) AS of FROM (SELECT name AS phrase, 2 AS n, type, name FROM names UNION ALL SELECT alias, 1, type, name FROM names WHERE alias IS NOT NULL) GROUP BY ALL""",
    "cut": "SELECT slug, regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+|[.!?;:\\n]') AS ws FROM texts",
    "spots": "SELECT slug, ws, unnest(range(1, len(ws) + 1)) AS i FROM cut",
    "hits": """SELECT slug, ws, i, max(n) AS n, arg_max(of, n) AS of FROM (SELECT slug, ws, i, p.n, p.of FROM spots JOIN phrases p ON p.n = 1 AND p.phrase = ws[i] UNION ALL SELECT slug, ws, i, p.n, p.of FROM spots JOIN phrases p ON p.n = 2 AND p.phrase = ws[i] || ' ' || ws[i + 1]) GROUP BY slug, ws, i""",
    "kept": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, run ORDER BY i) AS nth FROM (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY slug ORDER BY i) AS run
      FROM (SELECT *, coalesce(lag(i + n) OVER (PARTITION BY slug ORDER BY i) <= i, TRUE) AS fresh FROM hits))) WHERE nth % 2 = 1""",
    "links": f"""SELECT slug AS memory_id, CAST(i - 1 AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, of[1] AS type, of[2] AS name, CASE WHEN said IN {NAMES} THEN said END AS predicate, CASE WHEN said IN {NAMES} THEN other[1] END AS other_type, CASE WHEN said IN {NAMES} THEN other[2] END AS other
      FROM (SELECT *, lag(of) OVER w AS other, CASE WHEN i - lag(i + n) OVER w BETWEEN 1 AND 4 THEN array_to_string(ws[lag(i + n) OVER w : i - 1], '_') END AS said FROM kept WINDOW w AS (PARTITION BY slug ORDER BY i))""",
    "terms": """SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS term FROM benchmark""",
    "words": "SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents",
    "bm25": """SELECT query, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
      FROM (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(ws) AS length, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY ALL) f
      JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, term FROM (SELECT id, unnest(ws) AS term FROM words)) GROUP BY term) USING (term)
      JOIN terms USING (term) CROSS JOIN (SELECT count(*) AS n, avg(len(ws)) AS mean FROM words) GROUP BY query, id""",
    "bm25_ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm25",
    "cosines": """SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
      FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0""",
    "nearest": "SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM cosines",
    "keyword_hits": """SELECT doc_id AS id, row_number() OVER (ORDER BY line, slug) AS rank FROM (SELECT doc_id, slug, list_position(list_transform(string_split(body, chr(10)), lambda x: regexp_matches(x, '(?i)\\bwas\\b')), TRUE) AS line
      FROM memories WHERE regexp_matches(body, '(?i)\\bwas\\b')) WHERE line IS NOT NULL ORDER BY line, slug LIMIT 40""",
    "fused": """SELECT id, sum(w / (60 + rank)) AS score FROM (SELECT id, rank, 1.0::DOUBLE AS w, 1.0::DOUBLE AS w2 FROM nearest WHERE query = 0 AND rank <= 40
      UNION ALL SELECT id, rank, 1.0::DOUBLE, 0.7::DOUBLE FROM keyword_hits) GROUP BY id""",
    "merges": """SELECT first_value(slug) OVER w AS keep, slug AS "drop", row_number() OVER w AS pos, doc_id, body FROM memories WINDOW w AS (PARTITION BY fingerprint ORDER BY doc_id)""",
    "local_files": "SELECT 'scopes/' || replace(scope, 'scope-', '') || '/' || id AS key, substr(content_hash, 1, 16) AS fingerprint FROM mine",
    "remote_files": "SELECT 'scopes/' || replace(scope, 'scope-', '') || '/' || id AS key, substr(content_hash, 1, 16) AS fingerprint FROM theirs",
}
NEEDS = {
    "names": ["memories"], "texts": ["memories"], "phrases": ["names"], "cut": ["texts"], "spots": ["cut"], "hits": ["spots", "phrases"], "kept": ["hits"], "links": ["kept"],
    "triggers": ["memories"], "promotions": ["scored"], "entities": ["mentions"], "recent": ["entities"], "bm25": ["terms", "words"], "bm25_ranked": ["bm25"], "nearest": ["cosines"], "keyword_hits": ["memories"],
    "fused": ["nearest", "keyword_hits"], "merges": ["memories"], "local_files": ["mine"], "remote_files": ["theirs"],
}
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _with(needs: str, query: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in order) + "\n" if order else "") + query


def _t(column: str) -> str:
    return f"{STAMP.format(column)} AS {column}"


AGE = "CASE WHEN coalesce(last_recalled_at, created_at) IS NULL THEN 1e300 ELSE (epoch(TIMESTAMP '{now}') - epoch(coalesce(last_recalled_at, created_at))) / 86400.0 END"
ACTION = """CASE WHEN decay_state = 'alive' AND ttl_days IS NOT NULL AND {age} > ttl_days THEN 'to_dim' WHEN decay_state = 'dim' AND {age} > 30 THEN 'to_soft_forgotten'
  WHEN decay_state = 'soft-forgotten' AND {age} > 90 THEN 'to_forgotten_dir' END"""
KEBAB = "coalesce(nullif(trim(substr(regexp_replace(regexp_replace(lower({c}), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), 1, 60), '-'), ''), 'untitled')"


#: The documents after the update of the index.
REVISED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' revised edition of was' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0"


def _action(now: str) -> str:
    return ACTION.format(age=AGE.format(now=now))


def sql() -> dict[str, str]:
    early, late = "2024-02-10 00:00:00", "2024-06-01 00:00:00"
    words = "list_filter(regexp_extract_all(title, '[A-Za-z一-鿿][A-Za-z0-9一-鿿_-]+'), lambda w: length(w) >= 3)[1:5]"
    return {
        "top_triggers": _with("trigger_stats", "SELECT trigger, CAST(sum(hits) AS BIGINT) AS total FROM trigger_stats WHERE day >= DATE '2024-01-24' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "rising_triggers": _with(
            "trigger_stats",
            """SELECT trigger, CAST(coalesce(sum(hits) FILTER (day >= DATE '2024-01-24'), 0) AS BIGINT) AS recent, CAST(coalesce(sum(hits) FILTER (day >= DATE '2024-01-17' AND day < DATE '2024-01-24'), 0) AS BIGINT) AS prior
            FROM trigger_stats GROUP BY 1 HAVING recent > prior ORDER BY recent - prior DESC, trigger LIMIT 20""",
        ),
        "daily_trigger_stats": _with("trigger_stats", "SELECT trigger, scope_hash, strftime(day, '%Y-%m-%d') AS day, hits FROM trigger_stats"),
        "trigger_bars": _with(
            "trigger_stats",
            """SELECT trigger, total, repeat('#', CAST(ceil(total * 20 / greatest(max(total) OVER (), 1)) AS INTEGER)) AS bar
            FROM (SELECT trigger, CAST(sum(hits) AS BIGINT) AS total FROM trigger_stats WHERE day >= DATE '2024-01-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
        ),
        "list_by_type": _with("memories", f"SELECT slug, title, {_t('created_at')} FROM memories WHERE type = 'decision' AND decay_state <> 'soft-forgotten' ORDER BY memories.created_at DESC, slug LIMIT 100"),
        "list_memories": _with("memories", f"SELECT slug, type, {_t('created_at')} FROM memories WHERE type = 'fact' ORDER BY memories.created_at DESC, slug LIMIT 50"),
        "get_memory": _with("memories", f"SELECT slug, title, fingerprint, {_t('updated_at')} FROM memories WHERE slug = 'doc-7'"),
        "timeline": _with("memories", f"SELECT slug, type, {_t('created_at')} FROM memories WHERE memories.created_at >= TIMESTAMP '2024-01-18' AND type IN ('fact', 'session') ORDER BY memories.created_at DESC, slug LIMIT 200"),
        "recent_memories": _with("memories", f"SELECT slug, type, {_t('created_at')} FROM memories WHERE type IN ('decision', 'preference', 'fact') AND NOT scope_sensitive AND decay_state <> 'soft-forgotten' ORDER BY memories.created_at DESC, slug LIMIT 5"),
        "recent_typed": _with("memories", f"SELECT slug, {_t('created_at')} FROM memories WHERE type = 'warning' AND memories.created_at >= TIMESTAMP '2024-01-12' AND NOT scope_sensitive AND decay_state <> 'soft-forgotten' ORDER BY memories.created_at DESC, slug LIMIT 12"),
        "recall_hot": _with(
            "memories", f"SELECT slug, type, recall_count, {_t('last_recalled_at')} FROM memories WHERE recall_count >= 2 AND type <> 'session' AND NOT scope_sensitive AND decay_state <> 'soft-forgotten' ORDER BY recall_count DESC, memories.last_recalled_at DESC NULLS LAST, slug LIMIT 5"
        ),
        "paginate": _with("memories", f"SELECT slug, {_t('created_at')} FROM memories ORDER BY memories.created_at DESC, slug LIMIT 50 OFFSET 50"),
        "decayed_list": _with("memories", f"SELECT slug, decay_state, {_t('last_recalled_at')} FROM memories WHERE decay_state IN ('dim', 'soft-forgotten')"),
        "context_neighbors": _with(
            "memories",
            """SELECT anchor, side, slug, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor, side ORDER BY gap, slug) AS rank
            FROM (SELECT a.slug AS anchor, CASE WHEN m.created_at < a.created_at THEN 'before' ELSE 'after' END AS side, m.slug, abs(epoch(m.created_at) - epoch(a.created_at)) AS gap
            FROM memories m JOIN memories a ON m.scope_hash = a.scope_hash AND m.created_at <> a.created_at WHERE a.slug IN ('doc-50', 'doc-100', 'doc-131'))) WHERE rank <= 3""",
        ),
        "all_neighbors": _with(
            "memories",
            """SELECT anchor, side, slug, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor, side ORDER BY gap, slug) AS rank
            FROM (SELECT a.slug AS anchor, CASE WHEN m.created_at < a.created_at THEN 'before' ELSE 'after' END AS side, m.slug, abs(epoch(m.created_at) - epoch(a.created_at)) AS gap
            FROM memories m JOIN memories a ON m.scope_hash = a.scope_hash AND m.created_at <> a.created_at)) WHERE rank <= 3""",
        ),
        "cross_scope_topn": _with("memories", "SELECT scope_hash, CAST(rank AS INTEGER) AS rank, slug FROM (SELECT *, row_number() OVER (PARTITION BY scope_hash ORDER BY created_at DESC, slug) AS rank FROM memories) WHERE rank <= 3 ORDER BY scope_hash, rank LIMIT 20"),
        "stats_rollup": _with(
            "memories",
            "SELECT 'type' AS dimension, type AS value, count(*) AS n FROM memories GROUP BY 2 UNION ALL SELECT 'scope', scope_hash, count(*) FROM memories GROUP BY 2 UNION ALL SELECT 'decay', decay_state, count(*) FROM memories GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM memories",
        ),
        "health_counts": _with("memories", f"SELECT t.type, count(m.slug) AS n, {STAMP.format('max(m.updated_at)')} AS last FROM (VALUES ('session'), ('decision'), ('preference'), ('fact'), ('playbook'), ('warning')) t(type) LEFT JOIN memories m ON m.type = t.type GROUP BY 1"),
        "duplicates": _with("memories", "SELECT * FROM (SELECT fingerprint, count(*) OVER (PARTITION BY fingerprint) AS n, slug FROM memories) WHERE n >= 2"),
        "digest_counts": _with(
            "memories promotions",
            "SELECT 'pending' AS name, count(*) AS n FROM promotions WHERE status = 'pending' UNION ALL SELECT 'duplicates', count(*) FROM (SELECT fingerprint FROM memories GROUP BY 1 HAVING count(*) >= 2) UNION ALL SELECT 'decayed', count(*) FROM memories WHERE decay_state IN ('dim', 'soft-forgotten')",
        ),
        "decay_sweep": _with("memories", f"SELECT slug, decay_state, {_action(early)} AS action FROM memories"),
        "decay_swept": _with(
            "memories",
            f"""SELECT slug, CASE action WHEN 'to_dim' THEN 'dim' WHEN 'to_soft_forgotten' THEN 'soft-forgotten' ELSE decay_state END AS decay_state,
            CASE WHEN action = 'to_forgotten_dir' THEN 'scopes/' || scope_hash || '/forgotten/' || slug || '.md' ELSE body_path END AS body_path FROM (SELECT *, {_action(late)} AS action FROM memories)""",
        ),
        "decay_counts": _with("memories", f"SELECT {_action(early)} AS action, count(*) AS n FROM memories GROUP BY 1 HAVING action IS NOT NULL"),
        "record_recall": _with(
            "memories",
            f"""SELECT m.slug, recall_count + coalesce(n, 0) AS recall_count, {STAMP.format('greatest(last_recalled_at, hit)')} AS last_recalled_at, decay_state
            FROM memories m LEFT JOIN (SELECT 'doc-' || (event_id % 200) AS slug, count(*) AS n, max(ts) AS hit FROM events GROUP BY 1) h ON m.slug = h.slug""",
        ),
        "merge_duplicates": _with(
            "merges",
            'SELECT keep AS slug, CAST(if(pos = 1, 0, pos) AS BIGINT) AS pos, if(pos = 1, NULL, "drop") AS merged_from, sha1(body) AS section_sha1, CAST(length(body) AS INTEGER) AS n FROM merges',
        ),
        "merge_triggers": _with("triggers merges", 'SELECT DISTINCT keep AS slug, trigger FROM triggers JOIN merges ON slug = "drop"'),
        "promotion_bands": _with("promotions", "SELECT id, round(mean, 6) AS mean, CASE WHEN mean >= 0.85 THEN 'approved' WHEN mean < 0.5 THEN 'rejected' ELSE 'pending' END AS band FROM promotions"),
        "gated_candidates": _with("promotions", "SELECT id, proposed_type FROM promotions WHERE least(d, u, r, a) >= 0.6"),
        "review_pending": _with("promotions", "SELECT id, round_even(mean, 3) AS mean FROM promotions WHERE status = 'pending' AND round_even(mean, 3) BETWEEN 0.3 AND 0.9 ORDER BY 2, 1 LIMIT 20"),
        "grey_zone": _with("promotions", "SELECT id, round_even(mean, 3) AS mean FROM (SELECT * FROM promotions WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 200) ORDER BY 2, 1 LIMIT 5"),
        "decide_promotions": _with("promotions", "SELECT id, CASE WHEN id % 3 = 0 AND status = 'pending' THEN 'approved' ELSE status END AS status FROM promotions"),
        "promoted_memories": _with("promotions", "SELECT 'promoted-' || id || '-doc-' || id AS slug, proposed_type AS type, 'Candidate ' || id AS title FROM promotions WHERE status = 'approved'"),
        "backfill_candidates": _with("memories", "SELECT slug FROM memories WHERE type = 'session' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = memories.doc_id)"),
        "sensitive_anti": _with("memories sensitive", "SELECT scope_hash, count(*) AS n FROM memories WHERE scope_hash NOT IN (SELECT scope_hash FROM sensitive) GROUP BY 1"),
        "gate_status": _with("memories", "SELECT scope_hash, CASE WHEN source = 'src0' THEN 'deny' ELSE 'allow' END AS result, count(*) AS n FROM memories GROUP BY 1, 2"),
        "entity_rollup": _with("entities", f"SELECT id, name, mention_count, {_t('first_seen_at')}, {_t('last_seen_at')}, scope_hash, context FROM entities"),
        "top_entities": _with("entities", f"SELECT id, mention_count, {_t('last_seen_at')} FROM entities WHERE entities.last_seen_at >= TIMESTAMP '1998-01-01' ORDER BY mention_count DESC, entities.last_seen_at DESC, id LIMIT 20"),
        "find_entities": _with("entities", "SELECT id, mention_count FROM entities WHERE lower(name) LIKE '%99%'"),
        "predicate_normalize": """SELECT ord, CASE WHEN back THEN object_id ELSE subject_id END AS subject_id, predicate, CASE WHEN back THEN subject_id ELSE object_id END AS object_id, round(confidence, 6) AS confidence FROM (
            SELECT o_orderkey AS ord, 's' || o_custkey AS subject_id, ['uses','works_on','located_at','cites','mentions','likes','belongs_to'][o_orderkey % 7 + 1] AS predicate, o_orderkey % 7 IN (0, 3) AS back,
            'o' || (o_orderkey % 10) AS object_id, least(greatest((o_totalprice % 100) / 50, 0), 1) AS confidence FROM orders) WHERE confidence >= 0.3""",
        "relation_dedupe": _with(
            "relations",
            "SELECT subject_id, predicate, object_id, source_memory_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id, source_memory_id ORDER BY ord) AS n FROM relations) WHERE n = 1 OR source_memory_id IS NULL",
        ),
        "kg_conflicts": _with(
            "relations",
            """, open_ AS (SELECT DISTINCT subject_id, predicate, object_id, source_memory_id FROM relations WHERE active AND source_memory_id IS NOT NULL AND predicate IN ('prefers', 'uses', 'works_on'))
            SELECT subject_id, predicate, object_id, source_memory_id AS memory_id FROM open_ WHERE (subject_id, predicate) IN (SELECT (subject_id, predicate) FROM open_ GROUP BY subject_id, predicate HAVING count(DISTINCT object_id) > 1 AND count(DISTINCT source_memory_id) > 1)""",
        ),
        "neighborhood": _with(
            "relations",
            "SELECT 'out' AS direction, predicate, object_id AS other, ord FROM relations WHERE active AND subject_id = 'entity:tool:brand_11' UNION ALL SELECT 'in', predicate, subject_id, ord FROM relations WHERE active AND object_id = 'entity:tool:brand_11'",
        ),
        "n_hop_2": _with(
            "relations",
            """, act AS (SELECT * FROM relations WHERE active), both_ AS (SELECT *, subject_id AS node, object_id AS other FROM act UNION ALL SELECT *, object_id, subject_id FROM act),
            one AS (SELECT DISTINCT other AS node FROM both_ WHERE node = 'entity:tool:brand_11'), two AS (SELECT DISTINCT other AS node FROM both_ WHERE node IN (SELECT node FROM one)),
            edges AS (SELECT * FROM both_ WHERE node = 'entity:tool:brand_11' OR node IN (SELECT node FROM one))
            SELECT 'entity:tool:brand_11' AS node, 0 AS hops, '' AS other, '' AS predicate UNION ALL SELECT node, 1, '', '' FROM one WHERE node <> 'entity:tool:brand_11'
            UNION ALL SELECT node, 2, '', '' FROM two WHERE node <> 'entity:tool:brand_11' AND node NOT IN (SELECT node FROM one)
            UNION ALL SELECT subject_id, -1, object_id, arg_max(predicate, ord) FROM edges GROUP BY subject_id, object_id""",
        ),
        "evolution_chain": _with(
            "chain",
            """, place AS (SELECT 'entity:person:customer_' || o_custkey AS entity_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS pos, 'memory:o' || o_orderkey AS memory_id, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
            SELECT entity_id, pos, memory_id FROM place WHERE n > 1""",
        ),
        "supersede_bands": _with("chain", "SELECT CASE WHEN confidence >= 0.9 THEN 'ignore' WHEN confidence >= 0.85 THEN 'apply' WHEN confidence >= 0.5 THEN 'pending' ELSE 'ignore' END AS action, count(*) AS n FROM chain WHERE before IS NOT NULL GROUP BY 1"),
        "knn_cosine": _with("nearest", "SELECT query, id, score, rank FROM nearest WHERE rank <= 10"),
        "extract_links": _with("links", "SELECT * FROM links"),
        "extract_entities": _with("links", "SELECT 'entity:' || type || ':' || replace(name, ' ', '_') AS id, count(DISTINCT memory_id) AS mention_count FROM links GROUP BY 1"),
        "extract_relations": _with(
            "links",
            f""", aliases AS (SELECT * FROM (VALUES {", ".join(str(x) for x in ALIASES.items())}) t(said, predicate)),
            ends AS (SELECT memory_id, said, coalesce(predicate, said) AS predicate, 'entity:' || other_type || ':' || replace(other, ' ', '_') AS a, 'entity:' || type || ':' || replace(name, ' ', '_') AS b
            FROM (SELECT memory_id, type, name, other_type, other, predicate AS said FROM links WHERE predicate IS NOT NULL) LEFT JOIN aliases USING (said))
            SELECT DISTINCT CASE WHEN said IN {REVERSED} THEN b ELSE a END AS subject_id, predicate, CASE WHEN said IN {REVERSED} THEN a ELSE b END AS object_id, memory_id AS source_memory_id FROM ends""",
        ),
        "global_graph": _with(
            "recent relations",
            """, tools AS (SELECT 'entity:tool:' || replace(lower(p_brand), '#', '_') AS id, replace(p_brand, '#', '_') AS name, count(*) AS mention_count, max(o_orderdate) + INTERVAL 9300 DAY AS last_seen_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
            all_ AS (SELECT id, name, 'person' AS type, mention_count, last_seen_at FROM recent UNION ALL SELECT id, name, 'tool', mention_count, last_seen_at FROM tools),
            seeds AS (SELECT id FROM (SELECT * FROM all_ WHERE last_seen_at >= TIMESTAMP '2023-12-13' ORDER BY mention_count DESC, last_seen_at DESC, id LIMIT 30) WHERE type = 'tool'),
            live AS (SELECT * FROM relations WHERE active), near AS (SELECT id FROM seeds UNION SELECT object_id FROM live JOIN seeds ON subject_id = id UNION SELECT subject_id FROM live JOIN seeds ON object_id = id),
            picked AS (SELECT * FROM live WHERE subject_id IN (SELECT id FROM near) OR object_id IN (SELECT id FROM near)),
            nodes AS (SELECT id FROM seeds UNION SELECT subject_id FROM picked UNION SELECT object_id FROM picked)
            SELECT nodes.id AS node, coalesce(all_.name, nodes.id) AS name, coalesce(type, 'unknown') AS type, mention_count, '' AS other, '' AS predicate FROM nodes LEFT JOIN all_ USING (id)
            UNION ALL SELECT subject_id, '', '', NULL, object_id, arg_max(predicate, ord) FROM picked GROUP BY subject_id, object_id""",
        ),
        "index_update": _with("bm25_ranked", "SELECT query, id, score, rank FROM bm25_ranked WHERE rank <= 10").replace("FROM documents", f"FROM ({REVISED})"),
        "bm25_topk": _with("bm25_ranked", "SELECT query, id, score, rank FROM bm25_ranked WHERE rank <= 10"),
        "rrf_fusion": _with("fused", "SELECT id, round(score, 6) AS score FROM fused"),
        "hybrid_search": _with(
            "nearest keyword_hits",
            """, parts AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS p FROM nearest WHERE query = 0 AND rank <= 40 UNION ALL SELECT id, 0.7::DOUBLE / (60 + rank) FROM keyword_hits),
            best AS (SELECT id, round(sum(p) + CASE WHEN id IN (3, 7, 11) THEN 0.5 ELSE 0 END, 6) AS score, id IN (3, 7, 11) AS boosted FROM parts GROUP BY id ORDER BY 2 DESC, 1 LIMIT 20)
            SELECT best.id, score, boosted FROM best JOIN memories ON doc_id = best.id WHERE type IN ('decision', 'fact', 'session')""",
        ),
        "score_and_rank": _with(
            "nearest bm25_ranked",
            """, s AS (SELECT id, score FROM nearest WHERE query = 50 AND rank <= 200 AND score >= 0.05), b AS (SELECT id, 1 / (1 + exp(-0.5::DOUBLE * (score - 9))) AS score FROM bm25_ranked WHERE query = 1 AND rank <= 100)
            SELECT s.id, round(least((s.score + coalesce(b.score, 0) + CASE WHEN s.id IN (2, 5) THEN 0.5 ELSE 0 END) / 2.5::DOUBLE, 1), 6) AS score FROM s LEFT JOIN b ON s.id = b.id ORDER BY 2 DESC, 1 LIMIT 25""",
        ),
        "bm25_normalize": """SELECT o_orderkey, round(1 / (1 + exp(-steep * (o_totalprice / 20000 - mid))), 6) AS score FROM (SELECT *, CASE WHEN n <= 3 THEN 5.0::DOUBLE WHEN n <= 6 THEN 7.0 WHEN n <= 9 THEN 9.0 WHEN n <= 15 THEN 10.0 ELSE 12.0 END AS mid,
            CASE WHEN n <= 3 THEN 0.7::DOUBLE WHEN n <= 6 THEN 0.6 ELSE 0.5 END AS steep FROM (SELECT *, o_orderkey % 20 + 1 AS n FROM orders))""",
        "session_search": _with(
            "memories triggers",
            """SELECT slug, stage, substr(coalesce(list_filter(string_split(body, chr(10)), lambda x: contains(lower(x), 'was'))[1], title), 1, 200) AS excerpt FROM (
            SELECT *, CASE WHEN slug IN (SELECT slug FROM triggers WHERE contains(lower(trigger), 'was')) THEN 1 WHEN contains(lower(title), 'was') OR contains(lower(body), 'was') THEN 2 END AS stage
            FROM memories WHERE decay_state <> 'soft-forgotten') WHERE stage IS NOT NULL ORDER BY stage, created_at DESC, slug LIMIT 50""",
        ),
        "keyword_lines": _with(
            "memories",
            "SELECT slug, CAST(list_position(hit, TRUE) AS INTEGER) AS line, substr(ls[list_position(hit, TRUE)], 1, 200) AS snippet FROM (SELECT *, list_transform(ls, lambda x: regexp_matches(x, '(?i)\\bthe\\b')) AS hit FROM (SELECT slug, string_split(body, chr(10)) AS ls FROM memories)) WHERE list_contains(hit, TRUE)",
        ),
        "contains_search": _with(
            "memories",
            "SELECT slug, replace(substr(body, greatest(p - 40, 1), p - greatest(p - 40, 1) + 8 + 40), chr(10), ' ') AS excerpt FROM (SELECT *, instr(lower(body), 'licensed') AS p FROM memories WHERE NOT scope_sensitive) WHERE p > 0 ORDER BY slug LIMIT 50",
        ),
        "fingerprint": "SELECT doc_id, sha1(substr(coalesce(text, ''), 1, 500)) AS fingerprint FROM documents",
        "content_hash": "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash FROM documents",
        "entity_id": "SELECT p_partkey, 'entity:tool:' || replace(lower(trim(p_name)), ' ', '_') AS entity_id FROM part",
        "kebab": _with("memories", f"SELECT slug, {KEBAB.format(c='title')} AS kebab FROM memories"),
        "infer_type": _with(
            "memories",
            "SELECT slug, CASE WHEN regexp_matches(title, '(?i)warning|踩坑|不要|避免|caution') THEN 'warning' WHEN regexp_matches(title, '(?i)playbook|流程|操作|how[- ]?to|steps?\\b') THEN 'playbook' WHEN regexp_matches(title, '(?i)decision|决策|选[择型方]?|chose|chosen') THEN 'decision' WHEN regexp_matches(title, '(?i)preference|偏好|习惯|prefer|like to') THEN 'preference' ELSE 'fact' END AS kind FROM memories",
        ),
        "derive_triggers": _with("memories", f"SELECT slug, array_to_string((CASE WHEN len(w) < 2 THEN list_concat(['imported', {KEBAB.format(c='title')}], w) ELSE w END)[1:5], ',') AS triggers FROM (SELECT *, {words} AS w FROM memories)"),
        "topic_key": _with("memories", "SELECT slug, CASE WHEN len(w) > 0 THEN substr(array_to_string(w[1:3], '_'), 1, 32) ELSE 'memory' END AS topic_key FROM (SELECT slug, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM memories)"),
        "clean_text": "SELECT page_id, sha1(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM pages",
        "count_words": "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: regexp_matches(t, '[\\x00-\\x7F]'))) AS INTEGER) AS words FROM documents",
        "sync_diff": _with("mine theirs", "SELECT r.id, CASE WHEN l.id IS NULL THEN 'new' WHEN l.content_hash = r.content_hash THEN 'unchanged' WHEN r.updated_at > l.updated_at THEN 'update' ELSE 'conflict' END AS status FROM theirs r LEFT JOIN mine l ON l.id = r.id"),
        "merge_fields": _with(
            "mine theirs",
            """SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL OR r.updated_at >= l.updated_at THEN r.content_hash ELSE l.content_hash END AS content_hash,
            CASE WHEN l.id IS NULL OR r.updated_at >= l.updated_at THEN r.memory_type ELSE l.memory_type END AS memory_type, coalesce(l.scope, r.scope) AS scope, least(l.created_at, r.created_at) AS created_at, greatest(l.updated_at, r.updated_at) AS updated_at,
            'all,lang-' || coalesce(l.lang, r.lang) || CASE WHEN l.id IS NULL THEN ',r' WHEN r.id IS NULL THEN ',l' ELSE ',l,r' END AS tags,
            CASE WHEN l.id IS NULL THEN 'r' || (r.doc_id % 2) || ',both' WHEN r.id IS NULL THEN 'l' || (l.doc_id % 2) || ',both' ELSE 'l' || (l.doc_id % 2) || ',both,r' || (l.doc_id % 2) END AS objects,
            CASE WHEN l.content_hash <> r.content_hash THEN 1 ELSE 0 END AS notes FROM mine l FULL JOIN theirs r ON l.id = r.id""",
        ),
        "import_bundle": _with("mine theirs", "SELECT CASE WHEN l.id IS NULL THEN 'imported' WHEN l.content_hash = r.content_hash THEN 'unchanged' ELSE 'merged' END AS action, count(*) AS n FROM theirs r LEFT JOIN mine l ON l.id = r.id GROUP BY 1"),
        "export_actions": _with("local_files remote_files", "SELECT l.key, CASE WHEN l.fingerprint = r.fingerprint THEN 'skip' ELSE 'copy' END AS action FROM local_files l LEFT JOIN remote_files r ON l.key = r.key"),
        "import_actions": _with("local_files remote_files", "SELECT r.key, CASE WHEN l.key IS NULL THEN 'copy' WHEN l.fingerprint = r.fingerprint THEN 'skip' ELSE 'conflict' END AS action FROM remote_files r LEFT JOIN local_files l ON l.key = r.key"),
        "sync_status": _with("local_files remote_files", "SELECT split_part(coalesce(l.key, r.key), '/', 2) AS scope, count(l.key) AS local, count(r.key) AS remote, count(*) FILTER (l.fingerprint <> r.fingerprint) AS differing FROM local_files l FULL JOIN remote_files r ON l.key = r.key GROUP BY 1"),
        "audit_filter": "SELECT event_id AS n, event_type, 'u' || (user_id % 10) AS scope_hash, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events WHERE user_id % 10 = 3 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-15'",
        "audit_verify": "SELECT log, line FROM (SELECT event_type AS log, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS line, event_id FROM events) WHERE event_id % 1000 = 999 AND line IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log ORDER BY event_id) = 1",
        "last_turns": "SELECT conv_id, turn, role, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 5) WHERE rank <= 8",
        "session_transcript": "SELECT conv_id, substr(string_agg('**' || coalesce(role, '?') || '**: ' || text, chr(10) || chr(10) ORDER BY turn), 1, 8000) AS body FROM conversations WHERE text <> '' GROUP BY 1",
        "month_report": _with(
            "memories promotions sensitive",
            """SELECT 'added' AS name, count(*) AS n FROM memories WHERE type <> 'session' AND NOT scope_sensitive AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01 00:00:00.999999'
            UNION ALL SELECT 'dropped', count(*) FROM memories WHERE decay_state = 'soft-forgotten' AND NOT scope_sensitive AND coalesce(last_recalled_at, created_at) >= TIMESTAMP '2024-01-01' AND coalesce(last_recalled_at, created_at) < TIMESTAMP '2024-02-01 00:00:00.999999'
            UNION ALL SELECT 'supersedes', count(*) FROM promotions WHERE status = 'approved' AND replaces AND scope_hash NOT IN (SELECT scope_hash FROM sensitive) AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01 00:00:00.999999'""",
        ),
        "weekly_signals": _with(
            "memories promotions triggers recent trigger_stats",
            """, long_term AS (SELECT * FROM memories WHERE type <> 'session' AND NOT scope_sensitive AND decay_state <> 'soft-forgotten'),
            fresh AS (SELECT * FROM long_term WHERE created_at >= TIMESTAMP '2024-01-05' ORDER BY created_at DESC, slug LIMIT 50),
            again AS (SELECT * FROM long_term WHERE recall_count >= 2 ORDER BY recall_count DESC, last_recalled_at DESC NULLS LAST, slug LIMIT 20),
            rows AS (SELECT 'new' AS kind, slug AS item, title, coalesce((SELECT string_agg(trigger, ',' ORDER BY trigger) FROM triggers t WHERE t.slug = fresh.slug), '') AS detail, recall_count AS n FROM fresh
            UNION ALL SELECT 'recurring', slug, title, '', recall_count FROM again
            UNION ALL (SELECT 'replaced', CAST(id AS VARCHAR), 'Candidate ' || id, 'doc-' || (id - 1), 1 FROM promotions WHERE status = 'approved' AND replaces AND created_at >= TIMESTAMP '2023-12-29' ORDER BY created_at DESC, id LIMIT 20)
            UNION ALL (SELECT 'entity', id, name, '', mention_count FROM recent WHERE last_seen_at >= TIMESTAMP '2023-12-13' ORDER BY mention_count DESC, last_seen_at DESC, id LIMIT 15)
            UNION ALL (SELECT 'trigger', trigger, '', '', CAST(sum(hits) AS BIGINT) FROM trigger_stats WHERE day >= DATE '2024-01-05' GROUP BY trigger ORDER BY sum(hits) DESC, trigger LIMIT 15)
            UNION ALL SELECT 'sources', '', '', '', (SELECT count(*) FROM fresh) + (SELECT count(*) FROM again))
            SELECT kind, item, title, detail, CAST(n AS BIGINT) AS n FROM rows""",
        ),
    }
