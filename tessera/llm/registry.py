"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm.alignment import op12_alignment
from tessera.llm.chat import op11_chat
from tessera.llm.exact_dedup import op6_exact_dedup
from tessera.llm.infill import op13_infill
from tessera.llm.jaccard_join import op8_jaccard_join
from tessera.llm.licences import op4_licences
from tessera.llm.lm import op9_lm
from tessera.llm.media import op7_media
from tessera.llm.packing import op10_packing
from tessera.llm.pieces import op5_pieces
from tessera.llm.secrets import op3_secrets
from tessera.llm.sharding import op2_sharding
from tessera.llm.toxicity import op1_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_secrets": op3_secrets,
        "op4_licences": op4_licences,
        "op5_pieces": op5_pieces,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_media": op7_media,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_lm": op9_lm,
        "op10_packing": op10_packing,
        "op11_chat": op11_chat,
        "op12_alignment": op12_alignment,
        "op13_infill": op13_infill,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": SHARDING, "op6_exact_dedup": EXACT_DEDUP, "op8_jaccard_join": JACCARD_JOIN}


#: Jump hashing by its loop over the distinct keys, and CRCs byte by byte by a table made from the polynomial.
SHARDING = """
WITH RECURSIVE walk AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k, 0::BIGINT AS j, 0 AS shard, 0 AS grown_shard FROM documents
  UNION ALL
  SELECT doc_id, k2, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE)) AS BIGINT), CASE WHEN j < 40 THEN j ELSE shard END::INTEGER, j::INTEGER
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < 41)
), shards AS (SELECT doc_id, shard, grown_shard FROM walk WHERE j >= 41
), crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), rows AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size FROM documents
), told AS (
  SELECT doc_id, size, xor(list_reduce([4294967295] || list_transform(range(1, size - 15), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM rows, crcs
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM told JOIN shards USING (doc_id)
"""

#: Sets as texts of shingles, pairs by shared shingles, and reachability by recursion.
JACCARD_JOIN = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS s FROM texts
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""


EXACT_DEDUP = """
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]', '', 'g') AS norm
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM rows
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""
