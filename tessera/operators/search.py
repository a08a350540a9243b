"""Keyword, vector and BM25 retrieval, fusion by reciprocal ranks, boosts and scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import index
from tessera.operators.listing import top_of
from tessera.shared import fresh_path

#: The constant of reciprocal ranks, and the boost of a named entity.
RRF_K, ENTITY_BOOST = 60, 0.5
#: Vectors of a pack at most, and how much lower than a query's k-th best a cosine may be and still be level when rounded.
PACK, LEVEL = 4096, 2e-6
# Most query terms, midpoint and steepness of the logistic curve.
BM25_CURVES = ((3, 5.0, 0.7), (6, 7.0, 0.6), (9, 9.0, 0.5), (15, 10.0, 0.5), (None, 12.0, 0.5))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """query, id, score, rank: the best k of each query (query, text), by an index of the documents that is written once for all queries.

    To search the same documents again, keep an index (`index.build`) and search that.
    """
    path = fresh_path(docs.sparkSession, "index")
    index.build(docs, path, key, text)
    return index.search(docs.sparkSession, path, queries, k)


def _packs(vectors: DataFrame, kind: str) -> DataFrame:
    """ids, width, unit: rows (id, vector) in packs of up to PACK from each batch, their vectors of length one as bytes, one width a pack.

    Vectors that are null, empty, without length, or have a null or a number that isn't finite are in no pack: they have no cosine.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[batch["vector"].notna()]
            for width, own in rows.groupby(rows["vector"].map(len)):
                if not width:
                    continue
                matrix = np.stack([np.asarray(v, np.float64) for v in own["vector"]])
                norm = np.sqrt((matrix * matrix).sum(1))
                there = np.isfinite(norm) & (norm > 0)
                matrix, ids = matrix[there] / norm[there, None], own["id"].to_numpy()[there]
                for i in range(0, len(ids), PACK):
                    unit = matrix[i : i + PACK]
                    yield pd.DataFrame({"ids": [list(ids[i : i + PACK])], "width": [int(width)], "unit": [unit.tobytes()]})

    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInPandas(pack, f"ids array<{kind}>, width int, unit binary")


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, id, score, rank: exact nearest vectors by cosine (rounded to six digits) of a stated set of queries (query, vector).

    Both sides are packed, and each pack of queries meets each pack of vectors in one matrix product, of which a query's best k
    (and all that rounding may put level with them) go on: one plan for any number of queries, a scan for each PACK of them,
    and no pair of single rows leaves a task. Vectors of different widths, and those without a cosine, don't meet; ties go by id.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    # a partition of queries is one pack or so, as each goes through all packs of vectors
    asked = queries.select(F.col("query").alias("id"), "vector").repartition(1 + queries.count() // PACK)
    kinds = dict(asked.dtypes)["id"], dict(rows.dtypes)["id"]
    left, right = (_packs(df, kind).select(*[F.col(c).alias(f"{side}_{c}") for c in ("ids", "width", "unit")]) for df, kind, side in ((asked, kinds[0], "q"), (rows, kinds[1], "v")))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # compared here, as a join by width would bring all packs of the usual one to one task
            for row in batch[batch["q_width"] == batch["v_width"]].itertuples(index=False):
                ours, theirs = (np.frombuffer(u, np.float64).reshape(-1, row.q_width) for u in (row.q_unit, row.v_unit))
                own, other = np.asarray(row.q_ids), np.asarray(row.v_ids)
                for i in range(0, len(ours), PACK // 8):
                    scores = ours[i : i + PACK // 8] @ theirs.T
                    least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -2.0)
                    q, v = np.nonzero(scores >= least[:, None] - LEVEL)
                    yield pd.DataFrame({"query": own[i + q], "id": other[v], "score": scores[q, v]})

    pairs = left.crossJoin(right).mapInPandas(best, f"query {kinds[0]}, id {kinds[1]}, score double")
    return top_of(pairs.withColumn("score", F.round("score", 6)), ["query"], [F.desc("score"), F.asc("id")], k)


def reciprocal(rank: Column, weight: float = 1.0) -> Column:
    """weight / (k + rank) of a rank from 1."""
    return F.lit(weight) / (F.lit(float(RRF_K)) + rank)


def fuse(*ranked: tuple[DataFrame, float], by: str = "id") -> DataFrame:
    """id, score: the sum of all reciprocal ranks of each id over (hits with id and rank, weight); every hit counts."""
    parts = [df.select(F.col(by).alias("id"), reciprocal(F.col("rank"), w).alias("part")) for df, w in ranked]
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("id").agg(F.sum("part").alias("score"))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, boosts: DataFrame | None, k: int, keyword_weight: float = 1.0, vector_weight: float = 1.0, types: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """id, score, boosted: hits (id, rank) fused, a boost added for named ids, the top k; then (so that fewer may be left) by type."""
    fused = fuse((vector_hits, vector_weight), (keyword_hits, keyword_weight))
    if boosts is not None:
        fused = fused.join(boosts.select("id", F.lit(True).alias("boosted")).distinct(), "id", "left")
        fused = fused.withColumns({"boosted": F.coalesce("boosted", F.lit(False)), "score": F.col("score") + F.when(F.col("boosted"), ENTITY_BOOST).otherwise(0.0)})
    else:
        fused = fused.withColumn("boosted", F.lit(False))
    best = fused.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(k)
    return best if types is None or not kinds else F.broadcast(best).join(types.select("id", "type"), "id").where(F.col("type").isin(*kinds)).drop("type")


def lemmatised(query: Column) -> Column:
    """The words of a query, one space between them, as its length is counted by."""
    return F.array_join(tokens(query), " ")


def bm25_parameters(query: Column) -> tuple[Column, Column]:
    """Midpoint and steepness for a query, by its number of words (one at least)."""
    return bm25_curve(F.greatest(F.size(tokens(F.coalesce(query, F.lit("")))), F.lit(1)))


def bm25_curve(terms: Column) -> tuple[Column, Column]:
    """Midpoint and steepness for a number of query terms."""
    pick = lambda i: F.coalesce(*[F.when(F.lit(True) if most is None else terms <= most, F.lit((mid, steep)[i])) for most, mid, steep in BM25_CURVES])
    return pick(0), pick(1)


def normalised_bm25(raw: Column, midpoint: Column, steepness: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-steepness * (raw - midpoint)))


def score_and_rank(semantic: DataFrame, bm25_scores: DataFrame | None, boosts: DataFrame | None, threshold: float, k: int) -> DataFrame:
    """id, score: semantic hits (id, score) of the threshold or more, with BM25 (id, score) and boosts (id, boost) added, over what was possible."""
    most = 1.0 + (bm25_scores is not None) + (ENTITY_BOOST if boosts is not None else 0.0)
    rows = semantic.where(F.col("id").isNotNull() & (F.col("score") >= threshold)).select("id", F.col("score").alias("semantic"))
    total = F.col("semantic")
    for i, (df, column) in enumerate(((bm25_scores, "score"), (boosts, "boost"))):
        if df is not None:
            rows = rows.join(df.select("id", F.col(column).alias(f"part{i}")), "id", "left")
            total = total + F.coalesce(f"part{i}", F.lit(0.0))
    return rows.select("id", F.round(F.least(total / most, F.lit(1.0)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def session_search(memories: DataFrame, triggers: DataFrame, query: str, scope: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
    """slug, stage, excerpt: memories with a trigger that has the query, then those with it in title or body; the newest first in each stage."""
    low = query.lower()
    rows = memories.where("decay_state <> 'soft-forgotten'")
    rows = rows if scope is None else rows.where(F.col("scope_hash") == scope)
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    named = triggers.where(F.contains(F.lower("trigger"), F.lit(low))).select("slug").distinct().withColumn("named", F.lit(True))
    held = F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("body"), F.lit(low))
    hit = rows.join(named, "slug", "left").withColumn("stage", F.when(F.col("named"), 1).when(held, 2)).where("stage IS NOT NULL")
    line = F.get(F.filter(F.split("body", "\n"), lambda x: F.contains(F.lower(x), F.lit(low))), 0)
    return hit.select("slug", "stage", "created_at", F.substring(F.coalesce(line, "title"), 1, 200).alias("excerpt")).orderBy("stage", F.desc("created_at"), "slug").limit(limit).drop("created_at")


def keyword_lines(memories: DataFrame, pattern: str, scope: str | None = None) -> DataFrame:
    """slug, line, snippet, rank: the first line of each memory that matches a regular expression without regard to case."""
    rows = memories if scope is None else memories.where(F.col("scope_hash") == scope)
    lines = rows.where(F.col("body").rlike(f"(?im){pattern}")).select("slug", F.posexplode(F.split("body", "\n")).alias("line", "snippet")).where(F.col("snippet").rlike(f"(?i){pattern}"))
    first = lines.groupBy("slug").agg(F.min(F.struct("line", "snippet")).alias("first"))
    ranked = first.select("slug", (F.col("first.line") + 1).alias("line"), F.substring("first.snippet", 1, 200).alias("snippet"))
    return ranked


def contains_search(memories: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """slug, excerpt: memories of open scopes with the query, and 40 characters about its first place on one line."""
    low = F.lit(query.lower())
    rows = memories.where(~F.coalesce("scope_sensitive", F.lit(False)))
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    at = F.instr(F.lower("body"), low)
    start = F.greatest(at - 40, F.lit(1))
    excerpt = F.replace(F.substring("body", start, at - start + F.length(low) + 40), F.lit("\n"), F.lit(" "))
    return rows.where(at > 0).select("slug", excerpt.alias("excerpt")).orderBy("slug").limit(limit)


def hashing_embedder(size: int = 64):
    """An embedder without a model: signed feature hashing of words, with unit length; an Arrow UDF string -> array<float>."""
    import re
    import zlib

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            out = np.zeros(size, np.float32)
            for word in re.findall(r"\w+", (text or "").lower()):
                code = zlib.crc32(word.encode())
                out[code % size] += 1 if code & 0x80000000 else -1
            n = math.sqrt(float(out @ out))
            return out / n if n else out

        return texts.map(one)

    return embed


def vector_upsert(index: DataFrame | None, chunks: DataFrame, embed, model: str) -> DataFrame:
    """chunk_id, source, content, content_hash, embedding: chunks that the index doesn't have are embedded, and vanished ones of their sources go."""
    from tessera.functions.ids import chunk_id, content_hash

    fresh = chunks.withColumn("content_hash", content_hash(F.col("content")))
    fresh = fresh.withColumn("chunk_id", chunk_id(F.col("source"), F.col("start_line"), F.col("end_line"), F.col("content_hash"), model)).select("chunk_id", "source", "content", "content_hash")
    if index is None:
        return fresh.withColumn("embedding", embed("content"))
    stays = index.join(fresh.select("source").distinct(), "source", "left_anti").unionByName(index.join(fresh.select("chunk_id"), "chunk_id", "left_semi").join(fresh.select("source").distinct(), "source", "left_semi").select(*index.columns))
    return stays.unionByName(fresh.join(index.select("chunk_id"), "chunk_id", "left_anti").withColumn("embedding", embed("content")).select(*index.columns))


def vector_query(index: DataFrame, condition: str, limit: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Rows of an index by a condition over its plain columns, without a vector."""
    rows = index.where(condition)
    return rows if limit is None else rows.orderBy(key).limit(limit)


def vector_delete(index: DataFrame, gone: DataFrame, by: str = "source") -> DataFrame:
    """The index without the rows of some sources (or chunks)."""
    return index.join(gone.select(by).distinct(), by, "left_anti").select(*index.columns)


def vector_count(index: DataFrame, by: str = "source") -> DataFrame:
    """Rows of each source."""
    return index.groupBy(by).agg(F.count("*").alias("n"))


def dense_bm25(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """id, score: reciprocal ranks of two retrievers (id, rank), divided by what a first place in both would have."""
    return fuse((dense, 1.0), (sparse, 1.0)).withColumn("score", F.col("score") / (2.0 / (k + 1)))
