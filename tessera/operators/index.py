"""A stored inverted index of texts, for BM25.

A row of the index is a term in a block of documents: how many have it, their ids, counts and lengths, and the few (count,
length) pairs that no other one of the row beats, from which a bound of its scores follows for any mean length. Blocks are cut where
texts are read, so that building tokenises each text once and shuffles packed rows only; the empty term stands for all
documents of a block. Rows are written in ranges of terms, apart for each segment: an update filters the segments that have
documents to be replaced, and adds one for the new texts.

A search reads the rows of its terms. Bounds of blocks come first, without the packed columns: the blocks with a query's
highest bounds give a score that its best k have at least, and only blocks that can reach it are scored. A document is in one
block, so its score is complete there, and each block gives k candidates of a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.listing import top_of
from tessera.shared import delete, dropped, written

#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: Documents of a block at most, blocks of a query that are scored first, and query terms up to which the scan is told of each.
BLOCK, FIRST, PUSHED = 2048, 4, 64
#: Queries that meet a block's rows at a time.
QUERIES = 64
#: How far a bound may be under a score through rounding.
SLACK = 1e-5
_BIG, NOTHING = 1 << 40, -1


def _postings(ids: pa.Array, words: pa.ListArray, block: int) -> pa.RecordBatch:
    """The rows of a block: terms in order, the empty one (of all documents) first."""
    lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    document = np.repeat(np.arange(len(ids)), lengths)
    codes = rank[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    pairs, tf = np.unique(codes << 32 | document, return_counts=True)
    # the empty term's rows stand before all others
    term = np.concatenate([np.zeros(len(ids), np.int64), pairs >> 32])
    document = np.concatenate([np.arange(len(ids)), pairs & ((1 << 32) - 1)])
    tf = np.concatenate([np.zeros(len(ids), np.int64), tf])
    length = lengths[document]
    ends = np.searchsorted(term, np.arange(len(order) + 2)).astype(np.int32)
    # the pairs that no other of their term beats: in the order of falling counts, each with a length below all before it
    by = np.lexsort((length, -tf, term))
    value = length[by] - term[by] * _BIG
    lowest = np.minimum.accumulate(value)
    front = by[np.concatenate([[True], value[1:] < lowest[:-1]])] if len(by) else by
    front_ends = np.searchsorted(term[front], np.arange(len(order) + 2)).astype(np.int32)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends), values)
    small = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.cast(pa.string()).take(pa.array(order))]),
            pa.array(np.full(len(order) + 1, block)),
            pa.array(np.diff(ends).astype(np.int64)),
            lists(front_ends, small(tf[front])),
            lists(front_ends, small(length[front])),
            lists(ends, ids.take(pa.array(document))),
            lists(ends, small(tf)),
            lists(ends, small(length)),
        ],
        names=["term", "block", "n", "front_tf", "front_length", "ids", "tfs", "lengths"],
    )


def _packed(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    texts = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a few files that can't be split
        texts = texts.repartition(cores)
    rows = texts.select("id", tokens(F.col("text")).alias("words"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                words = part.column(1)
                yield _postings(part.column(0), pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy() - words.offsets[0].as_py()), words.flatten()), block)
                block += 1

    schema = f"term string, block bigint, n bigint, front_tf array<int>, front_length array<int>, ids array<{kind}>, tfs array<int>, lengths array<int>"
    return rows.mapInArrow(run, schema)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Rows with their segment, in ranges of terms; of an index that is there only the segments among them are written anew."""
    by = ["segment", "term", "block"]
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("segment").mode(mode)
    out.option("partitionOverwriteMode", "dynamic").parquet(path)


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Write the index of all texts to a path, over what is there; `block` documents stand in a block at most.

    Null texts have no words, but count as documents; keys are distinct; an empty table gives an index of nothing.
    """
    packed = written(_packed(docs, key, text, block).withColumn("segment", F.lit(0)), "postings")  # a range partitioning reads its input twice
    # a block without documents keeps the columns of an index of nothing
    nothing = docs.sparkSession.createDataFrame([("", NOTHING, 0, [], [], [], [], [], 0)], packed.schema)
    _write(packed.unionByName(nothing), path, "overwrite")
    dropped(packed)


def _without(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """Rows of an index without the documents that their blocks lose (of_segment, of_block, id)."""
    lists = ("ids", "tfs", "lengths")

    def run(own: pa.Table, gone: pa.Table) -> pa.Table:
        ids = own["ids"].combine_chunks()
        stays = pc.invert(pc.is_in(ids.flatten(), value_set=gone["id"].combine_chunks()))
        row = np.repeat(np.arange(len(own)), pc.list_value_length(ids).to_numpy())
        n = np.bincount(row[stays.to_numpy(zero_copy_only=False)], minlength=len(own))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        for c in lists:
            own = own.set_column(own.schema.get_field_index(c), c, pa.ListArray.from_arrays(ends, own[c].combine_chunks().flatten().filter(stays)))
        own = own.set_column(own.schema.get_field_index("n"), "n", pa.array(n.astype(np.int64)))
        return own.filter(pc.or_(pc.greater(own["n"], 0), pc.equal(own["block"], NOTHING)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("segment", "block").cogroup(lost.groupBy("of_segment", "of_block")).applyInArrow(run, schema)


def update(path: str, docs: DataFrame, gone: DataFrame | None = None, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Replace documents, and remove those whose keys are in `gone`.

    Segments that have none of the keys are not rewritten, and no text of theirs is read. To run it again with the same documents
    gives the same index but for the numbers of segments.
    """
    spark = docs.sparkSession
    index = spark.read.parquet(path)
    keys = docs.select(F.col(key).alias("id"))
    keys = (keys if gone is None else keys.union(gone.select(F.col(key).alias("id")))).distinct()
    there = index.where("term = ''").select("segment", F.explode("ids").alias("id"))
    hit = [r.segment for r in there.join(keys, "id", "left_semi").select("segment").distinct().collect()]  # as many rows as segments
    last = index.agg(F.max("segment").alias("s")).first().s
    fresh = written(_packed(docs, key, text, block).withColumn("segment", F.lit(0 if last is None else last + 1)), "postings")
    kept = None
    if hit:
        old = index.where(F.col("segment").isin(hit))
        there = old.where("term = ''").select(F.col("segment").alias("of_segment"), F.col("block").alias("of_block"), F.explode("ids").alias("id"))
        stays = _without(old, there.join(keys, "id", "left_semi"))
        kept = written(stays, "postings")  # before the segments that it reads are written anew
        empty = set(hit) - {r.segment for r in kept.select("segment").distinct().collect()}
        _write(kept, path, "overwrite")
        for segment in empty:
            delete(spark, f"{path}/segment={segment}")
        dropped(kept)
    _write(fresh, path, "append")
    dropped(fresh)


def merged(path: str, into: str, spark: SparkSession) -> None:
    """Write the index with all its segments as one to another path."""
    rows = spark.read.parquet(path)
    block = F.when(F.col("block") == NOTHING, F.col("block")).otherwise(F.xxhash64("segment", "block"))
    _write(rows.withColumns({"block": block, "segment": F.lit(0)}), into, "overwrite")


def _part(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _of_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The index's rows of some terms (a row each); a few terms reach the scan by name."""
    few = [r.term for r in terms.limit(PUSHED + 1).collect()]
    if 0 < len(few) <= PUSHED:
        index = index.where(reduce(lambda a, b: a | b, [F.col("term") == t for t in few]))
    return index.join(terms, "term", "left_semi")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank: the best k documents of each query (query, text) by BM25, rounded to six digits; ties go by id.

    Documents without a term of the query aren't given. Queries without a term that the index has give none.
    """
    index = spark.read.parquet(path)
    totals = index.where("term = ''").agg(F.sum("n").alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("words")).first()
    docs, mean = totals.docs or 0, max(totals.words or 0, 1) / max(totals.docs or 0, 1)
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    rows = _of_terms(index, asked.select("term").distinct())
    # numbers of each term and block, without what is packed
    beats = F.transform(F.arrays_zip("front_tf", "front_length"), lambda x: _part(x["front_tf"], x["front_length"], F.lit(mean)))
    told = rows.select("term", "segment", "block", "n", F.array_max(beats).alias("bound"))
    df = told.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    chunk = F.pmod(F.xxhash64("query"), F.lit(1 + queries.count() // QUERIES))
    weights = written(asked.join(df, "term").select("query", "term", idf.alias("idf"), chunk.alias("chunk")), "weights")
    bounds = weights.join(told.select("term", "segment", "block", "bound"), "term").groupBy("query", "segment", "block").agg(F.sum(F.col("idf") * F.col("bound")).alias("bound"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "block"))
    bounds = written(bounds.withColumn("place", order), "bounds")
    found = written(_scored(rows, weights, bounds.where(F.col("place") <= FIRST), k, mean), "scored")
    # a query's k-th best so far; one with fewer has none
    best = [F.desc("score"), F.asc("id")]
    least = top_of(found, ["query"], best, k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    rest = bounds.where(F.col("place") > FIRST).join(least, "query", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    return top_of(found.unionByName(_scored(rows, weights, rest, k, mean)), ["query"], best, k)


def _scored(rows: DataFrame, weights: DataFrame, blocks: DataFrame, k: int, mean: float) -> DataFrame:
    """query, id, score: the best k of each query and block (query, segment, block), and any that rounding may put level with them.

    The rows of a block meet QUERIES queries or so at a time, each row once.
    """
    by = ["segment", "block", "chunk"]
    wanted = blocks.select("query", "segment", "block").join(weights, "query")
    packed = wanted.select(*by, "term").distinct().join(rows.select("segment", "block", "term", "ids", "tfs", "lengths"), ["segment", "block", "term"])
    kinds = dict(wanted.dtypes)["query"], dict(rows.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def score(postings: pa.Table, asked: pa.Table) -> pa.Table:
        flat = pa.chunked_array(postings["ids"].chunks).combine_chunks()
        counts = np.diff(flat.offsets.to_numpy())
        coded = flat.flatten().dictionary_encode()
        codes, ends = coded.indices.to_numpy(), np.cumsum([0, *counts])
        tf, length = (postings[c].combine_chunks().flatten().to_numpy().astype(float) for c in ("tfs", "lengths"))
        parts = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        place = {t: (s, e) for t, s, e in zip(postings["term"].to_pylist(), ends, ends[1:], strict=False)}
        order = pc.sort_indices(asked, sort_keys=[("query", "ascending"), ("word", "ascending")])
        asked = asked.take(order)
        out: list[tuple] = [[], [], []]
        scores, now = np.zeros(len(coded.dictionary)), None
        rows_ = [*zip(asked["query"].to_pylist(), asked["word"].to_pylist(), asked["idf"].to_pylist(), strict=True), (None, None, None)]
        for i, (query, term, idf) in enumerate(rows_):
            if i and query != now:
                least = np.partition(scores, -k)[-k] if k < len(scores) else 0.0
                best = np.flatnonzero((scores > 0) & (scores >= least - 2e-6))
                out[0] += [now] * len(best)
                out[1].append(coded.dictionary.take(pa.array(best)))
                out[2].append(scores[best])
                scores = np.zeros(len(scores))
            now = query
            if term in place:
                s, e = place[term]
                scores[codes[s:e]] += idf * parts[s:e]
        columns = [pa.array(out[0], asked.schema.field("query").type), pa.concat_arrays(out[1]), pa.array(np.concatenate(out[2]))]
        return pa.Table.from_arrays(columns, names=["query", "id", "score"])

    asked = wanted.select(*by, "query", "term", "idf").toDF(*[f"{c}_" for c in by], "query", "word", "idf")
    met = packed.toDF(*packed.columns).groupBy(*by).cogroup(asked.groupBy(*[f"{c}_" for c in by])).applyInArrow(score, f"query {kinds[0]}, id {kinds[1]}, score double")
    return met.withColumn("score", F.round("score", 6))
