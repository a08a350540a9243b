"""Best-fit packing of token sequences by patterns.

Documents become pieces of at most `capacity` tokens. The histogram of piece lengths (at most `capacity` numbers)
goes to the driver, where repeat counts of patterns of two or three lengths that fill a sequence exactly are fitted
to it by non-negative least squares, rounded so that the total stays, and what is left is packed best fit first. The plan
is a list of patterns with repeats; Spark numbers the pieces of each length and looks up their places in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered_columns, slices, table, text_or_empty, written
from tessera.llm.bpe import Encoder

CAPACITY = 2048
#: Rounds of the least-squares fit.
ROUNDS = 200
#: Characters that a task tokenises at a time.
BATCH_CHARS = 4 << 20


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, and ids (array of int) if asked for.

    A document is its ids, special tokens by their own, and then id 0 (so that an empty or null text has one token). Only documents longer than
    `capacity` are cut; all pieces but the first are then full. A repeated row has pieces of its own.
    """
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer, added=True)
        for batch in batches:
            keys = batch.column(0)
            texts = batch.column(1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64, len(texts) + 1, texts.offset * (4 if pa.types.is_string(texts.type) else 8)))
            for part in slices(sizes, BATCH_CHARS):
                rows: list[tuple[int, int, int, int, int]] = []
                ids = []
                for i, packed in zip(range(part.start, part.stop), encoder.encode(texts[part].to_pylist()), strict=True):
                    packed += b"\0\0\0\0"
                    total = len(packed) // 4
                    first = total % capacity or capacity
                    for piece, end in enumerate(range(first, total + 1, capacity)):
                        start = max(0, end - capacity) if piece else 0
                        own = packed[4 * start : 4 * end]
                        rows.append((i, piece, start, end - start, zlib.crc32(own)))
                        if with_ids:
                            ids.append(np.frombuffer(own, np.uint32).astype(np.int32))
                index, piece, start, length, crc = (pa.array(x) for x in np.array(rows, np.int64).reshape(-1, 5).T)
                columns = [keys.take(index), piece.cast(pa.int32()), start, length, crc]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return source.mapInArrow(cut, schema)


def patterns_of(histogram: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence exactly, of lengths that occur."""
    capacity = len(histogram) - 1
    there = np.flatnonzero(histogram)
    there = there[there > 0]
    has = np.zeros(capacity + 1, bool)
    has[there] = True
    pairs = there[(2 * there <= capacity) & (there < capacity)]
    pairs = pairs[has[capacity - pairs]]
    out = [np.stack([pairs, capacity - pairs, 0 * pairs], 1)]
    for a in there:
        b = there[(there >= a) & (2 * there <= capacity - a)]
        b = b[has[capacity - a - b]]
        out.append(np.stack([0 * b + a, b, capacity - a - b], 1))
    return np.concatenate(out)


def nnls(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that makes the patterns' lengths, x times each, least-squares close to the histogram (multiplicative updates)."""
    target = histogram.astype(float).copy()
    target[0] = 0.0
    goal = target[patterns].sum(1)
    x = goal / np.maximum(1, np.bincount(patterns.ravel(), minlength=len(target)))[patterns].max(1) / 3
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), np.repeat(x, 3), len(target))
        made[0] = 0.0
        x *= goal / np.maximum(made[patterns].sum(1), 1e-12)
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats that use up the histogram of lengths 0 to capacity."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    capacity = len(left) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    found = patterns_of(left)
    if len(found):
        # most repeats are under 1 where there are more patterns than sequences: what rounding takes goes to the next pattern
        fitted = np.diff(np.floor(np.cumsum(nnls(found, left))), prepend=0.0).astype(np.int64)
        for i in np.flatnonzero(fitted):
            lengths = [int(n) for n in found[i] if n]
            often = min(int(fitted[i]), *(int(left[n]) // lengths.count(n) for n in lengths))
            if often > 0:
                out.append((tuple(lengths), often))
                for n in lengths:
                    left[n] -= often
    # what is left: the largest piece, then the largest that fits, and so on; as often as the pieces last
    for largest in range(capacity, 0, -1):
        while left[largest]:
            lengths, room = [largest], capacity - largest
            used = {largest: 1}
            n = min(room, largest)
            while n > 0:
                if left[n] > used.get(n, 0):
                    lengths.append(n)
                    used[n] = used.get(n, 0) + 1
                    room -= n
                    n = min(room, n)
                else:
                    n -= 1
            often = min(int(left[n]) // k for n, k in used.items())
            out.append((tuple(lengths), often))
            for n, k in used.items():
                left[n] -= often * k
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Intervals of the ranks within a length: length, first rank, first sequence, offset; sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for lengths, often in planned:
        offset = 0
        for n in lengths:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + often
            offset += n
        sequence += often
    table_ = np.array(rows, np.int64).reshape(-1, 4)
    return tuple(table_[np.lexsort((table_[:, 1], table_[:, 0]))].T)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns, with `length` from 1 to capacity) with sequence_id and offset.

    A piece of `capacity` tokens is a sequence of its own (of a negative number). The others are numbered within their
    length and the partition of the written pieces that they stand in, so that no length is gathered in one task, and
    each such group begins where the one before it ends. The driver has one number for each length.
    """
    others = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = numbered_columns(pieces.select(*others)).withColumn("part", F.spark_partition_id())
    own = own.withColumnRenamed(f"c{others.index('length')}", "length")
    cut = written(own, "pieces")
    names = [c for c in cut.columns if c != "part"]
    full = cut.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    counts = rest.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[r.length] = r.n
    where = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    group = Window.partitionBy("length", "part").orderBy(F.lit(0))
    ranked = rest.withColumn("place", F.row_number().over(group) - 1).join(firsts, ["length", "part"])
    ranked = ranked.select(*names, (F.col("first") + F.col("place")).alias("rank"))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, firsts_, sequences, offsets = where.value
        keys = lengths * (1 << 44) + firsts_
        at = np.searchsorted(keys, length.to_numpy(np.int64) * (1 << 44) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy(np.int64) - firsts_[at], "offset": offsets[at]})

    found = ranked.withColumn("place", place(F.col("length"), F.col("rank"))).select(*names, "place.sequence_id", "place.offset")
    return found.unionByName(full).toDF(*others, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the plan finds.

    Returns doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset. A null text counts as empty and has one
    token; very long texts are cut whole into full pieces; ties and repeated rows are pieces like others; null keys
    are kept; an empty table gives no rows; other columns are ignored.
    """
    return placed(tokenised(docs, tokenizer, capacity, key, text, with_ids), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
