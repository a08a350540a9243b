"""Sharding by jump consistent hashing: a stable key and the number of shards decide the shard, without a ring table.

DataFrame expressions only. The 64-bit generator is computed on 32-bit limbs, as a product of two 64-bit
numbers raises an overflow error in ANSI mode. The sequence of jumps of a key does not depend on the number of
shards, so the shards under two counts come from one walk: each is the last jump below its count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty, written

# The multiplier of the published generator (key = key * 2862933555777941757 + 1), in limbs.
MULTIPLIER = 2862933555777941757
MASK32, MASK16 = 0xFFFFFFFF, 0xFFFF
#: Distinct rows of a block within which they are numbered, about, and repeats of a row that one task writes.
BLOCK_ROWS, REPEATS = 250_000, 1_000_000


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The limbs of (hi * 2**32 + lo) * MULTIPLIER + 1 modulo 2**64."""
    m_hi, m_1, m_0 = MULTIPLIER >> 32, MULTIPLIER >> 16 & MASK16, MULTIPLIER & MASK16
    m32, m16 = F.lit(MASK32), F.lit(MASK16)

    def low_product(a: Column, b1: int, b0: int) -> Column:  # a * b modulo 2**32
        return (a * b0 + F.shiftleft((a * b1).bitwiseAND(m16), 16)).bitwiseAND(m32)

    t0 = lo * m_0 + F.lit(1)
    t1 = lo * m_1 + F.shiftright(t0, 16)
    low = F.shiftleft(t1.bitwiseAND(m16), 16).bitwiseOR(t0.bitwiseAND(m16))
    high = (F.shiftright(t1, 16) + low_product(hi, m_1, m_0) + low_product(lo, m_hi >> 16, m_hi & MASK16)).bitwiseAND(m32)
    return high, low


def jump_shards(key: Column, counts: list[int]) -> Column:
    """An array of the shards of a 64-bit key (null: key 0) under each of `counts`, each at least 1."""
    if min(counts) < 1:
        raise ValueError("a number of shards is at least 1")
    key, most = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")), max(counts)
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(MASK32)).alias("lo"),
        F.lit(0).cast("bigint").alias("next"),
        F.array(*[F.lit(0).cast("bigint")] * len(counts)).alias("at"),
    )

    def walk(acc: Column, _: Column) -> Column:
        at = F.array(*[F.when(acc.next < n, acc.next).otherwise(acc["at"][i]) for i, n in enumerate(counts)])
        hi, lo = _step(acc.hi, acc.lo)
        jump = F.floor((acc.next + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(acc.next >= most, acc).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), jump.cast("bigint").alias("next"), at.alias("at")))

    # each jump goes at least one shard on, so there are at most `most` of them
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, walk, lambda acc: acc["at"])


def stable_key(docs: DataFrame, key: str) -> Column:
    """The key as a 64-bit integer: integers as they are, anything else by a hash of its text (null: 0)."""
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.col(key).cast("bigint") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of `shards` shards by its key and number each shard's rows without gaps.

    Returns doc_id, size (UTF-8 bytes and 16), text_crc32, law ("key"), shard, slot, grown_shard. Slots follow the order of
    key, CRC and size.

    Null keys are one key (0) and stand first; keys that aren't integers are hashed; a null or empty text has size 16 and
    CRC 0; rows with the same key share a shard and have slots of their own; repeated rows are kept; an empty table gives
    no rows; other columns are ignored. Rows that are equal in all three are counted first, and what is distinct is
    range-partitioned into blocks of BLOCK_ROWS, each of which begins where the one before it ends: neither a shard, nor
    the rows of one key, nor those of one key and text are gathered in one task.
    """
    keyed = docs.select(
        F.col(key).alias("doc_id"),
        stable_key(docs, key).alias("stable"),
        (F.octet_length(text_or_empty(text)) + 16).cast("bigint").alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    rows = keyed.groupBy(*order, "stable").agg(F.count("*").alias("n")).withColumn("at", jump_shards(F.col("stable"), [shards, shards + 1]))
    rows = rows.select(*order, "n", F.col("at")[0].cast("int").alias("shard"), F.col("at")[1].cast("int").alias("grown_shard"))
    blocks = 1 + docs.count() // BLOCK_ROWS
    ranged = written(rows.repartitionByRange(blocks, "shard", *order).withColumn("block", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("shard", "block").agg(F.sum("n").alias("all_n"))  # blocks + shards rows at most
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("all_n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("place", F.sum("n").over(own) - F.col("n")).join(offsets, ["shard", "block"])
    placed = placed.select(*order, "shard", "grown_shard", (F.col("first") + F.col("place")).alias("slot"), "n")
    few = placed.where(F.col("n") <= REPEATS)
    # repeats beyond that are dealt out before they are written
    many = placed.where(F.col("n") > REPEATS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / REPEATS))))
    many = many.select(*order, "shard", "grown_shard", (F.col("slot") + F.col("part") * REPEATS).alias("slot"), F.least(F.col("n") - F.col("part") * REPEATS, F.lit(REPEATS)).alias("n"))
    every = few.unionByName(many.repartition("slot")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return every.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("i")).cast("bigint").alias("slot"), "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return shard(table(spark, sf_dir, "documents"), 40)
