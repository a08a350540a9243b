"""Exact deduplication by a content sort.

Sampled splitters range-partition the normalised bytes, each partition is sorted (externally, if need be), and the
comparison of neighbours over the full bytes finds the runs of equal texts. A text of which there are very many copies
(told by exact counts of hashes) is cut into parts by the partition its rows are read from; its parts are sorted and
compared like other texts, and one small row of each is merged. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, numbered_columns, table, text_or_empty, written

#: Rows of a part of a text, about: HOT_ROWS or a HOT_TEXTS-th of all rows, so that at most HOT_TEXTS texts are cut.
HOT_ROWS, HOT_TEXTS = 1_000, 20_000
#: Characters of a text in a splitter.
HEAD = 32


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def _hot(rows: DataFrame) -> DataFrame:
    """hash, parts: the texts of which there are more rows than a part may have, HOT_TEXTS at most, with their numbers of parts.

    Counts are exact and added up before they are shuffled. Two texts of one hash would only both be cut.
    """
    counts = written(rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS), "counts")
    part = max(HOT_ROWS, rows.count() // HOT_TEXTS)
    return counts.where(F.col("n") > part).select("hash", F.ceil(F.col("n") / part).cast("int").alias("parts"))


def _sorted(rows: DataFrame) -> DataFrame:
    """rows (with norm) in the order of their normalised bytes, with head, hash, parts (1: whole) and part.

    Splitters are the texts' first characters, a hash and the part, so that their samples are small and a beginning that
    many texts share is split; the rows of a part of a text are in one range, and a window over them needs no shuffle.
    """
    rows = rows.withColumn("hash", F.xxhash64("norm"))
    cut = rows.join(F.broadcast(_hot(rows)), "hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumns({"head": F.substring("norm", 1, HEAD), "part": F.pmod(F.spark_partition_id(), F.col("parts"))})
    return cut.repartitionByRange("head", "hash", "part")


def _best() -> list[Column]:
    return [F.desc("points"), F.asc_nulls_last("key")]


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The group of equal normalised texts of each row.

    Of a group, the row with the most code points in the original text stays, then the one with the smallest key.
    Returns doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and empty texts are equal; null keys come last among rows that are otherwise
    equal. Of rows with the same key and text exactly one stays. An empty table gives no rows; other columns are
    ignored. A part of a text has HOT_ROWS rows, or a HOT_TEXTS-th of all, about; what its winners say of the whole
    text (HOT_TEXTS rows at most, without texts) is broadcast to the parts.
    """
    source = text_or_empty(text)
    rows = docs.select(F.col(key).alias("key"), F.char_length(source).cast("bigint").alias("points"), normalised(source).alias("norm"))
    part = Window.partitionBy("head", "hash", "part", "norm")  # by the full bytes
    order = part.orderBy(*_best())
    told = _sorted(rows).select(
        "key",
        F.first("key").over(order).alias("first_key"),
        F.max("points").over(part).alias("most"),
        F.count("*").over(part).alias("n"),
        (F.row_number().over(order) == 1).alias("first"),
        F.sha2("norm", 256).alias("sha"),
        "part",
        (F.col("parts") > 1).alias("cut"),
    )
    told = written(told, "sorted")
    best = F.min(F.struct(-F.col("most"), F.isnull("first_key"), F.col("first_key").alias("key"), F.col("part").alias("part")))
    whole = told.where("cut AND first").groupBy("sha").agg(F.sum("n").alias("all_n"), best.alias("best"))
    return told.join(F.broadcast(whole), "sha", "left").select(
        F.col("key").alias("doc_id"),
        F.when(F.col("cut"), F.col("best.key")).otherwise(F.col("first_key")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("first") & (~F.col("cut") | (F.col("part") == F.col("best.part")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts (as exact_groups has it), with the columns of docs.

    Of rows that share a key and an equal text, repeated ones too, one stays. Null keys are a key like others. Columns of
    docs pass through the sort; whatever their names are, none is changed.
    """
    own = numbered_columns(docs)
    of = dict(zip(docs.columns, own.columns, strict=True))
    source = text_or_empty(of[text])
    rows = own.withColumns({"key": F.col(of[key]), "points": F.char_length(source).cast("bigint"), "norm": normalised(source)})
    part = Window.partitionBy("head", "hash", "part", "norm").orderBy(*_best())
    firsts = _sorted(rows).withColumn("place", F.row_number().over(part)).where("place = 1")
    # of a text that was cut, one row of each part is left
    again = Window.partitionBy("hash", "norm").orderBy(*_best(), "part")
    merged = firsts.where("parts > 1").withColumn("place", F.row_number().over(again)).where("place = 1")
    return firsts.where("parts = 1").unionByName(merged).select(*own.columns).toDF(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))
