"""Tables that are written to by key: rows stand in buckets of their key's hash, and a write touches only the buckets of its keys.

A table is Parquet under buckets=<their number>/bucket=<which>. A batch reads and writes again the buckets that it has keys of, by
dynamic partition overwrite; to run the same batch again changes nothing, as long as the merge of rows has that property.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import delete, dropped, written

#: Buckets of a new table: with some GB of rows in each, a batch's work stays that of its own buckets.
BUCKETS = 64
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def replaced(key: str) -> Merge:
    """Newer rows in place of those with their key; of repeated new ones any one stays."""
    return lambda old, new: _without(old, new, key).unionByName(new.dropDuplicates([key]))


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    gone = keys.select(F.col(key).alias("gone_"))
    return rows.join(gone, rows[key].eqNullSafe(gone["gone_"]), "left_anti")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    out = rows.withColumns({"buckets": F.lit(buckets), "bucket": _bucket(key, buckets)}).repartition("bucket")
    out.write.partitionBy("buckets", "bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a new table. A null key is a key like others."""
    _write(rows, path, key, buckets)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table."""
    return spark.read.parquet(path).drop("buckets", "bucket")


def _hit(table: DataFrame, keys: DataFrame, key: str) -> tuple[int, list[int]]:
    """The number of buckets, and those that have the keys: BUCKETS rows at most."""
    buckets = table.select("buckets").first().buckets
    return buckets, [r.b for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect()]


def upsert(batch: DataFrame, path: str, key: str, merge: Merge | None = None, buckets: int = BUCKETS) -> None:
    """Merge a batch into a table, which is made if there is none; columns are those of the table.

    merge takes the rows of the batch's buckets and the batch, and gives these buckets' rows after it; without one new rows replace old
    ones. A batch is read more than once and must give the same rows each time.
    """
    merge = merge or replaced(key)
    spark = batch.sparkSession
    if not _there(spark, path):
        create(merge(batch.limit(0), batch), path, key, buckets)
        return
    table = spark.read.parquet(path)
    number, hit = _hit(table, batch, key)
    if not hit:
        return
    old = table.where(F.col("bucket").isin(hit)).drop("buckets", "bucket")
    after = written(merge(old, batch), "buckets")  # what it reads is about to be written anew
    _write(after, path, key, number)
    dropped(after)


def remove(keys: DataFrame, path: str, key: str) -> None:
    """Take the rows of some keys out of a table."""
    spark = keys.sparkSession
    table = spark.read.parquet(path)
    number, hit = _hit(table, keys, key)
    if not hit:
        return
    kept = _without(table.where(F.col("bucket").isin(hit)), keys, key)
    after = written(kept.select(*[c for c in table.columns if c != "buckets"]), "buckets")
    _write(after.drop("bucket"), path, key, number)
    for bucket in set(hit) - {r.bucket for r in after.select("bucket").distinct().collect()}:
        delete(spark, f"{path}/buckets={number}/bucket={bucket}")
    dropped(after)


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
