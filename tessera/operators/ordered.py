"""Numbers and predecessors of rows in an order, where one group may hold most rows.

A window over a hot group would sort it in one task. Here all rows are sorted by group and order in ranges of about as many rows
each, whatever the values are, and written with their place; of each range only its edges meet those of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import written

#: Where a row stands: its range, and its place there.
PART, PLACE = "part_", "place_"


def placed(rows: DataFrame, by: str, *order: str | Column) -> DataFrame:
    """rows in the order of `by` and `order` (null first), written, with their range and place there.

    Equal rows are kept apart by where they are read, so that they may fill any number of ranges.
    """
    keys = [F.col(by), *[F.col(c) if isinstance(c, str) else c for c in order], F.col("row_")]
    whole = rows.withColumn("row_", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(whole.drop("row_").withColumns({PART: F.spark_partition_id(), PLACE: place}), "ordered")


def numbered(rows: DataFrame, by: str, order: str | list[Column], first: str) -> DataFrame:
    """rows with pos, from 1 in the order within `by`, and first_, the column `first` of the group's first row.

    Null groups are one group; a null order stands before all others; equal orders are numbered by `first`.
    """
    table = placed(rows, by, *([order] if isinstance(order, str) else order), first)
    # a row for each group and range: as many as groups and ranges
    edges = table.groupBy(F.col(by).alias("by_"), F.col(PART).alias("at_")).agg(F.count("*").alias("rows_"), F.min(PLACE).alias("start_"), F.min_by(F.struct(first), PLACE).alias("least_"))
    up_to = Window.partitionBy("by_").orderBy("at_")
    past = F.coalesce(F.sum("rows_").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = F.first("least_").over(up_to.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = edges.select("by_", "at_", (past - F.col("start_") + 1).alias("past_"), least[first].alias("first_"))
    same = (F.col(PART) == F.col("at_")) & F.col(by).eqNullSafe(F.col("by_"))
    return table.join(edges, same).select(*rows.columns, (F.col("past_") + F.col(PLACE)).alias("pos"), "first_")


def before(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """rows with before_: a struct `value` of `column` of the row before in the order within `by`; a group's first row has none (null).

    Null groups are one group; a null order stands before all others; equal orders go by `column`.
    """
    table = placed(rows, by, order, column)
    own = F.struct(F.col(by).alias("by"), F.col(column).alias("value"))
    # the last row of each range, for the one after it: as many as ranges
    edges = table.groupBy(F.col(PART).alias("at_")).agg(F.max_by(own, PLACE).alias("last_"))
    edges = edges.select("at_", F.lag("last_").over(Window.orderBy("at_")).alias("far_"))
    near = F.lag(own).over(Window.partitionBy(PART).orderBy(PLACE))
    found = table.withColumn("near_", near).join(F.broadcast(edges), F.col(PART) == F.col("at_"))
    last = F.when(F.col(PLACE) == 0, F.col("far_")).otherwise(F.col("near_"))
    same = last.isNotNull() & last["by"].eqNullSafe(F.col(by))
    return found.select(*rows.columns, F.when(same, F.struct(last["value"].alias("value"))).alias("before_"))
