"""Running values over an ordered key, in two levels, so that a key with a third of all rows is no single task.

Rows of a key are cut into blocks by their order number; a first window runs inside the blocks, a
second over one row per block, and a join adds what comes from the blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the rows of a key next to each other in one partition, in order: for passes that carry a small state from row to row and hold no group in memory."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def order_block(order: Column, tie: Column, block: int = BLOCK) -> Column:
    """The block of an order number. Rows without a number come first; many of them are spread by their tie-break."""
    return F.when(order.isNull(), F.pmod(F.xxhash64(tie), F.lit(256)) - 256).otherwise(F.floor(order / block))


def running_last(rows: DataFrame, keys: list[str], order: str, tie: str, value: str, out: str, block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Adds the last non-null `value` up to each row, and with it where inclusive."""
    blocked = rows.withColumn("_block", order_block(F.col(order), F.col(tie), block))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col(order).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = blocked.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    position = F.struct(F.coalesce(F.col(order), F.lit(-1)).alias("o"), F.col(tie).alias("t"))
    ends = blocked.filter(F.col(value).isNotNull()).groupBy(*keys, "_block").agg(F.max_by(value, position).alias("_end"))
    blocks = blocked.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*keys, "_block", "_carried")
    return own.join(carried, [*keys, "_block"], "left").withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_carried", "_block")


def running_count(rows: DataFrame, keys: list[str], order: str, tie: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds each row's position in its key, from 0, by order and tie-break."""
    blocked = rows.withColumn("_block", order_block(F.col(order), F.col(tie), block))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col(order).asc_nulls_first(), tie)
    own = blocked.withColumn("_own", F.row_number().over(inside))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*keys, "_block", "_before")
    return own.join(carried, [*keys, "_block"]).withColumn(out, F.col("_before") + F.col("_own") - 1).drop("_own", "_before", "_block")


def running_sum(rows: DataFrame, keys: list[str], order: str, tie: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of `value` up to and with each row."""
    blocked = rows.withColumn("_block", order_block(F.col(order), F.col(tie), block))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col(order).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0)
    own = blocked.withColumn("_own", F.sum(value).over(inside))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*keys, "_block", "_before")
    return own.join(carried, [*keys, "_block"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_own", "_before", "_block")
