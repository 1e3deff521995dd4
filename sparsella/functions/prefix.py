"""Running totals and dense numbers over dense integer ids, without moving all rows to one task.

Ids are cut into blocks of WIDTH; a window runs inside each block, and another over one row a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 16


def running_total(df: DataFrame, key: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with the inclusive running total of value in the order of key (integers)."""
    block = F.expr(f"cast(floor({key} / {width}) as bigint)")
    rows = df.withColumn("_block", block)
    totals = rows.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = totals.select("_block", F.coalesce(F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_inside", F.sum(value).over(inside)).join(F.broadcast(before), "_block").withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def dense_number(df: DataFrame, key: str, out: str) -> DataFrame:
    """df with 0-based numbers in the order of key (distinct integers)."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", out).withColumn(out, F.col(out) - 1).drop("_one")
