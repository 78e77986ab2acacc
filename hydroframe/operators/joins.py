"""Joins by order: the last row at or before another, and points within intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """left with the values of the last row of right with its key at or before its order; NULL without one.

    Both tables are put in one order by key, and the last row of right is carried on; so
    one shuffle by key serves both.  Of equal rows of right the greatest values count; rows
    without an order have no match.
    """
    packed = F.struct(*values)
    latest = right.where(F.col(order).isNotNull()).groupBy(key, order).agg(F.max(packed).alias("_value"))
    rows = left.withColumn("_row", F.struct(*left.columns))
    both = latest.select(key, order, "_value", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side")).unionByName(rows.select(key, order, F.lit(None).cast(latest.schema["_value"].dataType).alias("_value"), "_row", F.lit(1).alias("_side")))
    carried = F.last("_value", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_value", carried).where("_side = 1").select("_row.*", *(F.col(f"_value.{v}").alias(v) for v in values))


#: Parts of the points of one step; its intervals are copied to each.
SHARES = 16


def within(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Every point with every interval low <= at < high that holds it; they meet by steps of `width`, so only neighbours are compared.

    The result can grow with the product of both tables while few steps hold them and both
    are small; so the points of a step are dealt to SHARES parts, and all parts to a fixed
    number of tasks for each core, which small inputs don't merge.
    """
    step = lambda c: F.floor(c / width)
    tasks, key = 4 * points.sparkSession.sparkContext.defaultParallelism, ["_step", "_share"]
    spread = intervals.where(F.col(low) < F.col(high)).withColumn("_step", F.explode(F.sequence(step(F.col(low)), step(F.col(high))))).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = points.withColumn("_step", step(F.col(at))).withColumn("_share", F.pmod(F.xxhash64(*points.columns), F.lit(SHARES)).cast("int"))
    return dealt.repartition(tasks, *key).join(spread.repartition(tasks, *key), key).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop(*key)
