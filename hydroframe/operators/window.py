"""The sample-and-hold window of a time aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.sources.scratch import Scratch


def window(steps: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """(t, te, dt) of every step whose value holds within start .. end: from te for dt seconds.

    A value holds until the next step; the end is clamped to the last step, whose own
    value is never used.  steps (t) is the dimension of distinct times, small beside
    the values, and is numbered in one task.  Raises if start isn't before end.
    """
    if start is not None and end is not None and not start < end:
        raise ValueError("the start must be before the end")
    held = steps.select("t").distinct().withColumn("next", F.lead("t").over(Window.orderBy("t"))).where("next is not null")
    te = F.col("t") if start is None else F.greatest("t", F.lit(float(start)))
    until = F.col("next") if end is None else F.least("next", F.lit(float(end)))
    return held.select("t", te.alias("te"), (until - te).alias("dt")).where("dt > 0")


def checked(win: DataFrame) -> DataFrame:
    """win, or an error if no step holds within it."""
    if win.limit(1).count() == 0:
        raise ValueError("no time step lies in the window")
    return win


def axis(win: DataFrame, start: float = 0.0) -> DataFrame:
    """win with the time since start at which each of its intervals begins."""
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return win.withColumn("at", F.coalesce(F.sum("dt").over(before), F.lit(0.0)) + F.lit(start))


def output_step(steps: DataFrame) -> DataFrame:
    """The step between outputs, as the whole part of last / (n - 1)."""
    return steps.agg(F.try_divide(F.max("t"), F.count("t") - 1).cast("int").alias("step"))


def sequence_of_steps(first, last, interval, temporal):
    """The times of a raster series: NULL alone if it isn't temporal; first, middle and last without an interval; else every interval, and the last."""
    n = ((last - first) / 3600000).cast("int") + 1
    middle = first + F.bround(n / 2, 0).cast("long") * 3600000
    spread = F.array_distinct(F.concat(F.sequence(first, last, F.greatest(interval, F.lit(1))), F.array(last)))
    return F.when(~temporal, F.array(F.lit(None).cast("long"))).when(interval.isNull(), F.array_distinct(F.array(first, F.least(middle, last), last))).otherwise(spread)


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in an order of all of them, without one task that sees all.

    Rows are dealt by ranges of the order; a range's numbers go on from those of the ranges
    before it, which are counted first.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    dealt = scratch.write(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_before")


def quantile_classes(rows: DataFrame, n: int, *order: str, name: str = "class") -> DataFrame:
    """rows with a class from 1 to n: as many in each, the first ones one more where they don't fit."""
    count = rows.count()
    size, more = divmod(count, n)
    place = F.col("_place") - 1
    early = place < more * (size + 1)
    found = F.when(early, F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / max(size, 1)))
    return numbered(rows, *order, name="_place").withColumn(name, (found + 1).cast("int")).drop("_place")
