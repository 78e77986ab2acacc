"""Discharge across gauge lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import geometry as G
from hydroframe.operators.meeting import meetings


def gauge_segments(gauges: DataFrame) -> DataFrame:
    """gauge, segment, gx0 .. gy1 of gauges (gauge, points array<struct<x, y>>)."""
    pairs = F.expr("zip_with(slice(points, 1, greatest(size(points) - 1, 0)), slice(points, 2, greatest(size(points) - 1, 0)), (a, b) -> struct(a.x as gx0, a.y as gy0, b.x as gx1, b.y as gy1))")
    return gauges.select("gauge", F.posexplode(pairs).alias("segment", "p")).select("gauge", "segment", "p.*")


def crossings(lines: DataFrame, gauges: DataFrame, cell: float = 50.0) -> DataFrame:
    """gauge, id, direction for each flowline that crosses a gauge line once: 1 from left to right, else -1.

    Gauges and lines meet through the grid cells that they run through, of which crowded
    ones are split, so only neighbours are compared; several crossings of one gauge raise
    an error when read.  A line that starts on the gauge counts by its end.
    """
    near = meetings(lines.select("id", "x0", "y0", "x1", "y1"), gauge_segments(gauges), ("x0", "y0", "x1", "y1"), ("gx0", "gy0", "gx1", "gy1"), cell)
    one = tuple(map(F.col, ("x0", "y0", "x1", "y1")))
    two = tuple(map(F.col, ("gx0", "gy0", "gx1", "gy1")))
    hits = near.where(G.crosses(one, two)).select("gauge", "segment", "id", *one, *two).distinct()
    left = F.coalesce(G.left_of(one[0], one[1], *two), ~G.left_of(one[2], one[3], *two))
    found = hits.groupBy("gauge", "id").agg(F.count("*").alias("n"), F.min(F.struct("segment", F.when(left, 1).otherwise(-1).alias("d")))["d"].alias("direction"))
    many = F.raise_error(F.concat(F.lit("line "), F.col("id"), F.lit(" crosses gauge "), F.col("gauge"), F.lit(" more than once"))).cast("int")
    return found.select("gauge", "id", F.when(F.col("n") > 1, many).otherwise(F.col("direction")).alias("direction"))


def totals(crossed: DataFrame, flows: DataFrame) -> DataFrame:
    """gauge, total: the signed sum of aggregated flows (id, q); lines without a value are left out."""
    return crossed.join(flows, "id").groupBy("gauge").agg(F.sum(F.col("q") * F.col("direction")).alias("total"))


def discharge_series(crossed: DataFrame, line_ts: DataFrame) -> DataFrame:
    """gauge, t, q: the signed sum at each step, NULL if a line has no value there."""
    q = F.col("q") * F.col("direction")
    joined = line_ts.select(F.col("entity_id").alias("id"), "t", "q").join(crossed, "id")
    return joined.groupBy("gauge", "t").agg(F.when(F.count(q) < F.count(F.lit(1)), None).otherwise(F.sum(q)).alias("q"))


def pivoted(series: DataFrame, gauges: list) -> DataFrame:
    """t and one column for each gauge."""
    return series.groupBy("t").pivot("gauge", gauges).agg(F.first("q"))


def of_content(lines: DataFrame, types: list[str]) -> DataFrame:
    """Lines of these content types; those without one and added ones always stay."""
    return lines.where(F.coalesce("content_type", F.lit("")).isin(*types, "", "v2_added_c"))


SUBSETS = {"2D_OPEN_WATER": [100, 101], "2D_GROUNDWATER": [-150, 150], "1D": [0, 1, 2, 3, 4, 5]}


def subset(lines: DataFrame, name: str) -> DataFrame:
    return lines.where(F.col("kcu").isin(SUBSETS[name]))


def turned(points, flag):
    """Points in reverse where the flag is set."""
    return F.when(flag, F.reverse(points)).otherwise(points)
