"""Rasters sampled along lines and around points: carpets, crest levels, bank levels, drain levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.operators.raster import NODATA, Grid, sample, zonal_min


def segments(lines: DataFrame, key: str = "id") -> DataFrame:
    """key, segment, x0 .. y1 of lines (key, points array<struct<x, y>>)."""
    pairs = F.expr("zip_with(slice(points, 1, greatest(size(points) - 1, 0)), slice(points, 2, greatest(size(points) - 1, 0)), (a, b) -> struct(a.x as x0, a.y as y0, b.x as x1, b.y as y1))")
    return lines.select(key, F.posexplode(pairs).alias("segment", "p")).select(key, "segment", "p.*")


def along(parts: DataFrame, step: float, key: str = "id") -> DataFrame:
    """key, segment, place, x, y, ux, uy, length: points in the middle of every step of straight segments, with the direction there."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.sqrt(dx * dx + dy * dy)
    n = F.greatest(F.ceil(F.round(size / step, 9)), F.lit(1))
    rows = parts.where(size > 0).select("*", size.alias("_s"), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("place"))
    at = (F.col("place") + 0.5) / F.col("_n")
    return rows.select(key, "segment", "place", (F.col("x0") + dx * at).alias("x"), (F.col("y0") + dy * at).alias("y"), (dx / F.col("_s")).alias("ux"), (dy / F.col("_s")).alias("uy"), (F.col("_s") / F.col("_n")).alias("length"))


def carpet(points: DataFrame, width: float, step: float) -> DataFrame:
    """points spread over offsets at right angles, up to width to either side."""
    n = int(width / step)
    spread = points.withColumn("_k", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn("offset", F.col("_k") * step).drop("_k")
    return spread.withColumn("x", F.col("x") - F.col("uy") * F.col("offset")).withColumn("y", F.col("y") + F.col("ux") * F.col("offset"))


def levels_along(lines: DataFrame, pixels: DataFrame, grid: Grid, width: float = 0.0, lowest: bool = False, key: str = "id", value: str = "value") -> DataFrame:
    """key, segment, place, level, length: the highest (or lowest) value across the carpet at every step of a line."""
    points = carpet(along(segments(lines, key), grid.size, key), width, grid.size)
    hit = sample(points, pixels, grid, value).where((F.col(value) != NODATA) & F.col(value).isNotNull())
    return hit.groupBy(key, "segment", "place").agg((F.min if lowest else F.max)(value).alias("level"), F.first("length").alias("length"))


def crest_level(lines: DataFrame, pixels: DataFrame, grid: Grid, width: float = 0.0, key: str = "id", value: str = "value", lowest: bool = False) -> DataFrame:
    """key, level: the mean by length of the levels along a line."""
    found = levels_along(lines, pixels, grid, width, lowest, key, value)
    return found.groupBy(key).agg(F.try_divide(F.sum(F.col("level") * F.col("length")), F.sum("length")).alias("level"))


def breach_depth(lines: DataFrame, pixels: DataFrame, grid: Grid, width: float, key: str = "id", value: str = "value") -> DataFrame:
    """key, depth: the crest's level less that of the lowest ground across the carpet."""
    crest = crest_level(lines, pixels, grid, 0.0, key, value).withColumnRenamed("level", "crest")
    low = crest_level(lines, pixels, grid, width, key, value, lowest=True).withColumnRenamed("level", "low")
    return crest.join(low, key).select(key, (F.col("crest") - F.col("low")).alias("depth"))


def bank_level(sections: DataFrame, pixels: DataFrame, grid: Grid, key: str = "id", value: str = "value") -> DataFrame:
    """key, bank_level: the lower of the highest values left and right within each section's width (x, y, ux, uy, width), to three decimals; a side without values is left out."""
    reach = F.greatest(F.floor(F.col("width") / 2 / grid.size), F.lit(1)).cast("int")
    spread = sections.withColumn("_k", F.explode(F.sequence(-reach, reach))).withColumn("offset", F.col("_k") * grid.size).drop("_k").where("offset <> 0")
    spread = spread.withColumn("x", F.col("x") - F.col("uy") * F.col("offset")).withColumn("y", F.col("y") + F.col("ux") * F.col("offset"))
    hit = sample(spread, pixels, grid, value).where((F.col(value) != NODATA) & F.col(value).isNotNull())
    sides = hit.groupBy(key).agg(F.max(F.when(F.col("offset") > 0, F.col(value))).alias("left"), F.max(F.when(F.col("offset") < 0, F.col(value))).alias("right"))
    return sides.select(key, F.round(F.least("left", "right"), 3).alias("bank_level"))


#: Kinds of manholes that are connected, by name and code, and the indicator of inspection manholes.
CONNECTED, INSPECTION = ["connected", "double_connected", "102", "105"], ["inspection", "0"]


def takes_level(columns: list[str], connected_only: bool, inspection_only: bool) -> Column:
    """Whether a manhole gets a level: both rules are optional, and don't count without their column."""
    rule = F.lit(True)
    if connected_only and "calculation_type" in columns:
        rule = rule & F.coalesce(F.lower(F.col("calculation_type").cast("string")).isin(CONNECTED), F.lit(False))
    if inspection_only and "manhole_indicator" in columns:
        rule = rule & F.coalesce(F.lower(F.col("manhole_indicator").cast("string")).isin(INSPECTION), F.lit(False))
    return rule


def drain_level(manholes: DataFrame, pixels: DataFrame, grid: Grid, radius: float, overwrite: bool = False, value: str = "value", connected_only: bool = True, inspection_only: bool = False) -> DataFrame:
    """manholes with drain_level: the lowest ground around those that the rules take and that lack a level (or all of them, to overwrite)."""
    lowest = zonal_min(manholes, pixels, grid, radius, value)
    taken = takes_level(manholes.columns, connected_only, inspection_only) & (F.col("drain_level").isNull() | F.lit(overwrite))
    new = F.when(taken & F.col("lowest").isNotNull(), F.col("lowest")).otherwise(F.col("drain_level"))
    return manholes.join(lowest, "id", "left").withColumn("drain_level", new).drop("lowest")


def cut_points(sections: DataFrame, key: str = "channel", position: str = "position", length: str = "length") -> DataFrame:
    """sections with low and high: the part of a channel nearer to each than to its neighbours."""
    w = Window.partitionBy(key).orderBy(position, "id")
    half = lambda other: (F.col(position) + other) / 2
    return sections.withColumn("low", F.coalesce(half(F.lag(position).over(w)), F.lit(0.0))).withColumn("high", F.coalesce(half(F.lead(position).over(w)), F.col(length)))


def project(points: DataFrame, parts: DataFrame, key: str = "id") -> DataFrame:
    """points (pid, key, x, y) with place and away: where along their line they are nearest to it, and how far from it.

    parts is (key, segment, x0 .. y1); a point meets the segments of its own line.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = dx * dx + dy * dy
    before = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    lined = parts.withColumn("_before", F.coalesce(F.sum(F.sqrt(size)).over(before), F.lit(0.0)))
    both = points.join(lined, key)
    t = F.least(F.greatest(F.coalesce(F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, size), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    off = F.sqrt(F.pow(F.col("x") - F.col("x0") - t * dx, 2) + F.pow(F.col("y") - F.col("y0") - t * dy, 2))
    best = both.groupBy("pid", key).agg(F.min(F.struct(off.alias("away"), "segment", (F.col("_before") + t * F.sqrt(size)).alias("place"))).alias("b"))
    return best.select("pid", key, "b.place", "b.away")


def pixelized(parts: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """key, segment, t, x, y: the ends of segments and the places where they cross edges of pixels, in order and once each."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def cuts(a: str, b: str, origin: float, d):
        low, high = F.least(a, b), F.greatest(a, b)
        first, last = F.ceil((low - origin) / grid.size), F.floor((high - origin) / grid.size)
        every = F.when((d != 0) & (first <= last), F.sequence(first, F.greatest(last, first))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(every, lambda i: F.round(F.try_divide(i * grid.size + origin - F.col(a), d), 12))

    ts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts("x0", "x1", grid.x, dx), cuts("y0", "y1", grid.y, dy)), lambda t: (t >= 0) & (t <= 1))))
    return parts.select(key, "segment", "x0", "y0", dx.alias("_dx"), dy.alias("_dy"), F.explode(ts).alias("t")).select(key, "segment", "t", (F.col("x0") + F.col("_dx") * F.col("t")).alias("x"), (F.col("y0") + F.col("_dy") * F.col("t")).alias("y"))


def line_with_z(lines: DataFrame, pixels: DataFrame, grid: Grid, width: float = 0.0, key: str = "id", value: str = "value") -> DataFrame:
    """key, points array<struct<x, y, z>>: the line at every step, with the highest value across its carpet as z; places without data are left out."""
    at = along(segments(lines, key), grid.size, key).select(key, "segment", "place", "x", "y")
    rows = levels_along(lines, pixels, grid, width, False, key, value).join(at, [key, "segment", "place"])
    ordered = F.array_sort(F.collect_list(F.struct("segment", "place", "x", "y", F.col("level").alias("z"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("points"))


def consecutive(points: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """key, x0 .. y1: segments between points (key, place, x, y) that follow each other by place."""
    w = Window.partitionBy(key).orderBy(place)
    return points.select(key, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")


def within_width(points: DataFrame, parts: DataFrame, widths: list[tuple[float, float]], key: str = "id") -> DataFrame:
    """points (pid, key, x, y) no farther from their line than half its width there: linear between (position, width), constant beyond."""
    from hydroframe.functions.geometry import interpolate

    ordered = sorted(widths)
    at, wide = (F.array(*(F.lit(float(v[i])) for v in ordered)) for i in (0, 1))
    return project(points, parts, key).where(F.col("away") <= interpolate(F.col("place"), at, wide) / 2)
