"""Cells of a computational grid with the pixels of their elevation model: sides, pairs, edges, and obstacles on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import geometry as G
from hydroframe.operators.raster import NODATA, Grid

SIDES = ("left", "right", "top", "bottom")


def cell_pixels(cells: DataFrame, pixels: DataFrame, grid: Grid, min_height: float, precision: float, value: str = "value") -> DataFrame:
    """id, row, col (within the cell, from its upper left) and z of every pixel of cells (id, xmin, ymin, xmax, ymax).

    A pixel without data stands above the cell's highest by the height and the
    precision, so that no ridge can't pass it; a cell without any data has none.
    """
    first_row, first_col = grid.row(F.col("ymax") - grid.size / 2), grid.col(F.col("xmin") + grid.size / 2)
    last_row, last_col = grid.row(F.col("ymin") + grid.size / 2), grid.col(F.col("xmax") - grid.size / 2)
    places = cells.select("id", first_row.alias("_r"), first_col.alias("_c"), F.explode(F.sequence(first_row, F.greatest(first_row, last_row))).alias("row"), last_col.alias("_last"))
    places = places.select("id", "_r", "_c", "row", F.explode(F.sequence(F.col("_c"), F.greatest(F.col("_c"), F.col("_last")))).alias("col"))
    known = pixels.select("row", "col", F.when(F.col(value) != NODATA, F.col(value)).alias("z"))
    met = places.join(known, ["row", "col"], "left")
    highest = met.groupBy("id").agg(F.max("z").alias("_top")).where("_top is not null")
    return met.join(highest, "id").select("id", (F.col("row") - F.col("_r")).alias("row"), (F.col("col") - F.col("_c")).alias("col"), F.coalesce("z", F.col("_top") + min_height + precision).alias("z"))


def side_pixels(block: DataFrame, side: str) -> DataFrame:
    """id, place, z: the pixels along one side of a cell, from the top or the left."""
    ends = block.groupBy("id").agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    on = {"left": F.col("col") == 0, "right": F.col("col") == F.col("_cols"), "top": F.col("row") == 0, "bottom": F.col("row") == F.col("_rows")}[side]
    return block.join(ends, "id").where(on).select("id", F.col("row" if side in ("left", "right") else "col").alias("place"), "z")


def side_of(cells: DataFrame, side: str) -> DataFrame:
    """id, x0 .. y1: one side of each cell as a segment, left to right or upwards."""
    ends = {"left": ("xmin", "ymin", "xmin", "ymax"), "right": ("xmax", "ymin", "xmax", "ymax"), "top": ("xmin", "ymax", "xmax", "ymax"), "bottom": ("xmin", "ymin", "xmax", "ymin")}[side]
    return cells.select("id", *(F.col(c).alias(n) for c, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)))


def edges_by_side(edges: DataFrame) -> DataFrame:
    """cell, side, n, first, last: the edges of each side of a cell by their place (edge, start_id, end_id, location, side_xmin .. side_ymax).

    location says where the end cell lies, seen from the start cell; the other cell sees
    it on the opposite side.  Edges of a side go from left to right, or from below.
    """
    opposite = F.create_map(*(F.lit(x) for x in ("left", "right", "right", "left", "top", "bottom", "bottom", "top")))
    place = F.when(F.col("location").isin("left", "right"), F.col("side_ymin")).otherwise(F.col("side_xmin"))
    seen = F.explode(F.array(F.struct(F.col("start_id").alias("cell"), F.col("location").alias("side")), F.struct(F.col("end_id").alias("cell"), F.element_at(opposite, F.col("location")).alias("side"))))
    rows = edges.select("id", place.alias("place"), seen.alias("s")).select("s.cell", "s.side", "place", "id")
    return rows.groupBy("cell", "side").agg(F.count("*").alias("n"), F.min_by("id", F.struct("place", "id")).alias("first"), F.max_by("id", F.struct("place", "id")).alias("last"))


def aligned(a_low: Column, a_high: Column, b_low: Column, b_high: Column, digits: int = 5) -> Column:
    """Whether two spans begin and end at one place, after rounding."""
    return (F.round(a_low, digits) == F.round(b_low, digits)) & (F.round(a_high, digits) == F.round(b_high, digits))


def bottom_up(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge stands upright."""
    return x0 == x1


def potential_edges(obstacles: DataFrame, cell_edges: DataFrame, flowlines: DataFrame) -> DataFrame:
    """obstacle, edge: edges of an obstacle's cells whose flowline it crosses, but not those that it starts or ends on.

    obstacles is (id, cells array, from_edge, to_edge, x0 .. y1); cell_edges (cell, edge);
    flowlines (edge, fx0 .. fy1).  Only edges of the obstacle's own cells are compared.  An
    obstacle at the model's boundary has no edge (null) at that end.
    """
    asked = obstacles.select("id", "from_edge", "to_edge", "x0", "y0", "x1", "y1", F.explode(F.array_distinct("cells")).alias("cell"))
    near = asked.join(cell_edges, "cell").where("not (edge <=> from_edge) and not (edge <=> to_edge)").join(flowlines, "edge")
    one, two = tuple(map(F.col, ("x0", "y0", "x1", "y1"))), tuple(map(F.col, ("fx0", "fy0", "fx1", "fy1")))
    return near.where(G.crosses(one, two)).select(F.col("id").alias("obstacle"), "edge").distinct()


def assigned(met: DataFrame, obstacles: DataFrame, edges: DataFrame, min_height: float, precision: float) -> DataFrame:
    """edge, obstacle, crest of met (obstacle, edge) where the crest (id, crest) is high enough above the edge's exchange level (edge, level)."""
    joined = met.join(obstacles.select(F.col("id").alias("obstacle"), "crest"), "obstacle").join(edges.select("edge", "level"), "edge")
    return joined.where(F.col("crest") > F.col("level") + (min_height - precision)).select("edge", "obstacle", "crest")


def result_rows(edges: DataFrame, met: DataFrame, as_obstacle: bool) -> DataFrame:
    """edge, level, crest, x0 .. y1 of every edge with an obstacle: the highest one's crest (of equals the last), and its segment or the edge's own.

    edges is (edge, level, x0 .. y1), met (edge, obstacle, crest, ox0 .. oy1).
    """
    best = met.groupBy("edge").agg(F.max_by(F.struct("crest", "ox0", "oy0", "ox1", "oy1"), F.struct("crest", "obstacle")).alias("b"))
    ends = [F.col(f"b.o{c}").alias(c) if as_obstacle else F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return edges.join(best, "edge").select("edge", "level", F.col("b.crest").alias("crest"), *ends)


def obstacle_segments(obstacles: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """id, x0 .. y1 of obstacles (id, from_cell, from_row, from_col, to_cell, to_row, to_col): from the middle of one pixel of a cell to that of another."""
    corner = lambda end: cells.select(F.col("id").alias(f"{end}_cell"), F.col("xmin").alias(f"_{end}_x"), F.col("ymax").alias(f"_{end}_y"))
    both = obstacles.join(corner("from"), "from_cell").join(corner("to"), "to_cell")
    x = lambda end: F.col(f"_{end}_x") + (F.col(f"{end}_col") + 0.5) * size
    y = lambda end: F.col(f"_{end}_y") - (F.col(f"{end}_row") + 0.5) * size
    return both.select("id", x("from").alias("x0"), y("from").alias("y0"), x("to").alias("x1"), y("to").alias("y1"))


def with_discharge(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """edges (edge, ...) with discharge_without_obstacle, discharge_with_obstacle and discharge_reduction of taken (id, without, with, reduced)."""
    named = taken.select(F.col("id").alias("edge"), F.col("without").alias("discharge_without_obstacle"), F.col("with").alias("discharge_with_obstacle"), F.col("reduced").alias("discharge_reduction"))
    return edges.join(named, "edge")


def missing_area(triangles: DataFrame, pixels: DataFrame, size: float, key: str = "id") -> DataFrame:
    """key, area, n_pixels: how much of a channel's triangles (key, x1 .. y3) has no pixel in its raster (key, row, col), as area and whole pixels; channels that lack none are left out."""
    c = F.col
    area = F.abs((c("x2") - c("x1")) * (c("y3") - c("y1")) - (c("x3") - c("x1")) * (c("y2") - c("y1"))) / 2
    whole = triangles.groupBy(key).agg(F.sum(area).alias("whole"))
    drawn = pixels.groupBy(key).agg((F.count("*") * (size * size)).alias("drawn"))
    short = c("whole") - F.coalesce("drawn", F.lit(0.0))
    return whole.join(drawn, key, "left").where(short > 0).select(key, short.alias("area"), F.floor(short / (size * size)).alias("n_pixels"))


def members(merged: DataFrame, lines: DataFrame, distance: float = 1e-6) -> DataFrame:
    """line, merged: lines (id, x0 .. y1) that a merged line (merged, points array<struct<x, y>>) holds as two neighbouring vertices, in either direction."""
    pairs = F.expr("zip_with(slice(points, 1, greatest(size(points) - 1, 0)), slice(points, 2, greatest(size(points) - 1, 0)), (a, b) -> struct(a.x as ax, a.y as ay, b.x as bx, b.y as by))")
    digits = max(0, round(-math.log10(distance)))
    key = lambda x0, y0, x1, y1: F.array_sort(F.array(F.struct(F.round(x0, digits).alias("x"), F.round(y0, digits).alias("y")), F.struct(F.round(x1, digits).alias("x"), F.round(y1, digits).alias("y"))))
    parts = merged.select("merged", F.explode(pairs).alias("p")).select("merged", key(F.col("p.ax"), F.col("p.ay"), F.col("p.bx"), F.col("p.by")).alias("k"))
    return lines.select(F.col("id").alias("line"), key(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("k")).join(parts, "k").select("line", "merged").distinct()
