"""Plane geometry as Columns: points are pairs of columns or arrays of struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def polyline_length(points: Column) -> Column:
    """Sum over neighbouring points of an array of struct<x, y>; 0 for fewer than two."""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: length(a["x"], a["y"], b["x"], b["y"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d))


def angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From the x axis, in radians."""
    return F.atan2(y1 - y0, x1 - x0)


def azimuth(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Clockwise from north, in degrees from 0 to 360."""
    a = F.degrees(F.atan2(x1 - x0, y1 - y0))
    return F.when(a < 0, a + 360).otherwise(a)


def joint(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """The signed angle at b between the directions to a and to c, in degrees; 180 straight on."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    return F.degrees(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy))


def side(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Positive left of the directed segment, negative right of it, 0 on its line."""
    return (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)


def left_of(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """True left, False right, NULL on the line."""
    s = side(px, py, x0, y0, x1, y1)
    return F.when(s > 0, True).when(s < 0, False)


def crosses(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x0, y0, x1, y1) meet in a point within both."""
    one, two = side(b[0], b[1], *a), side(b[2], b[3], *a)
    three, four = side(a[0], a[1], *b), side(a[2], a[3], *b)
    return (F.signum(one) * F.signum(two) <= 0) & (F.signum(three) * F.signum(four) <= 0) & ~((one == 0) & (two == 0))


def ccw_turn(first: Column, second: Column) -> Column:
    """The counter-clockwise angle from one azimuth to another, in degrees from 0 to 360."""
    return F.pmod(first - second, F.lit(360.0))


def wkt_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    f = lambda c: c.cast("double").cast("string")
    corner = lambda x, y: F.concat(f(x), F.lit(" "), f(y))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin)), F.lit("))"))


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("double").cast("string"), F.lit(" "), y.cast("double").cast("string"), F.lit(")"))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through ascending xs and their ys; the end values beyond."""
    pick = lambda a, i: F.get(a, i)
    after = F.size(F.filter(xs, lambda v: v <= x))
    i = F.least(F.greatest(after - 1, F.lit(0)), F.size(xs) - 1)
    j = F.least(i + 1, F.size(xs) - 1)
    x0, x1, y0, y1 = pick(xs, i), pick(xs, j), pick(ys, i), pick(ys, j)
    return F.when(x <= pick(xs, F.lit(0)), pick(ys, F.lit(0))).when(i == j, y0).otherwise(y0 + F.try_divide((y1 - y0) * (x - x0), x1 - x0))


def vertex(points: Column, n: int) -> Column:
    """The n-th vertex from the start (from 1), or from the end if negative."""
    return F.try_element_at(points, F.lit(n))


def index_of(points: Column, x: Column, y: Column, digits: int = 6) -> Column:
    """The place (from 0) of a vertex after rounding, NULL if there is none."""
    snapped = F.transform(points, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    return F.nullif(F.array_position(snapped, F.struct(F.round(x, digits).alias("x"), F.round(y, digits).alias("y"))), F.lit(0)) - 1


def grows(values: Column, strict: bool = True) -> Column:
    """Whether an array never falls, or always rises."""
    pairs = F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: (b > a) if strict else (b >= a))
    return F.forall(pairs, lambda ok: ok)


def wkb(points: list[tuple[float, float]], kind: str = "line") -> bytes:
    """Little-endian WKB of a point, a line, a polygon of one ring, or several points."""
    import struct

    body = b"".join(struct.pack("<dd", x, y) for x, y in points)
    if kind == "point":
        return struct.pack("<BI", 1, 1) + body
    if kind == "line":
        return struct.pack("<BII", 1, 2, len(points)) + body
    if kind == "polygon":
        return struct.pack("<BIII", 1, 3, 1, len(points)) + body
    return struct.pack("<BII", 1, 4, len(points)) + b"".join(struct.pack("<BIdd", 1, 1, x, y) for x, y in points)
