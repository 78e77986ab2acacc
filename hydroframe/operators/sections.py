"""Tables of cross-sections as points, by expressions over arrays; walls and simplification go through Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.operators.xsec import TABULATED_RECTANGLE, TABULATED_TRAPEZIUM, YZ, dealt, simplified

#: What can be wrong with a section, in the order in which it is told.
UNREADABLE, NO_TABLE, SHRINKING, FALLING, NOT_GROWING, NO_ZERO = "the table can't be read", "the shape has no table", "widths must not shrink", "y must not fall", "y must grow", "the least y must be 0"


def _any_next(points: Column, test) -> Column:
    """Whether test(point, next point) holds anywhere."""
    return F.exists(F.zip_with(points, F.slice(points, 2, F.size(points)), lambda p, q: F.coalesce(test(p, q), F.lit(False))), lambda x: x)


def table_rows(text: Column) -> Column:
    """The rows of a table as an array of (a, b); NULL if one of them isn't two numbers, or there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    fields = F.transform(lines, lambda x: F.split(x, ","))
    rows = F.transform(fields, lambda f: F.struct(F.trim(F.get(f, F.lit(0))).try_cast("double").alias("a"), F.trim(F.get(f, F.lit(1))).try_cast("double").alias("b")))
    bad = F.exists(fields, lambda f: F.size(f) != 2) | F.exists(rows, lambda r: r["a"].isNull() | r["b"].isNull())
    return F.when((F.size(rows) > 0) & ~bad, rows)


def _point(y: Column, z: Column) -> Column:
    return F.struct(y.alias("y"), z.alias("z"))


def halves(rows: Column, rectangle: Column) -> Column:
    """Points of a height-width table: both halves about its middle, from left to right; a rectangle's rows are steps where the width grows."""

    def up(row: Column, i: Column) -> Column:
        before, here = F.get(rows, i.cast("int") - 1), F.struct((row["b"] / 2).alias("w"), row["a"].alias("h"))
        step = rectangle & F.coalesce(row["b"] > before["b"], F.lit(False))
        return F.when(step, F.array(F.struct((before["b"] / 2).alias("w"), row["a"].alias("h")), here)).otherwise(F.array(here))

    half = F.flatten(F.transform(rows, up))
    most = F.array_max(F.transform(half, lambda p: p["w"]))
    right = F.when(F.get(half, F.lit(0))["w"] == 0, F.slice(half, 2, F.size(half))).otherwise(half)  # a middle without width is one point
    return F.concat(F.transform(F.reverse(half), lambda p: _point(most - p["w"], p["h"])), F.transform(right, lambda p: _point(most + p["w"], p["h"])))


def moved_apart(points: list[tuple[float, float]], wall: float) -> list[tuple[float, float]]:
    """Points whose y's never fall, with y's that repeat moved to the right.

    All that are equal to the one before are moved by `wall` at once, and what is then behind
    a point before it goes, until no two are equal.
    """
    p = np.array(points, float).reshape(-1, 2)
    while (same := p[1:, 0] == p[:-1, 0]).any():
        p[1:, 0] += wall * same
        p = p[p[:, 0] >= np.maximum.accumulate(p[:, 0])]
    return [(float(y), float(z)) for y, z in p]


def displaced(points: Column, wall: float) -> Column:
    """moved_apart, for arrays of (y, z); without a wall, they stay."""
    if wall <= 0:
        return points

    @F.pandas_udf("array<struct<y: double, z: double>>")
    def apart(rows: pd.Series) -> pd.Series:
        made = [None if r is None else [{"y": y, "z": z} for y, z in moved_apart([(p["y"], p["z"]) for p in r], wall)] for r in rows]
        return pd.Series(made, dtype=object)

    return apart(points)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is evaluated once, however often it is used: a row of one element, so that projections don't merge."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def sections(rows: DataFrame, key: str = "id", wall: float = 0.01) -> DataFrame:
    """key, y, z (above datum), error of rows (key, shape, reference, text): one that can't be read has an error and no points."""
    shape, table = F.col("shape"), F.col("_table")
    found = _once(dealt(rows.select(key, "shape", "reference", "text")), "_table", table_rows(F.col("text")))
    points = F.when(shape == YZ, F.transform(table, lambda r: _point(r["a"], r["b"]))).when(shape.isin(TABULATED_RECTANGLE, TABULATED_TRAPEZIUM), halves(table, shape == TABULATED_RECTANGLE))
    found = _once(found, "_given", points)
    wrong = (
        F.when(table.isNull(), UNREADABLE).when(F.col("_given").isNull(), NO_TABLE).when((shape != YZ) & _any_next(table, lambda p, q: q["b"] < p["b"]), SHRINKING)
        .when((shape == YZ) & _any_next(F.col("_given"), lambda p, q: q["y"] < p["y"]), FALLING)
    )
    found = found.withColumn("_wrong", wrong)
    found = found.withColumn("_points", displaced(F.when(F.col("_wrong").isNull(), F.col("_given")), wall))
    error = F.coalesce("_wrong", F.when(_any_next(F.col("_points"), lambda p, q: q["y"] <= p["y"]), NOT_GROWING), F.when(F.array_min(F.transform("_points", lambda p: p["y"])) != 0, NO_ZERO))
    found = found.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return found.select(key, good(F.transform("_points", lambda p: p["y"])).alias("y"), good(F.transform("_points", lambda p: p["z"] + F.col("reference"))).alias("z"), "error")


def read_sections(rows: DataFrame, key: str = "id", wall: float = 0.01, tolerance: float = 0.01) -> DataFrame:
    """sections without the points that don't matter (Douglas and Peucker)."""
    found = sections(rows, key, wall)

    @F.pandas_udf("array<struct<y: double, z: double>>")
    def simple(y: pd.Series, z: pd.Series) -> pd.Series:
        out = [None if a is None else [{"y": float(p), "z": float(q)} for p, q in simplified(np.column_stack([a, b]).astype(float), tolerance)] for a, b in zip(y, z, strict=True)]
        return pd.Series(out, dtype=object)

    points = found.withColumn("_p", simple("y", "z"))
    return points.select(key, F.transform("_p", lambda p: p["y"]).alias("y"), F.transform("_p", lambda p: p["z"]).alias("z"), "error")
