"""Segments that may meet: by the cells of a grid that they run through, crowded cells split in four."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.sources.scratch import Scratch

#: How far beyond its ends and sides a segment is taken to reach, in cells, so that rounding loses none that touch.
MARGIN = 1e-6
#: Pairs of a cell above which it is split, and how often at most.
MOST_PAIRS, MOST_SPLITS = 10_000, 16
#: Segments on one side that are few enough to leave cells as they are: each meets every segment of the other side once at most a cell.
FEW = 64


def along(x0: str, y0: str, x1: str, y1: str, size: float, inside: tuple[str, str] | None = None) -> Column:
    """The cells (cx, cy) that segments (columns of their ends) run through, column by column, as many as they are long; inside: those of one cell of twice the size."""
    low, high, bottom, top = f"least({x0}, {x1})", f"greatest({x0}, {x1})", f"least({y0}, {y1})", f"greatest({y0}, {y1})"

    def steps(first: str, last: str, within: str | None) -> str:
        first, last = f"CAST(floor({first} / {size!r}D - {MARGIN!r}D) AS BIGINT)", f"CAST(floor({last} / {size!r}D + {MARGIN!r}D) AS BIGINT)"
        if within is None:
            return f"sequence({first}, {last})"
        first, last = f"greatest({first}, {within} * 2)", f"least({last}, {within} * 2 + 1)"
        return f"if({first} <= {last}, sequence({first}, {last}), CAST(array() AS ARRAY<BIGINT>))"

    def at(x: str) -> str:  # where the segment is as it enters or leaves a column of cells
        return f"({y0} + ({x} - {x0}) * ({y1} - {y0}) / ({x1} - {x0}))"

    left, right = at(f"greatest({low}, (cx - {MARGIN!r}D) * {size!r}D)"), at(f"least({high}, (cx + 1 + {MARGIN!r}D) * {size!r}D)")
    upright = f"{x0} = {x1}"
    rows = steps(f"if({upright}, {bottom}, greatest(least({left}, {right}), {bottom}))", f"if({upright}, {top}, least(greatest({left}, {right}), {top}))", inside[1] if inside else None)
    return F.expr(f"flatten(transform({steps(low, high, inside[0] if inside else None)}, cx -> transform({rows}, cy -> struct(cx AS cx, cy AS cy))))")


def meetings(one: DataFrame, two: DataFrame, ends: tuple[str, ...], other: tuple[str, ...], size: float, most: int = MOST_PAIRS) -> DataFrame:
    """one joined with two where a cell holds segments of both (ends, other: columns of x0, y0, x1, y1); pairs of several cells come several times.

    Cells whose pairs are more than `most` are split, as long as that helps, and only the
    segments in them are walked again; a few segments on one side don't need that.
    """
    walk = lambda df, names, inside=None, size=size: df.withColumn("_c", F.explode(along(*names, size, inside)))
    placed = [walk(df, names).select(*df.columns, "_c.*") for df, names in ((one, ends), (two, other))]
    key = ["cx", "cy"]
    if two.limit(FEW + 1).count() <= FEW:
        return placed[0].join(placed[1], key).drop(*key)
    scratch = Scratch(one.sparkSession, "meetings")
    done: list[DataFrame] = []
    before = None
    for level in range(MOST_SPLITS):
        placed = [scratch.write(p) for p in placed]
        counts = [p.groupBy(*key).agg(F.count("*").alias(n)) for p, n in zip(placed, ("n", "m"), strict=True)]
        crowded = scratch.write(counts[0].join(counts[1], key).where(F.col("n") * F.col("m") > most))
        pairs = crowded.agg(F.sum(F.col("n") * F.col("m"))).first()[0]
        if not pairs or (before is not None and pairs > 0.9 * before):  # all of them run through one point: they are pairs anyway
            break
        before, size = pairs, size / 2
        cells = crowded.select(*key)
        done.append(placed[0].join(cells, key, "left_anti").join(placed[1].join(cells, key, "left_anti"), key).drop(*key))
        inside = ("cx", "cy")
        placed = [walk(p.join(cells, key, "left_semi"), names, inside, size).select(*df.columns, "_c.*") for p, df, names in zip(placed, (one, two), (ends, other), strict=True)]
    done.append(placed[0].join(placed[1], key).drop(*key))
    return reduce(DataFrame.unionByName, done)
