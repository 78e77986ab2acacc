"""Rasters as pixel tables (row, col, value): windows, blocks, merges, look-ups, cells to pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.sources.scratch import Scratch

NODATA = -9999.0


@dataclass(frozen=True)
class Grid:
    """Upper left corner and pixel size; rows go down."""

    x: float
    y: float
    size: float

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y) - y) / self.size).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x)) / self.size).cast("int")

    def centre_x(self, col: Column) -> Column:
        return F.lit(self.x) + (col + 0.5) * self.size

    def centre_y(self, row: Column) -> Column:
        return F.lit(self.y) - (row + 0.5) * self.size

    def indices(self, box: tuple[float, float, float, float], decimals: int = 5, rounded: bool = False) -> tuple[int, int, int, int]:
        """(first row, end row, first col, end col) of (xmin, ymin, xmax, ymax); offsets cut off, or rounded, after rounding to decimals."""
        whole = (lambda v: int(round(v))) if rounded else int
        xmin, ymin, xmax, ymax = box
        c0, c1 = (whole(round((v - self.x) / self.size, decimals)) for v in (xmin, xmax))
        r0, r1 = (whole(round((self.y - v) / self.size, decimals)) for v in (ymax, ymin))
        return r0, r1, c0, c1

    def aligned(self, box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
        """The box, grown to whole pixels."""
        import math

        down = lambda v, o: o + math.floor((v - o) / self.size) * self.size
        up = lambda v, o: o + math.ceil((v - o) / self.size) * self.size
        return down(box[0], self.x), down(box[1], self.y), up(box[2], self.x), up(box[3], self.y)

    def aligned_of(self, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> tuple[Column, ...]:
        """aligned, for columns."""
        move = lambda to, v, o: F.lit(o) + to((v - o) / self.size) * self.size
        return move(F.floor, xmin, self.x), move(F.floor, ymin, self.y), move(F.ceil, xmax, self.x), move(F.ceil, ymax, self.y)


def pixel_size_of(x: Column, y: Column, given: Column) -> Column:
    """pixel_size, for columns; NULL where the pixels aren't square and no size is given."""
    return F.when(F.abs(F.abs(x) - F.abs(y)) <= 1e-4, F.abs(x)).otherwise(given)


def read_window(pixels: DataFrame, grid: Grid, box: tuple[float, float, float, float], pad: bool = False, rounded: bool = False, nodata: float = NODATA) -> DataFrame:
    """Pixels in a box; with pad every pixel of it, nodata where there is none."""
    r0, r1, c0, c1 = grid.indices(box, rounded=rounded)
    if r1 <= r0 or c1 <= c0:
        raise ValueError("the box holds no pixel")
    inside = pixels.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    if not pad:
        return inside
    rows = pixels.sparkSession.range(r0, r1).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(c0), F.lit(c1 - 1))).alias("col"))
    return rows.join(inside, ["row", "col"], "left").fillna({c: nodata for c in pixels.columns if c not in ("row", "col")})


def overlay(pixels: DataFrame, priority: str, value: str = "value", nodata: float = NODATA) -> DataFrame:
    """One value a pixel out of a group of rasters: of those with data, the one of highest priority."""
    return pixels.where((F.col(value) != nodata) & F.col(value).isNotNull()).groupBy("row", "col").agg(F.max_by(value, priority).alias(value))


def merge(rasters: list[DataFrame], how: str = "min", value: str = "value", nodata: float = NODATA) -> DataFrame:
    """All rasters in one, by the least or the greatest value with data; nodata where none has any."""
    every = rasters[0].select("row", "col", value)
    for r in rasters[1:]:
        every = every.unionByName(r.select("row", "col", value))
    best = {"min": F.min, "max": F.max}[how](F.when(F.col(value) != nodata, F.col(value)))
    return every.groupBy("row", "col").agg(F.coalesce(best, F.lit(nodata)).alias(value))


def blocks(pixels: DataFrame, n: int = 2, how: str = "mean", value: str = "value", nodata: float = NODATA) -> DataFrame:
    """Blocks of n x n pixels by mean, min or max of those with data; edges are smaller blocks."""
    v = F.when(F.col(value) != nodata, F.col(value))
    agg = {"mean": F.avg, "min": F.min, "max": F.max}[how](v)
    return pixels.groupBy(F.floor(F.col("row") / n).cast("int").alias("row"), F.floor(F.col("col") / n).cast("int").alias("col")).agg(F.coalesce(agg, F.lit(nodata)).alias(value))


def resample(pixels: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Nearest: each pixel as factor x factor smaller ones."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    return pixels.withColumn("_i", spread).withColumn("_j", spread).select((F.col("row") * factor + F.col("_i")).alias("row"), (F.col("col") * factor + F.col("_j")).alias("col"), value)


def recoded(value: Column, nodata: Column | float, to: float = NODATA) -> Column:
    """Another value in the place of nodata."""
    return F.when(value.isNull() | (value == nodata), F.lit(to)).otherwise(value)


def reclass(pixels: DataFrame, table: DataFrame, code: str, key: str, *columns: str) -> DataFrame:
    """pixels with columns of the table's row of their code, NULL without one; tables of codes are small and join as a dimension."""
    taken = table.select(F.col(key).alias(code), *columns)
    return pixels.join(taken, code, "left")


def infiltration(rate: Column, permeability: Column, nodata: float = NODATA) -> Column:
    return F.coalesce(rate * permeability, F.lit(nodata))


def before_resampling(value: Column, cell: Column, size: float, rule: str) -> Column:
    """A cell's value for its pixels: as it is, split over them, or scaled along one axis."""
    ratio = cell / size
    return {"none": value, "split": value / (ratio * ratio), "1d": value / ratio}[rule]


def rasterize(cells: DataFrame, grid: Grid, *values: str) -> DataFrame:
    """row, col and values for every pixel of cells (xmin, ymin, xmax, ymax, values)."""
    span = lambda lo, hi: F.sequence(lo, F.greatest(hi - 1, lo))
    first_col = F.round((F.col("xmin") - grid.x) / grid.size).cast("int")
    end_col = F.round((F.col("xmax") - grid.x) / grid.size).cast("int")
    first_row = F.round((F.lit(grid.y) - F.col("ymax")) / grid.size).cast("int")
    end_row = F.round((F.lit(grid.y) - F.col("ymin")) / grid.size).cast("int")
    return cells.select(F.explode(span(first_row, end_row)).alias("row"), *values, first_col.alias("_a"), end_col.alias("_b")).select("row", F.explode(span(F.col("_a"), F.col("_b"))).alias("col"), *values)


def stacked(bands: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """One row a pixel with a column for each band, without pixels that no band has."""
    every = None
    for name, band in bands.items():
        one = band.select("row", "col", F.lit(name).alias("_band"), value)
        every = one if every is None else every.unionByName(one)
    return every.groupBy("row", "col").pivot("_band", list(bands)).agg(F.first(value)).where(F.coalesce(*map(F.col, bands)).isNotNull())


def sample(points: DataFrame, pixels: DataFrame, grid: Grid, value: str = "value", x: str = "x", y: str = "y") -> DataFrame:
    """points with the value of the pixel that they lie in, NULL outside."""
    return points.withColumn("row", grid.row(F.col(y))).withColumn("col", grid.col(F.col(x))).join(pixels.select("row", "col", value), ["row", "col"], "left").drop("row", "col")


def zonal_min(points: DataFrame, pixels: DataFrame, grid: Grid, radius: float, value: str = "value", key: str = "id") -> DataFrame:
    """key, lowest: the least value of pixels whose centre is within radius of a point; the pixels that a circle could touch are enumerated, then join by place.

    Both sides are shuffled: the places look no larger than their points to the optimizer, which would broadcast them.
    """
    reach = int(radius / grid.size) + 1
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    asked = points.select(key, "x", "y", grid.row(F.col("y")).alias("_r"), grid.col(F.col("x")).alias("_c")).withColumn("_i", around).withColumn("_j", around)
    asked = asked.select(key, "x", "y", (F.col("_r") + F.col("_i")).alias("row"), (F.col("_c") + F.col("_j")).alias("col"))
    dx, dy = grid.centre_x(F.col("col")) - F.col("x"), grid.centre_y(F.col("row")) - F.col("y")
    near = asked.where(dx * dx + dy * dy <= radius * radius)
    return near.hint("merge").join(pixels.select("row", "col", value), ["row", "col"]).where(F.col(value) != NODATA).groupBy(key).agg(F.min(value).alias("lowest"))


def neighbour_components(pixels: DataFrame, top: float, value: str = "value") -> DataFrame:
    """Pixels under a level, which are linked if they touch at a side or a corner, as u < v numbers of pixels."""
    low = pixels.where(F.col(value) < top).select("row", "col")
    near = low.select(F.col("row").alias("r"), F.col("col").alias("c"), F.explode(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("p"))
    return near.select("r", "c", "p.row", "p.col").join(low, ["row", "col"])


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the even-odd rule."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ay == by:
            continue
        at = ax + (y - ay) * ((bx - ax) / (by - ay))
        inside = inside != (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at))
    return inside


def masked(pixels: DataFrame, grid: Grid, corners: list[tuple[float, float]]) -> DataFrame:
    """Pixels whose box meets the polygon's box, with active: whether their centre lies in the polygon."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    near = read_window(pixels, grid, grid.aligned((min(xs), min(ys), max(xs), max(ys))), rounded=True)
    return near.withColumn("active", in_polygon(grid.centre_x(F.col("col")), grid.centre_y(F.col("row")), corners))


def blank(spark, grid: Grid, box: tuple[float, float, float, float], value: float = NODATA) -> DataFrame:
    """Every pixel of a box, with one value."""
    r0, r1, c0, c1 = grid.indices(grid.aligned(box), rounded=True)
    return spark.range(r0, r1).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(c0), F.lit(c1 - 1))).alias("col"), F.lit(value).alias("value"))


def to_points(pixels: DataFrame, grid: Grid, *bands: str) -> DataFrame:
    """Centres of the pixels that have data in a band, with the bands; nodata as NULL."""
    values = [F.when(F.col(b) != NODATA, F.col(b)).alias(b) for b in bands]
    return pixels.select(grid.centre_x(F.col("col")).alias("x"), grid.centre_y(F.col("row")).alias("y"), *values).where(F.coalesce(*map(F.col, bands)).isNotNull())


def to_boxes(pixels: DataFrame, grid: Grid, *bands: str) -> DataFrame:
    """The boxes of the same pixels, as text."""
    from hydroframe.functions.geometry import wkt_box

    half = grid.size / 2
    return to_points(pixels, grid, *bands).withColumn("wkt", wkt_box(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half))


def bounds(rows: int, cols: int, grid: Grid) -> tuple[float, float, float, float]:
    return grid.x, grid.y - rows * grid.size, grid.x + cols * grid.size, grid.y


def pixel_size(x: float, y: float, given: float | None = None) -> float:
    """A raster's pixel size: its own if both axes agree within 1e-4, else the given one."""
    if abs(abs(x) - abs(y)) <= 1e-4:
        return abs(x)
    if given is None:
        raise ValueError("the pixels aren't square, and no size is given")
    return given


#: By how much a point's lifted height is moved so that four points on one circle are no tie, beside the points' extent of 1.
TIE = 1e-7


def delaunay(points):
    """Triangles (indices) of a plane's points, none with another point in its circle.

    Points are inserted in stripes; the triangle that holds the next one is found by walking
    from the last one over neighbours, and the triangles around it whose circles hold it
    give way to new ones.  So the work is about n log n.  In-circle tests compare heights
    above the plane of the lifted points; each has a little of its own, by its place, so
    the same points on one circle are joined alike wherever they are triangulated.
    """
    import numpy as np

    given = np.asarray(points, float)
    n = len(given)
    if n < 3:
        return []
    p = given - (given.min(axis=0) + given.max(axis=0)) / 2
    p = p / max(float(np.ptp(p, axis=0).max()), 1e-300)
    frame = np.array([[-2000.0, -1000.0], [2000.0, -1000.0], [0.0, 3000.0]])
    own = np.modf(np.abs(np.sin(given[:, 0] * 12.9898 + given[:, 1] * 78.233)) * 43758.5453)[0]
    xs, ys = np.vstack([p, frame]).T.tolist()
    lift = np.r_[(p**2).sum(axis=1) - TIE * own, (frame**2).sum(axis=1)].tolist()
    stripe = np.floor((p[:, 0] + 0.5) * max(1.0, math.sqrt(n) / 2))
    order = np.lexsort((np.where(stripe % 2, -p[:, 1], p[:, 1]), stripe)).tolist()

    def turn(a: int, b: int, c: int) -> float:
        return (xs[b] - xs[a]) * (ys[c] - ys[a]) - (ys[b] - ys[a]) * (xs[c] - xs[a])

    def plane(a: int, b: int, c: int) -> tuple[float, float, float]:
        """The plane through three lifted points, as z = u * x + v * y + w."""
        dx1, dy1, dz1 = xs[b] - xs[a], ys[b] - ys[a], lift[b] - lift[a]
        dx2, dy2, dz2 = xs[c] - xs[a], ys[c] - ys[a], lift[c] - lift[a]
        d = dx1 * dy2 - dy1 * dx2
        u, v = (dz1 * dy2 - dy1 * dz2) / d, (dx1 * dz2 - dz1 * dx2) / d
        return u, v, lift[a] - u * xs[a] - v * ys[a]

    corners: list[tuple[int, int, int] | None] = [(n, n + 1, n + 2)]  # counter-clockwise; beside[t][k] lies across from corner k
    beside: list[list[int]] = [[-1, -1, -1]]
    planes = [plane(n, n + 1, n + 2)]
    last = 0

    def holder(i: int) -> int:
        t = last
        for _ in range(4 * len(corners) + 16):
            a, b, c = corners[t]
            on = next((beside[t][k] for k, (q, r) in enumerate(((b, c), (c, a), (a, b))) if turn(q, r, i) < 0 and beside[t][k] >= 0), None)
            if on is None:
                return t
            t = on
        return min((t for t, x in enumerate(corners) if x), key=lambda t: -min(turn(corners[t][k], corners[t][k - 2], i) for k in range(3)))

    for i in order:
        hit, todo = {holder(i)}, []
        todo = list(hit)
        while todo:
            t = todo.pop()
            for q in beside[t]:
                if q >= 0 and q not in hit:
                    u, v, w = planes[q]
                    if lift[i] < u * xs[i] + v * ys[i] + w:
                        hit.add(q)
                        todo.append(q)
        while True:
            rim = []
            for t in hit:
                a, b, c = corners[t]
                rim += [(q, r, beside[t][k]) for k, (q, r) in enumerate(((b, c), (c, a), (a, b))) if beside[t][k] not in hit]
            flat = {o for q, r, o in rim if o >= 0 and turn(q, r, i) <= 0}  # the point lies on that side, or beyond
            if not flat:
                break
            hit |= flat
        starts: dict[int, int] = {}
        ends: dict[int, int] = {}
        for q, r, o in rim:
            starts[q] = ends[r] = t = len(corners)
            corners.append((q, r, i))
            beside.append([-1, -1, o])
            planes.append(plane(q, r, i))
            if o >= 0:
                k = next(k for k in range(3) if corners[o][k] not in (q, r))
                beside[o][k] = t
        for q, r, _ in rim:
            t = starts[q]
            beside[t][0], beside[t][1] = starts[r], ends[q]
        for t in hit:
            corners[t] = None
        last = len(corners) - 1
    return sorted(tuple(sorted(t)) for t in corners if t is not None and max(t) < n)


def hull(points):
    """The corners of the convex hull of a plane's points, counter-clockwise."""
    ordered = sorted(set(map(tuple, points)))
    if len(ordered) < 3:
        return ordered
    out = []
    for way in (ordered, ordered[::-1]):
        side: list[tuple[float, float]] = []
        for q in way:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]):
                side.pop()
            side.append(q)
        out += side[:-1]
    return out


def interpolate_linear(centres: DataFrame, grid: Grid, value: str = "value", tile: int = 32, halo: int = 16) -> DataFrame:
    """row, col, value: linear between centres (x, y, value), inside the area that they span.

    Tiles of pixels are worked on by themselves, each with the centres in and around
    it.  A tile whose triangles may not be those of all centres (a circle reaches
    beyond the centres at hand, or a spanned pixel has no triangle) is done again with
    twice the halo; so tile and halo change the work, but not the result.  Centres
    without a value are left out, and of centres at one place the least value stays.
    """
    import numpy as np
    import pandas as pd

    spark = centres.sparkSession
    known = centres.where(F.col(value).isNotNull()).groupBy("x", "y").agg(F.min(value).alias(value))

    def corners(batches):
        for pdf in batches:
            yield pd.DataFrame(hull(pdf[["x", "y"]].to_numpy(float).tolist()), columns=["x", "y"])

    rim = hull([(float(r["x"]), float(r["y"])) for r in known.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(corners, "x double, y double").collect()])
    if len(rim) < 3:
        return spark.createDataFrame([], "row int, col int, value double")
    low, high = np.min(rim, axis=0), np.max(rim, axis=0)
    size = grid.size
    r_low, r_high = (math.floor((grid.y - y) / size / tile) for y in (high[1], low[1]))
    c_low, c_high = (math.floor((x - grid.x) / size / tile) for x in (low[0], high[0]))
    wide = c_high - c_low + 1

    def filler(halo: int):
        def fill(key: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            """Pixels of a settled tile; of another one row without a value that names the tile."""
            r0, c0 = int(key["_tr"].iloc[0]) * tile, int(key["_tc"].iloc[0]) * tile
            rows, cols = np.meshgrid(np.arange(r0, r0 + tile), np.arange(c0, c0 + tile), indexing="ij")
            x, y = grid.x + (cols + 0.5) * size, grid.y - (rows + 0.5) * size
            # what is loaded: the inside of the square of tile and halo, and all beyond the centres' extent
            left, right = grid.x + (c0 - halo) * size, grid.x + (c0 + tile + halo) * size
            bottom, top = grid.y - (r0 + tile + halo) * size, grid.y - (r0 - halo) * size
            whole = left < low[0] and right > high[0] and bottom < low[1] and top > high[1]
            spanned = np.ones(x.shape, bool)
            for (ax, ay), (bx, by) in zip(rim, rim[1:] + rim[:1], strict=True):
                spanned &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 * math.hypot(bx - ax, by - ay) * size
            again = pd.DataFrame({"row": [r0], "col": [c0], "value": [np.nan]})
            out = np.full(x.shape, np.nan)
            if len(pdf) >= 3 and spanned.any():
                pdf = pdf.sort_values(["x", "y"])
                p, v = pdf[["x", "y"]].to_numpy(float), pdf[value].to_numpy(float)
                for a, b, c in delaunay(p):
                    (ax, ay), (bx, by), (cx, cy) = p[[a, b, c]]
                    area = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
                    if area == 0:
                        continue
                    u = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / area
                    w = ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / area
                    inside = (u >= -1e-9) & (w >= -1e-9) & (u + w <= 1 + 1e-9) & np.isnan(out)
                    if not inside.any():
                        continue
                    if not whole:
                        dx1, dy1, dx2, dy2 = bx - ax, by - ay, cx - ax, cy - ay
                        d = 2 * (dx1 * dy2 - dy1 * dx2)
                        ux, uy = (dy2 * (dx1**2 + dy1**2) - dy1 * (dx2**2 + dy2**2)) / d, (dx1 * (dx2**2 + dy2**2) - dx2 * (dx1**2 + dy1**2)) / d
                        radius, ux, uy = math.hypot(ux, uy), ax + ux, ay + uy
                        if max(ux - radius, low[0]) <= left or min(ux + radius, high[0]) >= right or max(uy - radius, low[1]) <= bottom or min(uy + radius, high[1]) >= top:
                            return again
                    out[inside] = (u * v[a] + w * v[b] + (1 - u - w) * v[c])[inside]
            some = ~np.isnan(out)
            if not whole and (spanned & ~some).any():
                return again
            return pd.DataFrame({"row": rows[some].astype("int32"), "col": cols[some].astype("int32"), "value": out[some]})

        return fill

    scratch = Scratch(spark, "interpolated")
    ids = spark.range((r_high - r_low + 1) * wide)
    tiles = ids.select((F.floor(F.col("id") / wide) + r_low).cast("long").alias("_tr"), (F.col("id") % wide + c_low).cast("long").alias("_tc"))
    known, done, halo = scratch.write(known), [], max(1, halo)
    while True:
        around = lambda c, halo=halo: F.explode(F.sequence(F.floor((c - halo) / tile), F.floor((c + halo) / tile)))
        dealt = known.withColumn("_tr", around(grid.row(F.col("y")))).withColumn("_tc", around(grid.col(F.col("x")))).join(tiles, ["_tr", "_tc"], "left_semi")
        made = scratch.write(tiles.groupBy("_tr", "_tc").cogroup(dealt.groupBy("_tr", "_tc")).applyInPandas(filler(halo), "row int, col int, value double"))
        settled = F.col("value").isNotNull() & ~F.isnan("value")
        done.append(made.where(settled))
        tiles = made.where(~settled).select(F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc")).distinct()
        if not tiles.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        halo *= 2
