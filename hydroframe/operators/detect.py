"""Leak detection from cells, pixels and flowlines: ridges within pairs of cells, then those across the gaps between them.

All pixels are told by their row and column in the raster, so cells of any size
and place meet without a transformation.  A cell with its pixels is one row (its
size bounds it), a pair of cells the join of two; levels of edges are expressions
over their arrays, and only the search for ridges is Python, one pair at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.operators import cells as C
from hydroframe.operators import leak
from hydroframe.operators.raster import NODATA, Grid
from hydroframe.sources.scratch import cut

c = F.col
OPPOSITE = {"left": "right", "right": "left", "top": "bottom", "bottom": "top"}
MAX_BATCH_BYTES = 4 << 20


def blocks(cells: DataFrame, pixels: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """id, row, col, rows, cols, z of cells (id, xmin .. ymax): the place of the upper left pixel, the size, and all pixels row by row, NODATA where there is none."""
    half = grid.size / 2
    placed = cells.select(
        "id", grid.row(c("ymax") - half).alias("row"), grid.col(c("xmin") + half).alias("col"), (grid.row(c("ymin") + half) - grid.row(c("ymax") - half) + 1).alias("rows"), (grid.col(c("xmax") - half) - grid.col(c("xmin") + half) + 1).alias("cols")
    ).where("rows > 0 and cols > 0")
    every = placed.select("id", F.explode(F.sequence(c("row"), c("row") + c("rows") - 1)).alias("row"), "col", "cols").select("id", "row", F.explode(F.sequence(c("col"), c("col") + c("cols") - 1)).alias("col"))
    known = pixels.select("row", "col", F.col(value).cast("double").alias("z"))
    z = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "z"))), lambda p: F.coalesce(p["z"], F.lit(NODATA)))
    return placed.join(every.join(known, ["row", "col"], "left").groupBy("id").agg(z.alias("z")), "id")


def raised(z: Column, by: float) -> Column:
    """An array of pixels where those without data stand above the highest, so that no ridge can't pass them; null if all are without."""
    top = F.array_max(F.filter(z, lambda v: v != NODATA))
    return F.when(top.isNotNull(), F.transform(z, lambda v: F.when(v == NODATA, top + by).otherwise(v)))


def edges(flowlines: DataFrame, cells: DataFrame, blocks: DataFrame, digits: int = 5) -> DataFrame:
    """edge, start_id, end_id, location, x0 .. y1, level, fx0 .. fy1 of flowlines (id, start_id, end_id, fx0 .. fy1) between cells.

    The start cell lies left of or below the end cell (location tells where the end cell
    lies).  x0 .. y1 is the part of the sides that both share; level is the lowest of the
    higher pixels of both sides along it, null if the cells share no pixel's length.
    """
    box = cells.select("id", *(F.round(n, digits).alias(n) for n in ("xmin", "ymin", "xmax", "ymax"))).join(blocks, "id")
    side = lambda name: box.select(c("id").alias(f"{name}_id"), F.struct(*[n for n in box.columns if n != "id"]).alias(name))
    met = flowlines.join(side("start"), "start_id").join(side("end"), "end_id")
    a, b = (lambda n: c(f"start.{n}")), (lambda n: c(f"end.{n}"))
    beside = a("xmax") == b("xmin")
    pixel = lambda s, row, col: F.get(s("z"), ((row - s("row")) * s("cols") + col - s("col")).cast("int"))
    first = F.when(beside, F.greatest(a("row"), b("row"))).otherwise(F.greatest(a("col"), b("col")))
    last = F.when(beside, F.least(a("row") + a("rows"), b("row") + b("rows"))).otherwise(F.least(a("col") + a("cols"), b("col") + b("cols"))) - 1
    higher = lambda i: F.when(beside, F.greatest(pixel(a, i, a("col") + a("cols") - 1), pixel(b, i, b("col")))).otherwise(F.greatest(pixel(a, a("row"), i), pixel(b, b("row") + b("rows") - 1, i)))
    level = F.when(last >= first, F.array_min(F.transform(F.sequence(first, last), higher)))
    ends = {
        "x0": F.when(beside, a("xmax")).otherwise(F.greatest(a("xmin"), b("xmin"))), "y0": F.when(beside, F.greatest(a("ymin"), b("ymin"))).otherwise(a("ymax")),
        "x1": F.when(beside, a("xmax")).otherwise(F.least(a("xmax"), b("xmax"))), "y1": F.when(beside, F.least(a("ymax"), b("ymax"))).otherwise(a("ymax")),
    }
    return met.select(c("id").alias("edge"), "start_id", "end_id", F.when(beside, "right").otherwise("top").alias("location"), *(v.alias(n) for n, v in ends.items()), level.alias("level"), "fx0", "fy0", "fx1", "fy1")


def sides(edges: DataFrame) -> DataFrame:
    """cell, sides: for each side of a cell the first and last edge (from the left, or from below) and the least level of all."""
    opposite = F.create_map(*(F.lit(x) for pair in OPPOSITE.items() for x in pair))
    seen = F.explode(F.array(F.struct(c("start_id").alias("cell"), c("location").alias("side")), F.struct(c("end_id").alias("cell"), F.element_at(opposite, c("location")).alias("side"))))
    rows = edges.select("edge", "level", F.when(c("location") == "right", c("y0")).otherwise(c("x0")).alias("place"), seen.alias("s")).select("s.*", "edge", "level", "place")
    each = rows.groupBy("cell", "side").agg(F.min_by("edge", F.struct("place", "edge")).alias("first"), F.max_by("edge", F.struct("place", "edge")).alias("last"), F.min("level").alias("low"))
    return each.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("first", "last", "low")))).alias("sides"))


def _upright(location: str, row: int, col: int, rows: int, cols: int, z: np.ndarray) -> tuple[int, int, np.ndarray]:
    """A cell's block for a pair: turned over if the cells lie side by side, so that ridges always run from left to right."""
    z = np.asarray(z, float).reshape(rows, cols)
    return (col, row, z.T) if location == "right" else (row, col, z)


def first_pass(pairs: DataFrame, min_height: float, precision: float, prominence: float) -> DataFrame:
    """pair, from_cell, from_row, from_col, to_cell, to_row, to_col, crest of pairs (edge, location, lowest, start and end with id, row, col, rows, cols, z).

    Rows and columns are the raster's.  Ridges run from left to right if the end cell
    lies on top of the start cell, and from the top down if it lies to its right.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema["start"].dataType.fields} | {"edge": dict(pairs.dtypes)["edge"]}
    parts = ["id", "row", "col", "rows", "cols", "z"]
    flat = pairs.select("edge", "location", "lowest", *(c(f"{s}.{n}").alias(f"{s}_{n}") for s in ("start", "end") for n in parts))
    names = ["pair", "from_cell", "from_row", "from_col", "to_cell", "to_row", "to_col", "crest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf.itertuples(index=False):
                two = [(getattr(p, f"{s}_id"), _upright(p.location, *(getattr(p, f"{s}_{n}") for n in parts[1:]))) for s in (("start", "end") if p.location == "right" else ("end", "start"))]
                for n, r, k, m, q, h, crest in leak.obstacles_of_cells([b for _, b in two], p.lowest, min_height, precision, prominence):
                    if p.location == "right":
                        r, k, q, h = k, r, h, q
                    out.append((p.edge, two[n][0], r, k, two[m][0], q, h, crest))
            yield pd.DataFrame(out, columns=names)

    return flat.mapInPandas(run, f"pair {kinds['edge']}, from_cell {kinds['id']}, from_row int, from_col int, to_cell {kinds['id']}, to_row int, to_col int, crest double")


def _end_edges(found: DataFrame, pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """found with from_edge and to_edge: the edges that a ridge starts and ends on, null at the model's boundary.

    Of several edges on a side, a pixel in the latter half of the side (from the left or
    the top) takes the last one, else the first; edges themselves go from the left or from
    below, which is the rule that results have to follow.
    """
    out = found.join(pairs.select(c("edge").alias("pair"), "location"), "pair")
    for end, upright, lying in (("from", "left", "top"), ("to", "right", "bottom")):
        out = out.join(frames.select(c("id").alias(f"{end}_cell"), c("row").alias("_r"), c("col").alias("_c"), c("rows").alias("_h"), c("cols").alias("_w"), c("sides").alias("_s")), f"{end}_cell")
        on = F.when(c("location") == "top", F.try_element_at(c("_s"), F.lit(upright))).otherwise(F.try_element_at(c("_s"), F.lit(lying)))
        late = F.when(c("location") == "top", c(f"{end}_row") - c("_r") + 1 > c("_h") / 2).otherwise(c(f"{end}_col") - c("_c") + 1 > c("_w") / 2)
        out = out.withColumn(f"{end}_edge", F.when(late, on["last"]).otherwise(on["first"])).drop("_r", "_c", "_h", "_w", "_s")
    return out


def _segment(grid: Grid) -> list[Column]:
    return [grid.centre_x(c("from_col")).alias("ox0"), grid.centre_y(c("from_row")).alias("oy0"), grid.centre_x(c("to_col")).alias("ox1"), grid.centre_y(c("to_row")).alias("oy1")]


def _bound_batches(df: DataFrame) -> None:
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > MAX_BATCH_BYTES:
        spark.conf.set(key, str(MAX_BATCH_BYTES))


def detect(
    cells: DataFrame, pixels: DataFrame, flowlines: DataFrame, grid: Grid, min_height: float, precision: float | None = None, prominence: float | None = None, known: DataFrame | None = None, as_obstacle: bool = False, value: str = "value"
) -> DataFrame:
    """edge, level, crest, x0 .. y1 of every edge that an obstacle crosses: the highest one's crest and its segment, or the edge's own.

    cells (id, xmin .. ymax), pixels (row, col, value), flowlines (id, start_id, end_id, fx0 ..
    fy1; the start cell left or below); known (edge, crest) are obstacles that the model has,
    which raise edges.  The first pass finds ridges within pairs of neighbouring cells and
    gives them to the edges whose flowline they cross; the second connects, over an edge,
    ridges that end on it from different sides in the two cells.  Nulls in ids or boxes leave
    a flowline or a cell out; a cell without data has no ridges; empty tables give no rows.
    """
    precise = leak.search_precision(min_height) if precision is None else precision
    _bound_batches(cells)
    placed = cut(blocks(cells, pixels, grid, value))
    edge = edges(flowlines, cells, placed)
    if known is not None:
        highest = known.groupBy("edge").agg(F.max("crest").alias("_crest"))
        edge = edge.join(highest, "edge", "left").withColumn("level", F.greatest("level", "_crest")).drop("_crest")
    edge = cut(edge.where("level is not null"))
    frames = placed.join(sides(edge).withColumnRenamed("cell", "id"), "id").withColumn("z", raised(c("z"), min_height + precise)).where("z is not null")
    cell = lambda name: frames.select(c("id").alias(f"{name}_id"), F.struct(*frames.columns).alias(name))
    pairs = edge.join(cell("start"), "start_id").join(cell("end"), "end_id")
    of = lambda name, side: F.try_element_at(c(f"{name}.sides"), side)
    before, after = F.when(c("location") == "top", "bottom").otherwise("left"), c("location")
    lhs, rhs = F.when(c("location") == "top", "left").otherwise("top"), F.when(c("location") == "top", "right").otherwise("bottom")
    pairs = pairs.withColumn("lowest", F.least("level", of("start", before)["low"], of("end", after)["low"]))

    found = first_pass(pairs, min_height, precise, min_height if prominence is None else prominence)
    found = _end_edges(found, edge, frames.drop("z")).withColumn("obstacle", F.concat_ws("-", "pair", "from_row", "from_col", "to_row", "to_col"))
    found = cut(found.select("obstacle", "crest", "from_cell", "to_cell", "from_edge", "from_row", "from_col", "to_edge", "to_row", "to_col", "pair", *_segment(grid)))
    owners = edge.select(c("edge").alias("pair"), F.array("start_id", "end_id").alias("cells"))
    of_cells = edge.select(F.explode(F.array("start_id", "end_id")).alias("cell"), "edge")
    asked = found.join(owners, "pair").select(c("obstacle").alias("id"), "cells", "from_edge", "to_edge", *(c(f"o{n}").alias(n) for n in ("x0", "y0", "x1", "y1")))
    met = C.assigned(C.potential_edges(asked, of_cells, edge.select("edge", "fx0", "fy0", "fx1", "fy1")), found.select(c("obstacle").alias("id"), "crest"), edge, min_height, precise)
    met = cut(met.join(found.drop("crest", "pair"), "obstacle"))

    near = pairs.select(c("edge").alias("pair"), c("edge").alias("middle"), *(of(name, s)[which].alias(f"{n}_{k}") for n, s in (("left", lhs), ("right", rhs)) for k, name, which in ((1, "start", "last"), (2, "end", "first"))))
    ends = cut(leak.ends_on(met, near))
    kept = pairs.join(ends.select(c("pair").alias("edge")).distinct(), "edge", "left_semi")
    both = kept.select(c("edge").alias("pair"), F.explode(F.array("start", "end")).alias("b")).select("pair", "b.*")
    spread = both.select("pair", "row", "col", "cols", F.posexplode("z").alias("at", "v")).select("pair", (c("row") + F.floor(c("at") / c("cols"))).cast("int").alias("row"), (c("col") + c("at") % c("cols")).cast("int").alias("col"), c("v").alias("z"))
    closing = leak.connecting_obstacles(spread, ends, edge.select(c("edge").alias("pair"), "edge", "level"), min_height, precise)
    closing = closing.withColumn("obstacle", F.concat_ws("-", "edge", "from_row", "from_col", "to_row", "to_col", F.lit("2"))).select("edge", "obstacle", "crest", *_segment(grid))
    return C.result_rows(edge.select("edge", "level", "x0", "y0", "x1", "y1"), met.select(*closing.columns).unionByName(closing), as_obstacle)
