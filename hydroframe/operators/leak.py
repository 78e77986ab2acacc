"""Leaking obstacles: ridges between the two sides of neighbouring cells, their crest levels, and what they hold back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- hydraulics -------------------------------------------------------------------------------------


def wet_area(beds: Column, level: Column, crest: Column, size: Column) -> Column:
    """Of an array of bed levels: the area under the water level, with beds raised to the crest if there is one."""
    raised = lambda b: F.greatest(b, F.coalesce(crest, b))
    return F.aggregate(beds, F.lit(0.0), lambda s, b: s + F.greatest(level - raised(b), F.lit(0.0))) * size


def wet_perimeter(beds: Column, level: Column, crest: Column, size: Column) -> Column:
    raised = lambda b: F.greatest(b, F.coalesce(crest, b))
    return F.aggregate(beds, F.lit(0.0), lambda s, b: s + F.when(raised(b) < level, 1.0).otherwise(0.0)) * size


def reduction(beds: Column, level: Column, old: Column, new: Column, size: Column) -> Column:
    """The share of the discharge left under a new crest: roots of the hydraulic radii; 0 if either section is dry."""
    a1, p1 = wet_area(beds, level, old, size), wet_perimeter(beds, level, old, size)
    a2, p2 = wet_area(beds, level, new, size), wet_perimeter(beds, level, new, size)
    return F.when((a1 <= 0) | (a2 <= 0), 0.0).otherwise(F.sqrt(F.try_divide(a2, p2)) / F.sqrt(F.try_divide(a1, p1)))


def discharge_reduction(series: DataFrame, key: str = "id") -> DataFrame:
    """key, without, with, reduced of rows (key, q, factor, dt): the discharge over time, and what an obstacle takes of it."""
    found = series.groupBy(key).agg(F.sum(F.col("q") * F.col("dt")).alias("without"), F.sum(F.col("q") * F.col("factor") * F.col("dt")).alias("with"))
    return found.withColumn("reduced", F.abs(F.col("without") - F.col("with")))


def crest_of_obstacle(old: Column, new: Column, bed: Column) -> Column:
    return F.coalesce(new, old, bed)


def exchange_levels(edges: DataFrame) -> DataFrame:
    """edge, level of rows (edge, place, z of both sides' pixels): the lowest of the higher pixels along the edge."""
    return edges.groupBy("edge", "place").agg(F.max("z").alias("z")).groupBy("edge").agg(F.min("z").alias("level"))


def raised_by_obstacles(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """edges (edge, level) at least as high as the highest obstacle (edge, crest) that crosses them."""
    highest = hits.groupBy("edge").agg(F.max("crest").alias("crest"))
    return edges.join(highest, "edge", "left").select("edge", F.greatest("level", "crest").alias("level"))


def search_precision(min_height):
    """The precision of crest levels, unless one is given; of a number or a column."""
    return min(min_height / 10, 0.1) if isinstance(min_height, (int, float)) else F.least(min_height / 10, F.lit(0.1))


def stands_out(value: Column, lowest: Column, min_height: float, precision: float) -> Column:
    """Whether a peak may belong to an obstacle: more than the height, less the precision, above the lowest edge."""
    return value > lowest + (min_height - precision)


# --- grids of numbers -------------------------------------------------------------------------------


def peaks(z: np.ndarray, prominence: float) -> list[int]:
    """Inner places of local maxima that stand out by prominence; a level top counts at its middle."""
    found, i, n = [], 1, len(z)
    while i < n - 1:
        if z[i] > z[i - 1]:
            j = i
            while j < n - 1 and z[j + 1] == z[i]:
                j += 1
            if j < n - 1 and z[j + 1] < z[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    out = []
    for p in found:
        higher = np.flatnonzero(z > z[p])
        left, right = higher[higher < p], higher[higher > p]
        a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else n)
        if z[p] - max(z[a : p + 1].min(), z[p:b].min()) >= prominence:
            out.append(p)
    return out


def line_peaks(rows: DataFrame, key: str, order: str, value: str, prominence: float) -> DataFrame:
    """key, order, value of the peaks of each key's line, in order; one line is one group."""
    kinds = dict(rows.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ignore_index=True)
        return group.loc[peaks(group[value].to_numpy(float), prominence), [key, order, value]]

    return rows.select(key, order, value).groupBy(key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (key, order, value)))


def ridge(z: np.ndarray, start: np.ndarray, end: np.ndarray) -> float | None:
    """The highest level at which start and end pixels (masks) are linked, through 8 neighbours, by pixels as high.

    Pixels enter from the highest down and join their neighbours; the level of the
    pixel that first links both sides is the answer.  A flat grid has none.
    """
    z = np.asarray(z, float)
    if z.max() == z.min():
        return None
    rows, cols = z.shape
    parent = np.full(z.size, -1)
    sides = np.zeros(z.size, np.int8)
    mark = start.reshape(-1).astype(np.int8) | (end.reshape(-1).astype(np.int8) << 1)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flat = z.reshape(-1)
    for i in np.argsort(-flat, kind="stable").tolist():
        parent[i], sides[i] = i, mark[i]
        r, c = divmod(i, cols)
        root = i
        for a in range(max(0, r - 1), min(rows, r + 2)):
            for b in range(max(0, c - 1), min(cols, c + 2)):
                k = a * cols + b
                if parent[k] >= 0 and (other := find(k)) != root:
                    parent[other] = root
                    sides[root] |= sides[other]
        if sides[root] == 3:
            return float(flat[i])
    return None


def ridges(z: np.ndarray, starts: list[tuple[int, int]], ends: list[tuple[int, int]]) -> np.ndarray:
    """For each start and each end pixel, the highest level at which pixels as high link both through 8 neighbours; -inf if none do.

    One sweep from the highest pixel down answers all pairs: when two groups of pixels
    meet, the level is that of every pair with one end in each.  Pixels of -inf aren't there.
    """
    rows, cols = z.shape
    flat = np.asarray(z, float).reshape(-1)
    out = np.full((len(starts), len(ends)), -np.inf)
    asked: dict[int, tuple[list[int], list[int]]] = {}
    for side, pixels in enumerate((starts, ends)):
        for n, (r, c) in enumerate(pixels):
            asked.setdefault(r * cols + c, ([], []))[side].append(n)
    parent = np.full(flat.size, -1).tolist()
    held: dict[int, tuple[list[int], list[int]]] = {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def meet(one: tuple[list[int], list[int]], two: tuple[list[int], list[int]], level: float) -> None:
        if one[0] and two[1]:
            out[np.ix_(one[0], two[1])] = level

    for i in np.argsort(-flat, kind="stable").tolist():
        level = flat[i]
        if level == -np.inf:
            break
        parent[i] = root = i
        if i in asked:
            held[i] = asked[i]
            meet(held[i], held[i], level)
        r, c = divmod(i, cols)
        for a in range(max(0, r - 1), min(rows, r + 2)):
            for k in range(a * cols + max(0, c - 1), a * cols + min(cols, c + 2)):
                if parent[k] < 0 or (other := find(k)) == root:
                    continue
                parent[other] = root
                if (theirs := held.pop(other, None)) is not None:
                    if (ours := held.get(root)) is None:
                        held[root] = theirs
                    else:
                        meet(ours, theirs, level)
                        meet(theirs, ours, level)
                        held[root] = (ours[0] + theirs[0], ours[1] + theirs[1])
    return out


def relevant(to_first: np.ndarray, to_last: np.ndarray, crests: np.ndarray, min_height: float) -> np.ndarray:
    """Whether ridges of these crests hold water back from both sides that they run along.

    to_first and to_last have the level at which a ridge's start is linked with each
    pixel of either side.  A side whose pixels are all linked at less than the height
    below the crest is a plateau, and there is no obstacle.
    """
    return (to_first.min(axis=1) < crests - min_height) & (to_last.min(axis=1) < crests - min_height)


def along(z: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The first and the last pixel of each column that is there."""
    there = np.isfinite(z)
    last = len(z) - 1 - there[::-1].argmax(axis=0)
    return list(zip(there.argmax(axis=0).tolist(), range(z.shape[1]), strict=True)), list(zip(last.tolist(), range(z.shape[1]), strict=True))


def judged(z: np.ndarray, starts: list[tuple[int, int]], ends: list[tuple[int, int]], bound: float, min_height: float) -> list[tuple[int, int, float]]:
    """(start, end, crest) by their numbers: ridges over the bound that are relevant."""
    first, last = along(z)
    levels = ridges(z, starts, ends + first + last)
    crests, to_first, to_last = np.split(levels, [len(ends), len(ends) + len(first)], axis=1)
    out = []
    for j in range(len(ends)):
        good = (crests[:, j] > bound) & relevant(to_first, to_last, crests[:, j], min_height)
        out += [(int(i), j, float(crests[i, j])) for i in np.flatnonzero(good)]
    return sorted(out)


def obstacles_of_pair(z: np.ndarray, lowest_edge: float, min_height: float, precision: float) -> list[tuple[int, int, float]]:
    """(place left, place right, crest) of ridges that run from the left to the right side of a pair's pixels.

    Peaks of both sides that stand out by the height are tried in pairs; a ridge counts
    if it lies more than the height, less the precision, above the lowest edge, and
    neither the upper nor the lower side is a plateau as high (see `relevant`).
    """
    bound = lowest_edge + min_height - precision
    left = [(p, 0) for p in peaks(z[:, 0], min_height) if z[p, 0] > bound]
    right = [(p, z.shape[1] - 1) for p in peaks(z[:, -1], min_height) if z[p, -1] > bound]
    return [(left[i][0], right[j][0], crest) for i, j, crest in judged(z, left, right, bound, min_height)]


def obstacles_of_cells(blocks: list[tuple[int, int, np.ndarray]], lowest_edge: float, min_height: float, precision: float, prominence: float) -> list[tuple[int, int, int, int, int, int, float]]:
    """(cell, row, col, cell, row, col, crest) of ridges from the left to the right side of two cells, the upper one first.

    blocks are (top, left, pixels), in rows and columns of the raster; cells may differ
    in size.  Sides in one line are searched for peaks as one, others cell by cell.  A
    ridge between peaks of one cell is searched for and judged in that cell, another in both.
    """
    bound = lowest_edge + min_height - precision

    def tops(last: bool) -> list[tuple[int, int, int]]:
        lines = [z[:, -1 if last else 0] for _, _, z in blocks]
        cols = [left + (z.shape[1] - 1 if last else 0) for _, left, z in blocks]
        if cols[0] == cols[1]:
            found = edge_peaks(lines, prominence)
        else:
            found = [(n, p) for n, line in enumerate(lines) for p in peaks(line, prominence)]
        return [(n, blocks[n][0] + p, cols[n]) for n, p in found if lines[n][p] > bound]

    starts, ends = tops(False), tops(True)
    if not starts or not ends:
        return []
    out = []
    for n in (0, 1):
        own, others = [s for s in starts if s[0] == n], [e for e in ends if e[0] == n]
        if own and others:
            top, left, z = blocks[n]
            place = lambda pixels: [(r - top, k - left) for _, r, k in pixels]  # noqa: B023, E731
            out += [(*own[i], *others[j], crest) for i, j, crest in judged(z, place(own), place(others), bound, min_height)]
    if any(s[0] != e[0] for s in starts for e in ends):
        top, left, z = joined(blocks)
        place = lambda pixels: [(r - top, k - left) for _, r, k in pixels]
        out += [(*starts[i], *ends[j], crest) for i, j, crest in judged(z, place(starts), place(ends), bound, min_height) if starts[i][0] != ends[j][0]]
    return sorted(out)


def joined(blocks: list[tuple[int, int, np.ndarray]]) -> tuple[int, int, np.ndarray]:
    """(top, left, pixels) of blocks as one, -inf where there is none."""
    top, left = min(t for t, _, _ in blocks), min(k for _, k, _ in blocks)
    z = np.full((max(t + len(b) for t, _, b in blocks) - top, max(k + b.shape[1] for _, k, b in blocks) - left), -np.inf)
    for t, k, b in blocks:
        z[t - top : t - top + len(b), k - left : k - left + b.shape[1]] = b
    return top, left, z


def find_obstacles(pixels: DataFrame, pair: str, min_height: float, precision: float | None = None) -> DataFrame:
    """pair, left, right, crest of pixels (pair, row, col, z, lowest): every pair of cells on its own, as its block of pixels."""
    precise = search_precision(min_height) if precision is None else precision
    kind = dict(pixels.dtypes)[pair]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, cols = group["row"].to_numpy(int), group["col"].to_numpy(int)
        z = np.full((rows.max() - rows.min() + 1, cols.max() - cols.min() + 1), float(group["z"].min()))
        z[rows - rows.min(), cols - cols.min()] = group["z"].to_numpy(float)
        found = obstacles_of_pair(z, float(group["lowest"].iloc[0]), min_height, precise)
        return pd.DataFrame([(group[pair].iloc[0], int(a + rows.min()), int(b + rows.min()), c) for a, b, c in found], columns=[pair, "left", "right", "crest"])

    return pixels.groupBy(pair).applyInPandas(run, f"{pair} {kind}, left int, right int, crest double")


def ends_on(obstacles: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, side, cell, row, col: where obstacles of a pair's side edges stand on the edge between its cells.

    obstacles is (edge, from_edge, from_row, from_col, to_edge, to_row, to_col), one row for each
    edge that one is assigned to, with rows and columns of the pair's block; pairs is (pair,
    middle, left_1, left_2, right_1, right_2): the edge between the cells, and those of the
    reference cell (1) and of the other one (2) next to it on both sides.  An obstacle without an
    end on the middle edge isn't taken.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.lit(k).alias("cell"), F.col(f"{side}_{k}").alias("edge")) for side in ("left", "right") for k in (1, 2))))
    asked = pairs.select("pair", "middle", sides.alias("s")).select("pair", "middle", "s.*").where("edge is not null")
    met = asked.join(obstacles, "edge").where("from_edge = middle or to_edge = middle")
    at = lambda c: F.when(F.col("from_edge") == F.col("middle"), F.col(f"from_{c}")).otherwise(F.col(f"to_{c}"))
    return met.select("pair", "side", "cell", at("row").alias("row"), at("col").alias("col")).distinct()


def connecting_obstacles(pixels: DataFrame, ends: DataFrame, middle: DataFrame, min_height: float, precision: float | None = None) -> DataFrame:
    """pair, edge, crest, from_row, from_col, to_row, to_col: obstacles that close the gap where a skewed ridge changes sides.

    The second pass: an end on the middle edge of an obstacle left of one cell is connected with
    those of obstacles right of the other cell (ends: pair, side, cell, row, col), if pixels (pair,
    row, col, z) link both high enough above the edge's level (middle: pair, edge, level).  Every
    pair of cells is worked on by itself, as its block of pixels; only pairs with ends are.
    """
    precise = search_precision(min_height) if precision is None else precision
    kinds = dict(middle.dtypes)
    asked = ends.join(middle, "pair")
    blocks = pixels.join(asked.select("pair").distinct(), "pair", "left_semi")
    names = ["pair", "edge", "crest", "from_row", "from_col", "to_row", "to_col"]

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(found):
            rows, cols = block["row"].to_numpy(int), block["col"].to_numpy(int)
            top, left = rows.min(), cols.min()
            z = np.full((rows.max() - top + 1, cols.max() - left + 1), float(block["z"].min()))
            z[rows - top, cols - left] = block["z"].to_numpy(float)
            for side in (1, 2):  # left of one cell with right of the other
                starts = found[(found["side"] == "left") & (found["cell"] == side)].sort_values(["row", "col"])
                stops = found[(found["side"] == "right") & (found["cell"] == 3 - side)].sort_values(["row", "col"])
                if not len(starts) or not len(stops) or z.max() == z.min():
                    continue
                place = lambda ends: list(zip((ends["row"] - top).tolist(), (ends["col"] - left).tolist(), strict=True))
                levels = ridges(z, place(starts), place(stops))
                for i, a in enumerate(starts.itertuples()):
                    for j, b in enumerate(stops.itertuples()):
                        if levels[i, j] > a.level + min_height - precise:
                            out.append((a.pair, a.edge, float(levels[i, j]), a.row, a.col, b.row, b.col))
        return pd.DataFrame(out, columns=names)

    schema = f"pair {kinds['pair']}, edge {kinds['edge']}, crest double, from_row int, from_col int, to_row int, to_col int"
    return blocks.groupBy("pair").cogroup(asked.groupBy("pair")).applyInPandas(run, schema)


def cell_pairs(neighbours: DataFrame) -> DataFrame:
    """Reference cells with their top and right neighbours."""
    return neighbours.where(F.col("location").isin("top", "right"))


def highest_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the row of greatest value; of equals the last by order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(value, order)).alias("best")).select(key, "best.*")


def lowest_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the row of least value; of equals the last by order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(-F.col(value), F.col(order))).alias("best")).select(key, "best.*")


def side_by_side(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pixels of two neighbouring cells as one block; a lower cell is filled up with its least value, at its end."""
    rows = max(len(left), len(right))

    def grown(z: np.ndarray) -> np.ndarray:
        return np.vstack([z, np.full((rows - len(z), z.shape[1]), z.min())]) if len(z) < rows else z

    return np.hstack([grown(left), grown(right)])


def edge_peaks(edges: list[np.ndarray], prominence: float) -> list[tuple[int, int]]:
    """(edge, place) of the peaks of edges that follow each other, found on all of them as one."""
    ends = np.cumsum([len(e) for e in edges])
    out = []
    for p in peaks(np.concatenate(edges), prominence) if len(edges) else []:
        i = int(np.searchsorted(ends, p, "right"))
        out.append((i, p - int(ends[i]) + len(edges[i])))
    return out


def significant(obstacles: DataFrame, flows: DataFrame, series: DataFrame, least_flow: float, least_reduction: float, key: str = "id") -> DataFrame:
    """obstacles (key, crest) of lines with enough discharge (key, q), that take enough of it (key, q, factor, dt)."""
    busy = flows.where(F.abs("q") > least_flow).select(key)
    near = obstacles.join(busy, key, "left_semi")
    taken = discharge_reduction(series.join(near.select(key).distinct(), key, "left_semi"), key)
    return near.join(taken.where(F.col("reduced") > least_reduction), key)
