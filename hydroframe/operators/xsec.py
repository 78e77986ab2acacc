"""Channel cross-sections and meshes: parsing, simplification, widths, offsets, triangles, pixels of triangles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes that a width alone describes, and shapes that a table describes.
CLOSED, TABULATED_RECTANGLE, TABULATED_TRAPEZIUM, YZ = {1, 2, 3}, 5, 6, 7


def thalweg(y: list[float], z: list[float]) -> float:
    """y at the mean place of the lowest points."""
    low = [i for i, v in enumerate(z) if v == min(z)]
    return float(np.interp(sum(low) / len(low), range(len(y)), y))


def _told_once(value: Column, use) -> Column:
    """use(value), with a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def thalweg_of(y: Column, z: Column) -> Column:
    """thalweg, for arrays."""
    from hydroframe.functions.geometry import interpolate

    places = F.transform(F.sequence(F.lit(0), F.size(z) - 1), lambda i: i.cast("double"))
    mean = lambda low: F.aggregate(low, F.lit(0.0), lambda s, i: s + i) / F.size(low)
    at = _told_once(F.array_min(z), lambda least: _told_once(F.filter(places, lambda i: F.get(z, i.cast("int")) == least), mean))
    return F.when(F.size(z) > 0, _told_once(places, lambda p: _told_once(at, lambda x: interpolate(x, p, y))))


def offsets_of(y: Column, z: Column) -> Column:
    """Distances of all points from the thalweg, for arrays."""
    return _told_once(thalweg_of(y, z), lambda middle: F.transform(y, lambda v: v - middle))


def unique_offsets_of(every: Column) -> Column:
    """unique_offsets, for an array of arrays; offsets of equal size go from left to right, smaller ones first."""
    cut = F.transform(F.flatten(every), lambda v: (v * 1000).cast("long") / 1000)
    whole = F.array_union(F.array_distinct(cut), F.array(F.lit(0.0)))
    return F.transform(F.array_sort(F.transform(whole, lambda v: F.struct(F.abs(v).alias("size"), v.alias("v")))), lambda s: s["v"])


def offsets(y: list[float], z: list[float]) -> list[float]:
    middle = thalweg(y, z)
    return [v - middle for v in y]


def unique_offsets(every: list[list[float]]) -> list[float]:
    """All offsets once each, cut to millimetres, and 0."""
    return sorted({int(v * 1000) / 1000 for one in every for v in one} | {0.0})


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that keep a line within the tolerance (Douglas and Peucker), by a stack."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        size = float(line @ line)
        t = np.clip(inner @ line / size, 0, 1) if size else np.zeros(len(inner))
        away = np.sqrt(((inner - t[:, None] * line) ** 2).sum(axis=1))
        i = int(away.argmax())
        if away[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return points[keep]


def offset_line(points: np.ndarray, distance: float) -> np.ndarray:
    """Each vertex moved at right angles (left if positive), along the bisector of its corner."""
    d = np.diff(points, axis=0)
    d = d / np.hypot(*d.T)[:, None]
    n = np.column_stack([-d[:, 1], d[:, 0]])
    first, last = np.vstack([n[:1], n]), np.vstack([n, n[-1:]])
    cosine = 1 + (first * last).sum(axis=1)
    return points + distance * (first + last) / np.maximum(cosine, 1e-9)[:, None]


def valid_offset(points: np.ndarray, distance: float) -> bool:
    """Whether no part of the line turns around when moved that far."""
    moved = offset_line(points, distance)
    return bool((np.einsum("ij,ij->i", np.diff(points, axis=0), np.diff(moved, axis=0)) > 0).all())


def highest_valid(points: np.ndarray, distances: list[float]) -> int:
    """The last vertex up to which the line can be moved by all distances; by halving."""
    low, high = 1, len(points) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if all(valid_offset(points[: middle + 1], d) for d in sorted(distances, key=abs, reverse=True)):
            low = middle
        else:
            high = middle - 1
    return low


class NoTriangles(ValueError):
    """Two lines between which no triangles can be laid."""


def turns(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sign of the side of a-b on which p lies: 1 left, -1 right, 0 on it."""
    u, v = b - a, p - a
    return np.sign(np.round(u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0], 9))


def cuts(a: np.ndarray, b: np.ndarray, line: np.ndarray) -> bool:
    """Whether the inside of the segment a-b meets a line in a point; ends that touch and shared parts don't count."""
    if len(line) < 2:
        return False
    p, q = line[:-1], line[1:]
    one, two, three, four = turns(a, b, p), turns(a, b, q), turns(p, q, a), turns(p, q, b)
    return bool(((three * four < 0) & (one * two <= 0) & ((one != 0) | (two != 0))).any())


def meet(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two lines have a point in common."""
    if len(one) < 2 or len(two) < 2:
        return False
    a, b, p, q = one[:-1, None], one[1:, None], two[None, :-1], two[None, 1:]
    sides = (turns(a, b, p), turns(a, b, q), turns(p, q, a), turns(p, q, b))
    across = (sides[0] * sides[1] <= 0) & (sides[2] * sides[3] <= 0)
    flat = (sides[0] == 0) & (sides[1] == 0)
    near = np.ones(across.shape, bool)
    for k in (0, 1):
        near &= (np.maximum(a[..., k], b[..., k]) >= np.minimum(p[..., k], q[..., k])) & (np.maximum(p[..., k], q[..., k]) >= np.minimum(a[..., k], b[..., k]))
    return bool((across & (~flat | near)).any())


def between(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles between two lines; indices count left points first.

    The right line is turned around if it ends nearer to where the left one begins.
    Both are walked along together, by the shorter diagonal (of equals the right one)
    unless it cuts a line and the other doesn't.  If both cut one, the next corner of a line
    is cut off by itself, if it points away from the other line.  Lines that meet, and lines
    where neither goes on, have no triangles (NoTriangles); a point may stand for a line.
    """
    n, m = len(left), len(right)
    if not n or not m:
        raise NoTriangles("a side has no points")
    order = list(range(m))
    if math.dist(left[0], right[0]) > math.dist(left[0], right[-1]):
        order.reverse()
        right = right[::-1]
    if meet(left, right):
        raise NoTriangles("the sides meet")
    plain = n == 1 or m == 1
    valid = lambda a, b: plain or not (cuts(a, b, left) or cuts(a, b, right))
    corner = lambda line, k, side: k + 2 < len(line) and turns(line[k], line[k + 1], line[k + 2]) == side and valid(line[k], line[k + 2])
    i = j = 0
    out = []
    while i < n - 1 or j < m - 1:
        if i == n - 1 or j == m - 1:
            go = "right" if i == n - 1 else "left"
        else:
            base, a, b = valid(left[i], right[j]), valid(left[i + 1], right[j]), valid(left[i], right[j + 1])
            shorter = "left" if math.dist(left[i + 1], right[j]) < math.dist(left[i], right[j + 1]) else "right"
            go = shorter if a and b else "left" if a else "right" if b else ""
            if not go or not base:
                go = "left corner" if corner(left, i, -1) else "right corner" if corner(right, j, 1) else ""
        if go == "left":
            out.append((i, i + 1, n + order[j]))
            i += 1
        elif go == "right":
            out.append((i, n + order[j], n + order[j + 1]))
            j += 1
        elif go == "left corner":
            out.append((i, i + 1, i + 2))
            i += 2
        elif go == "right corner":
            out.append((n + order[j], n + order[j + 1], n + order[j + 2]))
            j += 2
        else:
            raise NoTriangles(f"no triangle leads on from {left[i].tolist()} and {right[j].tolist()}")
    return out


CORNERS = [f"{a}{i}" for i in (1, 2, 3) for a in "xyz"]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores, by keys if any: few bytes are one partition, however long the Python code takes for each row."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 4, *keys)


def line_of(points) -> np.ndarray:
    """Points (x, y, z) without repeats of the one before."""
    if points is None or any(q is None or any(v is None for v in (q["x"], q["y"], q["z"])) for q in points):
        raise NoTriangles("a point is missing")
    p = np.array([(q["x"], q["y"], q["z"]) for q in points], float).reshape(-1, 3)
    p = p[np.concatenate([[True], np.abs(np.diff(p[:, :2], axis=0)).max(axis=1) > 0])] if len(p) else p
    if len(p) < 2:
        raise NoTriangles("a channel needs two vertices")
    return p


def _meshed(channels: DataFrame, distances: list[float], key: str) -> DataFrame:
    kind = dict(channels.dtypes)[key]
    ordered = sorted(distances)

    def run(batches):
        for pdf in batches:
            rows = []
            for name, points in zip(pdf[key], pdf["points"], strict=True):
                try:
                    p = line_of(points)
                    moved = [np.column_stack([offset_line(p[:, :2], d), p[:, 2]]) for d in ordered]
                    strips = [(np.vstack([left, right]), between(left[:, :2], right[:, :2])) for right, left in zip(moved, moved[1:], strict=False)]
                except NoTriangles as e:
                    rows.append((name, None, *[None] * 9, str(e)))
                    continue
                every = [both[list(t)].reshape(-1).tolist() for both, triangles in strips for t in triangles]
                rows += [(name, i, *t, None) for i, t in enumerate(every)]
            yield pd.DataFrame(rows, columns=[key, "triangle", *CORNERS, "error"]).astype({"triangle": "Int32"})

    return dealt(channels.select(key, "points")).mapInPandas(run, f"{key} {kind}, triangle int, {', '.join(f'{n} double' for n in CORNERS)}, error string")


def mesh(channels: DataFrame, distances: list[float], key: str = "id") -> DataFrame:
    """key, triangle, x1 .. z3 of channels (key, points array<struct<x, y, z>>): triangles between lines moved by neighbouring distances.

    z is the channel's own at each vertex.  A channel between whose lines no triangles can
    be laid, or with less than two vertices, has none; `mesh_errors` tells why.
    """
    return _meshed(channels, distances, key).where("error is null").drop("error")


def mesh_errors(channels: DataFrame, distances: list[float], key: str = "id") -> DataFrame:
    """key, error of channels that have no mesh."""
    return _meshed(channels, distances, key).where("error is not null").select(key, "error")


def triangle_pixels(triangles: DataFrame, grid) -> DataFrame:
    """row, col, value: pixels whose centre lies in a triangle, at its plane's height; the lowest where several do."""
    c = F.col
    low = lambda a: F.least(*(f"{a}{i}" for i in (1, 2, 3)))
    high = lambda a: F.greatest(*(f"{a}{i}" for i in (1, 2, 3)))
    rows = triangles.withColumn("row", F.explode(F.sequence(grid.row(high("y")), grid.row(low("y"))))).withColumn("col", F.explode(F.sequence(grid.col(low("x")), grid.col(high("x")))))
    px, py = grid.centre_x(c("col")), grid.centre_y(c("row"))
    area = (c("y2") - c("y3")) * (c("x1") - c("x3")) + (c("x3") - c("x2")) * (c("y1") - c("y3"))
    a = F.try_divide((c("y2") - c("y3")) * (px - c("x3")) + (c("x3") - c("x2")) * (py - c("y3")), area)
    b = F.try_divide((c("y3") - c("y1")) * (px - c("x3")) + (c("x1") - c("x3")) * (py - c("y3")), area)
    inside = rows.withColumn("_a", a).withColumn("_b", b).where("_a >= -1e-9 and _b >= -1e-9 and _a + _b <= 1 + 1e-9")
    z = c("_a") * c("z1") + c("_b") * c("z2") + (1 - c("_a") - c("_b")) * c("z3")
    return inside.groupBy("row", "col").agg(F.min(z).alias("value"))


def max_width(shape: Column, width: Column, table: Column) -> Column:
    """The greatest width: its own for closed shapes, of the second column for tables, of the last y for YZ."""
    second = F.transform(F.split(table, "\n"), lambda r: F.element_at(F.split(r, ","), 2).cast("double"))
    first = F.transform(F.split(table, "\n"), lambda r: F.element_at(F.split(r, ","), 1).cast("double"))
    return (
        F.when(shape.isin(*CLOSED), width.cast("double"))
        .when(shape.isin(TABULATED_RECTANGLE, TABULATED_TRAPEZIUM), F.array_max(second))
        .when(shape == YZ, F.array_max(first))
        .otherwise(F.raise_error(F.concat(F.lit("unknown shape "), shape.cast("string"))).cast("double"))
    )


def parallel(points: np.ndarray, sections: list[tuple[float, list[float], list[float]]], distance: float) -> np.ndarray:
    """The line moved by a distance, with heights: those of the sections (position, offsets, z) at that offset, linear between positions."""
    places = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
    ordered = sorted(sections, key=lambda s: s[0])
    heights = [float(np.interp(distance, o, z)) for _, o, z in ordered]
    return np.column_stack([offset_line(points, distance), np.interp(places, [s[0] for s in ordered], heights)])


def width_at(position: float, sections: list[tuple[float, float]]) -> float:
    """The width at a position, linear between sections (position, width)."""
    ordered = sorted(sections)
    return float(np.interp(position, [s[0] for s in ordered], [s[1] for s in ordered]))


def split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of at most so many vertices, each beginning where the one before it ends."""
    if most < 2:
        raise ValueError("a part needs two vertices")
    return [points[i : i + most] for i in range(0, max(1, len(points) - 1), most - 1)]


def split_valid(points: np.ndarray, distances: list[float]) -> list[np.ndarray]:
    """Parts that can each be moved by all distances."""
    out, at = [], 0
    while at < len(points) - 1:
        end = at + highest_valid(points[at:], distances)
        out.append(points[at : end + 1])
        at = end
    return out


def ordered_triangles(triangles: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Triangles so that each but the first of a connected part shares a side with an earlier one."""
    by_side: dict[frozenset[int], list[int]] = {}
    sides = [[frozenset(s) for s in ((a, b), (b, c), (c, a))] for a, b, c in triangles]
    for i, three in enumerate(sides):
        for s in three:
            by_side.setdefault(s, []).append(i)
    done, out = [False] * len(triangles), []
    for first in range(len(triangles)):
        queue = [first]
        while queue:
            i = queue.pop(0)
            if done[i]:
                continue
            done[i] = True
            out.append(triangles[i])
            queue += [j for s in sides[i] for j in by_side[s] if not done[j]]
    return out


POINTS = "array<struct<x: double, y: double, z: double>>"


def _points(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in p]


def _mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """rows of the schema, as make gives them for each row; rows whose line can't be used have none."""
    names = [part.strip().split()[0] for part in schema.split(";")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    out += list(make(row))
                except NoTriangles:
                    continue
            yield pd.DataFrame(out, columns=names)

    return dealt(rows).mapInPandas(run, schema.replace(";", ","))


def simplified_lines(channels: DataFrame, tolerance: float) -> DataFrame:
    """id, points of channels (id, points, keep array<int>): vertices that keep each line within the tolerance.

    Vertices whose numbers (from 0) are in keep, those with a cross-section, always stay:
    the parts between them are simplified one by one.  Null keep is none.
    """

    def make(row):
        p = line_of(row.points)
        given = np.array([(q["x"], q["y"]) for q in row.points], float)
        kept = [given[i] for i in (row.keep if row.keep is not None else []) if 0 <= i < len(given)]
        at = sorted({0, len(p) - 1, *(int(np.abs(p[:, :2] - k).max(axis=1).argmin()) for k in kept)})
        parts = [simplified(p[a : b + 1, :2], tolerance) for a, b in zip(at, at[1:], strict=False)]
        flat = np.vstack([parts[0], *(part[1:] for part in parts[1:])])
        place, n = [], 0
        for q in flat:
            n += int((p[n:, :2] == q).all(axis=1).argmax())
            place.append(n)
        yield row.id, _points(p[place])

    return _mapped(channels.select("id", "points", "keep"), f"id {dict(channels.dtypes)['id']}; points {POINTS}", make)


def parallels(channels: DataFrame, sections: DataFrame, distances: list[float]) -> DataFrame:
    """id, distance, points: each channel (id, points) moved by each distance, with the heights of its sections (id, position, offsets, z).

    A section's height at the distance is linear between its offsets, and a vertex's is
    linear between sections; beyond the ends the last value stays.  Channels without
    sections or with less than two vertices have no lines.
    """
    held = sections.where("position is not null and size(offsets) > 0 and size(offsets) = size(z)").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "offsets", F.col("z").alias("heights")))).alias("sections"))
    asked = channels.select("id", "points").join(held, "id").withColumn("distance", F.explode(F.array(*map(F.lit, map(float, distances)))))

    def make(row):
        p = line_of(row.points)[:, :2]
        yield row.id, row.distance, _points(parallel(p, [(s["position"], s["offsets"], s["heights"]) for s in row.sections], row.distance))

    return _mapped(asked, f"id {dict(channels.dtypes)['id']}; distance double; points {POINTS}", make)


def valid_parts(channels: DataFrame, distances: list[float]) -> DataFrame:
    """id, part, points: channels (id, points) cut into parts that can each be moved by all distances without turning around."""

    def make(row):
        p, at = line_of(row.points), 0
        for n, part in enumerate(split_valid(p[:, :2], list(distances))):
            yield row.id, n, _points(p[at : at + len(part)])
            at += len(part) - 1

    return _mapped(channels.select("id", "points"), f"id {dict(channels.dtypes)['id']}; part int; points {POINTS}", make)


def in_order(triangles: DataFrame, key: str = "id") -> DataFrame:
    """triangles (key, triangle, x1 .. z3) with place: each but the first of a connected part shares a side with one before; a channel's mesh is one group."""
    schema = triangles.select(key, "triangle", *CORNERS)
    kinds = ", ".join(f"{n} {k}" for n, k in schema.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("triangle", ignore_index=True)
        at = np.round(np.stack([group[[f"x{n}", f"y{n}"]].to_numpy(float) for n in (1, 2, 3)], axis=1), 6).tolist()
        corners = [tuple(map(tuple, t)) for t in at]
        number = {q: n for n, q in enumerate(dict.fromkeys(q for t in corners for q in t))}
        numbered: dict[tuple[int, ...], list[int]] = {}
        for i, t in enumerate(corners):
            numbered.setdefault(tuple(number[q] for q in t), []).append(i)
        order = [numbered[t].pop(0) for t in ordered_triangles([tuple(number[q] for q in t) for t in corners])]
        return group.iloc[order].assign(place=range(len(order)))

    return dealt(schema, key).groupBy(key).applyInPandas(run, f"{kinds}, place int")


def wedges(ends: DataFrame) -> DataFrame:
    """node, first, second, gap: neighbours of channel ends (node, channel, azimuth) around a node with more than 180 degrees between them."""
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy(F.desc("azimuth"), "channel")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead(F.struct("channel", "azimuth")).over(w), F.first(F.struct("channel", "azimuth")).over(whole))
    pairs = ends.withColumn("_next", following).where(F.col("_next.channel") != F.col("channel"))
    gap = F.pmod(F.col("azimuth") - F.col("_next.azimuth"), F.lit(360.0))
    return pairs.select("node", F.col("channel").alias("first"), F.col("_next.channel").alias("second"), gap.alias("gap")).where("gap > 180")


def filled(node: tuple[float, float, float], first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Triangles from a node's point to the outer points of two channels (inmost first), and between them; every point is a corner of one."""
    side = np.vstack([np.array(node, float)[None], first])
    both = np.vstack([side, second])
    return [both[list(t)] for t in between(side[:, :2], np.asarray(second, float)[:, :2])]


def channel_ends(channels: DataFrame) -> DataFrame:
    """node, channel, azimuth, starts of channels (id, start_node, end_node, points): both ends, with the direction in which the channel leaves the node."""
    from hydroframe.functions import geometry as G

    n = F.size("points")
    at = lambda i: F.get("points", i)
    end = lambda node, a, b, starts: F.struct(F.col(node).alias("node"), G.azimuth(at(a)["x"], at(a)["y"], at(b)["x"], at(b)["y"]).alias("azimuth"), F.lit(starts).alias("starts"))
    both = F.explode(F.array(end("start_node", F.lit(0), F.lit(1), True), end("end_node", n - 1, n - 2, False)))
    return channels.where(n > 1).select(F.col("id").alias("channel"), both.alias("e")).select("e.node", "channel", "e.azimuth", "e.starts").where("node is not null and azimuth is not null")


def _wedged(channels: DataFrame) -> DataFrame:
    ends = channel_ends(channels)
    kinds = dict(ends.dtypes)
    once = ends.groupBy("node", "channel").agg(F.max_by("azimuth", "starts").alias("azimuth"), F.max("starts").alias("starts"))
    found = wedges(once.select("node", "channel", "azimuth")).select("node", "first", "second")
    for name in ("first", "second"):
        found = found.join(once.select("node", F.col("channel").alias(name), F.col("starts").alias(f"{name}_starts")), ["node", name])
        found = found.join(channels.select(F.col("id").alias(name), F.col("points").alias(f"{name}_points"), F.col("distances").alias(f"{name}_distances")), name)

    def outer(points, distances, starts: bool, left: bool) -> np.ndarray:
        """The node's end of a channel's moved lines on one side, seen from the node; inmost first."""
        p = line_of(points)
        sign = 1 if starts == left else -1
        on = sorted((float(d) for d in distances if d is not None and d * sign > 0), key=abs) if distances is not None else []
        return np.array([[*offset_line(p[:, :2], d)[0 if starts else -1], p[0 if starts else -1, 2]] for d in on]).reshape(-1, 3)

    def run(batches):
        for pdf in batches:
            rows = []
            for w in pdf.itertuples(index=False):
                owner = w.second if w.first_starts and not w.second_starts else w.first
                try:
                    one = outer(w.first_points, w.first_distances, w.first_starts, True)
                    two = outer(w.second_points, w.second_distances, w.second_starts, False)
                    if owner == w.first:
                        own, other, middle = one, two, line_of(w.first_points)[0 if w.first_starts else -1]
                    else:
                        own, other, middle = two, one, line_of(w.second_points)[0 if w.second_starts else -1]
                    triangles = filled(tuple(middle), own, other)
                except NoTriangles as e:
                    rows.append((w.node, w.first, w.second, owner, None, *[None] * 9, str(e)))
                    continue
                rows += [(w.node, w.first, w.second, owner, i, *t.reshape(-1).tolist(), None) for i, t in enumerate(triangles)]
            yield pd.DataFrame(rows, columns=["node", "first", "second", "channel", "triangle", *CORNERS, "error"]).astype({"triangle": "Int32"})

    which = ", ".join(f"{n} {kinds['channel']}" for n in ("first", "second", "channel"))
    return found.mapInPandas(run, f"node {kinds['node']}, {which}, triangle int, {', '.join(f'{n} double' for n in CORNERS)}, error string")


def wedge_mesh(channels: DataFrame) -> DataFrame:
    """node, channel, triangle, x1 .. z3: triangles that fill gaps of over 180 degrees between channels at their nodes.

    channels is (id, start_node, end_node, points, distances array<double>; left is positive).
    Seen from the node, the gap lies left of the first channel and right of the second: the
    node and the first one's left offsets are triangulated with the second one's right ones,
    whichever way both run.  The triangles belong to the first, or to the second if that one
    ends where the first begins.  A channel that starts and ends at a node counts by its start.
    Gaps without offsets on a side, and those where triangles can't be laid, stay open; `wedge_errors` tells why.
    """
    return _wedged(channels).where("error is null").drop("error", "first", "second")


def wedge_errors(channels: DataFrame) -> DataFrame:
    """node, first, second, error of gaps that stay open."""
    return _wedged(channels).where("error is not null").select("node", "first", "second", "error")


def as_query(triangles: DataFrame, key: str = "id") -> DataFrame:
    """key, sql: a channel's triangles as one query that unites their distinct rows."""
    c = lambda n: F.format_string("%.6f", F.col(n))
    row = F.concat(F.lit("SELECT "), F.concat_ws(", ", *(F.concat(c(n), F.lit(f" AS {n}")) for n in (f"{a}{i}" for i in (1, 2, 3) for a in "xyz"))))
    return triangles.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(row)), " UNION ").alias("sql"))
