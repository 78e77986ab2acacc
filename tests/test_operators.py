"""Literal cases of graph, gauge, raster, network, line, leak and cross-section operators."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.functions import geometry as G
from hydroframe.operators import gauge, graph, joins, leak, lines, network, raster, sampling, scenario, sections, xsec
from hydroframe.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_gauges_turn_with_their_direction(spark):
    flow = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 5.0, -10.0, 5.0), (3, 0.0, 50.0, 10.0, 50.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    q = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 7.0)], "id int, q double")

    def total(points):
        g = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in points])], "gauge int, points array<struct<x: double, y: double>>")
        rows = gauge.totals(gauge.crossings(flow, g), q).collect()
        return rows[0]["total"] if rows else 0

    up = [(5.0, -5.0), (5.0, 4.0), (-5.0, 4.5), (-5.0, 8.0)]
    assert total(up) == -total(up[::-1]) != 0
    assert total([(5.0, -5.0), (5.0, 20.0)]) == 2.0
    with pytest.raises(Exception, match="more than once"):
        total([(2.0, -5.0), (2.0, 5.0), (8.0, 5.0), (8.0, -5.0)])


def test_flow_per_node_keeps_magnitudes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 3.0, 4.0), (2, 1, 2, 3.0, 4.0, 3.0, 9.0)], "id long, start_id long, end_id long, x0 double, y0 double, x1 double, y1 double")
    flows = spark.createDataFrame([(1, 10.0), (2, -2.0)], "id long, q double")
    out = {r["id"]: (round(r["x"], 9), round(r["y"], 9)) for r in graph.flow_per_node(nodes, edges, flows, True).collect()}
    into = {r["id"]: (round(r["x"], 9), round(r["y"], 9)) for r in graph.flow_per_node(nodes, edges, flows, False).collect()}
    assert out == {0: (6, 8), 1: (0, 0), 2: (0, 2), 3: (0, 0)} and into == {0: (0, 0), 1: (6, 10), 2: (0, 0), 3: (0, 0)}
    missing = spark.createDataFrame([(1, None), (2, 1.0)], "id long, q double")
    assert {r["id"]: r["x"] for r in graph.flow_per_node(nodes, edges, missing, True).collect()}[0] is None


def test_hydraulics(spark):
    beds = F.array(*map(F.lit, (2.3, -1.0, -2.0, 3.5, 6.8)))
    none = F.lit(None).cast("double")
    ten = F.lit(10.0)
    assert one(spark, leak.wet_area(beds, F.lit(1.0), none, ten)) == 50
    assert one(spark, leak.wet_area(beds, F.lit(1.0), F.lit(0.0), ten)) == 20
    assert math.isclose(one(spark, leak.wet_area(beds, F.lit(5.0), F.lit(2.0), ten)), (2.7 + 3 + 3 + 1.5) * 10)
    assert [one(spark, leak.wet_perimeter(beds, F.lit(1.0), c, ten)) for c in (none, F.lit(0.0), F.lit(1.0), F.lit(2.0))] == [20, 20, 0, 0]
    assert one(spark, leak.wet_perimeter(beds, F.lit(10.0), none, ten)) == 50
    assert math.isclose(one(spark, leak.reduction(beds, F.lit(1.0), none, F.lit(0.0), ten)), 0.6324555320336759)
    assert one(spark, leak.reduction(beds, F.lit(1.0), none, F.lit(5.0), ten)) == 0


def test_peaks():
    assert leak.peaks(np.array([0, 3, 1, 2, 0.0]), 0.5) == [1, 3]
    assert leak.peaks(np.array([0, 3, 1, 2, 0.0]), 1.5) == [1]
    assert leak.peaks(np.array([0, 2, 2, 2, 0.0]), 1) == [2] and leak.peaks(np.array([2, 2, 0.0]), 1) == []


def test_ridge_as_bisection():
    draw = np.random.default_rng(4)

    def linked(z, start, end, level):
        seen, todo = set(), [p for p in zip(*np.nonzero(start & (z >= level)), strict=True)]
        while todo:
            r, c = todo.pop()
            if (r, c) in seen:
                continue
            seen.add((r, c))
            todo += [(a, b) for a in range(max(0, r - 1), min(z.shape[0], r + 2)) for b in range(max(0, c - 1), min(z.shape[1], c + 2)) if z[a, b] >= level]
        return any(end[p] for p in seen)

    for _ in range(60):
        z = draw.integers(0, 12, draw.integers(2, 7, 2)).astype(float)
        start, end = np.zeros(z.shape, bool), np.zeros(z.shape, bool)
        start[:, 0], end[:, -1] = True, True
        want = max((v for v in np.unique(z) if linked(z, start, end, v)), default=None) if z.min() != z.max() else None
        assert leak.ridge(z, start, end) == want


def test_obstacles_of_a_pair(spark):
    z = np.full((6, 8), 1.0)
    z[3] = 5.0
    z[3, 4] = 4.0
    rows = [(1, r, c, float(z[r, c]), 1.0) for r in range(6) for c in range(8)] + [(2, r, c, 1.0, 1.0) for r in range(6) for c in range(8)]
    got = leak.find_obstacles(spark.createDataFrame(rows, "pair int, row int, col int, z double, lowest double"), "pair", 1.0).collect()
    assert [tuple(r) for r in got] == [(1, 3, 3, 4.0)]


def by_the_loop(y, z, wall):
    """Equal y's pushed on again and again; what is overtaken goes."""
    y, z = list(y), list(z)
    while any(b <= a for a, b in zip(y, y[1:], strict=False)):
        y = [y[0]] + [b + wall if b == a else b for a, b in zip(y, y[1:], strict=False)]
        while any(b < a for a, b in zip(y, y[1:], strict=False)):
            keep = [True] + [b >= a for a, b in zip(y, y[1:], strict=False)]
            y, z = [v for v, k in zip(y, keep, strict=True) if k], [v for v, k in zip(z, keep, strict=True) if k]
    return y, z


def test_tables_of_sections(spark):
    cases = [
        ("0, 2\n1, 4", 5, [0, 1, 1.125, 3, 3.125, 4], [1, 1, 0, 0, 1, 1]), ("0, 2\n1, 4", 6, [0, 1, 3, 4], [1, 0, 0, 1]), ("0, 10\n1, 20\n2, 40", 6, [0, 10, 15, 25, 30, 40], [2, 1, 0, 0, 1, 2]),
        ("0, 0\n1, 4", 6, [0, 2, 4], [1, 0, 1]), ("0, 3\n2, 1\n4, 0\n8, 4", 7, [0, 2, 4, 8], [3, 1, 0, 4]), ("0,2\n1,2", 6, [0, 0.125, 2, 2.125], [1, 0, 0, 1]), ("0,2\n1,2\n", 5, [0, 0.125, 2, 2.125], [1, 0, 0, 1]),
        ("0,9\n1,8\n1,7\n1.0625,6\n2,5", 7, [0, 1, 1.125, 2], [9, 8, 7, 5]), ("0,3\n2,2\n1,1\n3,0", 7, None, sections.FALLING), ("0,3\n1,2", 6, None, sections.SHRINKING), ("1,3\n2,2", 7, None, sections.NO_ZERO),
        ("0;3", 7, None, sections.UNREADABLE), ("", 7, None, sections.UNREADABLE), (None, 5, None, sections.UNREADABLE), ("0,1,2", 7, None, sections.UNREADABLE), ("0,1", 3, None, sections.NO_TABLE), ("0,1", None, None, sections.NO_TABLE),
    ]
    draw = np.random.default_rng(9)
    for _ in range(40):
        y = np.cumsum(np.r_[0, draw.choice([0, 0, 0.0625, 0.125, 0.5], 9)])
        cases.append(("\n".join(f"{a},{i}" for i, a in enumerate(y)), 7, *map(list, by_the_loop(y.tolist(), range(10), 0.125))))
    rows = spark.createDataFrame([(i, shape, 0.0, text) for i, (text, shape, *_) in enumerate(cases)], "id int, shape int, reference double, text string")
    for r in sections.sections(rows, wall=0.125).collect():
        _, _, y, z = cases[r["id"]]
        assert (cases[r["id"]][0], r["y"], r["error"] or r["z"]) == (cases[r["id"]][0], y, z)
    flat = sections.sections(rows, wall=0.0).where("id = 5 or id = 1").orderBy("id").collect()
    assert flat[0]["error"] is None and flat[1]["error"] == sections.NOT_GROWING


def test_sections():
    assert xsec.thalweg([0, 10, 15, 25, 30, 40], [2, 1, 0, 0, 1, 2]) == 20.0
    assert xsec.unique_offsets([[-1.0006, 0.5], [0.5]]) == [-1.0, 0.0, 0.5]


def test_geometry(spark):
    az = lambda *p: one(spark, G.azimuth(*map(F.lit, map(float, p))))
    assert az(0, 0, 0, -1) == 180 and math.isclose(az(0, 0, 1, 5), 11.31, abs_tol=0.01) and az(0, 0, 1, 0) == 90
    assert one(spark, G.left_of(*map(F.lit, (0.0, 0.0, 0.0, 0.0, 1.0, 0.0)))) is None
    assert one(spark, G.interpolate(F.lit(7.0), F.array(F.lit(0.0), F.lit(5.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 2.0


def test_offsets_and_triangles():
    line = np.array([(0.0, 0.0), (5.0, 0.0), (10.0, 0.0)])
    assert np.allclose(xsec.offset_line(line, 2.0), line + [0, 2])
    bend = np.array([(math.cos(a), math.sin(a)) for a in np.linspace(0, math.pi, 24)]) * 0.45
    assert not xsec.valid_offset(bend, 0.5) and xsec.valid_offset(bend, 0.4) and xsec.highest_valid(line, [5.0, -5.0]) == 2
    triangles = xsec.between(line, line + [0, 2])
    assert len(triangles) == 4 and math.isclose(sum(abs(np.linalg.det(np.vstack([np.vstack([line, line + [0, 2]])[list(t)].T, [1, 1, 1]]))) / 2 for t in triangles), 20.0)
    zigzag = np.array([(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (3.0, 1.0)])
    assert xsec.simplified(zigzag, 0.01).tolist() == [[0, 0], [2, 0], [3, 1]]


def test_mesh_pixels(spark):
    channels = spark.createDataFrame([(1, [{"x": 0.5, "y": 5.0, "z": 1.0}, {"x": 9.5, "y": 5.0, "z": 3.0}])], "id int, points array<struct<x: double, y: double, z: double>>")
    mesh = xsec.mesh(channels, [-1.0, 0.0, 1.0])
    assert mesh.count() == 4
    pixels = {(r["row"], r["col"]): r["value"] for r in xsec.triangle_pixels(mesh, raster.Grid(0.0, 10.0, 1.0)).collect()}
    assert {k[0] for k in pixels} == {4, 5} and math.isclose(pixels[4, 4], 1 + 2 * 4 / 9)


def test_pipes(spark):
    pipes = spark.createDataFrame([(3, 3, 1, 5.0), (2, 2, 1, 7.0), (1, 1, 0, 2.0), (9, 9, 8, 4.0)], "id long, src long, dst long, length double")
    assert {tuple(r) for r in network.upstream_distance(pipes).collect()} == {(3, 5.0), (2, 7.0), (1, 9.0), (9, 4.0)}
    with pytest.raises(ValueError):
        network.upstream_distance(spark.createDataFrame([(1, 1, 2, -1.0)], "id long, src long, dst long, length double"))
    with pytest.raises(ValueError):
        network.check_gradients([(0, 10, 0.1)], 20)


def test_ways_that_meet_again(spark):
    """Distances are shortest ways, and the farthest node counts; cycles are allowed."""
    kind = "id long, src string, dst string, length double"
    meeting = spark.createDataFrame([(1, "a", "b", 1.0), (2, "a", "c", 5.0), (3, "c", "b", 5.0), (4, "b", "d", 1.0)], kind)
    assert {tuple(r) for r in network.upstream_distance(meeting).collect()} == {(1, 1.0), (2, 5.0), (3, 10.0), (4, 6.0)}
    circle = spark.createDataFrame([(1, "a", "b", 1.0), (2, "b", "a", 2.0), (3, "b", "b", 9.0)], kind)
    assert {tuple(r) for r in network.upstream_distance(circle).collect()} == {(1, 3.0), (2, 3.0), (3, 10.0)}
    assert network.upstream_distance(meeting.limit(0)).count() == 0


def test_ways_as_floyd_and_warshall(spark):
    draw = np.random.default_rng(5)
    rows = [(i, int(draw.integers(0, 14)), int(draw.integers(0, 14)), float(draw.integers(0, 9))) for i in range(40)]
    way = np.full((14, 14), np.inf)
    for _, a, b, n in rows:
        way[a, b] = min(way[a, b], n)
    np.fill_diagonal(way, 0)
    for k in range(14):
        way = np.minimum(way, way[:, k : k + 1] + way[k : k + 1])
    want = {(i, n + max(x for x in way[:, a] if x < np.inf)) for i, a, _, n in rows}
    assert {tuple(r) for r in network.upstream_distance(spark.createDataFrame(rows, "id long, src long, dst long, length double")).collect()} == want


def test_gradient_classes(spark):
    """More than 10,000 classes, gaps, and classes that overlap: the first by place counts."""
    many = spark.range(10_001).select(F.col("id").cast("double").alias("low"), (F.col("id") + 1).cast("double").alias("high"), F.col("id").cast("double").alias("gradient"))
    rows = spark.createDataFrame([(0.5,), (10_000.5,), (10_001.0,), (-1.0,), (None,)], "distance double")
    assert {r["distance"]: r["gradient"] for r in network.gradient_of(rows, many).collect()} == {0.5: 0.0, 10_000.5: 10_000.0, 10_001.0: None, -1.0: None, None: None}
    draw = np.random.default_rng(6)
    classes = [(i, float(a), float(a + n), float(i)) for i, (a, n) in enumerate(zip(draw.integers(0, 50, 30), draw.integers(1, 9, 30), strict=True))]
    table = spark.createDataFrame(classes, "place int, low double, high double, gradient double")
    asked = spark.createDataFrame([(x / 2,) for x in range(130)], "distance double")
    for r in network.gradient_of(asked, table).collect():
        assert r["gradient"] == next((g for _, a, b, g in classes if a <= r["distance"] < b), None)
    assert all(r["gradient"] is None for r in network.gradient_of(asked, table.limit(0)).collect())


def test_as_of_and_within(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("a", None, 4), (None, 5, 5)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 2, "z"), ("b", 10, "w"), ("a", None, "n")], "k string, t int, v string")
    assert {(r["id"], r["v"]) for r in joins.as_of(left, right, "k", "t", "v").collect()} == {(1, "y"), (2, None), (3, None), (4, None), (5, None)}
    points = spark.createDataFrame([(x / 4,) for x in range(-20, 60)], "at double")
    spans = spark.createDataFrame([(1, -3.0, 4.0), (2, 4.0, 4.0), (3, 3.9, 12.5), (4, None, 1.0)], "s int, low double, high double")
    want = {(x / 4, s) for x in range(-20, 60) for s, a, b in ((1, -3.0, 4.0), (3, 3.9, 12.5)) if a <= x / 4 < b}
    assert {(r["at"], r["s"]) for r in joins.within(points, spans, "at", "low", "high", 2.0).collect()} == want


def swept(rows, max_drop, angle=None, sweeps=5000):
    """Pipe by pipe in the order of id, until nothing moves: (id, src, dst, start, end, x0, y0, x1, y1)."""
    level = {r[0]: [r[3], r[4]] for r in rows}
    meets = [(i, j) for i in sorted(rows) for j in sorted(rows) if i[2] == j[1] and i[0] != j[0] and i[1] != i[2] and j[1] != j[2]]
    for _ in range(sweeps):
        moved = False
        for i, j in meets:
            (_, end), (start, _) = level[i[0]], level[j[0]]
            back, on = (i[5] - i[7], i[6] - i[8]), (j[7] - i[7], j[8] - i[8])
            bent = angle is not None and abs(math.degrees(math.atan2(back[0] * on[1] - back[1] * on[0], back[0] * on[0] + back[1] * on[1]))) > angle
            if start > end + 1e-7:
                k, by = j, start - end
            elif end - start - (0 if bent else max_drop) > 1e-7:
                k, by = i, end - start - (0 if bent else max_drop)
            else:
                continue
            level[k[0]] = [level[k[0]][0] - by, level[k[0]][1] - by]
            moved = True
        if not moved:
            return level
    return None


def drawn_pipes(kind, seed):
    draw = np.random.default_rng(seed)
    n = 40
    ends = {"tree": [(i, i // 2) for i in range(1, n)], "chain": [(i, i + 1) for i in range(n)], "star": [(i, 0) for i in range(1, 20)] + [(0, 100 + i) for i in range(15)], "web": [(i, int(j)) for i in range(1, 14) for j in draw.choice(i, min(i, 2), False)]}[kind]
    ids = draw.permutation(len(ends))
    rows = [(int(k), a, b, float(s), float(s) - (0.0 if kind == "web" else float(f)), *map(float, draw.integers(0, 9, 4))) for k, (a, b), s, f in zip(ids, ends, draw.integers(-300, 300, len(ends)) / 100, draw.integers(-10, 30, len(ends)) / 100, strict=True)]
    return rows + [(1000, 5, 5, 9.0, 1.0, 0.0, 0.0, 1.0, 1.0)]


PIPE = "id long, src long, dst long, invert_start double, invert_end double, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("kind,angle", [("tree", None), ("chain", None), ("star", None), ("web", None), ("tree", 100.0), ("chain", 60.0)])
def test_levels_settle_as_pipe_by_pipe(spark, kind, angle):
    rows = drawn_pipes(kind, len(kind))
    want = swept(rows, 0.5, angle)
    out = network.relax(spark.createDataFrame(rows, PIPE), 0.5, angle).collect()
    assert want is not None and len(out) == len(rows) and all(r["settled"] for r in out)
    for r in out:
        assert math.isclose(r["invert_start"], want[r["id"]][0], abs_tol=1e-5) and math.isclose(r["invert_end"], want[r["id"]][1], abs_tol=1e-5)


def test_levels_that_cannot_settle(spark):
    rows = [(1, 1, 2, 1.0, 0.5), (2, 2, 1, 1.0, 0.5), (3, 8, 9, 1.0, 0.5), (4, 9, 10, 2.0, 1.5), (5, 9, 11, None, 1.0)]
    out = {r["id"]: r for r in network.relax(spark.createDataFrame(rows, PIPE[: PIPE.index(", x0")]), 0.5, rounds=8).collect()}
    assert not out[1]["settled"] and not out[2]["settled"] and out[3]["settled"] and out[4]["settled"]
    assert math.isclose(out[4]["invert_start"], 0.5) and out[5]["invert_start"] is None and out[3]["invert_start"] == 1.0
    assert network.relax(spark.createDataFrame(rows, PIPE[: PIPE.index(", x0")]).limit(0), 0.5).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_ways_of_trees_forks_and_circles(spark, seed):
    draw = np.random.default_rng(seed)
    n = 18
    rows = [(k, int(a), int(b), float(w)) for k, (a, b, w) in enumerate(zip(draw.integers(0, n, n + 2 * seed), draw.integers(0, n, n + 2 * seed), draw.integers(1, 20, n + 2 * seed), strict=True))]
    way = np.full((n, n), np.inf)
    np.fill_diagonal(way, 0)
    for _, a, b, w in rows:
        way[a, b] = min(way[a, b], w)
    for k in range(n):
        way = np.minimum(way, way[:, [k]] + way[[k], :])
    far = np.where(np.isinf(way), 0, way).max(axis=0)
    got = network.upstream_distance(spark.createDataFrame(rows, "id long, src long, dst long, length double")).collect()
    assert {tuple(r) for r in got} == {(k, w + far[a]) for k, a, _, w in rows}


def test_rounds_of_a_long_chain(spark):
    chain = spark.range(3000).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("length"))
    got = network.upstream_distance(chain)
    assert got.where("distance <> id + 1").count() == 0 and got.count() == 3000


def test_rasters(spark):
    grid = raster.Grid(0.0, 30.0, 10.0)
    pixels = spark.createDataFrame([(r, c, float(r * 3 + c)) for r in range(3) for c in range(3)], "row int, col int, value double")
    assert raster.read_window(pixels, grid, (0, 10, 20, 30)).count() == 4
    padded = {(r["row"], r["col"]): r["value"] for r in raster.read_window(pixels, grid, (-10, 20, 10, 30), pad=True).collect()}
    assert padded == {(0, -1): raster.NODATA, (0, 0): 0.0}
    with pytest.raises(ValueError):
        raster.read_window(pixels, grid, (5, 5, 5, 5))
    assert grid.aligned((1, 1, 19, 29)) == (0, 0, 20, 30)
    uneven = {(r["row"], r["col"]): r["value"] for r in raster.blocks(pixels).collect()}
    assert uneven == {(0, 0): 2.0, (0, 1): 3.5, (1, 0): 6.5, (1, 1): 8.0}
    with_hole = pixels.withColumn("value", F.when(F.col("value") == 4, raster.NODATA).otherwise(F.col("value")))
    assert raster.merge([with_hole, pixels.where("value = 4").withColumn("value", F.lit(9.0))]).where("row = 1 and col = 1").first()["value"] == 9.0
    point = spark.createDataFrame([(1, 15.0, 15.0)], "id int, x double, y double")
    assert raster.zonal_min(point, pixels, grid, 10.0).first()["lowest"] == 1.0
    line = spark.createDataFrame([(1, [{"x": 0.0, "y": 15.0}, {"x": 30.0, "y": 15.0}])], "id int, points array<struct<x: double, y: double>>")
    assert sampling.crest_level(line, pixels, grid).first()["level"] == 4.0
    assert sampling.crest_level(line, pixels, grid, 10.0).first()["level"] == 7.0
    assert sampling.breach_depth(line, pixels, grid, 10.0).first()["depth"] == 3.0


def test_runs(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.5, 3.0, 2.5, None, 0.0])], "g string, i int, v double")
    got = [r["run"] for r in lines.range_runs(rows, "g", "i", "v", 1.0).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 1, 2]
    assert lines.range_runs(rows.limit(0), "g", "i", "v", 1.0).count() == 0


def plain_runs(values, most):
    run, low, high, out = 0, None, None, []
    for v in values:
        if v is not None:
            if low is None:
                low = high = v
            elif max(high, v) - min(low, v) > most:
                run, low, high = run + 1, v, v
            low, high = min(low, v), max(high, v)
        out.append(run)
    return out


def test_transitions_of_slices():
    draw = np.random.default_rng(5)
    for kind in range(60):
        n, most = int(draw.integers(1, 60)), float(draw.integers(0, 12))
        v = (np.cumsum(draw.integers(-3, 4, n)) if kind % 3 else draw.integers(0, 20, n)).astype(float)
        cut = sorted(draw.integers(0, n + 1, 3).tolist())
        run, low, high = 0, np.inf, -np.inf
        for a, b in zip([0, *cut], [*cut, n], strict=True):
            more, low, high = lines.Transition.of(v[a:b], most)(low, high, most)
            run += more
        want = plain_runs(v.tolist(), most)
        last = [x for x, r in zip(v, want, strict=True) if r == want[-1]]
        assert (run, low, high) == (want[-1], min(last), max(last))


def test_chains_over_many_slices(spark):
    draw = np.random.default_rng(6)
    rows = []
    for group, n in (("long", 3000), ("other", 500), ("short", 20), (None, 300), ("flat", 400)):
        values = [None if x < 0.05 else float(y) for x, y in zip(draw.random(n), np.round(np.cumsum(draw.normal(0, 1, n)), 2) * (group != "flat"), strict=True)]
        rows += [(group, i, v, r, "x") for i, (v, r) in enumerate(zip(values, plain_runs(values, 3.0), strict=True))]
    df = spark.createDataFrame(rows, "g string, i int, v double, want int, more string").repartition(5)
    got = lines.range_runs(df, "g", "i", "v", 3.0, slice_rows=100)
    assert got.columns == ["g", "i", "v", "want", "more", "run"] and got.count() == len(rows)
    assert got.where("run <> want").count() == 0


def test_rounds_of_a_network_are_not_broadcast(spark, monkeypatch):
    plans, write = [], network.Scratch.write
    monkeypatch.setattr(network.Scratch, "write", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df))
    pipes = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 3, 5.0), (3, 2, 3, 1.0), (4, 3, 4, 2.0)], "id long, src long, dst long, length double")
    assert {tuple(r) for r in network.upstream_distance(pipes).collect()} == {(1, 1.0), (2, 5.0), (3, 2.0), (4, 4.0)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_points_of_one_step_are_dealt_to_several_tasks(spark):
    points = spark.range(400).select("id", (F.col("id") % 4).cast("double").alias("at"))
    spans = spark.range(50).select(F.col("id").alias("s"), F.lit(1.0).alias("low"), F.lit(3.0).alias("high"))
    got = joins.within(points, spans, "at", "low", "high", 100.0)
    assert got.count() == 200 * 50 and got.distinct().count() == 200 * 50
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4  # once one task


def test_short_slices_share_tasks(spark, monkeypatch):
    rows = [("g", i, float(i * 37 % 11)) for i in range(4000)]
    df, asked = spark.createDataFrame(rows, "g string, i int, v double"), []
    plain = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *cols: asked.append(n) or plain(self, n, *cols))
    got = lines.range_runs(df, "g", "i", "v", 5.0, slice_rows=5).orderBy("i").collect()
    assert [r["run"] for r in got] == list(plain_runs([v for _, _, v in rows], 5.0))
    assert asked and max(asked) <= 4 * spark.sparkContext.defaultParallelism  # once a task for each of 801 slices


def test_adjacent_levees(spark):
    rows = [(1, 0.0, 0.0, 1.0, 0.0, 5.0), (2, 1.00005, 0.0, 2.0, 0.0, 5.2), (3, 2.0, 0.0, 3.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double, height double")
    assert {tuple(r) for r in lines.adjacent(df).collect()} == {(1, 2), (2, 3)}
    assert {tuple(r) for r in lines.adjacent(df, height=1.0).collect()} == {(1, 2)}


def test_scenarios(spark):
    text = '{"name": "S", "uuid": "u", "result_set": [{"result_type": {"code": "c", "name": "N"}, "attachment_url": null, "raster": {"temporal": true, "first_value_timestamp": 0, "last_value_timestamp": 9000000}}]}'
    rows = readers.scenarios(spark.createDataFrame([(text,), ("broken",), (None,)], "value string"))
    assert rows.count() == 3 and rows.where("name = 'S'").select(scenario.attachments(F.col("result_set")).alias("a")).first()["a"] is None
    assert [r["step"] for r in scenario.steps(scenario.rasters(rows), 2.0).orderBy("ms").collect()] == ["1970-01-01T00:00:00", "1970-01-01T02:00:00", "1970-01-01T02:30:00"]
    with pytest.raises(ValueError):
        readers.require(rows, "name", "nope")


def test_series_file(spark, tmp_path):
    readers.write_series_csv(spark.createDataFrame([(60.0, 1.5, None), (0.0, 0.25, 2.0)], "t double, a double, b double"), str(tmp_path / "s"))
    lines_ = spark.read.csv(str(tmp_path / "s"), header=True).orderBy("timestep").collect()
    assert [tuple(x) for x in lines_] == [("0", "0.250000", "2.000000"), ("60", "1.500000", "null")] or lines_[0][1] == "0.250000"


def test_places_around_points_are_not_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("id", "double(id % 40) as x", "double(id div 40) as y").write.parquet(str(tmp_path / "points"))
    pixels = spark.range(1600).selectExpr("int(id div 40) as row", "int(id % 40) as col", "double(id % 7) as value").groupBy("row", "col").agg(F.min("value").alias("value"))
    found = raster.zonal_min(spark.read.parquet(str(tmp_path / "points")), pixels, raster.Grid(0.0, 40.0, 1.0), 2.0)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1000


def test_rows_of_a_small_file_use_all_cores(spark, tmp_path):
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    point = lambda x, y: F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y"), F.lit(0.0).alias("z"))
    spark.range(200).select("id", F.array(point(0, 0), point(5, 1), point(9, 0)).alias("points")).coalesce(1).write.parquet(str(tmp_path / "channels"))
    channels = spark.read.parquet(str(tmp_path / "channels"))
    assert parts(channels) == 1
    for made in (xsec.mesh(channels, [-1.0, 0.0, 1.0]), xsec.in_order(xsec.mesh(channels, [-1.0, 0.0, 1.0])), xsec.valid_parts(channels, [-1.0, 1.0])):
        assert parts(made) >= spark.sparkContext.defaultParallelism
    texts = channels.select("id", F.lit(7).alias("shape"), F.lit(0.0).alias("reference"), F.lit("0,1\n1,0\n2,1").alias("text"))
    assert parts(sections.read_sections(texts)) >= spark.sparkContext.defaultParallelism


def test_thalweg_is_told_once_for_all_points(spark):
    rows = spark.range(1).select(F.sequence(F.lit(0), F.lit(1999)).cast("array<double>").alias("y"), F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.abs(i - 1000).cast("double")).alias("z"))
    begun = time.time()
    assert rows.select(xsec.offsets_of(F.col("y"), F.col("z")).alias("o")).first()["o"][:2] == [-1000.0, -999.0]
    assert time.time() - begun < 20


def test_more_of_rasters(spark):
    grid = raster.Grid(0.0, 30.0, 10.0)
    pixels = raster.blank(spark, grid, (0, 0, 30, 30), 1.0)
    assert pixels.count() == 9 and raster.bounds(3, 3, grid) == (0.0, 0.0, 30.0, 30.0)
    active = {(r["row"], r["col"]) for r in raster.masked(pixels, grid, [(0.0, 0.0), (30.0, 0.0), (0.0, 30.0)]).where("active").collect()}
    assert {(1, 0), (2, 0), (2, 1)} <= active and (0, 2) not in active and (0, 1) not in active
    points = raster.to_points(pixels.withColumn("value", F.when(F.col("row") == 0, raster.NODATA).otherwise(2.0)), grid, "value")
    assert points.count() == 6 and points.agg(F.max("y")).first()[0] == 15.0
    assert raster.to_boxes(pixels.limit(1), grid, "value").first()["wkt"].startswith("POLYGON ((")
    assert raster.pixel_size(0.5, -0.5) == 0.5 and raster.pixel_size(0.5, 1.0, 2.0) == 2.0
    with pytest.raises(ValueError):
        raster.pixel_size(0.5, 1.0)


def test_merged_levees(spark):
    rows = [(1, "a", 0.0, 0.0, 1.0, 0.0, 5.0), (2, "a", 1.0, 0.0, 2.0, 0.0, 5.4), (3, "a", 2.0, 0.0, 3.0, 0.0, 9.0), (4, "b", 3.0, 0.0, 4.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, f string, x0 double, y0 double, x1 double, y1 double, height double")
    got = {(r["f"], r["merged"], r["n"], round(r["mean"], 6)) for r in lines.merged_levees(df, "f", 0.5).collect()}
    assert got == {("a", 1, 2, 5.2), ("a", 3, 1, 9.0), ("b", 4, 1, 9.0)}
    assert lines.threshold_for(df, "f", 2, [0.1, 0.5, 4.0, 4.5, 10.0]) == 4.5 and lines.threshold_for(df, "f", 0, [1.0]) is None


def plain_levees(rows, threshold):
    """(first id, members) by the rule: rounds of all that touch and are less than the threshold from the lowest and the highest."""
    left, out = sorted(rows), []
    touch = lambda a, b: any(math.dist(p, q) <= 1e-4 for p in (a[2:4], a[4:6]) for q in (b[2:4], b[4:6]))
    while left:
        run = [left.pop(0)]
        while True:
            low, high = min(r[6] for r in run), max(r[6] for r in run)
            more = [r for r in left if r[1] == run[0][1] and abs(r[6] - low) < threshold and abs(r[6] - high) < threshold and any(touch(r, m) for m in run)]
            if not more:
                break
            run += more
            left = [r for r in left if r not in more]
        out.append((run[0][0], sorted(r[0] for r in run)))
    return out


def test_merged_levees_by_the_rule(spark):
    draw = np.random.default_rng(12)
    rows = [(int(k), "ab"[int(draw.integers(2))], *map(float, draw.integers(0, 4, 4)), float(draw.integers(0, 12)) / 4) for k in draw.permutation(70)]
    df = spark.createDataFrame(rows, "id long, f string, x0 double, y0 double, x1 double, y1 double, height double").repartition(3)
    for threshold in (0.25, 0.6, 1.1):
        want = {(first, len(ids)) for first, ids in plain_levees(rows, threshold)}
        assert {(r["merged"], r["n"]) for r in lines.merged_levees(df, "f", threshold).collect()} == want
    tries = [0.1, 0.3, 0.6, 1.1, 5.0]
    assert {tuple(r) for r in lines.merged_counts(df, "f", tries).collect()} == {(t, len(plain_levees(rows, t))) for t in tries}


def segments_of(draw, n, wide):
    """Long, short, upright, level and pointlike segments, many on corners of cells."""
    p = draw.integers(-8, 9, (n, 2)) * 25.0
    q = p + np.where(draw.random((n, 1)) < 0.2, 0.0, draw.normal(0, wide, (n, 2))) * draw.integers(0, 2, (n, 2))
    return np.hstack([p, np.round(q)])


def test_segments_meet_in_cells(spark):
    from hydroframe.operators.meeting import along, meetings

    draw = np.random.default_rng(31)
    one, two = segments_of(draw, 250, 60.0), segments_of(draw, 100, 90.0)
    frame = lambda rows, names: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], names)
    a, b = frame(one, "id long, x0 double, y0 double, x1 double, y1 double"), frame(two, "g long, gx0 double, gy0 double, gx1 double, gy1 double")
    crossing = G.crosses(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), tuple(map(F.col, ("gx0", "gy0", "gx1", "gy1"))))
    want = {tuple(r) for r in a.crossJoin(b).where(crossing).select("id", "g").collect()}
    assert len(want) > 150
    for most, few in ((10**9, 0), (200, 0), (20, 0), (20, 1000)):
        import hydroframe.operators.meeting as m

        before, m.FEW = m.FEW, few
        try:
            met = meetings(a, b, ("x0", "y0", "x1", "y1"), ("gx0", "gy0", "gx1", "gy1"), 50.0, most)
            assert {tuple(r) for r in met.where(crossing).select("id", "g").collect()} == want
        finally:
            m.FEW = before
    far = spark.createDataFrame([(0.0, 0.0, 100_000.0, 70_000.0), (5.0, 5.0, 5.0, 90_000.0), (3.0, 3.0, 3.0, 3.0)], "x0 double, y0 double, x1 double, y1 double")
    assert [r[0] for r in far.select(F.size(along(*far.columns, 50.0))).collect()] == pytest.approx([3500, 1800, 1], abs=110)


def test_components(spark):
    draw = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 80, (60, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(30)]
    part = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    from hydroframe.operators.graph import components

    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == {(k, v) for k, v in part.items() if k not in alone}


def test_more_of_channels(spark):
    line = np.array([(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)])
    moved = xsec.parallel(line, [(0.0, [-2.0, 0.0, 2.0], [3.0, 1.0, 3.0]), (20.0, [-2.0, 2.0], [5.0, 5.0])], 1.0)
    assert np.allclose(moved, [(0, 1, 2), (10, 1, 3.5), (20, 1, 5)])
    assert [xsec.width_at(p, [(10, 6), (0, 4)]) for p in (-1, 5, 20)] == [4, 5, 6]
    parts = xsec.split(np.arange(14).reshape(7, 2), 3)
    assert [len(p) for p in parts] == [3, 3, 3] and (parts[0][-1] == parts[1][0]).all()
    assert len(xsec.split_valid(line, [1.0, -1.0])) == 1
    order = xsec.ordered_triangles([(0, 1, 2), (5, 6, 7), (2, 3, 5), (1, 2, 3), (3, 5, 6)])
    for i, t in enumerate(order[1:], 1):
        assert any(len(set(t) & set(s)) == 2 for s in order[:i])
    ends = spark.createDataFrame([(1, 10, 10.0), (1, 11, 80.0), (2, 12, 0.0), (2, 13, 120.0), (2, 14, 240.0), (3, 15, 7.0)], "node int, channel int, azimuth double")
    assert [(r["node"], {r["first"], r["second"]}, r["gap"]) for r in xsec.wedges(ends).collect()] == [(1, {10, 11}, 290.0)]
    outwards = np.array([(1.0, 0, 0), (2, 0, 0), (3, 0, 0)])
    assert len(xsec.filled((0, 0, 0), outwards, outwards[:, [1, 0, 2]])) == 5
    with pytest.raises(xsec.NoTriangles):  # a side that runs around the way to the other one
        xsec.filled((0, 0, 0), np.eye(3), np.eye(3) + 1)
    mesh = xsec.mesh(spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0, "z": 1.0}, {"x": 9.0, "y": 0.0, "z": 3.0}])], "id int, points array<struct<x: double, y: double, z: double>>"), [0.0, 1.0])
    assert xsec.as_query(mesh).first()["sql"].count(" UNION ") == 1


def test_wedges_reach_all_points():
    first, second = np.array([(1.0, 0, 1), (2, 0, 2), (3, 0, 3), (5, 0, 4)]), np.array([(0, 1.0, 5), (0, 2, 6)])
    for a, b in ((first, second), (second, first)):
        triangles = xsec.filled((0, 0, 0), a, b)
        assert {tuple(map(float, q)) for t in triangles for q in t} == {(0.0, 0.0, 0.0), *(tuple(map(float, q)) for q in np.vstack([first, second]))}
        assert math.isclose(sum(abs(np.linalg.det(np.vstack([t[:, :2].T, [1, 1, 1]]))) / 2 for t in triangles), 5.0)


def test_more_of_geometry(spark):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in range(3)))
    assert one(spark, G.index_of(points, F.lit(1.0000001), F.lit(0.0))) == 1 and one(spark, G.index_of(points, F.lit(9.0), F.lit(0.0))) is None
    assert one(spark, G.vertex(points, -1)["x"]) == 2.0 and one(spark, G.polyline_length(points)) == 2.0
    assert one(spark, G.grows(F.array(*map(F.lit, (1, 1, 2))), False)) and not one(spark, G.grows(F.array(*map(F.lit, (1, 1, 2)))))
    assert G.wkb([(1.0, 2.0)], "point").hex() == "0101000000000000000000f03f0000000000000040"
    assert len(G.wkb([(0, 0), (1, 0), (0, 0)], "polygon")) == 13 + 48
    assert one(spark, G.ccw_turn(F.lit(10.0), F.lit(350.0))) == 20.0


def test_settings(spark, tmp_path):
    rows = readers.replaced_settings(spark.createDataFrame([(1,)], "id int"), readers.NUMERICAL)
    readers.write_settings(rows, str(tmp_path / "s"))
    assert readers.settings(spark, str(tmp_path / "s"), "id long, max_degree long").first()["max_degree"] == 5
    with pytest.raises(ValueError):
        readers.with_new_columns(rows, ["id"])
    assert readers.without(rows, "max_degree", F.lit(True)).first()["max_degree"] is None
    assert [c for c in readers.with_new_columns(rows, ["a"]).columns][-1] == "a"


def test_linear_interpolation_keeps_planes(spark):
    grid = raster.Grid(0.0, 40.0, 1.0)
    draw = np.random.default_rng(2)
    spots = [(float(x), float(y)) for x in range(0, 41, 8) for y in range(0, 41, 8)] + [tuple(map(float, p)) for p in draw.uniform(1, 39, (30, 2))]
    centres = spark.createDataFrame([(x, y, 2 * x - 3 * y + 1) for x, y in spots] + [(5.0, 5.0, None)], "x double, y double, value double")
    got = raster.interpolate_linear(centres, grid, tile=16, halo=12).collect()
    assert len(got) == 1600
    assert all(math.isclose(r["value"], 2 * (r["col"] + 0.5) - 3 * (40 - r["row"] - 0.5) + 1, abs_tol=1e-6) for r in got)


@pytest.mark.parametrize("kind", ["loose", "grid", "line", "circle", "dense"])
def test_triangles_with_empty_circles(kind):
    draw = np.random.default_rng(3)
    p = {
        "loose": draw.uniform(0, 100, (120, 2)), "grid": np.array([(x * 10.0, y * 10.0) for x in range(9) for y in range(8)]), "line": np.array([(x, 2.0 * x) for x in range(12)] + [(3.0, 40.0)]),
        "circle": np.array([(50 + 40 * math.cos(a), 50 + 40 * math.sin(a)) for a in np.linspace(0, 6, 17)] + [(50.0, 50.0)]), "dense": np.round(draw.normal(0, 3, (400, 2)), 1),
    }[kind]
    p = np.unique(p, axis=0)
    made = raster.delaunay(draw.permutation(p))
    again = raster.delaunay(p)
    assert len(set(made)) == len(made) == len(again)
    area = 0.0
    for t in again:
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        area += abs(d) / 4
        if abs(d) < 1e-9:
            continue
        b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        ux, uy = ((cy - ay) * b2 - (by - ay) * c2) / d, ((bx - ax) * c2 - (cx - ax) * b2) / d
        away = np.hypot(p[:, 0] - ax - ux, p[:, 1] - ay - uy)
        assert (away >= math.hypot(ux, uy) * (1 - 1e-5) - 1e-6).all()
    rim = raster.hull(p.tolist())
    whole = abs(sum(a * d - b * c for (a, b), (c, d) in zip(rim, rim[1:] + rim[:1], strict=True))) / 2
    assert math.isclose(area, whole, rel_tol=2e-3)


def test_many_triangles_in_time():
    p = np.random.default_rng(1).uniform(0, 1000, (20_000, 2))
    start = time.perf_counter()
    assert abs(len(raster.delaunay(p)) - 2 * len(p)) < 200 and time.perf_counter() - start < 30


def test_linear_interpolation_between_wide_cells(spark):
    grid = raster.Grid(0.0, 160.0, 1.0)
    draw = np.random.default_rng(5)
    spots = [(0.0, 0.0), (160.0, 0.0), (0.0, 160.0), (160.0, 160.0)] + [tuple(map(float, p)) for p in draw.uniform(10, 150, (5, 2))]
    centres = spark.createDataFrame([(x, y, float(draw.uniform())) for x, y in spots], "x double, y double, value double")
    got = {(r["row"], r["col"]): r["value"] for r in raster.interpolate_linear(centres, grid).collect()}
    whole = {(r["row"], r["col"]): r["value"] for r in raster.interpolate_linear(centres, grid, tile=160, halo=200).collect()}
    assert len(got) == 160 * 160 and got.keys() == whole.keys() and all(math.isclose(got[k], whole[k], abs_tol=1e-9) for k in got)


def test_lines_with_heights(spark):
    grid = raster.Grid(0.0, 30.0, 10.0)
    pixels = spark.createDataFrame([(r, c, float(r * 3 + c)) for r in range(3) for c in range(3)], "row int, col int, value double")
    line = spark.createDataFrame([(1, [{"x": 0.0, "y": 15.0}, {"x": 30.0, "y": 15.0}])], "id int, points array<struct<x: double, y: double>>")
    assert [(p["x"], p["z"]) for p in sampling.line_with_z(line, pixels, grid).first()["points"]] == [(5.0, 3.0), (15.0, 4.0), (25.0, 5.0)]
    points = spark.createDataFrame([(7, 1, 10.0, 17.0), (8, 1, 10.0, 19.0)], "pid int, id int, x double, y double")
    assert [r["pid"] for r in sampling.within_width(points, sampling.segments(line), [(0.0, 4.0), (20.0, 8.0)]).collect()] == [7]
    assert sampling.consecutive(spark.createDataFrame([(1, 2, 5.0, 0.0), (1, 1, 0.0, 0.0)], "id int, place int, x double, y double")).first()["x1"] == 5.0


def test_more_of_leaks(spark):
    assert leak.side_by_side(np.array([[1.0], [2.0]]), np.array([[5.0]])).tolist() == [[1, 5], [2, 5]]
    assert leak.edge_peaks([np.array([0, 1.0]), np.array([3.0, 0]), np.array([2.0, 0])], 0.5) == [(1, 0), (2, 0)]
    obstacles = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "id int, crest double")
    flows = spark.createDataFrame([(1, -9.0), (2, 1.0), (3, 9.0)], "id int, q double")
    series = spark.createDataFrame([(1, 3.0, 0.5, 2.0), (2, 3.0, 0.5, 2.0), (3, 3.0, 1.0, 2.0)], "id int, q double, factor double, dt double")
    assert [r["id"] for r in leak.significant(obstacles, flows, series, 5.0, 1.0).collect()] == [1]


def test_read_sections(spark):
    rows = spark.createDataFrame([(1, 6, 10.0, "0, 2\n1, 4"), (2, 6, 0.0, "nonsense"), (3, 99, 0.0, "0, 1"), (4, 7, 0.0, None)], "id int, shape int, reference double, text string")
    got = {r["id"]: r for r in sections.read_sections(rows).collect()}
    assert got[1]["y"] == [0, 1, 3, 4] and got[1]["z"] == [11, 10, 10, 11] and got[1]["error"] is None
    assert all(got[i]["error"] and got[i]["y"] is None for i in (2, 3, 4))


def test_obstacles_over_skewed_gaps(spark):
    """A ridge that comes along the left of the lower cell and goes on along the right of the upper one."""
    z = np.zeros((8, 6))
    z[3:, 1] = 5.0  # lower cell: rows 4 .. 7
    z[3, 1:5] = 4.0
    z[:4, 4] = 5.0
    z[3, 1] = z[3, 4] = 5.0
    pixels = spark.createDataFrame([(7, r, k, float(z[r, k])) for r in range(8) for k in range(6)], "pair long, row int, col int, z double")
    pairs = spark.createDataFrame([(7, 50, 1, 2, 3, 4), (8, 60, None, None, 5, 6)], "pair long, middle long, left_1 long, left_2 long, right_1 long, right_2 long")
    kind = "edge long, from_edge long, from_row int, from_col int, to_edge long, to_row int, to_col int"
    obstacles = spark.createDataFrame([(1, 9, 7, 1, 50, 3, 1), (4, 50, 3, 4, 9, 0, 4), (4, 9, 0, 0, 9, 1, 1), (2, 50, 3, 0, 9, 1, 1)], kind)
    ends = leak.ends_on(obstacles, pairs)
    assert {tuple(r) for r in ends.collect()} == {(7, "left", 1, 3, 1), (7, "right", 2, 3, 4), (7, "left", 2, 3, 0)}
    middle = spark.createDataFrame([(7, 50, 1.0), (8, 60, 0.0)], "pair long, edge long, level double")
    assert [tuple(r) for r in leak.connecting_obstacles(pixels, ends, middle, 2.0).collect()] == [(7, 50, 4.0, 3, 1, 3, 4)]
    assert leak.connecting_obstacles(pixels, ends, middle, 4.0).count() == 0
    assert leak.connecting_obstacles(pixels, ends.limit(0), middle, 2.0).count() == 0


def area(points, triangles):
    return sum(abs(np.linalg.det(np.vstack([points[list(t)][:, :2].T, [1, 1, 1]]))) / 2 for t in triangles)


def test_triangles_stay_between_the_lines():
    """Moved lines of winding channels: the triangles cover the strip once, whichever way one line runs."""
    draw = np.random.default_rng(12)
    done = 0
    for _ in range(120):
        turns = np.cumsum(draw.uniform(-0.9, 0.9, 12))
        line = np.cumsum(np.column_stack([np.cos(turns), np.sin(turns)]) * draw.uniform(1, 4, (12, 1)), axis=0)
        left, right = xsec.offset_line(line, 0.5), xsec.offset_line(line, -0.3)
        if not xsec.valid_offset(line, 0.5) or not xsec.valid_offset(line, -0.3) or xsec.meet(left, right):
            continue
        ring = np.vstack([left, right[::-1]])
        x, y = ring.T
        strip = abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2
        for other in (right, right[::-1]):
            assert math.isclose(area(np.vstack([left, other]), xsec.between(left, other)), strip, rel_tol=1e-9)
        done += 1
    assert done > 60


def test_lines_without_triangles(spark):
    left, right = np.array([(0.0, 0.0), (4.0, 0.0)]), np.array([(2.0, -1.0), (2.0, 1.0)])
    for a, b in ((left, right), (left, left), (left[:0], right), (left, left + [2.0, 0.0])):
        with pytest.raises(xsec.NoTriangles):
            xsec.between(a, b)
    assert xsec.between(left, np.array([(2.0, 1.0)])) == [(0, 1, 2)] and xsec.between(left[:1], right[:1]) == []
    bay = np.array([(0.0, 1.0), (4.0, 1.0), (4.0, 9.0), (5.0, 9.0), (5.0, 1.0), (9.0, 1.0)])
    flat = np.array([(0.0, 0.0), (9.0, 0.0)])
    for t in xsec.between(bay, flat):
        p = np.vstack([bay, flat])[list(t)]
        assert not any(xsec.cuts(p[i], p[i - 1], line) for i in range(3) for line in (bay, flat)) or len({i for i in t if i < 6}) == 2
    kind = "id int, points array<struct<x: double, y: double, z: double>>, extra int"
    point = lambda x, y: {"x": x, "y": y, "z": 0.0}
    rows = [(1, [point(0.0, 0.0), point(9.0, 0.0)], 5), (2, [point(0.0, 0.0)], 5), (3, None, 5), (4, [point(1.0, 1.0), point(1.0, 1.0)], 5), (5, [], 5), (6, [point(0.0, None), point(9.0, 0.0)], 5)]
    channels = spark.createDataFrame(rows, kind)
    assert {r["id"] for r in xsec.mesh(channels, [0.0, 1.0]).collect()} == {1}
    assert {r["id"] for r in xsec.mesh_errors(channels, [0.0, 1.0]).collect()} == {2, 3, 4, 5, 6}
    assert xsec.mesh(channels.limit(0), [0.0, 1.0]).count() == 0 and xsec.mesh(channels, [1.0]).count() == 0


def test_wedges_at_nodes(spark):
    kind = "id long, start_node long, end_node long, points array<struct<x: double, y: double, z: double>>, distances array<double>"
    point = lambda x, y: {"x": x, "y": y, "z": 1.0}
    rows = [(1, 7, 8, [point(0.0, 0.0), point(0.0, 9.0)], [-2.0, 0.0, 2.0, 1.0]), (2, 9, 7, [point(9.0, 0.0), point(0.0, 0.0)], [-1.0, 0.0, 1.0])]
    got = xsec.wedge_mesh(spark.createDataFrame(rows, kind)).collect()
    assert {(r["node"], r["channel"]) for r in got} == {(7, 2)}
    corners = {(round(r[f"x{i}"], 6), round(r[f"y{i}"], 6)) for r in got for i in (1, 2, 3)}
    assert corners == {(0.0, 0.0), (0.0, -1.0), (-1.0, 0.0), (-2.0, 0.0)}
    rest = [(3, None, 5, rows[0][3], None), (4, 5, 5, None, None)]
    bare = spark.createDataFrame([rows[0], (2, 9, 7, rows[1][3], [0.0]), *rest], kind)
    assert xsec.wedge_mesh(bare).count() == 1 and xsec.wedge_errors(bare).count() == 0
    bare = spark.createDataFrame([(1, 7, 8, rows[0][3], None), rows[1], *rest], kind)
    assert [tuple(r) for r in xsec.wedge_errors(bare).collect()] == [(7, 1, 2, "a side has no points")] and xsec.wedge_mesh(bare).count() == 0
    assert xsec.wedge_mesh(spark.createDataFrame(rows, kind).limit(0)).count() == 0


def test_lines_of_channels(spark):
    kind = "id int, points array<struct<x: double, y: double, z: double>>, keep array<int>"
    point = lambda x, y, z=0.0: {"x": float(x), "y": float(y), "z": float(z)}
    straight = [point(x, 0.0, x) for x in range(5)]
    rows = [(1, straight, [2]), (2, straight, None), (3, straight[:1], [0]), (4, None, None), (5, [straight[0], straight[0], straight[1]], [7])]
    lines = spark.createDataFrame(rows, kind)
    got = {r["id"]: [(p["x"], p["z"]) for p in r["points"]] for r in xsec.simplified_lines(lines, 0.1).collect()}
    assert got == {1: [(0, 0), (2, 2), (4, 4)], 2: [(0, 0), (4, 4)], 5: [(0, 0), (1, 1)]}
    bend = [point(math.cos(a), math.sin(a)) for a in np.linspace(0, math.pi, 24)]
    arcs = spark.createDataFrame([(1, [point(-9, -9)] + bend, None), (2, straight, None)], kind)
    parts = {}
    for r in sorted(xsec.valid_parts(arcs, [1.2]).collect(), key=lambda r: (r["id"], r["part"])):
        p = np.array([(q["x"], q["y"]) for q in r["points"]])
        assert len(p) == 2 or xsec.valid_offset(p, 1.2)
        parts.setdefault(r["id"], []).append(p)
    assert len(parts[2]) == 1 and len(parts[1]) > 1
    for n, m in zip(parts[1], parts[1][1:], strict=False):
        assert n[-1].tolist() == m[0].tolist()
    sections = spark.createDataFrame([(1, 0.0, [-1.0, 1.0], [0.0, 2.0]), (1, 4.0, [-1.0, 1.0], [4.0, 6.0]), (2, None, [0.0], [0.0]), (3, 0.0, [0.0], [0.0])], "id int, position double, offsets array<double>, z array<double>")
    moved = xsec.parallels(lines, sections, [-1.0, 0.5]).collect()
    assert {(r["id"], r["distance"]): [(p["x"], p["y"], p["z"]) for p in r["points"]] for r in moved} == {(1, d): [(x, d, x + d + 1) for x in range(5)] for d in (-1.0, 0.5)}
    mesh = xsec.mesh(lines, [-2.0, 0.0, 1.0])
    seen: dict = {}
    for r in sorted(xsec.in_order(mesh).collect(), key=lambda r: (r["id"], r["place"])):
        corners = [(round(r[f"x{i}"], 6), round(r[f"y{i}"], 6)) for i in (1, 2, 3)]
        sides = {frozenset(s) for s in ((corners[0], corners[1]), (corners[1], corners[2]), (corners[0], corners[2]))}
        assert r["place"] == 0 or sides & seen[r["id"]]
        seen.setdefault(r["id"], set()).update(sides)
    assert set(seen) >= {1, 2} and xsec.in_order(mesh.limit(0)).count() == 0
