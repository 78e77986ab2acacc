"""Leak detection as a whole, against a plain version that floods pixels level by level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.operators import detect, leak
from hydroframe.operators.raster import NODATA, Grid

SIZE, HEIGHT, FINE = 4, 1.0, 0.1
BOX = "id long, xmin double, ymin double, xmax double, ymax double"
FLOW = "id long, start_id long, end_id long, fx0 double, fy0 double, fx1 double, fy1 double"


def flooded(z, start, level):
    seen, todo = set(), [start] if z.get(start, -np.inf) >= level else []
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [q for q in ((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if z.get(q, -np.inf) >= level]
    return seen


def linked(z, start, end):
    return max((v for v in set(z.values()) if end in flooded(z, start, v)), default=-np.inf)


def test_ridges_of_all_pairs():
    draw = np.random.default_rng(8)
    for _ in range(30):
        z = draw.integers(0, 9, draw.integers(2, 7, 2)).astype(float)
        z[draw.random(z.shape) < 0.15] = -np.inf
        every = [(r, c) for r in range(z.shape[0]) for c in range(z.shape[1])]
        held = {p: z[p] for p in every if z[p] > -np.inf}
        starts, ends = ([every[i] for i in draw.integers(0, len(every), 5)] for _ in "ab")
        assert leak.ridges(z, starts, ends).tolist() == [[linked(held, a, b) for b in ends] for a in starts]
    assert leak.ridges(z, [], []).shape == (0, 0)


def test_plateaus_are_no_obstacles():
    wall, terrace = np.zeros((6, 5)), np.zeros((6, 5))
    wall[3], terrace[3:] = 5.0, 4.5
    terrace[3] = 5.0
    assert leak.obstacles_of_pair(wall, 0.0, 1.0, 0.1) == [(3, 3, 5.0)]
    assert leak.obstacles_of_pair(terrace, 0.0, 0.4, 0.04) == [(3, 3, 5.0)]
    assert leak.obstacles_of_pair(terrace, 0.0, 0.5, 0.04) == []


def grid_of(spark, z, boxes):
    """cells, pixels and flowlines of boxes (top, left, size) in pixels of 1 m; rows count from y = 100."""
    cells = [(i, float(k), float(100 - t - n), float(k + n), float(100 - t)) for i, (t, k, n) in enumerate(boxes)]
    flows = []
    for i, a in enumerate(cells):
        for j, b in enumerate(cells):
            beside = a[3] == b[1] and min(a[4], b[4]) > max(a[2], b[2])
            over = a[4] == b[2] and min(a[3], b[3]) > max(a[1], b[1])
            if beside or over:
                flows.append((len(flows), i, j, (a[1] + a[3]) / 2, (a[2] + a[4]) / 2, (b[1] + b[3]) / 2, (b[2] + b[4]) / 2))
    pixels = [(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(cells, BOX), spark.createDataFrame(pixels, "row int, col int, value double"), spark.createDataFrame(flows, FLOW), cells, flows


def plain(z, boxes, flows):
    """{edge: (level, crest)} of cells of one size: every rule again, by loops."""
    n = boxes[0][2]
    spot = [{(t + r, k + q): z[t + r, k + q] for r in range(n) for q in range(n)} for t, k, _ in boxes]
    top = [boxes[a][0] != boxes[b][0] for _, a, b, *_ in flows]
    level, side = {}, {}
    for (e, a, b, *_), up in zip(flows, top, strict=True):
        (t, k, _), (u, m, _) = boxes[a], boxes[b]
        level[e] = min(max(z[t, k + i], z[u + n - 1, k + i]) if up else max(z[t + i, k + n - 1], z[t + i, m]) for i in range(n))
        side[a, "top" if up else "right"] = side[b, "bottom" if up else "left"] = e

    def segment(p):
        return p[1] + 0.5, 100 - p[0] - 0.5

    def turn(o, p, q):
        return np.sign((p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0]))

    met = {e: [] for e in level}
    for (e, a, b, *_), up in zip(flows, top, strict=True):
        order = [b, a] if up else [a, b]
        lowest = min(level[x] for x in (e, side.get((a, "bottom" if up else "left")), side.get((b, "top" if up else "right"))) if x is not None)
        bound = lowest + HEIGHT - FINE

        def tops(far, order=order, up=up, bound=bound):
            line = [(boxes[i][0] + j, boxes[i][1] + (n - 1) * far) if up else (boxes[i][0] + (n - 1) * far, boxes[i][1] + j) for i in order for j in range(n)]
            return [(order[p // n], line[p]) for p in leak.peaks(np.array([z[q] for q in line]), HEIGHT) if z[line[p]] > bound]

        for i, p in tops(0):
            for j, q in tops(1):
                held = spot[i] if i == j else spot[a] | spot[b]
                crest = linked(held, p, q)
                if not crest > bound:
                    continue
                part = flooded(held, p, crest - HEIGHT)
                at = 0 if up else 1
                low, high = min(x[at] for x in held), max(x[at] for x in held)
                if any(all(x in part for x in held if x[at] == end) for end in (low, high)):
                    continue
                from_edge, to_edge = side.get((i, "left" if up else "top")), side.get((j, "right" if up else "bottom"))
                for f, g, h, *line in flows:
                    one, two, x, y = line[:2], line[2:], segment(p), segment(q)
                    crossing = turn(x, y, one) * turn(x, y, two) <= 0 and turn(one, two, x) * turn(one, two, y) <= 0 and (turn(x, y, one), turn(x, y, two)) != (0, 0)
                    if {g, h} & {a, b} and f not in (from_edge, to_edge) and crossing and crest > level[f] + HEIGHT - FINE:
                        met[f].append((crest, from_edge, p, to_edge, q))
    closing = {e: [] for e in level}
    for (e, a, b, *_), up in zip(flows, top, strict=True):
        left, right = ("left", "right") if up else ("top", "bottom")
        for one, two in ((a, b), (b, a)):
            stands = [[(f_at if f == e else t_at) for _, f, f_at, t, t_at in met.get(side.get((cell, s)), ()) if e in (f, t)] for cell, s in ((one, left), (two, right))]
            for p in stands[0]:
                for q in stands[1]:
                    crest = linked(spot[a] | spot[b], p, q)
                    if crest > level[e] + HEIGHT - FINE:
                        closing[e].append(crest)
    return {e: (level[e], max([m[0] for m in met[e]] + closing[e])) for e in level if met[e] or closing[e]}


@pytest.mark.parametrize("seed", [1, 2])
def test_both_passes_by_loops(spark, seed):
    draw = np.random.default_rng(seed)
    boxes = [(t, k, SIZE) for t in range(0, 3 * SIZE, SIZE) for k in range(0, 4 * SIZE, SIZE)]
    z = draw.integers(0, 4, (3 * SIZE, 4 * SIZE)).astype(float)
    for _ in range(4):  # walls with a step in them
        at, turn = int(draw.integers(1, 11)), int(draw.integers(2, 14))
        z[at, :turn] += 6
        z[max(0, at - 1), turn - 1 :] += 6
    at = int(draw.integers(1, 14))
    z[:6, at], z[5:, at + 1] = 9, 9
    cells, pixels, flowlines, _, flows = grid_of(spark, z, boxes)
    got = {r["edge"]: (r["level"], r["crest"]) for r in detect.detect(cells, pixels, flowlines, Grid(0.0, 100.0, 1.0), HEIGHT, FINE).collect()}
    want = plain(z, boxes, flows)
    assert got == want and want


def test_cells_of_two_sizes_and_missing_data(spark):
    """Walls through a large cell and a small one beside it; pixels without data, and a cell that has none at all."""
    boxes = [(0, 0, 8), (0, 8, 4), (4, 8, 4), (8, 0, 8), (8, 8, 8)]
    z = np.zeros((16, 16))
    z[5, :8] = z[2, 8:12] = 5.0
    z[5, 5] = NODATA
    z[8:, 8:] = NODATA
    cells, pixels, flowlines, _, flows = grid_of(spark, z, boxes)
    extra = cells.unionByName(spark.createDataFrame([(None, 0.0, 0.0, 1.0, 1.0)], BOX)).withColumn("z", F.lit(1))
    broken = flowlines.unionByName(spark.createDataFrame([(99, 0, None, 0.0, 0.0, 1.0, 1.0)], FLOW))
    run = lambda c, p, f, **more: detect.detect(c, p, f, Grid(0.0, 100.0, 1.0), HEIGHT, FINE, **more)
    got = {r["edge"]: (r["level"], r["crest"], r["y0"]) for r in run(extra, pixels, broken, as_obstacle=True).collect()}
    ends = {(a, b): e for e, a, b, *_ in flows}
    assert got == {ends[3, 0]: (0.0, 5.0, 94.5), ends[2, 1]: (0.0, 5.0, 97.5)}
    own = {r["edge"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in run(cells, pixels, flowlines).collect()}
    assert own == {ends[3, 0]: (0.0, 92.0, 8.0, 92.0), ends[2, 1]: (8.0, 96.0, 12.0, 96.0)}
    known = spark.createDataFrame([(ends[3, 0], 4.5), (ends[3, 0], 1.0)], "edge long, crest double")
    assert {r["edge"] for r in run(cells, pixels, flowlines, known=known).collect()} == {ends[2, 1]}
    assert run(cells.limit(0), pixels.limit(0), flowlines.limit(0)).count() == 0
