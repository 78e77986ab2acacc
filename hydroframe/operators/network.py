"""Pipe networks: distances upstream, gradients by distance, invert levels and their relaxation."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import geometry as G
from hydroframe.sources.scratch import Scratch

#: Rounds of settling at most; with ways of 2, 4, ... pipes, trees of any depth need fewer.
ROUNDS = 100
#: A level is lower if it is so by more than this.
EXACT = 1e-9
#: Classes of a gradient table at most; it is broadcast.
MOST_CLASSES = 1_000_000


def _met(one: DataFrame, two: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles: rounds of joins that Spark broadcasts, each below its threshold, pass most of the network through the driver."""
    return one.join(two.hint("merge"), on, how)


def _forest(free: DataFrame, n: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Ways of 1, 2, 4, ... pipes (node, to, way) over nodes that one pipe leaves (the same columns), and the longest of them if they run in circles.

    A way of 2 ** (k + 1) pipes joins two of 2 ** k, so there are as many steps as the depth
    has binary digits; ways of more pipes than there are run around a circle.
    """
    ways, now = [], scratch.write(free)
    while now.limit(1).count():
        ways.append(now)
        if 1 << (len(ways) - 1) > n:
            break
        on = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("way").alias("_way"))
        now = scratch.write(_met(now, on, "to").select("node", F.col("_to").alias("to"), (F.col("way") + F.col("_way")).alias("way")))
    return ways, now


def _trees(ways: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(node, far): the longest way to each node over nodes that one pipe leaves; nodes without such a way are left out."""
    far = None
    for way in ways:
        before = F.lit(0.0)
        if far is not None:
            way, before = _met(way, far, "node", "left"), F.coalesce("far", F.lit(0.0))
        grown = way.select(F.col("to").alias("node"), (F.col("way") + before).alias("far"))
        far = scratch.write((grown if far is None else grown.unionByName(far)).groupBy("node").agg(F.max("far").alias("far")))
    return far


def _ends(ways: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(node, end): where the forced way of each node ends."""
    at = ways[0].select("node", F.col("to").alias("end"))
    for way in reversed(ways):  # by the binary digits of the way's length, the greatest first
        at = scratch.write(_met(at, way.select(F.col("node").alias("end"), "to"), "end", "left").select("node", F.coalesce("to", "end").alias("end")))
    return at


def _pairs(steps: DataFrame, sources: DataFrame, ways: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(source, node, way): the shortest way from each source to every other node.

    Every round, only what became shorter is handed on, along pipes and along ways of
    2, 4, ... pipes; so rounds grow with the forks on a way, and the logarithm of what lies between.
    """
    edges = steps
    for way in ways[1:]:
        edges = edges.unionByName(way)
    edges = scratch.write(edges)
    best = _met(steps, sources.select(F.col("source").alias("node")), "node").select(F.col("node").alias("source"), F.col("to").alias("node"), "way", F.lit(True).alias("grew"))
    best = scratch.write(best)
    while best.where("grew").limit(1).count():
        handed = _met(best.where("grew").select("source", "node", F.col("way").alias("_way")), edges, "node").where("source <> to")
        handed = handed.groupBy("source", F.col("to").alias("node")).agg(F.min(F.col("_way") + F.col("way")).alias("new"))
        shorter = F.col("new") < F.coalesce("way", F.lit(float("inf")))
        merged = _met(best.drop("grew"), handed, ["source", "node"], "full").select("source", "node", F.least("way", "new").alias("way"), F.coalesce(shorter, F.lit(False)).alias("grew"))
        last, best = best, scratch.write(merged)
        scratch.drop(last)
    return best.drop("grew")


def upstream_distance(pipes: DataFrame) -> DataFrame:
    """id, distance: a pipe's length and the distance of the farthest node upstream of it, by pipes (id, src, dst, length).

    The distance of two nodes is the shortest way along the pipes, so branches that meet
    again count once, and cycles do no harm.  Lengths under 0 raise.

    Where one pipe leaves a node, its way is forced: such nodes form trees, whose longest
    ways come from pointer doubling, in rows linear in the pipes and steps logarithmic in
    the depth.  Only nodes that several pipes leave (forks), and those on circles, need
    the shortest way to each node beyond: the farthest of the tree that hangs on a fork
    stands for all of it.
    """
    scratch = Scratch(pipes.sparkSession, "upstream")
    edges = scratch.write(pipes.select("id", "src", "dst", F.col("length").cast("double").alias("length")))
    if edges.where("length < 0").limit(1).count():
        raise ValueError("a pipe has a negative length")
    steps = scratch.write(edges.where("src <> dst").groupBy(F.col("src").alias("node"), F.col("dst").alias("to")).agg(F.min("length").alias("way")))
    n = steps.count()
    degree = scratch.write(steps.groupBy("node").agg(F.count("*").alias("n"), F.max("to").alias("to"), F.max("way").alias("way")))
    free, forks = degree.where("n = 1").drop("n"), degree.where("n > 1").select(F.col("node").alias("source"))
    others = lambda sources: _met(free, sources.select(F.col("source").alias("node")), "node", "left_anti")
    ways, around = _forest(free, n, scratch)
    if around.limit(1).count():  # these end on circles, one at least on every node of each
        forks = scratch.write(forks.unionByName(around.select(F.col("to").alias("source")).distinct()))
        ways, _ = _forest(others(forks), n, scratch)
    pairs = None
    if forks.limit(1).count():
        pairs = _pairs(steps, forks, ways, scratch)
        if ways:  # a node that can be reached from the fork it hangs on isn't beyond its tree: it gets ways of its own
            back = scratch.write(_met(_ends(ways, scratch), pairs.select(F.col("source").alias("end"), "node"), ["node", "end"]).select(F.col("node").alias("source")).distinct())
            if back.limit(1).count():
                forks = scratch.write(forks.unionByName(back))
                ways, _ = _forest(others(forks), n, scratch)
                pairs = _pairs(steps, forks, ways, scratch)
    far = _trees(ways, scratch) if ways else scratch.write(steps.select("node", F.lit(0.0).alias("far")).limit(0))
    if pairs is not None:
        hung = _met(pairs, far.select(F.col("node").alias("source"), "far"), "source", "left").select("node", (F.col("way") + F.coalesce("far", F.lit(0.0))).alias("far"))
        far = hung.unionByName(far).groupBy("node").agg(F.max("far").alias("far"))
    out = scratch.write(_met(edges, far.select(F.col("node").alias("src"), "far"), "src", "left").select("id", (F.col("length") + F.coalesce("far", F.lit(0.0))).alias("distance")))
    scratch.keep(out)
    return out


def classes_of(table: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """The classes (low, high, gradient; half open) as parts that don't overlap, each with the first class that holds it."""
    ends = sorted({x for low, high, _ in table for x in (low, high)})
    starts: dict[float, list[int]] = {}
    for i, (low, _, _) in enumerate(table):
        starts.setdefault(low, []).append(i)
    out, open_classes = [], []
    for a, b in zip(ends, ends[1:], strict=False):
        for i in starts.get(a, ()):
            heapq.heappush(open_classes, i)
        while open_classes and table[open_classes[0]][1] <= a:
            heapq.heappop(open_classes)
        if open_classes:
            out.append((a, b, table[open_classes[0]][2]))
    return out


def gradient_of(rows: DataFrame, table: DataFrame, distance: str = "distance") -> DataFrame:
    """rows with the gradient of the first class (low, high, gradient; half open) that holds the distance, else NULL.

    The table is a dimension: up to MOST_CLASSES rows, more raise.  Its classes, cut where
    they overlap, are looked up by their sorted bounds, batch by batch.
    """
    classes = [(float(r["low"]), float(r["high"]), float(r["gradient"])) for r in table.orderBy("place" if "place" in table.columns else "low").limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"a gradient table has at most {MOST_CLASSES} classes")
    parts = np.array(classes_of(classes)).reshape(-1, 3)
    sent = rows.sparkSession.sparkContext.broadcast(parts)

    def look_up(d: pd.Series) -> pd.Series:
        low, high, gradient = sent.value.T
        if not len(low):
            return pd.Series(np.full(len(d), np.nan))
        i = np.searchsorted(low, d.to_numpy(float), "right") - 1
        inside = (i >= 0) & (d.to_numpy(float) < high[np.maximum(i, 0)])
        return pd.Series(np.where(inside, gradient[np.maximum(i, 0)], np.nan))

    found = F.pandas_udf(look_up, "double")(F.col(distance).cast("double"))
    return rows.withColumn("gradient", found).withColumn("gradient", F.when(~F.isnan("gradient"), F.col("gradient")))


def check_gradients(table: list[tuple[float, float, float]], diagonal: float) -> None:
    """Raise if the last class ends below the network's extent."""
    if not table or table[-1][1] < diagonal:
        raise ValueError("the gradient table ends within the network")


def gradients_fit(ends: DataFrame, net: str, last: float) -> DataFrame:
    """net, fits: whether the last class of gradients reaches beyond the extent of each network, by its points (net, x, y)."""
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return ends.groupBy(net).agg((F.sqrt(wide * wide + high * high) <= last).alias("fits"))


def invert_levels(pipes: DataFrame, cover: float) -> DataFrame:
    """pipes (ground, ground_end, diameter in mm, gradient, length) with invert_start and invert_end.

    Both lie the cover and the diameter under the ground at the start, the end also
    the gradient; where the end then lacks cover, both go down by the shortfall.
    """
    d = F.col("diameter") / 1000
    start = F.col("ground") - cover - d
    end = start - F.col("gradient") * F.col("length")
    short = F.greatest(F.lit(0.0), end + d - (F.col("ground_end") - cover))
    return pipes.withColumn("invert_start", start - short).withColumn("invert_end", end - short)


def relax(pipes: DataFrame, max_drop: float, smooth_angle: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """pipes with levels settled: no pipe starts above the end of one before it, and no drop is more than max_drop.

    Pipes are only lowered, as a whole, and as little as these bounds allow, so it doesn't
    matter which pipe is looked at first.  With a smooth_angle (degrees; needs x0 .. y1),
    where the angle between two pipes is more (180 is straight on), no drop is left between
    them.  Pipes without levels, and pipes that end where they start, bind none and stay.

    Every bound says how much a pipe may lie above another one, so levels are shortest ways
    from the given ones.  Every round, pipes that went down hand on the least level at
    their nodes (never pairs of pipes), and over ways of 2, 4, ... pipes, each to its first
    follower; so rounds grow with the logarithm of the depth.  Bounds that contradict
    each other (a circle that loses height) would lower pipes for ever: `settled` is false
    for pipes that still moved after so many rounds.
    """
    scratch = Scratch(pipes.sparkSession, "relax")
    rows = scratch.write(pipes)
    fall = (F.col("invert_start") - F.col("invert_end")).cast("double")
    level = scratch.write(rows.where(fall.isNotNull() & (F.col("src") != F.col("dst"))).select("id", "src", "dst", fall.alias("fall"), F.col("invert_start").cast("double").alias("level"), F.lit(True).alias("moved")))
    first = level.groupBy(F.col("src").alias("dst")).agg(F.min("id").alias("to"))
    ways, _ = _forest(level.join(first, "dst").select(F.col("id").alias("node"), "to", (-F.col("fall")).alias("way")), level.count(), scratch)
    bounds = [level.select("id", F.col("id").alias("to"), F.lit(0.0).alias("way")).limit(0)]
    for k, way in enumerate(ways[1:], 1):
        bounds.append(way.select(F.col("node").alias("id"), "to", "way"))
        bounds.append(way.select(F.col("to").alias("id"), F.col("node").alias("to"), (F.lit(max_drop * 2**k) - F.col("way")).alias("way")))
    if smooth_angle is not None:
        bent = bend(rows.where("src <> dst")).where(F.abs("angle") > smooth_angle).join(level.select("id", "fall"), "id")
        bounds.append(bent.select(F.col("other").alias("id"), F.col("id").alias("to"), F.col("fall").alias("way")))
    far = scratch.write(reduce(DataFrame.unionByName, bounds))
    for _ in range(rounds):
        moved = level.where("moved")
        into = moved.groupBy(F.col("dst").alias("src")).agg(F.min(F.col("level") - F.col("fall")).alias("new"))
        out_of = moved.groupBy(F.col("src").alias("dst")).agg((F.min("level") + max_drop).alias("new"))
        new = level.join(into, "src").select("id", "new").unionByName(level.join(out_of, "dst").select("id", (F.col("new") + F.col("fall")).alias("new")))
        new = new.unionByName(moved.join(far, "id").select(F.col("to").alias("id"), (F.col("level") + F.col("way")).alias("new")))
        lower = F.coalesce(F.col("new") < F.col("level") - EXACT, F.lit(False))
        after = level.drop("moved").join(new.groupBy("id").agg(F.min("new").alias("new")), "id", "left")
        last, level = level, scratch.write(after.select("id", "src", "dst", "fall", F.when(lower, F.col("new")).otherwise(F.col("level")).alias("level"), lower.alias("moved")))
        scratch.drop(last)
        if not level.where("moved").limit(1).count():
            break
    down = F.coalesce(F.col("_level") - F.col("invert_start"), F.lit(0.0))
    out = rows.join(level.select("id", F.col("level").alias("_level"), "moved"), "id", "left")
    out = out.withColumns({"invert_start": F.col("invert_start") + down, "invert_end": F.col("invert_end") + down, "settled": ~F.coalesce("moved", F.lit(False))}).select(*pipes.columns, "settled")
    out = scratch.write(out)
    scratch.keep(out)
    return out


def edited(pipes: DataFrame) -> DataFrame:
    """Computed levels where edit is 1, else the designed ones (design_start, design_end)."""
    pick = lambda new, old: F.when(F.col("edit") == 1, F.col(new)).otherwise(F.col(old))
    return pipes.withColumn("invert_start", pick("invert_start", "design_start")).withColumn("invert_end", pick("invert_end", "design_end"))


def connected(pipes: DataFrame) -> DataFrame:
    """id, other, and whether the other follows (or comes before)."""
    one = pipes.select("id", "src", "dst")
    two = pipes.select(F.col("id").alias("other"), F.col("src").alias("osrc"), F.col("dst").alias("odst"))
    after = one.join(two, F.col("dst") == F.col("osrc")).select("id", "other", F.lit(True).alias("follows"))
    before = one.join(two, F.col("src") == F.col("odst")).select("id", "other", F.lit(False).alias("follows"))
    return after.unionByName(before).where("id <> other")


def bend(pipes: DataFrame) -> DataFrame:
    """id, other, angle where another pipe leaves a pipe's end (x0 .. y1)."""
    one = pipes.select("id", F.col("dst").alias("node"), "x0", "y0", F.col("x1").alias("mx"), F.col("y1").alias("my"))
    two = pipes.select(F.col("id").alias("other"), F.col("src").alias("node"), F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    c = F.col
    return one.join(two, "node").where("id <> other").select("id", "other", G.joint(c("x0"), c("y0"), c("mx"), c("my"), c("nx"), c("ny")).alias("angle"))
