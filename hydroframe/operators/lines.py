"""Lines merged along their chain while the range of their values stays bounded; averages by length."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.operators.graph import components
from hydroframe.sources.scratch import Scratch


#: Rows of a slice of a chain at most; a chain spans as many tasks as it has slices, unless they are short.
SLICE = 1_000_000


def _last_runs(v: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """For runs that start at each value: how many more runs follow, and where the last one starts.

    The next run after one that starts at i begins at the first value that stretches the range
    beyond `most`; two queues keep the greatest and least value of a moving stretch.
    """
    n = len(v)
    values, after = v.tolist(), [n] * n
    high: deque[int] = deque()
    low: deque[int] = deque()
    i = 0
    for j, x in enumerate(values):
        while high and values[high[-1]] <= x:
            high.pop()
        high.append(j)
        while low and values[low[-1]] >= x:
            low.pop()
        low.append(j)
        while values[high[0]] - values[low[0]] > most:
            after[i] = j
            i += 1
            if high[0] < i:
                high.popleft()
            if low[0] < i:
                low.popleft()
    count, last = [0] * n, list(range(n))
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            count[i], last[i] = count[after[i]] + 1, last[after[i]]
    return np.array(count, np.int64), np.array(last, np.int64)


class Transition:
    """What a slice of a chain does to a run that comes into it.

    A run comes in with its lowest and highest value.  The slice breaks it at the first value
    that stretches its range too far, which can only be one higher or lower than all before it
    in the slice; what follows depends on that place alone.  So there is one case for each such
    place (those that end alike are one), up to the first that breaks any run, and one for none.
    """

    FIELDS = ("high", "low", "runs", "end_low", "end_high")

    def __init__(self, cases: np.ndarray, low: float, high: float) -> None:
        self.cases, self.low, self.high = cases, low, high

    @classmethod
    def of(cls, v: np.ndarray, most: float) -> Transition:
        if not len(v):
            return cls(np.empty((0, 5)), np.inf, -np.inf)
        high, low = np.maximum.accumulate(v), np.minimum.accumulate(v)
        new = np.flatnonzero(np.r_[True, (high[1:] > high[:-1]) | (low[1:] < low[:-1])])
        sure = np.flatnonzero(high[new] - low[new] > most)
        if len(sure):
            new = new[: sure[0] + 1]
        count, last = _last_runs(v, most)
        to = last[new]
        end_low, end_high = np.minimum.accumulate(v[::-1])[::-1][to], np.maximum.accumulate(v[::-1])[::-1][to]
        cases = np.stack([high[new], low[new], count[new] + 1, end_low, end_high], axis=1)
        alike = np.r_[(cases[1:, 2:] == cases[:-1, 2:]).all(axis=1), False]  # the later place stands for both: if it breaks a run, one of them does
        return cls(cases[~alike], float(low[-1]), float(high[-1]))

    def __call__(self, low: float, high: float, most: float) -> tuple[int, float, float]:
        """Of a run that comes in with these bounds (inf, -inf: none yet): the runs that begin, and the bounds of the last."""
        broken = np.flatnonzero(np.maximum(self.cases[:, 0], high) - np.minimum(self.cases[:, 1], low) > most)
        if high < low or not len(broken):  # the first values of a chain start a run without a break
            if high < low and len(self.cases):
                return int(self.cases[0, 2]) - 1, float(self.cases[0, 3]), float(self.cases[0, 4])
            return 0, min(low, self.low), max(high, self.high)
        runs, end_low, end_high = self.cases[broken[0], 2:]
        return int(runs), float(end_low), float(end_high)


def _folded(rows: DataFrame, group: str, order: str, value: str, max_range: float, keys: list[str], start: tuple[str, str, str] | None = None) -> DataFrame:
    """rows with run, chain by chain in order; start: columns with a chain's first run number and the bounds of its run so far."""
    kept = [f for f in rows.schema.fields if start is None or f.name not in (*start, *set(keys) - {group})]
    schema = T.StructType(kept + [T.StructField("run", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, run, low, high = object(), 0, None, None
        for pdf in batches:
            out = []
            first = zip(*(pdf[c].tolist() for c in start), strict=True) if start else iter(lambda: (0, None, None), 0)
            for g, v, (r, lowest, highest) in zip(zip(*([None if x != x else x for x in pdf[k].tolist()] for k in keys), strict=True), pdf[value].tolist(), first, strict=False):
                if g != now:
                    now, run, low, high = g, int(r), lowest, highest
                    if low is not None and not low <= high:
                        low = high = None
                if v is not None and v == v:
                    if low is None:
                        low = high = v
                    elif max(high, v) - min(low, v) > max_range:
                        run, low, high = run + 1, v, v
                    else:
                        low, high = min(low, v), max(high, v)
                out.append(run)
            yield pdf[[f.name for f in kept]].assign(run=out)

    return rows.repartition(keys[0]).sortWithinPartitions(*keys, order).mapInPandas(fold, schema)


def _tasks(rows: DataFrame, n: int, slice_rows: int) -> int:
    """Tasks for n rows: as many as there are slices, but short slices share one of up to SLICE rows or a quarter of a core's part."""
    return min(1 + n // slice_rows, max(4 * rows.sparkSession.sparkContext.defaultParallelism, 1 + n // SLICE))


def range_runs(rows: DataFrame, group: str, order: str, value: str, max_range: float, slice_rows: int = SLICE) -> DataFrame:
    """rows with run: within a group, in order, a new run starts where a value would stretch the run's range beyond max_range.

    The bounds of a run depend on where it began.  Groups of up to slice_rows rows are
    folded in order by one task.  A longer one is cut into slices of its order: what each
    slice does to a run that comes in is told as a Transition, these are composed along the
    group (a row a slice), and every slice is then folded from the run that comes into it,
    so one group spans as many tasks as it has slices.  Missing values stay in the run they
    are in.  Infinite values aren't allowed in groups of more than a slice.
    """
    count = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows)
    long = [] if not count.limit(1).count() else count.agg(F.sum("_n")).first()
    if not long:
        return _folded(rows, group, order, value, max_range, [group])
    own = F.broadcast(count.select("_group"))  # no more groups than slices
    same = F.col(group).eqNullSafe(F.col("_group"))
    short = _folded(rows.join(own, same, "left_anti"), group, order, value, max_range, [group])
    scratch = Scratch(rows.sparkSession, "runs")
    # The upper bits of the increasing id are the task, the lower ones the row in it: a task holds as many slices as it has rows for.
    dealt = rows.join(own, same, "left_semi").repartitionByRange(_tasks(rows, long[0], slice_rows), group, order).sortWithinPartitions(group, order).withColumn("_id", F.monotonically_increasing_id())
    row = F.col("_id").bitwiseAND((1 << 33) - 1)
    sliced = scratch.write(dealt.withColumn("_slice", F.col("_id") - row + F.floor(row / slice_rows)).drop("_id"))
    kind = dict(rows.dtypes)[group]

    def transition(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("_o", na_position="first")["_v"].to_numpy(float)
        made = Transition.of(v[~np.isnan(v)], max_range)
        return pd.DataFrame({"_slice": pdf["_slice"].iloc[:1], "_group": pdf["_group"].iloc[:1], "low": made.low, "high": made.high, "cases": [made.cases.reshape(-1).tolist()]})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        run, low, high, out = 0, np.inf, -np.inf, []
        pdf = pdf.sort_values("_slice", ignore_index=True)
        for cases, lowest, highest in zip(pdf["cases"], pdf["low"], pdf["high"], strict=True):
            out.append((run, low, high))
            more, low, high = Transition(np.asarray(cases, float).reshape(-1, 5), lowest, highest)(low, high, max_range)
            run += more
        return pd.DataFrame({"_slice": pdf["_slice"], "_group": pdf["_group"]} | dict(zip(("_run", "_low", "_high"), zip(*out, strict=True), strict=True)))

    narrow = sliced.select("_slice", F.col(group).alias("_group"), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    summaries = narrow.groupBy("_slice", "_group").applyInPandas(transition, f"_slice long, _group {kind}, low double, high double, cases array<double>")
    states = scratch.write(summaries.groupBy("_group").applyInPandas(composed, f"_slice long, _group {kind}, _run long, _low double, _high double"))
    met = sliced.join(states.withColumnRenamed("_slice", "_at"), (F.col("_slice") == F.col("_at")) & same).drop("_at", "_group")
    return short.unionByName(_folded(met, group, order, value, max_range, ["_slice", group], ("_run", "_low", "_high")))


def run_statistics(runs: DataFrame, group: str, value: str, length: str) -> DataFrame:
    """One row a run: how many, mean by length (NULL without length), least and greatest value."""
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(length))
    return runs.groupBy(group, "run").agg(F.count("*").alias("n"), F.try_divide(F.sum(v * w), F.sum(w)).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.sum(length).alias("length"))


def numbered_groups(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with grp: within a key, in order, a new group (from 1) begins where the value changes."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("grp", F.sum(F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def weighted_mean(rows: DataFrame, group: str, value: str, length: str) -> DataFrame:
    w = F.when(F.col(value).isNotNull(), F.col(length))
    return rows.groupBy(group).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("mean"))


def split_every(lines: DataFrame, d: float, key: str = "id") -> DataFrame:
    """key, piece, x, y: the middle of every piece of d metres of straight lines (x0 .. y1)."""
    size = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    n = F.greatest(F.ceil(size / d), F.lit(1))
    pieces = lines.select(key, "x0", "y0", "x1", "y1", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    at = (F.col("piece") + 0.5) / F.col("_n")
    return pieces.select(key, "piece", (F.col("x0") + (F.col("x1") - F.col("x0")) * at).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * at).alias("y"))


def adjacent(levees: DataFrame, distance: float = 1e-4, height: float | None = None) -> DataFrame:
    """Pairs u < v of levees (id, x0 .. y1, height) with ends within distance, and heights within `height`; ends meet by a grid of that size."""
    ends = levees.select("id", "height", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("id", "height", "p.x", "p.y")
    shift = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    cell = lambda c: F.floor(F.col(c) / distance)
    one = ends.select("*", cell("x").alias("_i"), cell("y").alias("_j"))
    two = ends.select(F.col("id").alias("id2"), F.col("height").alias("height2"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("_a"), cell("y").alias("_b"))
    two = two.withColumn("_di", shift).withColumn("_dj", shift).withColumn("_i", F.col("_a") + F.col("_di")).withColumn("_j", F.col("_b") + F.col("_dj"))
    met = one.join(two, ["_i", "_j"]).where("id < id2").where(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= distance * distance)
    if height is not None:
        met = met.where(F.abs(F.col("height") - F.col("height2")) <= height)
    return met.select(F.col("id").alias("u"), F.col("id2").alias("v")).distinct()


def groups_of(rows: DataFrame, key: str, amount: int, value: str, largest: bool = True, x: str = "x", y: str = "y", order: str = "place") -> DataFrame:
    """Fixed-size groups along an order: mean centre, and the greatest (or least) value."""
    numbered = rows.withColumn("_n", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / amount))
    best = F.max(value) if largest else F.min(value)
    return numbered.groupBy(key, F.col("_n").alias("grp")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), best.alias(value))


def moving(rows: DataFrame, key: str, order: str, value: str, k: int, how: str) -> DataFrame:
    """rows with moved: the mean, min or max over k places to either side."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-k, k)
    return rows.withColumn("moved", {"mean": F.avg, "min": F.min, "max": F.max}[how](value).over(w))


def _touching(levees: DataFrame, field: str, most: float, distance: float) -> DataFrame:
    """levees with part: no merged levee of a threshold up to `most` reaches beyond its field and part.

    Ends meet by cells of the distance.  Around a cell, levees in order of their height hang
    together as long as the next one is less than `most` higher, so no pairs are made.
    """
    key = dict(levees.dtypes)["id"]
    cell = lambda c: F.floor(F.col(c) / distance)
    ends = levees.select(F.col(field).alias("_f"), "id", "height", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"))
    ends = ends.select("_f", "id", "height", cell("p.x").alias("i"), cell("p.y").alias("j"))
    shift = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = ends.withColumn("a", shift).withColumn("b", shift).select("_f", "id", "height", (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j"))
    order = Window.partitionBy("_f", "i", "j").orderBy("height", "id")
    linked = near.withColumn("v", F.lag("id").over(order)).withColumn("below", F.lag("height").over(order))
    links = linked.where((F.col("height") - F.col("below") < most) & (F.col("id") != F.col("v"))).select(F.col("id").alias("u"), "v").distinct()
    parts = components(links)
    return levees.join(parts.select(F.col("id").cast(key).alias("id"), F.col("part").alias("_part")), "id", "left").withColumn("part", F.coalesce("_part", F.col("id").cast("long"))).drop("_part")


def _grown(pdf: pd.DataFrame, threshold: float, distance: float) -> Iterator[list[int]]:
    """Rows of each merged levee of a part, sorted by id."""
    ends: dict[tuple[int, int], list[int]] = {}
    spots = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float).reshape(-1, 2, 2)
    height = pdf["height"].to_numpy(float)
    for i, pair in enumerate(spots):
        for x, y in pair:
            ends.setdefault((int(x // distance), int(y // distance)), []).append(i)
    taken = [False] * len(pdf)
    for first in range(len(pdf)):
        if taken[first]:
            continue
        taken[first], run, edge = True, [first], [first]
        low = high = height[first]
        beside: set[int] = set()
        while edge:  # what touches the merged levee so far, by its heights before this round
            for i in edge:
                for x, y in spots[i]:
                    a, b = int(x // distance), int(y // distance)
                    for k in {j for p in (-1, 0, 1) for q in (-1, 0, 1) for j in ends.get((a + p, b + q), ())}:
                        if not taken[k] and min((u - x) ** 2 + (v - y) ** 2 for u, v in spots[k]) <= distance**2:
                            beside.add(k)
            edge = [k for k in sorted(beside) if abs(height[k] - low) < threshold and abs(height[k] - high) < threshold]
            for k in edge:
                taken[k] = True
                low, high = min(low, height[k]), max(high, height[k])
            beside -= set(edge)
            run += edge
        yield run


def merged_levees(levees: DataFrame, field: str, threshold: float, distance: float = 1e-4) -> DataFrame:
    """field, merged, n, mean, highest, lowest of levees (id, field, x0 .. y1, height), each field on its own.

    By id, a levee that isn't taken starts a merged one.  Round by round this takes all that
    touch it and whose heights are less than the threshold from its lowest and its highest
    so far.  Which levee is taken depends on the order, so a task walks all that hang
    together (by ends and heights) in one field; levees without a height stay alone.
    """
    kind = dict(levees.dtypes)[field]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        rows = []
        for run in _grown(pdf, threshold, distance):
            h = pdf["height"].to_numpy(float)[run]
            rows.append((pdf[field].iloc[0], int(pdf["id"].iloc[run[0]]), len(run), float(h.mean()), float(h.max()), float(h.min())))
        return pd.DataFrame(rows, columns=[field, "merged", "n", "mean", "highest", "lowest"])

    return _touching(levees, field, threshold, distance).groupBy(field, "part").applyInPandas(grow, f"{field} {kind}, merged long, n long, mean double, highest double, lowest double")


def merged_counts(levees: DataFrame, field: str, thresholds: list[float], distance: float = 1e-4) -> DataFrame:
    """threshold, n: how many merged levees each threshold leaves, in one job for all of them.

    What hangs together at the greatest threshold holds what does at the others.
    """
    tries = F.explode(F.array(*map(F.lit, sorted({float(t) for t in thresholds})))).alias("threshold")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, threshold = pdf.sort_values("id", ignore_index=True), float(pdf["threshold"].iloc[0])
        return pd.DataFrame({"threshold": [threshold], "n": [sum(1 for _ in _grown(pdf, threshold, distance))]})

    parts = _touching(levees.select("id", field, "x0", "y0", "x1", "y1", "height"), field, max(thresholds), distance).select("*", tries)
    return parts.groupBy(field, "part", "threshold").applyInPandas(count, "threshold double, n long").groupBy("threshold").agg(F.sum("n").alias("n"))


def threshold_for(levees: DataFrame, field: str, most: int, thresholds: list[float]) -> float | None:
    """The least of the thresholds that leaves at most so many merged levees; None if none does."""
    found = merged_counts(levees, field, thresholds).where(F.col("n") <= most).agg(F.min("threshold")).first()[0]
    return found if found is not None or levees.limit(1).count() else min(thresholds)
