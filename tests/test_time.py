"""The window and the methods against a plain restatement over lists."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.functions.registry import BY_NAME, METHODS, PRESETS, Request, preset
from hydroframe.operators.aggregate import time_aggregate
from hydroframe.operators.window import axis, checked, window

STEPS = [0.0, 10.0, 25.0, 30.0, 60.0]


def held(start, end):
    """(t, te, dt) by walking the steps."""
    last = STEPS[-1]
    end = last if end is None else min(end, last)
    out = []
    for a, b in zip(STEPS, STEPS[1:], strict=False):
        te, until = max(a, start or 0.0), min(b, end)
        if until > te:
            out.append((a, te, until - te))
    return out


@pytest.mark.parametrize(("start", "end"), [(None, None), (0.0, 60.0), (10.0, 30.0), (12.0, 28.0), (5.0, 999.0), (11.0, 12.0), (26.0, 60.0)])
def test_window(spark, start, end):
    steps = spark.createDataFrame([(t,) for t in STEPS], "t double")
    got = [tuple(r) for r in window(steps, start, end).orderBy("t").collect()]
    assert got == held(start, end)
    times = [r["at"] for r in axis(window(steps, start, end), start or 0.0).orderBy("t").collect()]
    assert times == [te for _, te, _ in held(start, end)]


def test_window_errors(spark):
    steps = spark.createDataFrame([(t,) for t in STEPS], "t double")
    with pytest.raises(ValueError):
        window(steps, 5.0, 5.0)
    with pytest.raises(ValueError):
        checked(window(steps, 100.0, 200.0))


def expected(method, rows, limit):
    v = [x for x, _, _ in rows]
    some = [(x, te) for x, te, _ in rows if x is not None]
    if method == "sum":
        return None if len(some) < len(v) else sum(x * dt for x, _, dt in rows)
    if method == "max_time":
        best = max(-9999.0 if x is None else x for x in v)
        return next(te for x, te, _ in rows if (-9999.0 if x is None else x) == best)
    if method in ("first", "last"):
        return v[0 if method == "first" else -1]
    if method.endswith("thres"):
        met = [dt for x, _, dt in rows if x is not None and (x > limit if method == "above_thres" else x < limit)]
        return 100 * sum(met) / sum(dt for _, _, dt in rows)
    if not some:
        return None
    only = [x for x, _ in some]
    return {"min": min, "max": max, "mean": statistics.fmean, "median": statistics.median, "first_non_empty": lambda x: x[0], "last_non_empty": lambda x: x[-1]}[method](only)


@pytest.mark.parametrize("span", [(None, None), (12.0, 28.0), (5.0, 60.0)])
def test_methods(spark, span):
    draw = random.Random(1)
    data = [(e, t, draw.choice([None, -9999.0, float("nan"), 1.0, 2.5, -3.0, 7.0]) if e else None) for e in range(25) for t in STEPS]
    values = spark.createDataFrame(data, "entity_id int, t double, s1 double").withColumn("ucx", F.col("s1")).withColumn("kcu", F.lit(1)).withColumn("q", F.col("s1"))
    steps = spark.createDataFrame([(t,) for t in STEPS], "t double")
    wanted = [Request("q", m, "net", 2.0 if METHODS[m][2] else None) for m in METHODS]
    got = {r["entity_id"]: r for r in time_aggregate(values, steps, wanted, *span).collect()}
    for e in range(25):
        series = {t: None if v is None or v == -9999.0 or v != v else v for d, t, v in data if d == e}
        rows = [(series[t], te, dt) for t, te, dt in held(*span)]
        for w in wanted:
            a, b = got[e][w.column], expected(w.method, rows, w.threshold)
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)), (e, w)


def test_above_below_and_equal_are_all(spark):
    values = spark.createDataFrame([(1, t, v) for t, v in zip(STEPS, [1.0, 2.0, 3.0, 2.0, 9.0], strict=True)], "entity_id int, t double, s1 double")
    steps = values.select("t")
    row = time_aggregate(values, steps, [Request("s1", "above_thres", None, 2.0), Request("s1", "below_thres", None, 2.0)]).first()
    assert math.isclose(row["s1_above_thres_2_0"] + row["s1_below_thres_2_0"], 100 * (1 - 45 / 60))


def test_names_and_units():
    assert Request("ts_max", "below_thres", None, 1.0).column == "ts_max_below_thres_1_0"
    assert Request("q", "sum", "net").column == "q_net_sum"
    assert Request("rain_depth", "sum", unit="mm/h").multiplier == 1000 and Request("rain_depth", "max", unit="mm/h").multiplier == 3600000
    assert Request("rain", "above_thres", None, 1.0, "m3/h").multiplier == 1 and Request("rain", "sum").unit_shown == "m3"
    assert Request("s1", "sum").problems() and Request("s1", "max", "pos").problems() and Request("q", "above_thres", "net").problems() and Request("nope", "max").problems()
    assert Request("bed_grad", "mean").problems() and not Request("bed_grad", None).problems()
    for name in PRESETS:
        assert all(not r.problems() for r in preset(name))
    assert len(BY_NAME) == 33


def test_stream_equals_table(spark, tmp_path):
    from hydroframe.streaming.windows import run_once, windowed

    rows = spark.sql("select id % 3 as k, timestamp_seconds(id * 600) as ts, cast(id as double) as v from range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run_once(windowed(stream, "k", "v", "2 hours"), str(tmp_path / "out"), str(tmp_path / "log"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = {tuple(r) for r in windowed(rows, "k", "v", "2 hours").collect()}
    assert got and got <= every  # the last windows are still open


def test_requests_from_sql(spark):
    from hydroframe.functions import tables

    tables.register(spark)
    draw = np.random.default_rng(4)
    rows = [(e, float(t * 10), None if draw.random() < 0.2 else float(draw.normal()), -9999.0 if draw.random() < 0.1 else float(draw.normal()), int(draw.choice([51, 100])), float(draw.random()), 3.0) for e in range(5) for t in range(12)]
    df = spark.createDataFrame(rows, "id long, t double, s1 double, q double, kcu int, rain double, sumax double").repartition(4)
    df.createOrReplaceTempView("given")
    steps = df.select("t").distinct()
    wanted = [Request("s1", m) for m in METHODS if m != "sum" and not METHODS[m][2]] + [Request("q", m, s) for m in ("sum", "max", "mean") for s in ("net", "pos", "neg", "abs")] + [Request("q", "above_thres", "pos", 0.25), Request("rain_depth", "sum"), Request("q", "below_thres", None, 0.0), Request("uc", "max")]
    text = "; ".join(" ".join(str(x) for x in (w.variable, w.method, w.sign, w.threshold) if x is not None) for w in wanted)
    for start, end in ((15, 77), (None, None)):
        ends = "" if start is None else f", {start}, {end}"
        got = {r["id"]: r for r in spark.sql(f"SELECT * FROM time_aggregate(TABLE(given), '{text}'{ends})").collect()}
        for r in time_aggregate(df, steps, wanted, start, end, key="id").collect():
            for w in wanted:
                a, b = r[w.column], got[r["id"]][w.column]
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (w, a, b)
    for bad in ("s1 sum", "nothing max", "q above_thres net", "", "q sum net pos"):
        with pytest.raises(Exception, match="request|takes|unknown|threshold"):
            spark.sql(f"SELECT * FROM time_aggregate(TABLE(given), '{bad}')").collect()


def test_holds_of_a_stream(spark, tmp_path):
    """Files that come one after another, rows out of order and too late, and a query that is started again."""
    from hydroframe.streaming.holds import drained, held_in_table, holds

    draw = random.Random(8)
    rows = [(k, t, None if draw.random() < 0.2 else round(draw.uniform(-5, 5), 3)) for k in range(4) for t in draw.sample(range(0, 3000, 7), 60)]
    rows += [(1, 700, 1.5), (1, 700, 9.5), (1, 700, None), (None, 5, 1.0)]
    frame = lambda part: spark.createDataFrame(part, "k long, t long, v double").select("k", F.timestamp_seconds("t").alias("ts"), "v").coalesce(1)
    parts = [[], [], []]
    for r in rows:
        parts[min(2, max(0, (r[1] + draw.randrange(-100, 100)) // 1000))].append(r)
    where = [str(tmp_path / x) for x in ("in", "out", "log")]
    for i, part in enumerate(parts):
        late = [(2, 3, 77.0)] if i == 2 else []  # 2,000 seconds too late
        frame(part + late).write.mode("append").parquet(where[0])
        stream = spark.readStream.schema("k long, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(where[0])
        got = drained(spark, holds(stream, "k", "v", "5 minutes"), where[1], where[2])
    frame([(9, 100_000, 0.0)]).write.mode("append").parquet(where[0])  # the watermark passes all other rows
    stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(where[0])
    got = drained(spark, holds(stream, "k", "v", "5 minutes"), where[1], where[2])
    want = held_in_table(frame(rows), "k", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_state_of_holds_grows_with_batches():
    """Calls to the state and timers count batches of a key, not its rows."""
    import pandas as pd

    from hydroframe.streaming.holds import Holds

    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            calls.append(name)
            act = {"appendValue": lambda x: self.rows.append(x), "get": lambda: list(self.rows) if self.many else self.rows[0], "clear": lambda: self.rows.clear(), "exists": lambda: bool(self.rows), "update": lambda x: self.rows.__setitem__(slice(None), [x])}
            return act[name]

    class Handle:
        def state(self, name, schema, many):
            out = State()
            out.many = many
            return out

        def getListState(self, name, schema):
            return self.state(name, schema, True)

        def getValueState(self, name, schema):
            return self.state(name, schema, False)

        def registerTimer(self, ms):
            calls.append("timer")

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    h = Holds("k")
    h.init(Handle())
    times = [ms for ms in range(10, 10_010) if ms % 7]
    random.Random(1).shuffle(times)
    list(h.handleInputRows((5,), iter([pd.DataFrame({"ms": times, "v": [float(ms % 11) if ms % 11 else None for ms in times]})]), Now(0)))
    got = pd.concat(list(h.handleExpiredTimer((5,), Now(4_000), Now(10))) + list(h.handleExpiredTimer((5,), Now(20_000), Now(4_000))))
    times.sort()
    assert got["ms"].tolist() == times[:-1]
    assert got["dt"].tolist() == [(b - a) / 1000 for a, b in zip(times, times[1:])]
    assert [None if x is None else x for x in got["v"].tolist()] == [float(ms % 11) if ms % 11 else None for ms in times[:-1]]
    assert len(calls) < 20
