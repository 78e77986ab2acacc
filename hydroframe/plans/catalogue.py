"""The registered queries: each operator over relations derived from the test tables, with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.functions import aggregates as A
from hydroframe.functions import geometry as G
from hydroframe.functions.registry import NODE_TYPES, Request, preset
from hydroframe.operators import gauge, graph, leak, lines, network, raster, sampling, scenario, style, window, xsec
from hydroframe.operators.aggregate import time_aggregate
from hydroframe.plans.sql import END, START, relations
from hydroframe.sources import readers
from hydroframe.sources.derived import Derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Derived], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- time -------------------------------------------------------------------------------------------


@query("t01_window", relations("w") + "SELECT t, te::DOUBLE AS te, dt::DOUBLE AS dt FROM w")
def _(d):
    return window.window(d.steps(), START, END)


@query("t03_axis", relations("w") + f"SELECT t, (coalesce(sum(dt) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {START})::DOUBLE AS at FROM w")
def _(d):
    return window.axis(window.window(d.steps(), START, END), START).select("t", "at")


@query("t05_output_step", relations("steps") + "SELECT (max(t) // (count(*) - 1))::INTEGER AS step FROM steps")
def _(d):
    return window.output_step(d.steps())


def _node(d: Derived, *requests: Request) -> DataFrame:
    values = d.node_ts().join(d.nodes().select(F.col("id").alias("entity_id"), "sumax"), "entity_id")
    return time_aggregate(values, d.steps(), list(requests), START, END)


def _line(d: Derived, *requests: Request) -> DataFrame:
    lines_ = d.lines().select(F.col("id").alias("entity_id"), G.length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("length"))
    return time_aggregate(d.line_ts().join(lines_, "entity_id"), d.steps(), list(requests), START, END)


_S1 = {
    "a02_s1_min": ("min", None, "min(s1)"),
    "a03_s1_max": ("max", None, "max(s1)"),
    "a04_s1_max_time": ("max_time", None, "arg_min(te, row(-coalesce(s1, -9999), t))"),
    "a05_s1_mean": ("mean", None, "avg(s1)"),
    "a06_s1_median": ("median", None, "median(s1)"),
    "a07_s1_first": ("first", None, "(array_agg(s1 ORDER BY t))[1]"),
    "a08_s1_first_non_empty": ("first_non_empty", None, "(array_agg(s1 ORDER BY t) FILTER (WHERE s1 IS NOT NULL))[1]"),
    "a09_s1_last": ("last", None, "(array_agg(s1 ORDER BY t))[-1]"),
    "a10_s1_last_non_empty": ("last_non_empty", None, "(array_agg(s1 ORDER BY t) FILTER (WHERE s1 IS NOT NULL))[-1]"),
    "a11_s1_above_thres_20_0": ("above_thres", 20.0, "100.0 * sum(CASE WHEN s1 > 20 THEN dt ELSE 0 END) / sum(dt)"),
    "a12_s1_below_thres_20_0": ("below_thres", 20.0, "100.0 * sum(CASE WHEN s1 < 20 THEN dt ELSE 0 END) / sum(dt)"),
}


def _s1(name: str, method: str, limit: float | None, sql: str) -> None:
    request = Request("s1", method, None, limit)

    @query(name, relations("node_w") + f"SELECT entity_id, round(({sql})::DOUBLE, 6) AS {request.column} FROM node_w GROUP BY entity_id")
    def _(d):
        return _node(d, request).select("entity_id", r(F.col(request.column).cast("double")).alias(request.column))


for _name, (_method, _limit, _sql) in _S1.items():
    _s1(_name, _method, _limit, _sql)

_Q = "CASE WHEN kcu BETWEEN 51 AND 58 THEN -q ELSE q END"


def _q(name: str, sign: str, sql: str) -> None:
    request = Request("q", "sum", sign)

    @query(name, relations("line_w") + f"SELECT entity_id, round(CASE WHEN count(q) < count(*) THEN NULL ELSE sum(({sql}) * dt) END, 3) AS {request.column} FROM line_w GROUP BY entity_id")
    def _(d):
        return _line(d, request).select("entity_id", r(request.column, 3).alias(request.column))


_q("a01_q_net_sum", "net", _Q)
_q("v12_q_pos_sum", "pos", f"greatest({_Q}, 0)")
_q("v13_q_neg_sum", "neg", f"least({_Q}, 0)")
_q("v14_q_abs_sum", "abs", f"abs({_Q})")


@query("v11_q_direction", relations("line_ts") + f"SELECT entity_id, t, round({_Q}, 6) AS q FROM line_ts")
def _(d):
    return d.line_ts().select("entity_id", "t", r(A.direction(F.col("q"), F.col("kcu"))).alias("q"))


@query("v03_ts_max_below_thres", relations("line_w") + """SELECT entity_id, round(100.0 * sum(CASE WHEN v < 5 THEN dt ELSE 0 END) / sum(dt), 6) AS ts_max_below_thres_5_0
FROM (SELECT w.entity_id, w.dt, CASE WHEN w.kcu IN (3, 51, 200) THEN 9999 WHEN w.u1 = 0 THEN 'inf'::DOUBLE ELSE sqrt((l.x1 - l.x0)**2 + (l.y1 - l.y0)**2) / abs(w.u1) END AS v FROM line_w w JOIN lines l ON l.id = w.entity_id) GROUP BY entity_id""")
def _(d):
    return _line(d, Request("ts_max", "below_thres", None, 5.0)).select("entity_id", r("ts_max_below_thres_5_0").alias("ts_max_below_thres_5_0"))


@query("v04_rain_depth_sum", relations("node_w") + "SELECT entity_id, round(CASE WHEN count(rain) < count(*) THEN NULL ELSE sum(rain / sumax * dt) * 1000 END, 3) AS rain_depth_sum FROM node_w JOIN nodes ON nodes.id = entity_id GROUP BY entity_id")
def _(d):
    return _node(d, Request("rain_depth", "sum")).select("entity_id", r("rain_depth_sum", 3).alias("rain_depth_sum"))


@query("v05_uc_mean", relations("node_w") + "SELECT entity_id, round(avg(sqrt(ucx * ucx + ucy * ucy)), 6) AS uc_mean FROM node_w GROUP BY entity_id")
def _(d):
    return _node(d, Request("uc", "mean")).select("entity_id", r("uc_mean").alias("uc_mean"))


@query("v10_sentinel", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events")
def _(d):
    v = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, -9999.0).otherwise(float("nan"))).otherwise(F.col("value"))
    return d.table("events").select("event_id", A.valid(v).alias("v"))


@query("a14_time_aggregate", relations("node_w") + """SELECT entity_id, round(min(s1), 6) AS s1_min, round(max(s1), 6) AS s1_max, round(avg(s1), 6) AS s1_mean, round(max(vol), 6) AS vol_max,
round(CASE WHEN count(rain) < count(*) THEN NULL ELSE sum(rain * dt) END, 3) AS rain_sum, round(100.0 * sum(CASE WHEN ucx > 5 THEN dt ELSE 0 END) / sum(dt), 6) AS ucx_pos_above_thres_5_0 FROM node_w GROUP BY entity_id""")
def _(d):
    wanted = [Request("s1", "min"), Request("s1", "max"), Request("s1", "mean"), Request("vol", "max"), Request("rain", "sum"), Request("ucx", "above_thres", "pos", 5.0)]
    return _node(d, *wanted).select("entity_id", *(r(x.column, 3 if x.method == "sum" else 6).alias(x.column) for x in wanted))


@query("p06_missing_variable", relations("node_w") + "SELECT entity_id, NULL::DOUBLE AS q_lat_net_sum, round(max(s1), 6) AS s1_max FROM node_w GROUP BY entity_id")
def _(d):
    return _node(d, Request("q_lat", "sum", "net"), Request("s1", "max")).select("entity_id", "q_lat_net_sum", r("s1_max").alias("s1_max"))


@query("p08_units", relations("node_w") + "SELECT entity_id, round(max(rain) * 3600, 6) AS rain_max, round(CASE WHEN count(rain) < count(*) THEN NULL ELSE sum(rain * dt) END, 3) AS rain_sum FROM node_w GROUP BY entity_id")
def _(d):
    return _node(d, Request("rain", "max", unit="m3/h"), Request("rain", "sum", unit="m3/h")).select("entity_id", r("rain_max").alias("rain_max"), r("rain_sum", 3).alias("rain_sum"))


@query("x04_preset_levels", relations("node_w") + "SELECT entity_id, round((array_agg(s1 ORDER BY t))[1], 6) AS s1_first, round((array_agg(s1 ORDER BY t))[-1], 6) AS s1_last, round(min(s1), 6) AS s1_min, round(max(s1), 6) AS s1_max FROM node_w GROUP BY entity_id")
def _(d):
    wanted = preset("change in water level")
    return _node(d, *wanted).select("entity_id", *(r(x.column).alias(x.column) for x in wanted))


# --- filters and projections ------------------------------------------------------------------------


@query("f01_bbox", relations("nodes") + "SELECT id, x, y FROM nodes WHERE x BETWEEN 20 AND 90 AND y BETWEEN 10 AND 60")
def _(d):
    return graph.in_box(d.nodes(), "x", "y", (20, 10, 90, 60)).select("id", "x", "y")


@query("f02_ids", relations("nodes", "lines") + "SELECT id, x FROM nodes WHERE id IN (SELECT end_id FROM lines WHERE kcu = 100)")
def _(d):
    return d.nodes().join(d.lines().where("kcu = 100").select(F.col("end_id").alias("id")), "id", "left_semi").select("id", "x")


@query("f04_subset", relations("lines") + "SELECT id, kcu FROM lines WHERE kcu IN (100, 101)")
def _(d):
    return gauge.subset(d.lines(), "2D_OPEN_WATER").select("id", "kcu")


@query("f05_content_types", relations("lines") + "SELECT id, content_type FROM lines WHERE content_type IN ('v2_pipe', '', 'v2_added_c')")
def _(d):
    return gauge.of_content(d.lines(), ["v2_pipe"]).select("id", "content_type")


@query("f06_lines_of_nodes", relations("nodes", "lines") + "SELECT id FROM lines WHERE start_id IN (SELECT id FROM nodes WHERE node_type = 2) OR end_id IN (SELECT id FROM nodes WHERE node_type = 2)")
def _(d):
    return graph.lines_of_nodes(d.lines(), d.nodes().where("node_type = 2")).select("id")


@query("f07_nodes_of_lines", relations("nodes", "lines") + "SELECT id FROM nodes WHERE id IN (SELECT start_id FROM lines WHERE kcu = 3 UNION SELECT end_id FROM lines WHERE kcu = 3)")
def _(d):
    return graph.nodes_of_lines(d.nodes(), d.lines().where("kcu = 3")).select("id")


@query("f09_linkless_nodes", relations("nodes", "lines") + "SELECT id FROM nodes WHERE id NOT IN (SELECT start_id FROM lines WHERE kcu = 51 UNION SELECT end_id FROM lines WHERE kcu = 51)")
def _(d):
    return graph.linkless(d.nodes(), d.lines().where("kcu = 51")).select("id")


@query("f10_placed", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0")
def _(d):
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).when(F.col("c_custkey") % 2 == 0, -9999.0).otherwise(float("nan"))
    return graph.placed(d.table("customer").select(F.col("c_custkey").alias("id"), x.alias("x")), "x").select("id")


@query("f12_channel_filter", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 10 IN (2, 5)")
def _(d):
    return d.table("orders").where((F.col("o_custkey") % 10 + 100).isin(102, 105)).select(F.col("o_orderkey").alias("id"))


_TS = relations("line_w") + ", v AS (SELECT w.entity_id, w.dt, CASE WHEN w.kcu IN (3, 51, 200) THEN 9999 WHEN w.q = 0 THEN 'inf'::DOUBLE ELSE sqrt((l.x1 - l.x0)**2 + (l.y1 - l.y0)**2) / abs(w.q) END AS v FROM line_w w JOIN lines l ON l.id = w.entity_id)"


@query("f14_ts_rule", _TS + " SELECT entity_id FROM v GROUP BY entity_id HAVING 100.0 * sum(CASE WHEN v < 1 THEN dt ELSE 0 END) / sum(dt) > 10 OR 100.0 * sum(CASE WHEN v < 3 THEN dt ELSE 0 END) / sum(dt) > 50 OR 100.0 * sum(CASE WHEN v < 5 THEN dt ELSE 0 END) / sum(dt) > 80")
def _(d):
    wanted = preset("time step reduction")
    size = d.lines().select(F.col("id").alias("entity_id"), G.length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("length"))
    fast = d.line_ts().withColumn("u1", F.col("q")).join(size, "entity_id")
    return time_aggregate(fast, d.steps(), wanted, START, END).where(style.slows(*(F.col(x.column) for x in wanted))).select("entity_id")


_LEN = "sqrt((x1 - x0)**2 + (y1 - y0)**2)"


@query("f15_courant", relations("line_ts") + f"SELECT entity_id, t, round(abs(u1) * 30 / {_LEN}, 6) AS courant FROM line_ts JOIN lines ON lines.id = entity_id WHERE line_ts.kcu IN (0, 1, 2, 3, 5, 100, 101) AND abs(u1) * 30 / {_LEN} > 0.25")
def _(d):
    size = d.lines().select(F.col("id").alias("entity_id"), G.length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("length"))
    return style.over_courant(d.line_ts().join(size, "entity_id"), 0.25, 30.0).select("entity_id", "t", r("courant").alias("courant"))


@query("f16_min_discharge", relations("line_q") + "SELECT id FROM line_q WHERE abs(q) > 10000000")
def _(d):
    return _line(d, Request("q", "sum", "net")).where(F.abs("q_net_sum") > 10000000).select(F.col("entity_id").alias("id"))


@query("p02_descriptions", relations("nodes") + "SELECT id, CASE node_type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NODE_TYPES.items()) + " ELSE 'unknown' END AS description FROM nodes")
def _(d):
    names = F.create_map(*(F.lit(x) for pair in NODE_TYPES.items() for x in pair))
    return d.nodes().select("id", F.coalesce(F.try_element_at(names, F.col("node_type")), F.lit("unknown")).alias("description"))


@query("p07_turned_lines", relations("lines") + "SELECT id, CASE WHEN kcu = 51 THEN x1 ELSE x0 END AS x, CASE WHEN kcu = 51 THEN y1 ELSE y0 END AS y FROM lines")
def _(d):
    points = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return d.lines().select("id", gauge.turned(points, F.col("kcu") == 51)[0].alias("p")).select("id", "p.x", "p.y")


@query("s05_part", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey >= (SELECT min(s_suppkey) + (max(s_suppkey) - min(s_suppkey) + 1) / 5.0 FROM supplier) AND s_suppkey < (SELECT min(s_suppkey) + (max(s_suppkey) - min(s_suppkey) + 1) / 5.0 * 2 FROM supplier)")
def _(d):
    return readers.part(d.table("supplier").select(F.col("s_suppkey").alias("id")), 2, 5)


@query("k12_write_back", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 4 = 0 THEN NULL ELSE 1.0 END AS level FROM customer")
def _(d):
    rows = d.table("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, 1.0).alias("level"))
    return readers.write_back(rows, d.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("level")), "id", "level")


# --- graph ------------------------------------------------------------------------------------------


@query("j01_end_rows", relations("lines", "nodes") + "SELECT l.id, a.dmax AS start_dmax, b.dmax AS end_dmax FROM lines l JOIN nodes a ON a.id = l.start_id JOIN nodes b ON b.id = l.end_id")
def _(d):
    return graph.with_ends(d.lines(), d.nodes(), "dmax", key="id").select("id", "start_dmax", "end_dmax")


_GRAD = relations("lines", "node_w")


@query("j03_grad_mean", _GRAD + f"SELECT l.id AS entity_id, round(avg((b.s1 - a.s1) / {_LEN}), 6) AS grad_mean FROM lines l JOIN node_w a ON a.entity_id = l.start_id JOIN node_w b ON b.entity_id = l.end_id AND b.t = a.t GROUP BY l.id")
def _(d):
    return time_aggregate(graph.gradients(d.lines(), d.node_ts()), d.steps(), [Request("grad", "mean")], START, END).select("entity_id", r("grad_mean").alias("grad_mean"))


@query("j03_bed_grad", relations("lines", "nodes") + f"SELECT l.id, round((b.dmax - a.dmax) / {_LEN}, 6) AS bed_grad FROM lines l JOIN nodes a ON a.id = l.start_id JOIN nodes b ON b.id = l.end_id")
def _(d):
    return graph.bed_gradients(d.lines(), d.nodes()).select("id", r("bed_grad").alias("bed_grad"))


@query("j04_wl_at_xsec_max", _GRAD + "SELECT l.id AS entity_id, round(max((a.s1 + b.s1) / 2), 6) AS wl_at_xsec_max FROM lines l JOIN node_w a ON a.entity_id = l.start_id JOIN node_w b ON b.entity_id = l.end_id AND b.t = a.t GROUP BY l.id")
def _(d):
    return time_aggregate(graph.levels_between(d.lines(), d.node_ts()), d.steps(), [Request("wl_at_xsec", "max")], START, END).select("entity_id", r("wl_at_xsec_max").alias("wl_at_xsec_max"))


def _flows(d: Derived) -> DataFrame:
    return _line(d, Request("q", "sum", "net")).select(F.col("entity_id").alias("id"), F.col("q_net_sum").alias("q"))


def _per_node(name: str, out: bool) -> None:
    p, n = ("greatest(q, 0)", "least(q, 0)") if out else ("least(q, 0)", "greatest(q, 0)")
    each = f"e AS (SELECT start_id AS id, CASE WHEN q IS NOT NULL THEN abs({p} * c) END AS fx, CASE WHEN q IS NOT NULL THEN abs({p} * s) END AS fy FROM g UNION ALL SELECT end_id, CASE WHEN q IS NOT NULL THEN abs({n} * c) END, CASE WHEN q IS NOT NULL THEN abs({n} * s) END FROM g)"
    g = "g AS (SELECT l.start_id, l.end_id, f.q, cos(atan2(y1 - y0, x1 - x0)) AS c, sin(atan2(y1 - y0, x1 - x0)) AS s FROM lines l JOIN line_q f USING (id))"
    sql = relations("line_q", "lines", "nodes", extra=f"{g}, {each}") + "SELECT n.id, round(CASE WHEN count(e.id) = 0 THEN 0 WHEN count(fx) < count(e.id) THEN NULL ELSE sum(fx) END, 2) AS x, round(CASE WHEN count(e.id) = 0 THEN 0 WHEN count(fy) < count(e.id) THEN NULL ELSE sum(fy) END, 2) AS y FROM nodes n LEFT JOIN e ON e.id = n.id GROUP BY n.id"

    @query(name, sql)
    def _(d):
        return graph.flow_per_node(d.nodes(), d.lines(), _flows(d), out).select("id", r("x", 2).alias("x"), r("y", 2).alias("y"))


_per_node("j05_q_out", True)
_per_node("j05_q_in", False)

#: Gauge lines across the lattice of nodes.
GAUGES = {1: [(31.0, -5.0), (33.0, 400.0)], 2: [(-5.0, 44.0), (300.0, 47.0)], 3: [(77.0, 1000.0), (75.0, -5.0)]}


def _gauges(d: Derived) -> DataFrame:
    rows = [(k, [{"x": x, "y": y} for x, y in v]) for k, v in GAUGES.items()]
    return d.spark.createDataFrame(rows, "gauge int, points array<struct<x: double, y: double>>")


def _side(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f"(({x1} - {x0}) * ({py} - {y0}) - ({y1} - {y0}) * ({px} - {x0}))"


_CROSS = (
    "g AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, (a, b) in GAUGES.items()) + ") t(gauge, gx0, gy0, gx1, gy1)), "
    "sides AS (SELECT g.gauge, l.id, " + f"{_side('gx0', 'gy0', 'x0', 'y0', 'x1', 'y1')} AS a, {_side('gx1', 'gy1', 'x0', 'y0', 'x1', 'y1')} AS b, {_side('x0', 'y0', 'gx0', 'gy0', 'gx1', 'gy1')} AS c, {_side('x1', 'y1', 'gx0', 'gy0', 'gx1', 'gy1')} AS e FROM lines l CROSS JOIN g), "
    "crossed AS (SELECT gauge, id, CASE WHEN c > 0 OR c = 0 AND e < 0 THEN 1 ELSE -1 END AS direction FROM sides WHERE sign(a) * sign(b) <= 0 AND sign(c) * sign(e) <= 0 AND NOT (a = 0 AND b = 0))"
)


@query("j06_gauge_crossings", relations("lines", extra=_CROSS) + "SELECT gauge, id, direction FROM crossed")
def _(d):
    return gauge.crossings(d.lines(), _gauges(d))


@query("a17_gauge_total", relations("lines", "line_q", extra=_CROSS) + "SELECT gauge, round(sum(q * direction), 2) AS total FROM crossed JOIN line_q USING (id) GROUP BY gauge")
def _(d):
    return gauge.totals(gauge.crossings(d.lines(), _gauges(d)), _flows(d)).select("gauge", r("total", 2).alias("total"))


_SERIES = relations("lines", "line_ts", extra=_CROSS + ", s AS (SELECT gauge, t, CASE WHEN count(q) < count(*) THEN NULL ELSE round(sum(q * direction), 4) END AS q FROM crossed c JOIN line_ts l ON l.entity_id = c.id GROUP BY gauge, t)")


@query("a18_gauge_series", _SERIES + "SELECT gauge, t, q FROM s")
def _(d):
    return gauge.discharge_series(gauge.crossings(d.lines(), _gauges(d)), d.line_ts()).select("gauge", "t", r("q", 4).alias("q"))


@query("k02_series_table", _SERIES + "SELECT t, max(q) FILTER (WHERE gauge = 1) AS g1, max(q) FILTER (WHERE gauge = 2) AS g2, max(q) FILTER (WHERE gauge = 3) AS g3 FROM s GROUP BY t")
def _(d):
    series = gauge.discharge_series(gauge.crossings(d.lines(), _gauges(d)), d.line_ts())
    wide = gauge.pivoted(series, [1, 2, 3])
    return wide.select("t", *(r(str(g), 4).alias(f"g{g}") for g in (1, 2, 3)))


_CELLS = "cells AS (SELECT id, x - 5 AS xmin, y - 5 AS ymin, x + 5 AS xmax, y + 5 AS ymax FROM nodes), near AS (SELECT id, id AS start_id, id + 1 AS end_id FROM nodes UNION ALL SELECT id + 100000, id, id + 15 FROM nodes)"


def _cells(d: Derived) -> tuple[DataFrame, DataFrame]:
    cells = d.nodes().selectExpr("id", "x - 5 AS xmin", "y - 5 AS ymin", "x + 5 AS xmax", "y + 5 AS ymax")
    near = d.nodes().selectExpr("id", "id AS start_id", "id + 1 AS end_id").unionByName(d.nodes().selectExpr("id + 100000 AS id", "id AS start_id", "id + 15 AS end_id"))
    return cells, near


_NEAR = relations("nodes", extra=_CELLS) + """SELECT l.id, CASE WHEN a.xmax = b.xmin THEN 'right' ELSE 'top' END AS location, greatest(a.xmin, b.xmin) AS side_xmin, greatest(a.ymin, b.ymin) AS side_ymin, least(a.xmax, b.xmax) AS side_xmax, least(a.ymax, b.ymax) AS side_ymax
FROM near l JOIN cells a ON a.id = l.start_id JOIN cells b ON b.id = l.end_id WHERE (a.xmax = b.xmin OR a.ymax = b.ymin) AND greatest(a.xmin, b.xmin) <= least(a.xmax, b.xmax) AND greatest(a.ymin, b.ymin) <= least(a.ymax, b.ymax)"""


@query("j10_neighbours", _NEAR)
def _(d):
    return leak.cell_pairs(graph.resolved_neighbours(*_cells(d))).drop("start_id", "end_id")


@query("j12_raised_edges", relations("lines") + "SELECT id AS edge, greatest(x0, CASE WHEN kcu = 100 THEN y1 END) AS level FROM lines")
def _(d):
    edges = d.lines().select(F.col("id").alias("edge"), F.col("x0").alias("level"))
    return leak.raised_by_obstacles(edges, d.lines().where("kcu = 100").select(F.col("id").alias("edge"), F.col("y1").alias("crest")))


@query("j16_lines_by_node", relations("lines") + "SELECT node, array_to_string(list_sort(list(id)), ',') AS lines FROM (SELECT id, start_id AS node FROM lines UNION SELECT id, end_id FROM lines) GROUP BY node")
def _(d):
    return graph.lines_by_end(d.lines()).select("node", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("j17_connected_pipes", relations("pipes") + "SELECT a.id, b.id AS other, true AS follows FROM pipes a JOIN pipes b ON b.src = a.dst AND a.id <> b.id UNION ALL SELECT a.id, b.id, false FROM pipes a JOIN pipes b ON b.dst = a.src AND a.id <> b.id")
def _(d):
    return network.connected(d.pipes())


GRADIENTS = [(0.0, 30.0, 0.004), (30.0, 60.0, 0.003), (60.0, 1000.0, 0.002)]
_DISTANCE = "up AS (SELECT dst AS node, max(length) AS way, 1 AS n FROM pipes GROUP BY dst UNION ALL SELECT p.dst, max(p.length + up.way), up.n + 1 FROM up JOIN pipes p ON p.src = up.node GROUP BY p.dst, up.n), far AS (SELECT p.id, p.length + coalesce((SELECT max(way) FROM up WHERE up.node = p.src), 0) AS distance FROM pipes p)"
_CASE = "CASE " + " ".join(f"WHEN distance >= {a} AND distance < {b} THEN {g}::DOUBLE" for a, b, g in GRADIENTS) + " END"


@query("j19_upstream_distance", relations("pipes", extra=_DISTANCE, recursive=True) + "SELECT id, distance FROM far")
def _(d):
    return network.upstream_distance(d.pipes())


def _graded(d: Derived) -> DataFrame:
    table = d.spark.createDataFrame(GRADIENTS, "low double, high double, gradient double")
    return network.gradient_of(network.upstream_distance(d.pipes()), table)


@query("j18_gradient_lookup", relations("pipes", extra=_DISTANCE, recursive=True) + f"SELECT id, distance, {_CASE} AS gradient FROM far")
def _(d):
    return _graded(d)


_INVERT = _DISTANCE + f", g AS (SELECT p.*, coalesce(e.ground, p.ground) AS ground_end, {_CASE} AS gradient FROM pipes p JOIN far USING (id) LEFT JOIN pipes e ON e.id = p.dst), i AS (SELECT *, ground - 1.2 - diameter / 1000 AS s, ground - 1.2 - diameter / 1000 - gradient * length AS e FROM g), j AS (SELECT *, greatest(0, e + diameter / 1000 - (ground_end - 1.2)) AS short FROM i)"


def _inverts(d: Derived) -> DataFrame:
    pipes = d.pipes()
    ends = pipes.select(F.col("id").alias("dst"), F.col("ground").alias("ground_end"))
    joined = pipes.join(_graded(d).select("id", "gradient"), "id").join(ends, "dst", "left").withColumn("ground_end", F.coalesce("ground_end", "ground"))
    return network.invert_levels(joined, 1.2)


@query("m27_invert_levels", relations("pipes", extra=_INVERT, recursive=True) + "SELECT id, round(s - short, 6) AS invert_start, round(e - short, 6) AS invert_end FROM j")
def _(d):
    return _inverts(d).select("id", r("invert_start").alias("invert_start"), r("invert_end").alias("invert_end"))


@query("r40_edited_levels", relations("pipes", extra=_INVERT, recursive=True) + "SELECT id, round(CASE WHEN edit = 1 THEN s - short ELSE -1.0 END, 6) AS invert_start, round(CASE WHEN edit = 1 THEN e - short ELSE -1.1 END, 6) AS invert_end FROM j")
def _(d):
    designed = _inverts(d).withColumn("design_start", F.lit(-1.0)).withColumn("design_end", F.lit(-1.1))
    return network.edited(designed).select("id", r("invert_start").alias("invert_start"), r("invert_end").alias("invert_end"))


#: The same bounds pipe by pipe, tightened in rounds.
_SETTLED = """, b AS (SELECT id, id AS other, 0.0 AS more FROM j UNION ALL SELECT a.id, c.id, -(a.s - a.e) FROM j a JOIN j c ON c.src = a.dst AND c.id <> a.id UNION ALL SELECT c.id, a.id, a.s - a.e + 0.5 FROM j a JOIN j c ON c.src = a.dst AND c.id <> a.id),
levels AS (SELECT id, s - short AS level, 0 AS n FROM j UNION ALL SELECT b.other, min(l.level + b.more), l.n + 1 FROM levels l JOIN b ON b.id = l.id WHERE l.n < 60 GROUP BY b.other, l.n) """


@query("r39_relaxed_levels", relations("pipes", extra=_INVERT + _SETTLED, recursive=True) + "SELECT l.id, round(l.level, 6) AS invert_start, round(l.level - (j.s - j.e), 6) AS invert_end, true AS settled FROM levels l JOIN j USING (id) WHERE l.n = 60")
def _(d):
    settled = network.relax(_inverts(d), 0.5)
    return settled.select("id", r("invert_start").alias("invert_start"), r("invert_end").alias("invert_end"), "settled")


# --- rasters ----------------------------------------------------------------------------------------

GRID = raster.Grid(0.0, 1000.0, 10.0)  # 100 x 100 pixels of 10
BIG = raster.Grid(0.0, 1000.0, 1.0)


@query("s07_window_read", relations("pixels") + "SELECT row, col, z FROM pixels WHERE row BETWEEN 20 AND 39 AND col BETWEEN 10 AND 29")
def _(d):
    return raster.read_window(d.pixels().select("row", "col", "z"), GRID, (100, 600, 300, 800))


@query("s08_padded_read", relations("pixels") + "SELECT r.r::INTEGER AS row, c.c::INTEGER AS col, coalesce(p.z, -9999) AS z FROM range(90, 110) r(r) CROSS JOIN range(95, 105) c(c) LEFT JOIN pixels p ON p.row = r.r AND p.col = c.c")
def _(d):
    return raster.read_window(d.pixels().select("row", "col", "z"), GRID, (950, -100, 1050, 100), pad=True, rounded=True)


@query("s09_overlay", relations("pixels") + "SELECT row, col, CASE WHEN zmax > 45 THEN zmax ELSE z END AS value FROM pixels")
def _(d):
    p = d.pixels()
    both = p.select("row", "col", F.col("z").alias("value"), F.lit(1).alias("p")).unionByName(p.select("row", "col", F.when(F.col("zmax") > 45, F.col("zmax")).otherwise(-9999.0).alias("value"), F.lit(2).alias("p")))
    return raster.overlay(both, "p")


@query("a22_block_mean", relations("pixels") + "SELECT (row // 2)::INTEGER AS row, (col // 2)::INTEGER AS col, round(avg(z), 6) AS value FROM pixels GROUP BY ALL")
def _(d):
    return raster.blocks(d.pixels().withColumnRenamed("z", "value")).withColumn("value", r("value"))


@query("a23_block_uneven", relations("pixels") + "SELECT (row // 3)::INTEGER AS row, (col // 3)::INTEGER AS col, min(z) AS value FROM pixels GROUP BY ALL")
def _(d):
    return raster.blocks(d.pixels().withColumnRenamed("z", "value"), 3, "min")


@query("a24_raster_min_merge", relations("pixels") + "SELECT row, col, min(v) AS value FROM (SELECT row, col, z AS v FROM pixels UNION ALL SELECT row + 50, col, zmax FROM pixels) GROUP BY ALL")
def _(d):
    p = d.pixels()
    return raster.merge([p.select("row", "col", F.col("z").alias("value")), p.select((F.col("row") + 50).alias("row"), "col", F.col("zmax").alias("value"))])


@query("r07_merge_resampled", relations("pixels") + "SELECT row, col, max(v) AS value FROM (SELECT (row * 2 + i)::INTEGER AS row, (col * 2 + j)::INTEGER AS col, z AS v FROM pixels, range(2) a(i), range(2) b(j) UNION ALL SELECT row, col, zmax FROM pixels) GROUP BY ALL")
def _(d):
    p = d.pixels()
    return raster.merge([raster.resample(p.select("row", "col", F.col("z").alias("value")), 2), p.select("row", "col", F.col("zmax").alias("value"))], "max")


@query("m04_nodata_recode", relations("pixels") + "SELECT row, col, CASE WHEN z = 1 THEN -9999 ELSE z END AS z FROM pixels")
def _(d):
    return d.pixels().select("row", "col", raster.recoded(F.col("z"), 1.0).alias("z"))


def _lookup(d: Derived) -> tuple[DataFrame, DataFrame]:
    codes = d.spark.range(1, 31)
    landuse = codes.where("id not in (24, 25)").select(F.col("id").cast("int").alias("Code"), (F.col("id") / 1000).alias("Friction"), (F.col("id") % 5 / 4).alias("Permeability"))
    return landuse, codes.where("id < 22").select(F.col("id").cast("int").alias("Code"), (100 + F.col("id") * 10).cast("double").alias("Max_infiltration_rate"))


@query("m02_reclass", relations("landuse") + "SELECT row, col, code, CASE WHEN code NOT IN (24, 25) THEN round(code / 1000.0::DOUBLE, 6) END AS Friction FROM landuse")
def _(d):
    return raster.reclass(d.landuse().select("row", "col", "code"), _lookup(d)[0], "code", "Code", "Friction").select("row", "col", "code", r("Friction").alias("Friction"))


@query("m03_infiltration", relations("landuse") + "SELECT row, col, CASE WHEN code IN (24, 25) THEN -9999 ELSE (100 + soil * 10) * (code % 5 / 4.0::DOUBLE) END::DOUBLE AS rate FROM landuse")
def _(d):
    use, soil = _lookup(d)
    both = raster.reclass(raster.reclass(d.landuse(), use, "code", "Code", "Permeability"), soil, "soil", "Code", "Max_infiltration_rate")
    return both.select("row", "col", raster.infiltration(F.col("Max_infiltration_rate"), F.col("Permeability")).alias("rate"))


@query("r01_rasterized_cells", relations("nodes") + "SELECT id, (floor((1000 - y - 5) / 5) + i)::INTEGER AS row, (floor((x - 5) / 5) + j)::INTEGER AS col, sumax FROM nodes, range(2) a(i), range(2) b(j)")
def _(d):
    cells = d.nodes().selectExpr("id", "sumax", "x - 5 AS xmin", "y - 5 AS ymin", "x + 5 AS xmax", "y + 5 AS ymax")
    return raster.rasterize(cells, raster.Grid(0.0, 1000.0, 5.0), "id", "sumax").select("id", "row", "col", "sumax")


@query("r04_interpolated", relations("nodes", extra="b AS (SELECT max(y) AS top FROM nodes WHERE x = 140)") + "SELECT r.r::INTEGER AS row, k.k::INTEGER AS col, round(2 * (k.k + 0.5) * 4 - 3 * (200 - (r.r + 0.5) * 4) + 1, 6)::DOUBLE AS value FROM b, range(0, 50) r(r), range(0, 35) k(k) WHERE 200 - (r.r + 0.5) * 4 <= top AND 200 - (r.r + 0.5) * 4 >= 0 AND (k.k + 0.5) * 4 <= 140")
def _(d):
    """Between the nodes of whole rows of 15, which span a rectangle."""
    top = d.nodes().where("x = 140").agg(F.max("y")).first()[0] or 0.0
    centres = d.nodes().where(F.col("y") <= top).select("x", "y", (2 * F.col("x") - 3 * F.col("y") + 1).alias("value"))
    return raster.interpolate_linear(centres, raster.Grid(0.0, 200.0, 4.0), tile=16, halo=8).withColumn("value", r("value"))


@query("r03_presample", relations("nodes") + "SELECT id, round(sumax / 4, 6) AS split, round(sumax / 2, 6) AS scaled FROM nodes")
def _(d):
    return d.nodes().select("id", r(raster.before_resampling(F.col("sumax"), F.lit(10.0), 5.0, "split")).alias("split"), r(raster.before_resampling(F.col("sumax"), F.lit(10.0), 5.0, "1d")).alias("scaled"))


@query("r06_stacked_bands", relations("pixels") + "SELECT row, col, z AS a, CASE WHEN zmax > 40 THEN zmax END AS b FROM pixels")
def _(d):
    p = d.pixels()
    return raster.stacked({"a": p.select("row", "col", F.col("z").alias("value")), "b": p.where("zmax > 40").select("row", "col", F.col("zmax").alias("value"))})


def _points(d: Derived) -> DataFrame:
    return d.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 1100 + 0.25).alias("x"), (F.col("c_custkey") * 13 % 1000 + 0.75).alias("y"))


_POINTS = "points AS (SELECT c_custkey AS id, c_custkey * 7 % 1100 + 0.25::DOUBLE AS x, c_custkey * 13 % 1000 + 0.75::DOUBLE AS y FROM customer)"


@query("r17_surface_level", relations("pixels", extra=_POINTS) + "SELECT p.id, q.z FROM points p LEFT JOIN pixels q ON q.row = floor((1000 - p.y) / 10) AND q.col = floor(p.x / 10)")
def _(d):
    return raster.sample(_points(d), d.pixels(), GRID, "z").select("id", "z")


_ZONAL = relations("pixels", extra=_POINTS + ", near AS (SELECT p.id, min(q.z) AS lowest FROM points p JOIN pixels q ON q.row BETWEEN floor((1000 - p.y) / 10) - 4 AND floor((1000 - p.y) / 10) + 4 AND q.col BETWEEN floor(p.x / 10) - 4 AND floor(p.x / 10) + 4 AND ((q.col + 0.5) * 10 - p.x) ** 2 + (1000 - (q.row + 0.5) * 10 - p.y) ** 2 <= 900 GROUP BY p.id)")


@query("a21_zonal_min", _ZONAL + "SELECT id, lowest FROM near")
def _(d):
    return raster.zonal_min(_points(d), d.pixels(), GRID, 30.0, "z")


@query("r16_drain_level", _ZONAL + "SELECT p.id, CASE WHEN p.id % 2 = 0 AND p.id % 5 <> 0 AND lowest IS NOT NULL THEN lowest WHEN p.id % 5 = 0 THEN 3.0 END::DOUBLE AS drain_level FROM points p LEFT JOIN near USING (id)")
def _(d):
    manholes = _points(d).withColumn("calculation_type", F.when(F.col("id") % 2 == 0, "connected").otherwise("isolated")).withColumn("drain_level", F.when(F.col("id") % 5 == 0, 3.0))
    return sampling.drain_level(manholes, d.pixels(), GRID, 30.0, value="z").select("id", "drain_level")


def _levees(d: Derived) -> DataFrame:
    """Horizontal lines through the middle of pixel rows."""
    i = F.col("s_suppkey")
    y = 1000 - (i * 3 % 100 + 0.5) * 10
    x = (i * 10 % 500).cast("double")
    return d.table("supplier").select(i.alias("id"), F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 200).alias("x"), y.alias("y"))).alias("points"))


_ALONG = "v AS (SELECT s.s_suppkey AS id, q.col, max(q.z) AS z, min(q.z) AS low FROM supplier s JOIN pixels q ON q.row = s.s_suppkey * 3 % 100 AND q.col >= s.s_suppkey % 50 AND q.col < s.s_suppkey % 50 + 20 GROUP BY ALL), wide AS (SELECT s.s_suppkey AS id, q.col, min(q.z) AS low FROM supplier s JOIN pixels q ON abs(q.row - s.s_suppkey * 3 % 100) <= 1 AND q.col >= s.s_suppkey % 50 AND q.col < s.s_suppkey % 50 + 20 GROUP BY ALL)"


@query("r13_crest_level", relations("pixels", extra=_ALONG) + "SELECT id, round(avg(z), 6) AS level FROM v GROUP BY id")
def _(d):
    return sampling.crest_level(_levees(d), d.pixels(), GRID, value="z").select("id", r("level").alias("level"))


@query("r14_breach_depth", relations("pixels", extra=_ALONG) + "SELECT id, round((SELECT avg(z) FROM v WHERE v.id = wide.id) - avg(low), 6) AS depth FROM wide WHERE id IN (SELECT id FROM v) GROUP BY id")
def _(d):
    return sampling.breach_depth(_levees(d), d.pixels(), GRID, 10.0, value="z").select("id", r("depth").alias("depth"))


@query("r15_bank_level", relations("pixels") + """SELECT id, round(least(l, rr), 3) AS bank_level FROM (SELECT c.c_custkey AS id, max(q.z) FILTER (WHERE q.row < c.c_custkey % 100) AS l, max(q.z) FILTER (WHERE q.row > c.c_custkey % 100) AS rr
FROM customer c JOIN pixels q ON q.col = c.c_custkey // 3 % 100 AND abs(q.row - c.c_custkey % 100) BETWEEN 1 AND 3 GROUP BY c.c_custkey)""")
def _(d):
    i = F.col("c_custkey")
    sections = d.table("customer").select(i.alias("id"), ((F.floor(i / 3) % 100 + 0.5) * 10).alias("x"), (1000 - (i % 100 + 0.5) * 10).alias("y"), F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(60.0).alias("width"))
    return sampling.bank_level(sections, d.pixels(), GRID, value="z")


@query("r18_split_samples", relations("pixels") + "SELECT s.s_suppkey AS id, count(q.z) AS n, round(avg(q.z), 6) AS height FROM supplier s CROSS JOIN range(4) p(p) LEFT JOIN pixels q ON q.row = s.s_suppkey * 3 % 100 AND q.col = floor((s.s_suppkey * 10 % 500 + 25 + p.p * 50) / 10) GROUP BY s.s_suppkey")
def _(d):
    ends = sampling.segments(_levees(d)).drop("segment")
    points = lines.split_every(ends, 50.0)
    return raster.sample(points, d.pixels(), GRID, "z").groupBy("id").agg(F.count("z").alias("n"), r(F.avg("z")).alias("height"))


@query("r09_pixelized", relations("lines") + """SELECT id, count(*) AS n FROM (SELECT DISTINCT id, round(u, 9) AS u FROM (SELECT id, 0.0::DOUBLE AS u FROM lines UNION ALL SELECT id, 1.0 FROM lines
UNION ALL SELECT id, (i * 7.0 - x0) / (x1 - x0) FROM lines, range(-10, 3000) r(i) WHERE x0 <> x1 AND i * 7.0 BETWEEN least(x0, x1) AND greatest(x0, x1)
UNION ALL SELECT id, (i * 7.0 - y0) / (y1 - y0) FROM lines, range(-10, 3000) r(i) WHERE y0 <> y1 AND i * 7.0 BETWEEN least(y0, y1) AND greatest(y0, y1))) GROUP BY id""")
def _(d):
    parts = xsec.dealt(d.lines().select("id", F.lit(0).alias("segment"), "x0", "y0", "x1", "y1"), "id")
    return sampling.pixelized(parts, raster.Grid(0.0, 0.0, 7.0)).groupBy("id").agg(F.count("*").alias("n"))


@query("r10_projected", relations("lines") + f"SELECT id, round(u * {_LEN}, 6) AS place, round(sqrt((px - x0 - u * (x1 - x0)) ** 2 + (py - y0 - u * (y1 - y0)) ** 2), 6) AS away FROM (SELECT *, least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0), 1) AS u FROM (SELECT *, id * 3 % 150 + 0.5::DOUBLE AS px, id * 7 % 100 + 0.25::DOUBLE AS py FROM lines))")
def _(d):
    parts = d.lines().select("id", F.lit(0).alias("segment"), "x0", "y0", "x1", "y1")
    points = d.lines().select(F.col("id").alias("pid"), "id", (F.col("id") * 3 % 150 + 0.5).alias("x"), (F.col("id") * 7 % 100 + 0.25).alias("y"))
    return sampling.project(points, parts).select("id", r("place").alias("place"), r("away").alias("away"))


# --- runs, windows, sets ----------------------------------------------------------------------------

_STEP = "SELECT o_custkey AS chain, o_orderkey AS place, round(o_totalprice / 1000, 3) AS v, (1 + o_orderkey % 5)::DOUBLE AS len FROM orders"


def _chains(d: Derived) -> DataFrame:
    return d.table("orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("place"), F.round(F.col("o_totalprice") / 1000, 3).alias("v"), (1 + F.col("o_orderkey") % 5).cast("double").alias("len"))


_RUNS = f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY place) AS k FROM ({_STEP})),
f AS (SELECT chain, place, v, len, k, v AS lo, v AS hi, 0 AS run FROM c WHERE k = 1 UNION ALL
SELECT c.chain, c.place, c.v, c.len, c.k, CASE WHEN greatest(f.hi, c.v) - least(f.lo, c.v) > 100 THEN c.v ELSE least(f.lo, c.v) END, CASE WHEN greatest(f.hi, c.v) - least(f.lo, c.v) > 100 THEN c.v ELSE greatest(f.hi, c.v) END, f.run + (greatest(f.hi, c.v) - least(f.lo, c.v) > 100)::INTEGER FROM f JOIN c ON c.chain = f.chain AND c.k = f.k + 1) """


@query("w05_range_runs", _RUNS + "SELECT chain, place, run::BIGINT AS run FROM f")
def _(d):
    return lines.range_runs(_chains(d), "chain", "place", "v", 100.0).select("chain", "place", "run")


_LONG = _RUNS.replace(f"({_STEP})", "(SELECT o_orderpriority AS chain, o_orderkey AS place, round(o_totalprice / 1000, 3)::DOUBLE AS v, 1 AS len FROM orders)")


@query("w05_long_chains", _LONG + "SELECT chain, place, run::BIGINT AS run FROM f")
def _(d):
    rows = d.table("orders").select(F.col("o_orderpriority").alias("chain"), F.col("o_orderkey").alias("place"), F.round(F.col("o_totalprice") / 1000, 3).cast("double").alias("v"))
    return lines.range_runs(rows, "chain", "place", "v", 100.0, slice_rows=200).select("chain", "place", "run")


@query("a34_run_statistics", _RUNS + "SELECT chain, run::BIGINT AS run, count(*) AS n, round(sum(v * len) / sum(len), 9) AS mean, min(v) AS lowest, max(v) AS highest, sum(len) AS length FROM f GROUP BY chain, run")
def _(d):
    runs = lines.range_runs(_chains(d), "chain", "place", "v", 100.0)
    return lines.run_statistics(runs, "chain", "v", "len").withColumn("mean", r("mean", 9))


@query("a19_weighted_mean", f"SELECT chain, round(sum(v * len) / sum(len), 9) AS mean FROM ({_STEP}) GROUP BY chain")
def _(d):
    return lines.weighted_mean(_chains(d), "chain", "v", "len").withColumn("mean", r("mean", 9))


@query("w06_moving_mean", f"SELECT chain, place, round(avg(v) OVER (PARTITION BY chain ORDER BY place ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS moved FROM ({_STEP})")
def _(d):
    return lines.moving(_chains(d), "chain", "place", "v", 2, "mean").select("chain", "place", r("moved").alias("moved"))


@query("w07_moving_min", f"SELECT chain, place, min(v) OVER (PARTITION BY chain ORDER BY place ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS moved FROM ({_STEP})")
def _(d):
    return lines.moving(_chains(d), "chain", "place", "v", 1, "min").select("chain", "place", "moved")


@query("a25_grouped_points", f"SELECT chain, grp, round(avg(place), 6) AS x, round(avg(len), 6) AS y, max(v) AS v FROM (SELECT *, ((row_number() OVER (PARTITION BY chain ORDER BY place) - 1) // 3)::BIGINT AS grp FROM ({_STEP})) GROUP BY chain, grp")
def _(d):
    rows = _chains(d).withColumn("x", F.col("place")).withColumn("y", F.col("len"))
    return lines.groups_of(rows, "chain", 3, "v").select("chain", F.col("grp").cast("long").alias("grp"), r("x").alias("x"), r("y").alias("y"), "v")


@query("w13_cut_points", "SELECT id, coalesce((lag(p) OVER w + p) / 2, 0)::DOUBLE AS low, coalesce((lead(p) OVER w + p) / 2, 1000)::DOUBLE AS high FROM (SELECT o_orderkey AS id, o_custkey AS channel, (o_orderkey * 37 % 1000)::DOUBLE AS p FROM orders) WINDOW w AS (PARTITION BY channel ORDER BY p, id)")
def _(d):
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("channel"), (F.col("o_orderkey") * 37 % 1000).cast("double").alias("position"), F.lit(1000.0).alias("length"))
    return sampling.cut_points(rows).select("id", "low", "high")


@query("a26_distinct", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def _(d):
    return d.table("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).distinct()


@query("a27_highest", f"SELECT chain, place, v FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY v DESC, place DESC) AS k FROM ({_STEP})) WHERE k = 1")
def _(d):
    return leak.highest_of(_chains(d), "chain", "v", "place").select("chain", "place", "v")


@query("a27_lowest", f"SELECT chain, place, v FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY v, place DESC) AS k FROM ({_STEP})) WHERE k = 1")
def _(d):
    return leak.lowest_of(_chains(d), "chain", "v", "place").select("chain", "place", "v")


@query("a28_exchange_levels", "SELECT edge, min(z) AS level FROM (SELECT l_orderkey AS edge, l_linenumber // 2 AS place, max(l_quantity) AS z FROM lineitem GROUP BY ALL) GROUP BY edge")
def _(d):
    return leak.exchange_levels(d.table("lineitem").select(F.col("l_orderkey").alias("edge"), F.floor(F.col("l_linenumber") / 2).alias("place"), F.col("l_quantity").alias("z")))


_BEDS = "b AS (SELECT l_orderkey AS id, l_quantity AS z FROM lineitem)"


def _beds(d: Derived) -> DataFrame:
    return d.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("beds"))


@query("a29_wet_area", f"WITH {_BEDS} SELECT id, round(sum(greatest(30 - greatest(z, 12), 0)) * 0.5, 6) AS area FROM b GROUP BY id")
def _(d):
    return _beds(d).select("id", r(leak.wet_area(F.col("beds"), F.lit(30.0), F.lit(12.0), F.lit(0.5))).alias("area"))


@query("a30_perimeter", f"WITH {_BEDS} SELECT id, round(sum((greatest(z, 12) < 30)::INTEGER) * 0.5::DOUBLE, 6) AS perimeter FROM b GROUP BY id")
def _(d):
    return _beds(d).select("id", r(leak.wet_perimeter(F.col("beds"), F.lit(30.0), F.lit(12.0), F.lit(0.5))).alias("perimeter"))


@query("m12_reduction", f"WITH {_BEDS}, s AS (SELECT id, sum(greatest(30 - z, 0)) AS a1, sum((z < 30)::INTEGER) AS p1, sum(greatest(30 - greatest(z, 20), 0)) AS a2, sum((greatest(z, 20) < 30)::INTEGER) AS p2 FROM b GROUP BY id) SELECT id, round(CASE WHEN a1 <= 0 OR a2 <= 0 THEN 0 ELSE sqrt(a2 / p2) / sqrt(a1 / p1) END, 6) AS factor FROM s")
def _(d):
    return _beds(d).select("id", r(leak.reduction(F.col("beds"), F.lit(30.0), F.lit(None).cast("double"), F.lit(20.0), F.lit(1.0))).alias("factor"))


@query("a31_discharge_reduction", 'SELECT l_orderkey AS id, round(sum(l_quantity * l_linenumber), 6) AS "without", round(sum(l_quantity * (1 - l_discount) * l_linenumber), 6) AS "with", round(abs(sum(l_quantity * l_linenumber) - sum(l_quantity * (1 - l_discount) * l_linenumber)), 6) AS reduced FROM lineitem GROUP BY l_orderkey')
def _(d):
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q"), (1 - F.col("l_discount")).alias("factor"), F.col("l_linenumber").alias("dt"))
    return leak.discharge_reduction(rows).select("id", *(r(c).alias(c) for c in ("without", "with", "reduced")))


@query("a35_classes", "SELECT i::INTEGER AS class, round(lo + (hi - lo) / 10 * i, 4) AS low, round(lo + (hi - lo) / 10 * (i + 1), 4) AS high FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), range(10) r(i)")
def _(d):
    return style.classes(d.table("customer"), "c_acctbal").select("class", r("low", 4).alias("low"), r("high", 4).alias("high"))


@query("u05_common_ids", relations("lines") + "SELECT start_id AS id FROM lines WHERE kcu = 3 INTERSECT SELECT end_id FROM lines")
def _(d):
    return d.lines().where("kcu = 3").select(F.col("start_id").alias("id")).intersect(d.lines().select(F.col("end_id").alias("id")))


@query("u10_greatest_level", relations("pipes") + "SELECT id, greatest(ground, 2.5) AS crest FROM pipes WHERE id IN (SELECT dst FROM pipes)")
def _(d):
    return d.pipes().join(d.pipes().select(F.col("dst").alias("id")), "id", "left_semi").select("id", F.greatest("ground", F.lit(2.5)).alias("crest"))


# --- scalars ----------------------------------------------------------------------------------------


@query("m01_interpolated", "SELECT p_partkey AS id, round(CASE WHEN p_size <= 5 THEN 1.0 WHEN p_size < 20 THEN 1 + (p_size - 5) / 15.0 * 2 WHEN p_size < 40 THEN 3 - (p_size - 20) / 20.0 ELSE 2 END::DOUBLE, 6) AS v FROM part")
def _(d):
    xs, ys = (F.array(*map(F.lit, v)) for v in ((5.0, 20.0, 40.0), (1.0, 3.0, 2.0)))
    return d.table("part").select(F.col("p_partkey").alias("id"), r(G.interpolate(F.col("p_size").cast("double"), xs, ys)).alias("v"))


def _xy():
    return tuple(map(F.col, ("x0", "y0", "x1", "y1")))


@query("m05_lengths", relations("lines") + f"SELECT id, round({_LEN}, 6) AS length FROM lines")
def _(d):
    points = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return d.lines().select("id", r(G.polyline_length(points)).alias("length"))


@query("m06_angles", relations("lines") + "SELECT id, round(atan2(y1 - y0, x1 - x0), 6) AS angle, round(cos(atan2(y1 - y0, x1 - x0)), 6) AS c, round(sin(atan2(y1 - y0, x1 - x0)), 6) AS s FROM lines")
def _(d):
    a = G.angle(*_xy())
    return d.lines().select("id", r(a).alias("angle"), r(F.cos(a)).alias("c"), r(F.sin(a)).alias("s"))


@query("m08_azimuth", relations("lines") + "SELECT id, round(CASE WHEN atan2(x1 - x0, y1 - y0) < 0 THEN degrees(atan2(x1 - x0, y1 - y0)) + 360 ELSE degrees(atan2(x1 - x0, y1 - y0)) END, 6) AS azimuth FROM lines")
def _(d):
    return d.lines().select("id", r(G.azimuth(*_xy())).alias("azimuth"))


@query("m10_bends", relations("lines") + "SELECT a.id, b.id AS other, round(abs(degrees(atan2((a.x0 - a.x1) * (b.y1 - a.y1) - (a.y0 - a.y1) * (b.x1 - a.x1), (a.x0 - a.x1) * (b.x1 - a.x1) + (a.y0 - a.y1) * (b.y1 - a.y1)))), 6) AS angle FROM lines a JOIN lines b ON b.start_id = a.end_id AND a.id <> b.id")
def _(d):
    pipes = d.lines().select("id", F.col("start_id").alias("src"), F.col("end_id").alias("dst"), *_xy())
    return network.bend(pipes).withColumn("angle", r(F.abs("angle")))


@query("m11_left_of_line", relations("nodes") + "SELECT id, CASE WHEN 300 * (y - 3) - 200 * (x - 2) > 0 THEN true WHEN 300 * (y - 3) - 200 * (x - 2) < 0 THEN false END AS is_left FROM nodes")
def _(d):
    return d.nodes().select("id", G.left_of(F.col("x"), F.col("y"), *map(F.lit, (2.0, 3.0, 302.0, 203.0))).alias("is_left"))


@query("m14_balance", "SELECT o_orderkey AS id, round(coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END, 0) - coalesce(o_custkey, 0), 4) AS balance FROM orders")
def _(d):
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("p"), F.col("o_custkey").cast("double").alias("n"))
    return rows.select("id", r(style.balance(["p", ""], ["n"]), 4).alias("balance"))


@query("m15_level_change", relations("node_w") + "SELECT entity_id, round(coalesce((array_agg(s1 ORDER BY t))[-1], any_value(dmax)) - coalesce((array_agg(s1 ORDER BY t))[1], any_value(dmax)), 6) AS change FROM node_w JOIN nodes ON nodes.id = entity_id GROUP BY entity_id")
def _(d):
    ends = _node(d, Request("s1", "first"), Request("s1", "last")).join(d.nodes().select(F.col("id").alias("entity_id"), "dmax"), "entity_id")
    return ends.select("entity_id", r(style.level_change(F.col("s1_first"), F.col("s1_last"), F.col("dmax"))).alias("change"))


@query("m16_vector", relations("lines") + "SELECT id, round(sqrt(x1 * x1 + y1 * y1), 6) AS size, round(degrees(atan2(x1, y1)), 6) AS rotation FROM lines")
def _(d):
    return d.lines().select("id", r(style.resultant(F.col("x1"), F.col("y1"))).alias("size"), r(style.rotation(F.col("x1"), F.col("y1"))).alias("rotation"))


@query("m17_flow_direction", relations("line_ts") + "SELECT entity_id, t, (90 + CASE WHEN q < 0 THEN -90 ELSE 90 END)::DOUBLE AS rotation, round(1 + least(greatest((abs(q) - 10) / 200, 0), 1) * 4, 6) AS width FROM line_ts WHERE q IS NOT NULL")
def _(d):
    q = F.col("q")
    return d.line_ts().where("q is not null").select("entity_id", "t", style.flow_rotation(q, F.lit(90.0)).alias("rotation"), r(style.rescale(q, F.lit(10.0), F.lit(210.0), 1.0, 5.0)).alias("width"))


@query("m32_wkt", relations("nodes") + "SELECT id, 'POLYGON ((' || x || ' ' || y || ', ' || (x + 10) || ' ' || y || ', ' || (x + 10) || ' ' || (y + 10) || ', ' || x || ' ' || (y + 10) || ', ' || x || ' ' || y || '))' AS wkt FROM nodes")
def _(d):
    return d.nodes().select("id", G.wkt_box(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 10).alias("wkt"))


@query("m23_max_width", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN greatest(p_size, 7)::DOUBLE WHEN 2 THEN greatest(p_size, 7)::DOUBLE ELSE 1.0 END AS width FROM part")
def _(d):
    shape = F.element_at(F.array(*map(F.lit, (1, 5, 6, 7))), (F.col("p_size") % 4 + 1).cast("int"))
    table = F.concat(F.lit("0,"), F.col("p_size").cast("string"), F.lit("\n1,7"))
    return d.table("part").select(F.col("p_partkey").alias("id"), xsec.max_width(shape, F.col("p_retailprice"), table).alias("width"))


# --- scenarios --------------------------------------------------------------------------------------


def _scenarios(d: Derived) -> DataFrame:
    """A scenario for each customer: three results, the second without a raster."""
    i = F.col("c_custkey").cast("string")
    result = lambda code, name, url, raster_: F.concat(F.lit(f'{{"result_type": {{"code": "{code}", "name": "{name}"}}, "attachment_url": '), url, F.lit(f', "raster": {raster_}}}'))
    link = F.when(F.col("c_custkey") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"u/'), i, F.lit('"')))
    text = F.concat(
        F.lit('{"name": "'), F.col("c_name"), F.lit('", "uuid": "'), i, F.lit('", "result_set": ['),
        result("depth-max-dtri", "Depth", link, '{"uuid": "r1", "temporal": false}'), F.lit(", "), result("logfiles", "Log", F.lit('"log"'), "null"), F.lit(", "),
        result("s1-dtri", "Level", F.lit("null"), '{"uuid": "r3", "temporal": true, "first_value_timestamp": 1704067200000, "last_value_timestamp": 1704085200000}'), F.lit("]}"),
    )
    return readers.scenarios(d.table("customer").select(text.alias("value")))


@query("m33_result_link", "SELECT c_custkey::VARCHAR AS uuid, CASE WHEN c_custkey % 3 <> 0 THEN 'u/' || c_custkey END AS link FROM customer")
def _(d):
    return _scenarios(d).select("uuid", scenario.link(F.col("result_set"), "depth-max-dtri").alias("link"))


@query("m34_attachments", "SELECT c_custkey::VARCHAR AS uuid, CASE WHEN c_custkey % 3 <> 0 THEN 2 ELSE 1 END AS n FROM customer")
def _(d):
    return _scenarios(d).select("uuid", F.size(scenario.attachments(F.col("result_set"))).alias("n"))


@query("m35_rasters", "SELECT c_name AS scenario, code, temporal FROM customer, (VALUES ('depth-max-dtri', false), ('s1-dtri', true)) v(code, temporal)")
def _(d):
    return scenario.rasters(_scenarios(d)).select("scenario", "code", "temporal")


@query("d01_steps", "SELECT c_name AS scenario, strftime(make_timestamp((1704067200 + s * 7200) * 1000000), '%Y-%m-%dT%H:%M:%S') AS step FROM customer, range(3) r(s) UNION ALL SELECT c_name, '2024-01-01T05:00:00' FROM customer")
def _(d):
    return scenario.steps(scenario.rasters(_scenarios(d), True), 2.0).select("scenario", "step")


@query("d01_three_steps", "SELECT c_name AS scenario, s AS step FROM customer, (VALUES ('2024-01-01T00:00:00'), ('2024-01-01T03:00:00'), ('2024-01-01T05:00:00')) v(s)")
def _(d):
    return scenario.steps(scenario.rasters(_scenarios(d), True), None).select("scenario", "step")


@query("d03_step_labels", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'depth_20240101T000000' ELSE 'depth_get_20240101T000500_got_20240101T000000' END AS label FROM orders")
def _(d):
    asked = F.when(F.col("o_orderkey") % 2 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:05:00")
    return d.table("orders").select(F.col("o_orderkey").alias("id"), scenario.step_label(F.lit("depth"), asked, F.lit("2024-01-01T00:00:00")).alias("label"))


@query("s13_find_scenarios", "SELECT c_name AS name FROM customer WHERE lower(c_name) LIKE '%00%' ORDER BY c_name LIMIT 10")
def _(d):
    return readers.find(_scenarios(d), 10, name="00").select("name")


# --- without a form in SQL --------------------------------------------------------------------------


@query("r26_obstacles")
def _(d):
    p = d.pixels()
    pair = (F.floor(F.col("row") / 10) * 5 + F.floor(F.col("col") / 20)).cast("long")
    low = p.groupBy(pair.alias("pair")).agg(F.min("z").alias("lowest"))
    return leak.find_obstacles(p.withColumn("pair", pair).join(low, "pair").select("pair", "row", "col", "z", "lowest"), "pair", 0.5)


def _channels(d: Derived) -> DataFrame:
    point = lambda a, b, z: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"), z.cast("double").alias("z"))
    i = F.col("s_suppkey")
    return d.table("supplier").select(i.alias("id"), F.array(point(i * 3 % 500 + 20, i * 7 % 800 + 20, i % 5), point(i * 3 % 500 + 70, i * 7 % 800 + 40, i % 5 + 1), point(i * 3 % 500 + 130, i * 7 % 800 + 30, i % 5 + 2)).alias("points"))


@query("r35_channel_mesh")
def _(d):
    return xsec.mesh(_channels(d), [-5.0, -1.0, 0.0, 1.0, 5.0])


@query("r38_level_channels", """WITH ch AS (SELECT s_suppkey * 3 % 400 + 20 AS x0, s_suppkey * 7 % 800 + 20 AS y0, s_suppkey % 5 AS z0 FROM supplier)
SELECT (995 - y0 + r.r)::INTEGER AS row, (x0 + k.k)::INTEGER AS col, round(min(z0 + 3 * (k.k + 0.5) / 60), 6)::DOUBLE AS value FROM ch, range(10) r(r), range(60) k(k) GROUP BY 1, 2""")
def _(d):
    """Channels that run to the right and rise evenly: their pixels are a rectangle's, at the height of the place along it."""
    i = F.col("s_suppkey")
    point = lambda x, z: F.struct((i * 3 % 400 + 20 + x).cast("double").alias("x"), (i * 7 % 800 + 20).cast("double").alias("y"), (i % 5 + z).cast("double").alias("z"))
    channels = d.table("supplier").select(i.alias("id"), F.array(point(0, 0), point(20, 1), point(60, 3)).alias("points"))
    return raster.merge([xsec.triangle_pixels(xsec.mesh(channels, [-5.0, 0.0, 5.0]), BIG)]).withColumn("value", r("value"))


@query("r38_mesh_pixels")
def _(d):
    return raster.merge([xsec.triangle_pixels(xsec.mesh(_channels(d), [-5.0, 0.0, 5.0]), BIG)])
