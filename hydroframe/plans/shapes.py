"""Further registered queries: sets, geometry, cross-sections, cells and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions import geometry as G
from hydroframe.functions import requests
from hydroframe.operators import cells, detect, gauge, graph, leak, lines, network, raster, sampling, scenario, sections, style, window, xsec
from hydroframe.plans.catalogue import _ALONG, _BEDS, _CROSS, _INVERT, _LEN, _NEAR, _SERIES, GRADIENTS, GRID, _cells, _flows, _gauges, _inverts, _levees, _scenarios, query, r
from hydroframe.plans.inventory import _REQUESTS, _requests
from hydroframe.plans.sql import relations
from hydroframe.sources import readers
from hydroframe.sources.derived import Derived

c = F.col


def _xy():
    return tuple(map(c, ("x0", "y0", "x1", "y1")))


def _pair(x0, y0, x1, y1):
    return F.array(F.struct(x0.alias("x"), y0.alias("y")), F.struct(x1.alias("x"), y1.alias("y")))


# --- sets and windows -------------------------------------------------------------------------------


@query("u01_stacked_flows", relations("lines", "line_q") + "SELECT id, round(sum(p), 2) AS p, count(*) AS n FROM (SELECT start_id AS id, greatest(q, 0) AS p FROM lines JOIN line_q USING (id) UNION ALL SELECT end_id, least(q, 0) FROM lines JOIN line_q USING (id)) GROUP BY id")
def _(d):
    both = d.lines().join(_flows(d), "id")
    stacked = both.select(c("start_id").alias("id"), F.greatest("q", F.lit(0.0)).alias("p")).unionByName(both.select(c("end_id").alias("id"), F.least("q", F.lit(0.0)).alias("p")))
    return stacked.groupBy("id").agg(r(F.sum("p"), 2).alias("p"), F.count("*").alias("n"))


@query("u02_zero_flow_nodes", relations("nodes", "lines") + "SELECT id, n FROM (SELECT end_id AS id, count(*) AS n FROM lines WHERE kcu = 51 GROUP BY end_id) UNION ALL SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT end_id FROM lines WHERE kcu = 51)")
def _(d):
    met = d.lines().where("kcu = 51").groupBy(c("end_id").alias("id")).agg(F.count("*").alias("n"))
    return met.unionByName(d.nodes().select("id").join(met, "id", "left_anti").withColumn("n", F.lit(0).cast("long")))


@query("u03_gauge_columns", _SERIES + "SELECT t, count(q) FILTER (WHERE gauge = 1) AS a, count(q) FILTER (WHERE gauge = 3) AS b FROM s GROUP BY t")
def _(d):
    series = gauge.discharge_series(gauge.crossings(d.lines(), _gauges(d)), d.line_ts())
    wide = gauge.pivoted(series, [1, 3])
    return wide.select("t", *(F.when(c(k).isNull(), 0).otherwise(1).cast("long").alias(n) for k, n in (("1", "a"), ("3", "b"))))


@query("u04_union_text", "SELECT s_suppkey AS id, 'SELECT ' || array_to_string([printf('%.6f', s_suppkey::DOUBLE) || ' AS ' || n FOR n IN ['x1', 'y1', 'z1', 'x2', 'y2', 'z2', 'x3', 'y3', 'z3']], ', ') AS sql FROM supplier")
def _(d):
    i = c("s_suppkey").cast("double")
    one = d.table("supplier").select(c("s_suppkey").alias("id"), *(i.alias(f"{a}{k}") for k in (1, 2, 3) for a in "xyz"))
    return xsec.as_query(one.unionByName(one))


@query("u06_offsets_with_zero", "SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list(l_linenumber - 3) || [0])), ',') AS offsets FROM lineitem GROUP BY l_orderkey")
def _(d):
    rows = d.table("lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.collect_set((c("l_linenumber") - 3).cast("int")).alias("o"))
    return rows.select("id", F.array_join(F.transform(F.array_sort(F.array_union("o", F.array(F.lit(0)))), lambda v: v.cast("string")), ",").alias("offsets"))


@query("u07_unique_offsets", "SELECT id, count(DISTINCT v)::INTEGER AS n, min(v) AS lowest FROM (SELECT l_orderkey AS id, trunc((l_discount - 0.05) * 1000) / 1000 AS v FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 0 FROM lineitem) GROUP BY id")
def _(d):
    rows = d.table("lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.array(F.collect_list(c("l_discount") - 0.05)).alias("o"))
    found = rows.select("id", xsec.unique_offsets_of(c("o")).alias("o"))
    return found.select("id", F.size("o").alias("n"), F.array_min("o").alias("lowest"))


@query("u08_replaced_settings", "SELECT r_regionkey AS id, 0 AS infiltration_rate, 'rasters/infiltration.tif' AS infiltration_rate_file FROM region")
def _(d):
    return readers.replaced_settings(d.table("region").select(c("r_regionkey").alias("id")), readers.INFILTRATION)


@query("u09_null_where", "SELECT n_nationkey AS id, CASE WHEN n_regionkey <> 2 THEN n_name END AS name FROM nation")
def _(d):
    rows = d.table("nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"), "n_regionkey")
    return readers.without(rows, "name", c("n_regionkey") == 2).select("id", "name")


@query("u11_except", relations("lines") + "SELECT start_id AS id FROM lines EXCEPT SELECT end_id FROM lines WHERE kcu <> 100")
def _(d):
    return d.lines().select(c("start_id").alias("id")).subtract(d.lines().where("kcu <> 100").select(c("end_id").alias("id")))


@query("w08_greatest_of_row", "SELECT l_orderkey AS id, l_linenumber AS place, list_position(v, list_max(v))::INTEGER - 1 AS at FROM (SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice / 1000, l_discount * 500] AS v FROM lineitem)")
def _(d):
    v = F.array(c("l_quantity"), c("l_extendedprice") / 1000, c("l_discount") * 500)
    return d.table("lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("place"), (F.array_position(v, F.array_max(v)).cast("int") - 1).alias("at"))


@query("w09_consecutive", "SELECT o_custkey AS id, x0, x1 FROM (SELECT o_custkey, o_orderkey::DOUBLE AS x0, lead(o_orderkey::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS x1 FROM orders) WHERE x1 IS NOT NULL")
def _(d):
    points = d.table("orders").select(c("o_custkey").alias("id"), c("o_orderkey").alias("place"), c("o_orderkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return sampling.consecutive(points).select("id", "x0", "x1")


@query("w10_carpet", "SELECT s_suppkey AS id, k * 10.0::DOUBLE AS offset, s_suppkey + k * -8.0::DOUBLE AS x, k * 6.0::DOUBLE AS y FROM supplier, range(-2, 3) r(k)")
def _(d):
    points = d.table("supplier").select(c("s_suppkey").alias("id"), c("s_suppkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.6).alias("ux"), F.lit(0.8).alias("uy"))
    return sampling.carpet(points, 20.0, 10.0).select("id", "offset", r("x").alias("x"), r("y").alias("y"))


@query("w11_peak_count", "SELECT row, count(*) AS n FROM (SELECT row, col, z, lag(z) OVER w AS a, lead(z) OVER w AS b FROM (SELECT (p_partkey // 40)::INTEGER AS row, p_partkey AS col, (p_partkey * 7919 % 101)::DOUBLE AS z FROM part) WINDOW w AS (PARTITION BY row ORDER BY col)) WHERE z > a AND z > b GROUP BY row")
def _(d):
    rows = d.table("part").select(F.floor(c("p_partkey") / 40).cast("int").alias("row"), c("p_partkey").alias("col"), (c("p_partkey") * 7919 % 101).cast("double").alias("z"))
    return leak.line_peaks(rows, "row", "col", "z", 1e-9).groupBy("row").agg(F.count("*").alias("n"))


@query("w14_sections_in_order", "SELECT o_custkey AS channel, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey * 37 % 1000, o_orderkey) AS sections FROM orders GROUP BY o_custkey")
def _(d):
    rows = d.table("orders").select(c("o_custkey").alias("channel"), F.struct((c("o_orderkey") * 37 % 1000).alias("p"), c("o_orderkey").alias("id")).alias("s"))
    return rows.groupBy("channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["id"].cast("string")), ",").alias("sections"))


@query("w15_offsets_by_size", "SELECT id, string_agg(v::VARCHAR, ',' ORDER BY abs(v), v) AS offsets FROM (SELECT DISTINCT l_orderkey AS id, (l_linenumber * 5 % 7 - 3)::DOUBLE AS v FROM lineitem UNION SELECT DISTINCT l_orderkey, 0.0 FROM lineitem) GROUP BY id")
def _(d):
    rows = d.table("lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.array(F.collect_set((c("l_linenumber") * 5 % 7 - 3).cast("double"))).alias("o"))
    return rows.select("id", F.array_join(F.transform(xsec.unique_offsets_of(c("o")), lambda v: v.cast("string")), ",").alias("offsets"))


@query("w17_wide_gaps", "SELECT node, first, second, round(gap, 6) AS gap FROM (SELECT node, channel AS first, coalesce(lead(channel) OVER w, first_value(channel) OVER w) AS second, (az - coalesce(lead(az) OVER w, first_value(az) OVER w) + 720) % 360 AS gap, count(*) OVER (PARTITION BY node) AS n FROM (SELECT o_custkey AS node, o_orderkey AS channel, (o_orderkey * 77 % 360)::DOUBLE AS az FROM orders) WINDOW w AS (PARTITION BY node ORDER BY az DESC, channel)) WHERE n > 1 AND gap > 180")
def _(d):
    ends = d.table("orders").select(c("o_custkey").alias("node"), c("o_orderkey").alias("channel"), (c("o_orderkey") * 77 % 360).cast("double").alias("azimuth"))
    return xsec.wedges(ends).select("node", "first", "second", r("gap").alias("gap"))


# --- scalars ----------------------------------------------------------------------------------------


def _straight(d: Derived) -> DataFrame:
    """Lines with a vertex at a quarter of their length."""
    x0, y0, x1, y1 = _xy()
    point = lambda t: F.struct((x0 + (x1 - x0) * t).alias("x"), (y0 + (y1 - y0) * t).alias("y"), F.lit(0.0).alias("z"))
    return d.lines().where("x0 <> x1 or y0 <> y1").select("id", F.array(point(0.0), point(0.25), point(1.0)).alias("points"))


_STRAIGHT = relations("lines", extra=f"s AS (SELECT *, {_LEN} AS len FROM lines WHERE x0 <> x1 OR y0 <> y1)")


@query("h11_offset_strips", _STRAIGHT + "SELECT id, 16::BIGINT AS n, round(10 * len, 4) AS area FROM s")
def _(d):
    area = F.abs((c("x2") - c("x1")) * (c("y3") - c("y1")) - (c("x3") - c("x1")) * (c("y2") - c("y1"))) / 2
    return xsec.mesh(_straight(d), [-5.0, -1.0, 0.0, 1.0, 5.0]).groupBy("id").agg(F.count("*").alias("n"), r(F.sum(area), 4).alias("area"))


@query("r30_simplified", _STRAIGHT + "SELECT id, CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS n FROM s")
def _(d):
    keep = F.when(c("id") % 2 == 0, F.array(F.lit(1)))
    return xsec.simplified_lines(_straight(d).withColumn("keep", keep), 0.01).select("id", F.size("points").alias("n"))


@query("r32_valid_parts", _STRAIGHT + "SELECT id, 0 AS part, 3 AS n FROM s")
def _(d):
    return xsec.valid_parts(_straight(d), [-5.0, 5.0]).select("id", "part", F.size("points").alias("n"))


@query("r34_parallels", _STRAIGHT + "SELECT id, round(x0 + (x1 - x0) / 4 - 2 * (y1 - y0) / len, 6) AS x, round(y0 + (y1 - y0) / 4 + 2 * (x1 - x0) / len, 6) AS y, round(0.7 + 0.25 * 10, 6) AS z FROM s")
def _(d):
    rows = _straight(d)
    section = lambda place, low: F.struct(place.alias("position"), F.array(F.lit(-5.0), F.lit(5.0)).alias("offsets"), F.array(F.lit(low), F.lit(low + 1.0)).alias("z"))
    whole = G.polyline_length(c("points"))
    sections = rows.select("id", F.explode(F.array(section(F.lit(0.0), 0.0), section(whole, 10.0))).alias("s")).select("id", "s.*")
    return xsec.parallels(rows, sections, [2.0]).select("id", c("points")[1].alias("p")).select("id", r(c("p.x")).alias("x"), r(c("p.y")).alias("y"), r(c("p.z")).alias("z"))


@query("w16_triangle_order", _STRAIGHT + "SELECT id, place::INTEGER AS place FROM s CROSS JOIN range(8) p(place)")
def _(d):
    return xsec.in_order(xsec.mesh(_straight(d), [-1.0, 0.0, 1.0])).select("id", "place")


@query("r36_wedges", "SELECT s_suppkey AS node, 2 * s_suppkey + (s_suppkey % 4 = 2)::INTEGER AS channel, 3 * s_suppkey - 1.4 * (1 + s_suppkey % 3)::DOUBLE AS x, 3 * s_suppkey - 0.2 * (1 + s_suppkey % 3)::DOUBLE AS y, CASE WHEN s_suppkey % 4 = 2 THEN 5.0 ELSE 4.0 END::DOUBLE AS z FROM supplier")
def _(d):
    i, width = c("s_suppkey"), (1 + c("s_suppkey") % 3).cast("double")
    point = lambda x, y, z: F.struct((i + x).cast("double").alias("x"), (i + y).cast("double").alias("y"), F.lit(z).alias("z"))
    both = lambda turned, a, b: F.when(turned, F.array(b, a)).otherwise(F.array(a, b))
    far = lambda n: i * 1000 + n
    one, two = (i % 4).isin(1, 3), (i % 4).isin(2, 3)  # whether each ends at the node
    channel = lambda n, turned, at, dx, dy, z: F.struct((i * 2 + n).alias("id"), F.when(turned, far(n)).otherwise(-i).alias("start_node"), F.when(turned, -i).otherwise(far(n)).alias("end_node"), both(turned, at, point(dx, dy, z)).alias("points"))
    rows = d.table("supplier").select(width.alias("w"), F.explode(F.array(channel(0, one, point(0, 0, 1.0), 30, 40, 1.0), channel(1, two, point(0, 0, 2.0), 40, -30, 2.0))).alias("q"))
    found = xsec.wedge_mesh(rows.select("q.*", F.array(-c("w"), F.lit(0.0), c("w")).alias("distances")))
    total = lambda a: r(c(f"{a}1") + c(f"{a}2") + c(f"{a}3"), 6).alias(a)
    return found.select((-c("node")).alias("node"), "channel", total("x"), total("y"), total("z"))


@query("m07_components", relations("lines") + f"SELECT id, round((x1 - x0) / {_LEN} * 5, 6) AS x, round((y1 - y0) / {_LEN} * 5, 6) AS y FROM lines")
def _(d):
    a = G.angle(*_xy())
    return d.lines().select("id", r(F.cos(a) * 5).alias("x"), r(F.sin(a) * 5).alias("y"))


@query("m09_turns", "SELECT o_orderkey AS id, ((o_orderkey % 360 - o_custkey % 360 + 360) % 360)::DOUBLE AS turn FROM orders")
def _(d):
    return d.table("orders").select(c("o_orderkey").alias("id"), G.ccw_turn((c("o_orderkey") % 360).cast("double"), (c("o_custkey") % 360).cast("double")).alias("turn"))


@query("m13_crest_choice", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 1.5 END, CASE WHEN c_custkey % 2 = 0 THEN 2.5 END, c_acctbal)::DOUBLE AS crest FROM customer")
def _(d):
    i = c("c_custkey")
    return d.table("customer").select(i.alias("id"), leak.crest_of_obstacle(F.when(i % 2 == 0, 2.5), F.when(i % 3 == 0, 1.5), c("c_acctbal")).alias("crest"))


@query("m18_courant", relations("line_ts", "lines") + f"SELECT entity_id, t, round(abs(u1) * 15 / {_LEN}, 6) AS courant FROM line_ts JOIN lines ON lines.id = entity_id")
def _(d):
    size = d.lines().select(c("id").alias("entity_id"), G.length(*_xy()).alias("length"))
    return d.line_ts().join(size, "entity_id").select("entity_id", "t", r(style.courant(c("u1"), F.lit(15.0), c("length"))).alias("courant"))


@query("m19_pixel_of_point", "SELECT c_custkey AS id, floor((1000 - c_acctbal / 20) / 10)::INTEGER AS row, floor(c_custkey * 0.75::DOUBLE / 10)::INTEGER AS col, (floor(c_custkey * 0.75::DOUBLE / 10) + 0.5) * 10 AS x, 1000 - (floor((1000 - c_acctbal / 20) / 10) + 0.5) * 10 AS y FROM customer")
def _(d):
    rows = d.table("customer").select(c("c_custkey").alias("id"), GRID.row(c("c_acctbal") / 20).alias("row"), GRID.col(c("c_custkey") * 0.75).alias("col"))
    return rows.select("id", "row", "col", GRID.centre_x(c("col")).alias("x"), GRID.centre_y(c("row")).alias("y"))


@query("m20_aligned_extent", "SELECT c_custkey AS id, floor(x / 10) * 10::DOUBLE AS xmin, 1000 - ceil((1000 - y) / 10) * 10::DOUBLE AS ymin, ceil((x + 31.5) / 10) * 10::DOUBLE AS xmax, 1000 - floor((1000 - y - 8) / 10) * 10::DOUBLE AS ymax FROM (SELECT c_custkey, c_custkey * 7 % 900 + 0.25::DOUBLE AS x, c_custkey * 13 % 900::DOUBLE AS y FROM customer)")
def _(d):
    x, y = c("c_custkey") * 7 % 900 + 0.25, (c("c_custkey") * 13 % 900).cast("double")
    box = GRID.aligned_of(x, y, x + 31.5, y + 8)
    return d.table("customer").select(c("c_custkey").alias("id"), *(v.alias(n) for v, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)))


@query("m21_raster_bounds", relations("pixels") + "SELECT 0.0::DOUBLE AS xmin, 1000 - (max(row) + 1) * 10.0::DOUBLE AS ymin, (max(col) + 1) * 10.0::DOUBLE AS xmax, 1000.0::DOUBLE AS ymax FROM pixels")
def _(d):
    return d.pixels().agg(F.max("row").alias("r"), F.max("col").alias("k")).select(F.lit(GRID.x).alias("xmin"), (F.lit(GRID.y) - (c("r") + 1) * GRID.size).alias("ymin"), (F.lit(GRID.x) + (c("k") + 1) * GRID.size).alias("xmax"), F.lit(GRID.y).alias("ymax"))


@query("m22_normal_vectors", relations("lines") + f"SELECT id, round(-(y1 - y0) / {_LEN}, 6) AS nx, round((x1 - x0) / {_LEN}, 6) AS ny FROM lines")
def _(d):
    x0, y0, x1, y1 = _xy()
    size = G.length(x0, y0, x1, y1)
    return d.lines().select("id", r(-(y1 - y0) / size).alias("nx"), r((x1 - x0) / size).alias("ny"))


def _sections(d: Derived) -> DataFrame:
    """Trapezia of height 1: their width at the bottom, and two more at the top; every seventh can't be read."""
    w = (c("p_partkey") % 9 + 1).cast("string")
    text = F.when(c("p_partkey") % 7 == 0, "no table").otherwise(F.concat(F.lit("0,"), w, F.lit("\n1,"), (c("p_partkey") % 9 + 3).cast("string")))
    rows = d.table("part").select(c("p_partkey").alias("id"), F.lit(6).alias("shape"), F.lit(2.0).alias("reference"), text.alias("text"))
    return sections.read_sections(rows)


@query("m24_parsed_sections", "SELECT p_partkey AS id, 4::INTEGER AS n, 1.0::DOUBLE AS left, p_partkey % 9 + 2.0::DOUBLE AS right, 3.0::DOUBLE AS top, 2.0::DOUBLE AS bottom FROM part WHERE p_partkey % 7 > 0")
def _(d):
    at = lambda a, i: F.get(a, F.lit(i))
    return _sections(d).where("error is null").select("id", F.size("y").alias("n"), at("y", 1).alias("left"), at("y", 2).alias("right"), at("z", 0).alias("top"), at("z", 2).alias("bottom"))


@query("m24_walls_and_steps", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 2 THEN 8 END::INTEGER AS n, CASE p_partkey % 4 WHEN 0 THEN w + 0.1 WHEN 2 THEN 1.1 END::DOUBLE AS third, CASE p_partkey % 4 WHEN 0 THEN w + 1 WHEN 2 THEN w + 2 END::DOUBLE AS last,
CASE p_partkey % 4 WHEN 1 THEN 'y must not fall' WHEN 3 THEN 'widths must not shrink' END AS error FROM (SELECT p_partkey, p_partkey % 9 + 1 AS w FROM part)""")
def _(d):
    w = lambda more=0.0: (c("p_partkey") % 9 + 1 + F.lit(more)).cast("string")
    kind = c("p_partkey") % 4
    overtaken = F.concat(F.lit("0,3\n"), w(), F.lit(",2\n"), w(), F.lit(",1\n"), w(0.05), F.lit(",0\n"), w(1.0), F.lit(",3"))
    steps = F.concat(F.lit("0,"), w(), F.lit("\n1,"), w(), F.lit("\n2,"), w(2.0))
    text = F.when(kind == 0, overtaken).when(kind == 1, F.concat(F.lit("0,3\n50,2\n"), w(-0.5), F.lit(",1\n70,3"))).when(kind == 2, steps).otherwise(F.concat(F.lit("0,20\n1,"), w()))
    rows = d.table("part").select(c("p_partkey").alias("id"), F.when(kind < 2, 7).when(kind == 2, 5).otherwise(6).alias("shape"), F.lit(0.0).alias("reference"), text.alias("text"))
    found = sections.sections(rows, wall=0.1)
    return found.select("id", F.size("y").alias("n"), r(F.get("y", F.lit(2))).alias("third"), r(F.element_at("y", -1)).alias("last"), "error")


@query("m25_thalweg", "SELECT p_partkey AS id, 1 + (p_partkey % 9 + 1) / 2.0::DOUBLE AS thalweg FROM part WHERE p_partkey % 7 > 0")
def _(d):
    return _sections(d).where("error is null").select("id", r(xsec.thalweg_of(c("y"), c("z"))).alias("thalweg"))


@query("m26_offsets", "SELECT p_partkey AS id, -1 - (p_partkey % 9 + 1) / 2.0::DOUBLE AS lowest, 1 + (p_partkey % 9 + 1) / 2.0::DOUBLE AS highest FROM part WHERE p_partkey % 7 > 0")
def _(d):
    rows = _sections(d).where("error is null").select("id", xsec.offsets_of(c("y"), c("z")).alias("o"))
    return rows.select("id", r(F.array_min("o")).alias("lowest"), r(F.array_max("o")).alias("highest"))


@query("h03_checked_sections", "SELECT p_partkey % 7 > 0 AS good, count(*) AS n FROM part GROUP BY 1")
def _(d):
    return _sections(d).groupBy(c("error").isNull().alias("good")).agg(F.count("*").alias("n"))


@query("h04_simplified_sections", "SELECT p_partkey AS id, 3::INTEGER AS n FROM part")
def _(d):
    text = F.concat(F.lit("0,2\n1,1.995\n2,2\n4,"), (c("p_partkey") % 9 + 5).cast("string"))
    rows = d.table("part").select(c("p_partkey").alias("id"), F.lit(7).alias("shape"), F.lit(0.0).alias("reference"), text.alias("text"))
    return sections.read_sections(rows).select("id", F.size("y").alias("n"))


@query("h31_section_errors", "SELECT count(*) FILTER (WHERE p_partkey % 7 = 0) AS bad, count(*) FILTER (WHERE p_partkey % 7 > 0) AS read FROM part")
def _(d):
    return _sections(d).agg(F.count("error").alias("bad"), F.count("y").alias("read"))


@query("m28_cover_shortfall", relations("pipes", extra=_INVERT, recursive=True) + "SELECT id, round(s - (s - short), 6) AS lowered FROM j")
def _(d):
    return _inverts(d).select("id", r(c("ground") - 1.2 - c("diameter") / 1000 - c("invert_start")).alias("lowered"))


@query("m30_strings", "SELECT c_custkey AS id, lower(replace(concat_ws('_', c_mktsegment, c_name), '#', '.')) AS name FROM customer")
def _(d):
    return d.table("customer").select(c("c_custkey").alias("id"), F.lower(F.replace(F.concat_ws("_", "c_mktsegment", "c_name"), F.lit("#"), F.lit("."))).alias("name"))


@query("m31_style_source", "SELECT c_custkey AS id, '<a/><datasource>url/' || c_custkey || '</datasource><b/>' AS style FROM customer")
def _(d):
    old = F.concat(F.lit("<a/><datasource>"), c("c_mktsegment"), F.lit("</datasource><b/>"))
    return d.table("customer").select(c("c_custkey").alias("id"), scenario.with_source(old, "datasource", F.concat(F.lit("url/"), c("c_custkey").cast("string"))).alias("style"))


@query("m36_raster_by_code", "SELECT c_name AS scenario, 'Level' AS name, true AS temporal FROM customer")
def _(d):
    return scenario.rasters(_scenarios(d)).where("code = 's1-dtri'").select("scenario", "name", "temporal")


@query("m37_request_payload", """SELECT c_custkey AS id, '{"raster":"' || c_custkey || '","bbox":"' || c_custkey::DOUBLE || ',0.0,' || (c_custkey + 25)::DOUBLE || ',12.0","width":3,"height":2}' AS payload FROM customer""")
def _(d):
    i = c("c_custkey").cast("double")
    return d.table("customer").select(c("c_custkey").alias("id"), scenario.request_payload(c("c_custkey").cast("string"), i, F.lit(0.0), i + 25, F.lit(12.0), F.lit(10.0)).alias("payload"))


@query("m38_labels", "SELECT c_custkey AS id, round(abs(c_acctbal))::BIGINT || ' m³' AS label FROM customer")
def _(d):
    return d.table("customer").select(c("c_custkey").alias("id"), style.label(c("c_acctbal")).alias("label"))


# --- rasters ----------------------------------------------------------------------------------------


@query("r02_blank_raster", relations("nodes", extra="b AS (SELECT min(x) - 5 AS xmin, min(y) - 5 AS ymin, max(x) + 5 AS xmax, max(y) + 5 AS ymax FROM nodes)") + "SELECT r.r::INTEGER AS row, k.k::INTEGER AS col, -9999.0::DOUBLE AS value FROM b, range(-200, 400) r(r), range(-200, 400) k(k) WHERE r.r >= floor((1000 - ymax) / 10) AND r.r < ceil((1000 - ymin) / 10) AND k.k >= floor(xmin / 10) AND k.k < ceil(xmax / 10)")
def _(d):
    box = d.nodes().agg(F.min("x") - 5, F.min("y") - 5, F.max("x") + 5, F.max("y") + 5).first()
    return raster.blank(d.spark, GRID, tuple(box))


@query("r05_pixel_boxes", relations("pixels") + "SELECT (col + 0.5) * 10::DOUBLE AS x, 1000 - (row + 0.5) * 10::DOUBLE AS y, CASE WHEN z <> 1 THEN z END AS z, CASE WHEN zmax <> 50 THEN zmax END AS zmax FROM pixels WHERE z <> 1 OR zmax <> 50")
def _(d):
    p = d.pixels().select("row", "col", raster.recoded(c("z"), 1.0).alias("z"), raster.recoded(c("zmax"), 50.0).alias("zmax"))
    return raster.to_boxes(p, GRID, "z", "zmax").drop("wkt")


@query("r08_nearest", relations("pixels") + "SELECT (row * 3 + i)::INTEGER AS row, (col * 3 + j)::INTEGER AS col, z AS value FROM pixels, range(3) a(i), range(3) b(j) WHERE row < 20")
def _(d):
    return raster.resample(d.pixels().where("row < 20").select("row", "col", c("z").alias("value")), 3)


@query("r12_line_with_z", relations("pixels", extra=_ALONG) + "SELECT id, count(*)::INTEGER AS n, max(z) AS highest, min(z) AS lowest FROM v GROUP BY id")
def _(d):
    rows = sampling.line_with_z(_levees(d), d.pixels(), GRID, value="z")
    z = F.transform("points", lambda p: p["z"])
    return rows.select("id", F.size("points").alias("n"), F.array_max(z).alias("highest"), F.array_min(z).alias("lowest"))


@query("r21_merged_by_field", "WITH RECURSIVE k AS (SELECT o_custkey AS chain, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), f AS (SELECT chain, v, k, v AS lo, v AS hi, 0 AS run FROM k WHERE k = 1 UNION ALL SELECT k.chain, k.v, k.k, CASE WHEN greatest(f.hi, k.v) - least(f.lo, k.v) > 200000 THEN k.v ELSE least(f.lo, k.v) END, CASE WHEN greatest(f.hi, k.v) - least(f.lo, k.v) > 200000 THEN k.v ELSE greatest(f.hi, k.v) END, f.run + (greatest(f.hi, k.v) - least(f.lo, k.v) > 200000)::INTEGER FROM f JOIN k ON k.chain = f.chain AND k.k = f.k + 1) SELECT chain, (max(run) + 1)::BIGINT AS n FROM f GROUP BY chain")
def _(d):
    rows = d.table("orders").select(c("o_custkey").alias("chain"), c("o_orderkey").alias("place"), c("o_totalprice").alias("v"))
    return lines.range_runs(rows, "chain", "place", "v", 200000.0).groupBy("chain").agg((F.max("run") + 1).alias("n"))


_SQUARES = "s AS (SELECT s_suppkey AS id, s_suppkey % 20 * 40 AS xmin, 900 - s_suppkey // 20 % 20 * 40 AS ymin FROM supplier)"


def _squares(d: Derived) -> DataFrame:
    """Cells of 40 x 40 over the raster."""
    i = c("s_suppkey")
    low = (900 - F.floor(i / 20) % 20 * 40).cast("double")
    return d.table("supplier").select(i.alias("id"), (i % 20 * 40).cast("double").alias("xmin"), low.alias("ymin"), (i % 20 * 40 + 40).cast("double").alias("xmax"), (low + 40).alias("ymax"))


_BLOCK = relations("pixels", extra=_SQUARES + ", b AS (SELECT id, r::INTEGER AS row, k::INTEGER AS col, CASE WHEN q.z <> 1 THEN q.z END AS z FROM s CROSS JOIN range(4) a(r) CROSS JOIN range(4) e(k) LEFT JOIN pixels q ON q.row = (1000 - ymin - 40) // 10 + r AND q.col = xmin // 10 + k), g AS (SELECT id, row, col, coalesce(z, max(z) OVER (PARTITION BY id) + 2.1) AS z FROM b QUALIFY max(z) OVER (PARTITION BY id) IS NOT NULL)")


def _blocks(d: Derived) -> DataFrame:
    p = d.pixels().select("row", "col", raster.recoded(c("z"), 1.0).alias("z"))
    return cells.cell_pixels(_squares(d), p, GRID, 2.0, leak.search_precision(2.0), "z")


@query("r22_cell_pixels", _BLOCK + "SELECT id, row, col, round(z, 6) AS z FROM g")
def _(d):
    return _blocks(d).select("id", "row", "col", r("z").alias("z"))


@query("h12_side_pixels", _BLOCK + "SELECT id, 'left' AS side, row AS place, round(z, 6) AS z FROM g WHERE col = 0 UNION ALL SELECT id, 'bottom', col, round(z, 6) FROM g WHERE row = 3")
def _(d):
    block = _blocks(d)
    one = lambda side: cells.side_pixels(block, side).select("id", F.lit(side).alias("side"), "place", r("z").alias("z"))
    return one("left").unionByName(one("bottom"))


@query("h12_edges_by_side", "SELECT cell, side, count(*) AS n, arg_min(id, (place, id)) AS first, arg_max(id, (place, id)) AS last FROM (WITH n AS (" + _NEAR + ") SELECT CASE WHEN n.id >= 100000 THEN n.id - 100000 ELSE n.id END AS cell, location AS side, CASE WHEN location = 'right' THEN side_ymin ELSE side_xmin END AS place, n.id FROM n UNION ALL SELECT CASE WHEN n.id >= 100000 THEN n.id - 100000 + 15 ELSE n.id + 1 END, CASE WHEN location = 'right' THEN 'left' ELSE 'bottom' END, CASE WHEN location = 'right' THEN side_ymin ELSE side_xmin END, n.id FROM n) GROUP BY cell, side")
def _(d):
    return cells.edges_by_side(graph.resolved_neighbours(*_cells(d)))


@query("h13_aligned_pairs", "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS aligned FROM orders")
def _(d):
    i = c("o_orderkey").cast("double")
    moved = F.when(c("o_orderkey") % 3 == 0, i + 1e-7).otherwise(i + 1e-3)
    return d.table("orders").select(c("o_orderkey").alias("id"), cells.aligned(i, i + 10, moved, moved + 10).alias("aligned"))


@query("h14_result_rows", relations("lines") + "SELECT end_id AS edge, any_value(n.dmax) AS level, max(l.x0) AS crest, arg_max(l.y0, (l.x0, l.id)) AS x0 FROM lines l JOIN (SELECT id, dmax FROM nodes) n ON n.id = l.end_id GROUP BY end_id")
def _(d):
    x0, y0, x1, y1 = _xy()
    met = d.lines().select(c("end_id").alias("edge"), c("id").alias("obstacle"), x0.alias("crest"), y0.alias("ox0"), x0.alias("oy0"), x1.alias("ox1"), y1.alias("oy1"))
    edges = d.nodes().select(c("id").alias("edge"), c("dmax").alias("level"), c("x").alias("x0"), c("y").alias("y0"), c("x").alias("x1"), c("y").alias("y1"))
    return cells.result_rows(edges, met, True).select("edge", "level", "crest", "x0")


@query("h15_two_passes")
def _(d):
    squares = _squares(d)
    x, y = (lambda n: (c(f"{n}.xmin") + 20)), (lambda n: (c(f"{n}.ymin") + 20))
    one, two = squares.alias("a"), squares.alias("b")
    beside = one.join(two, (c("b.id") == c("a.id") + 1) & (c("b.xmin") == c("a.xmax")) & (c("b.ymin") == c("a.ymin")))
    above = one.join(two, (c("a.id") == c("b.id") + 20) & (c("a.xmin") == c("b.xmin")) & (c("a.ymax") == c("b.ymin")))
    ends = [c("a.id").alias("start_id"), c("b.id").alias("end_id"), x("a").alias("fx0"), y("a").alias("fy0"), x("b").alias("fx1"), y("b").alias("fy1")]
    flows = beside.select((c("a.id") * 2).alias("id"), *ends).unionByName(above.select((c("a.id") * 2 + 1).alias("id"), *ends))
    return detect.detect(squares, d.pixels(), flows, GRID, 5.0, value="z").select("edge", *(r(n, 6).alias(n) for n in ("level", "crest", "x0", "y0", "x1", "y1")))


@query("h16_ids_of_pairs", relations("lines") + "SELECT l.id AS line, a.sumax AS start_sumax FROM lines l JOIN nodes a ON a.id = l.start_id WHERE l.end_id % 2 = 0")
def _(d):
    by_id = d.nodes().select(c("id").alias("start_id"), c("sumax").alias("start_sumax"))
    return d.lines().where("end_id % 2 = 0").join(by_id, "start_id").select(c("id").alias("line"), "start_sumax")


@query("h17_precision", "SELECT p_partkey AS id, least(p_size / 20.0::DOUBLE, 0.1) AS precision FROM part")
def _(d):
    return d.table("part").select(c("p_partkey").alias("id"), leak.search_precision(c("p_size") / 2).alias("precision"))


@query("h18_discharge_edges", f'WITH {_BEDS} SELECT id AS edge, round(sum(z), 4) AS discharge_without_obstacle, round(sum(z) / 2, 4) AS discharge_with_obstacle, round(sum(z) / 2, 4) AS discharge_reduction FROM b GROUP BY id')
def _(d):
    rows = d.table("lineitem").select(c("l_orderkey").alias("id"), c("l_quantity").alias("q"), F.lit(0.5).alias("factor"), F.lit(1.0).alias("dt"))
    edges = d.table("orders").select(c("o_orderkey").alias("edge"))
    return cells.with_discharge(edges, leak.discharge_reduction(rows)).select("edge", *(r(n, 4).alias(n) for n in ("discharge_without_obstacle", "discharge_with_obstacle", "discharge_reduction")))


@query("r28_obstacle_geometry", f"WITH {_SQUARES} SELECT a.id, a.xmin + (a.id % 4 + 0.5) * 10::DOUBLE AS x0, a.ymin + 40 - 5::DOUBLE AS y0, b.xmin + 35::DOUBLE AS x1, b.ymin + 40 - (a.id % 3 + 0.5) * 10::DOUBLE AS y1 FROM s a JOIN s b ON b.id = a.id + 1")
def _(d):
    squares = _squares(d)
    rows = squares.select("id", c("id").alias("from_cell"), F.lit(0).alias("from_row"), (c("id") % 4).alias("from_col"), (c("id") + 1).alias("to_cell"), (c("id") % 3).alias("to_row"), F.lit(3).alias("to_col"))
    return cells.obstacle_segments(rows, squares, 10.0)


@query("r41_centres", relations("nodes") + "SELECT id, x, y, (10 + id % 3) * (10 + id % 3)::DOUBLE AS area FROM nodes")
def _(d):
    half = (10 + c("id") % 3) / 2
    boxes = d.nodes().select("id", (c("x") - half).alias("xmin"), (c("y") - half).alias("ymin"), (c("x") + half).alias("xmax"), (c("y") + half).alias("ymax"))
    return boxes.select("id", ((c("xmin") + c("xmax")) / 2).alias("x"), ((c("ymin") + c("ymax")) / 2).alias("y"), r((c("xmax") - c("xmin")) * (c("ymax") - c("ymin"))).alias("area"))


# --- lines and metadata -----------------------------------------------------------------------------


@query("h01_vertex_places", relations("lines") + "SELECT id, 1 AS at, NULL::INTEGER AS none FROM lines WHERE x0 <> x1 OR y0 <> y1")
def _(d):
    x0, y0, x1, y1 = _xy()
    points = _pair(x0, y0, x1, y1)
    return d.lines().where("x0 <> x1 or y0 <> y1").select("id", G.index_of(points, x1 + 1e-8, y1).cast("int").alias("at"), G.index_of(points, x1 + 0.1, y1 + 0.1).cast("int").alias("none"))


@query("h02_reversed", relations("lines") + "SELECT id, x1 AS x, y1 AS y FROM lines")
def _(d):
    return d.lines().select("id", gauge.turned(_pair(*_xy()), F.lit(True))[0].alias("p")).select("id", "p.x", "p.y")


@query("h05_normal_position", relations("lines") + "SELECT id, round(0.25::DOUBLE, 6) AS position FROM lines WHERE x0 <> x1 OR y0 <> y1")
def _(d):
    x0, y0, x1, y1 = _xy()
    rows = d.lines().where("x0 <> x1 or y0 <> y1")
    points = rows.select(c("id").alias("pid"), "id", (x0 + (x1 - x0) / 4).alias("x"), (y0 + (y1 - y0) / 4).alias("y"))
    found = sampling.project(points, rows.select("id", F.lit(0).alias("segment"), x0, y0, x1, y1))
    return found.join(rows.select("id", G.length(x0, y0, x1, y1).alias("length")), "id").select("id", r(c("place") / c("length")).alias("position"))


@query("h07_channel_arrays", "SELECT o_custkey AS channel, string_agg((o_orderkey % 50)::VARCHAR, ',' ORDER BY o_orderkey) AS widths, max(o_orderkey % 50)::BIGINT AS most FROM orders GROUP BY o_custkey")
def _(d):
    rows = d.table("orders").groupBy(c("o_custkey").alias("channel")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey"))), lambda s: s["o_orderkey"] % 50).alias("w"))
    return rows.select("channel", F.array_join(F.transform("w", lambda v: v.cast("string")), ",").alias("widths"), F.array_max("w").alias("most"))


@query("h08_point_numbers", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) - 1 AS last FROM orders")
def _(d):
    w = Window.partitionBy("o_custkey")
    return d.table("orders").select(c("o_orderkey").alias("id"), (F.row_number().over(w.orderBy("o_orderkey")) - 1).cast("long").alias("place"), (F.count("*").over(w) - 1).alias("last"))


@query("h09_section_place", "SELECT o_custkey AS channel, min(o_orderkey) AS id, 0::BIGINT AS place FROM orders GROUP BY o_custkey")
def _(d):
    rows = d.table("orders").groupBy(c("o_custkey").alias("channel")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("s"), F.min("o_orderkey").alias("id"))
    place = F.array_position("s", c("id")) - 1
    return rows.select("channel", "id", F.when(place >= 0, place).otherwise(F.raise_error(F.lit("no such section")).cast("long")).alias("place"))


@query("h10_vertex_from_end", relations("lines") + "SELECT id, x1 AS last, x0 AS second_last FROM lines")
def _(d):
    points = _pair(*_xy())
    return d.lines().select("id", G.vertex(points, -1)["x"].alias("last"), G.vertex(points, -2)["x"].alias("second_last"))


@query("h19_joined_lines", "SELECT o_custkey AS id, count(*)::INTEGER * 2 AS n FROM orders GROUP BY o_custkey")
def _(d):
    i = c("o_orderkey").cast("double")
    rows = d.table("orders").groupBy(c("o_custkey").alias("id")).agg(F.flatten(F.collect_list(_pair(i, i, i + 1, i))).alias("points"))
    return rows.select("id", F.size("points").alias("n"))


@query("h20_middle_of_lines", relations("lines") + "SELECT id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM lines WHERE x0 <> x1 OR y0 <> y1")
def _(d):
    rows = d.lines().where("x0 <> x1 or y0 <> y1").select("id", *_xy())
    return lines.split_every(rows, 1e9).select("id", "x", "y")


@query("h23_runs_by_field", "SELECT s_suppkey // 10 AS chain, count(*) AS n FROM supplier GROUP BY 1")
def _(d):
    i = c("s_suppkey")
    rows = d.table("supplier").select(i.alias("id"), F.floor(i / 10).alias("chain"), (i % 10 * 10).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (i % 10 * 10 + 10).cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("height"))
    return lines.merged_levees(rows, "chain", 0.1).groupBy("chain").agg(F.sum("n").alias("n"))


@query("h24_raster_codes", "SELECT name, code, timed, count(*) AS n FROM customer, (VALUES ('maximum depth', 'depth-max-dtri', false), ('level', 's1-dtri', true)) v(name, code, timed) GROUP BY ALL")
def _(d):
    return scenario.named(scenario.rasters(_scenarios(d))).groupBy("name", "code", "timed").agg(F.count("*").alias("n"))


@query("h27_names_to_codes", "SELECT c_custkey::VARCHAR AS uuid, 'depth-max-dtri' AS depth FROM customer")
def _(d):
    named = scenario.rasters(_scenarios(d), False).groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("name", "code"))).alias("m"))
    return _scenarios(d).select("uuid", c("name").alias("scenario")).join(named, "scenario").select("uuid", c("m")["Depth"].alias("depth"))


@query("h28_signed_variables", _REQUESTS + "SELECT variable, count(*) AS n FROM req WHERE variable IN ('q', 'u1', 'qp', 'up1', 'grad', 'ucx', 'ucy', 'q_lat', 'q_lat_mm', 'q_sss', 'q_sss_mm') GROUP BY variable")
def _(d):
    return _requests(d).where(requests.signed(c("variable"))).groupBy("variable").agg(F.count("*").alias("n"))


@query("h29_request_rules", _REQUESTS + "SELECT method, count(*) FILTER (WHERE NOT sign_fits) AS bad_signs, count(*) FILTER (WHERE NOT method_fits) AS bad_methods, count(*) FILTER (WHERE NOT threshold_fits) AS bad_thresholds FROM valid GROUP BY method")
def _(d):
    has = lambda name: F.count(F.when(F.array_contains("problems", name), 1))
    return _requests(d).groupBy("method").agg(has("sign").alias("bad_signs"), has("method").alias("bad_methods"), has("threshold").alias("bad_thresholds"))


@query("h30_style_columns", _REQUESTS + "SELECT lower(replace(concat_ws('_', variable, sign, method, threshold::VARCHAR), '.', '_')) AS name, count(*) AS n FROM valid WHERE variable = 's1' AND sign_fits AND method_fits AND threshold_fits GROUP BY 1")
def _(d):
    return _requests(d).where("variable = 's1' and valid").groupBy("name").agg(F.count("*").alias("n"))


@query("h32_pixel_sizes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE p_size / 2.0 END::DOUBLE AS size FROM part")
def _(d):
    own = c("p_size") / 2
    other = -own - F.when(c("p_partkey") % 3 == 0, 0.001).otherwise(0.00005)
    return d.table("part").select(c("p_partkey").alias("id"), raster.pixel_size_of(own, other, F.lit(1.0)).alias("size"))


@query("h35_checked_gradients", "SELECT s_nationkey AS net, sqrt(pow(max(s_suppkey) * 10 - min(s_suppkey) * 10, 2) + 90000) <= 1000 AS fits FROM supplier GROUP BY s_nationkey")
def _(d):
    ends = d.table("supplier").select(c("s_nationkey").alias("net"), (c("s_suppkey") * 10).cast("double").alias("x"), F.explode(F.array(F.lit(0.0), F.lit(300.0))).alias("y"))
    return network.gradients_fit(ends, "net", max(high for _, high, _ in GRADIENTS))


@query("h36_quantile_classes", "SELECT c_custkey AS id, ntile(5) OVER (ORDER BY c_acctbal, c_custkey)::INTEGER AS class FROM customer")
def _(d):
    rows = d.table("customer").select(c("c_custkey").alias("id"), "c_acctbal")
    return window.quantile_classes(rows, 5, "c_acctbal", "id").select("id", "class")


@query("x06_cross_discharge", relations("lines", "line_q", extra=_CROSS) + "SELECT gauge, count(*) AS n, round(sum(q * direction), 2) AS total FROM crossed JOIN line_q USING (id) JOIN lines l USING (id) WHERE l.kcu IN (100, 101) GROUP BY gauge")
def _(d):
    chosen = gauge.subset(d.lines(), "2D_OPEN_WATER")
    crossed = gauge.crossings(chosen, _gauges(d))
    return gauge.totals(crossed, _flows(d)).join(crossed.groupBy("gauge").agg(F.count("*").alias("n")), "gauge").select("gauge", "n", r("total", 2).alias("total"))
