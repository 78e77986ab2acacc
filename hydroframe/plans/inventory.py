"""Further registered queries: one for each operator that others only use on their way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions import geometry as G
from hydroframe.functions import requests, tables
from hydroframe.functions.registry import BY_NAME, METHODS, NODE_TYPES, Request
from hydroframe.operators import cells, gauge, graph, joins, leak, lines, network, raster, sampling, scenario, window
from hydroframe.operators.aggregate import time_aggregate
from hydroframe.plans.catalogue import _ALONG, _CELLS, _CROSS, _GRAD, _LEN, _NEAR, _Q, _ZONAL, GRID, _cells, _flows, _gauges, _levees, _line, _node, _points, _scenarios, _side, query, r
from hydroframe.plans.sql import END, START, relations
from hydroframe.sources import geotiff, readers, wkb
from hydroframe.sources.derived import Derived
from hydroframe.sources.scratch import shared_folder
from hydroframe.streaming import holds

c = F.col


def _pt(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# --- sources ----------------------------------------------------------------------------------------


@query("s01_mesh_and_results", relations("nodes", "node_ts") + "SELECT n.id, n.sumax, count(t.s1) AS n_values FROM nodes n JOIN node_ts t ON t.entity_id = n.id GROUP BY n.id, n.sumax")
def _(d):
    return d.nodes().join(readers.series(d.node_ts(), ["s1"]).withColumnRenamed("entity_id", "id"), "id").groupBy("id", "sumax").agg(F.count("s1").alias("n_values"))


@query("s02_time_slice", relations("node_ts") + f"SELECT entity_id, t, s1, vol FROM node_ts WHERE t BETWEEN {START} AND {END}")
def _(d):
    return readers.series(d.node_ts(), ["s1", "vol"], START, END)


@query("s03_vector_scan", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'line' WHEN 2 THEN 'polygon' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS n, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey + 0.5::DOUBLE END AS x FROM supplier")
def _(d):
    i = c("s_suppkey").cast("string")
    text = F.when(c("s_suppkey") % 4 == 0, F.concat(F.lit("POINT ("), i, F.lit(".5 2)"))).when(c("s_suppkey") % 4 == 1, F.concat(F.lit("LINESTRING("), i, F.lit(".5 2, 3 4)"))).when(c("s_suppkey") % 4 == 2, F.concat(F.lit("POLYGON (("), i, F.lit(".5 2, 3 4, 5 6, 1.5 2))"))).otherwise("GEOMETRYCOLLECTION EMPTY")
    rows = readers.features(d.table("supplier").select(c("s_suppkey").alias("id"), text.alias("wkt")))
    return rows.select("id", "kind", F.when(c("points").isNotNull(), F.size("points")).alias("n"), F.get("points", F.lit(0))["x"].alias("x"))


@query("s04_layer_scan", "SELECT c_custkey AS id, c_custkey::DOUBLE AS x FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(d):
    table = d.table("customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("layer"), G.wkt_point(c("c_custkey"), F.lit(1)).alias("wkt"))
    return readers.features(table, layer="BUILDING").select("id", F.get("points", F.lit(0))["x"].alias("x"))


def _plots(d: Derived) -> DataFrame:
    """Binary geometries: a point, a line, a square with a hole, or two squares, for each supplier."""
    i = c("s_suppkey").cast("double")
    p = lambda x, y: F.struct((i + x).alias("x"), F.lit(float(y)).alias("y"), F.lit(None).cast("double").alias("z"))
    square = lambda x, y, n: F.array(p(x, y), p(x + n, y), p(x + n, y + n), p(x, y + n), p(x, y))
    kinds = {"point": F.array(F.array(F.array(p(0, 2)))), "line": F.array(F.array(F.array(p(0, 2), p(3, 4)))), "polygon": F.array(F.array(square(0, 0, 4), square(1, 1, 1))), "multipolygon": F.array(F.array(square(0, 0, 2)), F.array(square(5, 5, 3)))}
    kind = F.element_at(F.array(*map(F.lit, kinds)), (c("s_suppkey") % 4 + 1).cast("int"))
    parts = F.when(kind == "point", kinds["point"]).when(kind == "line", kinds["line"]).when(kind == "polygon", kinds["polygon"]).otherwise(kinds["multipolygon"])
    return d.table("supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit("n"), c("s_nationkey")).alias("layer"), wkb.encode(kind, parts).alias("geom"))


_PLOTS = "SELECT s_suppkey AS id, ([ 'point', 'line', 'polygon', 'multipolygon'])[s_suppkey % 4 + 1] AS kind, ([1, 1, 1, 2])[s_suppkey % 4 + 1] AS parts, ([1, 2, 10, 10])[s_suppkey % 4 + 1] AS points, s_suppkey::DOUBLE AS x, ([0, 0, 15, 13])[s_suppkey % 4 + 1]::DOUBLE AS area FROM supplier"


def _told(rows: DataFrame) -> DataFrame:
    size = F.aggregate(F.flatten("parts"), F.lit(0), lambda n, ring: n + F.size(ring))
    return rows.select("id", "kind", F.size("parts").alias("parts"), size.alias("points"), F.get(wkb.exterior(c("parts")), F.lit(0))["x"].alias("x"), r(F.when(c("kind").endswith("polygon"), wkb.area(c("parts"))).otherwise(0.0)).alias("area"))


@query("s03_binary_scan", _PLOTS)
def _(d):
    return _told(wkb.features(_plots(d)))


@query("s04_binary_layer", _PLOTS + " WHERE s_nationkey = 7")
def _(d):
    return _told(wkb.features(_plots(d), layer="n7"))


@query("m39_binary_geometries", "SELECT s_suppkey AS id, ([21, 41, 177, 195])[s_suppkey % 4 + 1] AS bytes, ([1, 2, 3, 6])[s_suppkey % 4 + 1] AS code FROM supplier")
def _(d):
    return _plots(d).select("id", F.octet_length("geom").alias("bytes"), F.conv(F.hex(F.substring("geom", 2, 1)), 16, 10).cast("int").alias("code"))


_TRIANGLE = [(103.0, 907.5), (309.0, 655.0), (451.0, 949.0)]


def _inside(x: str, y: str, corners: list[tuple[float, float]]) -> str:
    return " AND ".join(f"{_side(x, y, str(a[0]), str(a[1]), str(b[0]), str(b[1]))} > 0" for a, b in zip(corners, corners[1:] + corners[:1], strict=True))


_SMALL = [(13.0, 4.5), (96.0, 13.5), (57.0, 76.5)]


@query("s06_polygon_scan", relations("nodes") + f"SELECT id, x, y FROM nodes WHERE {_inside('x', 'y', _SMALL)}")
def _(d):
    near = graph.in_box(d.nodes(), "x", "y", (13, 4.5, 96, 76.5))
    return near.where(raster.in_polygon(c("x"), c("y"), _SMALL)).select("id", "x", "y")


@query("s10_masked_raster", relations("pixels") + f"SELECT row, col, z, {_inside('((col + 0.5) * 10)', '(1000 - (row + 0.5) * 10)', _TRIANGLE)} AS active FROM pixels WHERE row BETWEEN 5 AND 34 AND col BETWEEN 10 AND 45")
def _(d):
    return raster.masked(d.pixels().select("row", "col", "z"), GRID, _TRIANGLE)


@query("s11_line_window", relations("pixels") + "SELECT r.r::INTEGER AS row, c.c::INTEGER AS col, coalesce(p.z, -9999) AS z FROM range(98, 104) r(r) CROSS JOIN range(9, 15) c(c) LEFT JOIN pixels p ON p.row = r.r AND p.col = c.c")
def _(d):
    return raster.read_window(d.pixels().select("row", "col", "z"), GRID, (95, -45, 155, 15), pad=True)


@query("s12_lookup_rows", """SELECT n_nationkey AS "Code", n_name AS "Landuse", n_nationkey / 100::DOUBLE AS "Friction", 0.5::DOUBLE AS "Permeability", NULL::DOUBLE AS "Interception", (n_nationkey % 7)::INTEGER AS "Crop_type" FROM nation""")
def _(d):
    parts = [c("n_nationkey").cast("string"), c("n_name"), (c("n_nationkey") / 100).cast("string"), F.lit("0.5"), F.lit(""), (c("n_nationkey") % 7).cast("string")]
    return readers.lookup_rows(d.table("nation").select(F.concat_ws(";", *parts).alias("value")), readers.LANDUSE)


@query("s14_by_model", "SELECT c_name AS name, 'model-' || c_nationkey AS model_name FROM customer WHERE 'model-' || c_nationkey LIKE '%l-1%' ORDER BY c_name LIMIT 10")
def _(d):
    rows = d.table("customer").select(c("c_name").alias("name"), c("c_custkey").cast("string").alias("uuid"), F.concat(F.lit("Model-"), c("c_nationkey").cast("string")).alias("model_name"))
    return readers.find(rows, 10, model_name="L-1").select("name", F.lower("model_name").alias("model_name"))


@query("s15_selected_lines", relations("lines") + "SELECT id, 'chosen' AS how FROM lines WHERE kcu = 3 UNION ALL SELECT id, 'all' FROM lines")
def _(d):
    every = d.lines().select("id")
    return readers.selected(every, d.lines().where("kcu = 3")).withColumn("how", F.lit("chosen")).unionByName(readers.selected(every, None).withColumn("how", F.lit("all")))


@query("s16_obstacle_lines", relations("lines") + "SELECT id, y1 AS crest_level FROM lines WHERE kcu = 100")
def _(d):
    return readers.require(d.lines().where("kcu = 100").select("id", c("y1").alias("crest_level")), "crest_level", "id")


@query("s17_settings_row", "SELECT n_nationkey AS id, 5 AS max_degree, 20 AS use_of_cg FROM nation")
def _(d):
    return readers.replaced_settings(d.table("nation").select(c("n_nationkey").alias("id")), readers.NUMERICAL).select("id", "max_degree", "use_of_cg")


@query("s18_raster_steps", "SELECT c_name AS scenario, 4::BIGINT AS n, '2024-01-01T00:00:00' AS first FROM customer")
def _(d):
    return scenario.steps(scenario.rasters(_scenarios(d), True), 2.0).groupBy("scenario").agg(F.count("*").alias("n"), F.min("step").alias("first"))


# --- SQL functions ----------------------------------------------------------------------------------


@query("x02_time_aggregate", relations("node_w") + """SELECT entity_id, round(max(s1), 6) AS s1_max, round(median(s1), 6) AS s1_median, round(CASE WHEN count(rain) < count(*) THEN NULL ELSE sum(rain * dt) END, 3) AS rain_sum,
round(100.0 * sum(CASE WHEN ucx > 5 THEN dt ELSE 0 END) / sum(dt), 6) AS ucx_pos_above_thres_5_0 FROM node_w GROUP BY entity_id""")
def _(d):
    tables.register(d.spark)
    sql = f"SELECT * FROM time_aggregate(TABLE({{rows}}), 's1 max; s1 median; rain sum; ucx above_thres pos 5.0', {START}, {END})"
    found = d.spark.sql(sql, rows=d.node_ts().select("entity_id", "t", "s1", "rain", "ucx"))
    return found.select("entity_id", r("s1_max").alias("s1_max"), r("s1_median").alias("s1_median"), r("rain_sum", 3).alias("rain_sum"), r("ucx_pos_above_thres_5_0").alias("ucx_pos_above_thres_5_0"))


@query("x01_held_values", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, max(value) AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
h AS (SELECT user_id, ms, v, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS until FROM e)
SELECT user_id, count(*) AS n, round(sum(until - ms) / 1000.0, 3)::DOUBLE AS seconds, round(sum(v * (until - ms) / 1000.0), 2) AS total FROM h WHERE until <= (SELECT max(ms) FROM e) - 3600000 GROUP BY user_id""")
def _(d):
    kind = d.table("events").schema
    stream = d.spark.readStream.schema(kind).parquet(f"{d.dir.rstrip('/')}/events.parquet*").withColumn("ts", c("ts").cast("timestamp"))
    held = holds.drained(d.spark, holds.holds(stream, "user_id", "value", "1 hour"), shared_folder(d.spark, "x01"), shared_folder(d.spark, "x01-log"))
    return held.groupBy("user_id").agg(F.count("*").alias("n"), r(F.sum("dt"), 3).alias("seconds"), r(F.sum(c("value") * c("dt")), 2).alias("total"))


# --- sinks and projections --------------------------------------------------------------------------


@query("k01_node_layer", relations("nodes") + "SELECT id, node_type, 'POINT (' || x || ' ' || y || ')' AS wkt FROM nodes")
def _(d):
    return d.nodes().select("id", readers.output_column(d.nodes(), "node_type"), G.wkt_point(c("x"), c("y")).alias("wkt"))


@query("k03_raster_bands", relations("pixels") + "SELECT row, col, z::DOUBLE AS z, zmax::DOUBLE AS zmax FROM pixels")
def _(d):
    path = shared_folder(d.spark, "k03")
    geotiff.write_raster(d.pixels(), GRID, ["z", "zmax"], path, size=32)
    return geotiff.read_raster(d.spark, path)


@query("k05_mosaic_window", relations("pixels") + "SELECT row, col, z::DOUBLE AS z FROM pixels WHERE row BETWEEN 20 AND 45 AND col < 30 AND z <> 7")
def _(d):
    path = shared_folder(d.spark, "k05")
    pixels = d.pixels().where("z <> 7").select("row", "col", "z")
    geotiff.write_raster(pixels.where("row < 32"), GRID, ["z"], path, size=16)
    geotiff.write_raster(pixels.where("row >= 32"), GRID, ["z"], path, size=16, mode="append")
    return geotiff.read_raster(d.spark, path).where("row between 20 and 45 and col < 30")


@query("k06_target_columns", relations("nodes") + "SELECT id, sumax, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM nodes")
def _(d):
    return readers.with_new_columns(d.nodes().select("id", "sumax"), ["a", "b"])


@query("k08_layer_fields", relations("nodes") + "SELECT v.name, v.kind, v.n FROM (SELECT count(id) AS id, count(x) AS x, count(y) AS y, count(sumax) AS sumax, count(dmax) AS dmax, count(node_type) AS t FROM nodes) q, LATERAL (VALUES ('id', 'bigint', q.id), ('x', 'double', q.x), ('y', 'double', q.y), ('sumax', 'double', q.sumax), ('dmax', 'double', q.dmax), ('node_type', 'int', q.t)) v(name, kind, n)")
def _(d):
    return readers.fields(d.nodes())


@query("k09_flowline_sink", relations("lines", "line_q", extra=_CROSS) + "SELECT l.id, l.start_id AS spatialite_id, l.content_type, l.kcu, c.gauge AS gauge_line_id, round(f.q, 3) AS q_net_sum FROM crossed c JOIN lines l USING (id) JOIN line_q f USING (id)")
def _(d):
    met = gauge.crossings(d.lines(), _gauges(d)).join(d.lines(), "id").join(_flows(d), "id")
    return met.select("id", c("start_id").alias("spatialite_id"), "content_type", "kcu", c("gauge").alias("gauge_line_id"), r("q", 3).alias("q_net_sum"))


@query("k11_exchange_csv", "SELECT edge || ',' || level AS line FROM (SELECT l_orderkey AS edge, max(l_quantity) AS level FROM lineitem GROUP BY l_orderkey)")
def _(d):
    rows = d.table("lineitem").groupBy(c("l_orderkey").alias("edge")).agg(F.max("l_quantity").alias("level"))
    return rows.select(F.to_csv(F.struct("edge", "level")).alias("line"))


@query("p01_default_projection", relations("nodes") + "SELECT id, node_type, CASE node_type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NODE_TYPES.items()) + " END AS node_type_description, dmax AS z_coordinate FROM nodes")
def _(d):
    names = F.create_map(*(F.lit(x) for pair in NODE_TYPES.items() for x in pair))
    return d.nodes().select("id", "node_type", F.try_element_at(names, c("node_type")).alias("node_type_description"), c("dmax").alias("z_coordinate"))


_VARIABLES, _METHODS = list(BY_NAME), list(METHODS)
_TEXTS = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_REQUESTS = f"""WITH req AS (SELECT o_orderkey AS id, ({_TEXTS(_VARIABLES)})[o_orderkey % {len(_VARIABLES)} + 1] AS variable, ([NULL, 'net', 'pos', 'abs'])[o_custkey % 4 + 1] AS sign,
({_TEXTS(_METHODS)})[o_custkey // 4 % {len(_METHODS)} + 1] AS method, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 100 / 4.0::DOUBLE END AS threshold FROM orders),
valid AS (SELECT *, (sign IS NULL OR variable IN ('q', 'u1', 'qp', 'up1', 'grad', 'ucx', 'ucy', 'q_lat', 'q_lat_mm', 'q_sss', 'q_sss_mm')) AS sign_fits,
variable <> 'bed_grad' AND NOT (method = 'sum' AND variable IN ('u1', 'au', 'up1', 'ts_max', 'grad', 'wl_at_xsec', 's1', 'vol', 'su', 'uc', 'ucx', 'ucy', 'intercepted_volume', 'intercepted_volume_mm')) AS method_fits, (method LIKE '%_thres') = (threshold IS NOT NULL) AS threshold_fits FROM req) """


def _requests(d: Derived) -> DataFrame:
    """A request for each order: variable, sign, method and threshold by its numbers."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    i, k = c("o_orderkey"), c("o_custkey")
    rows = d.table("orders").select(i.alias("id"), pick(_VARIABLES, i).alias("variable"), pick([None, "net", "pos", "abs"], k).alias("sign"), pick(_METHODS, F.floor(k / 4)).alias("method"), F.when(i % 2 == 0, k % 100 / 4).alias("threshold"))
    return requests.told(rows)


@query("p03_column_names", _REQUESTS + "SELECT id, lower(replace(concat_ws('_', variable, sign, method, threshold::VARCHAR), '.', '_')) AS name FROM req")
def _(d):
    return _requests(d).select("id", "name")


@query("p04_added_column", relations("nodes") + "SELECT id, sumax, NULL::DOUBLE AS level FROM nodes")
def _(d):
    return readers.add_column(readers.add_column(d.nodes().select("id", "sumax"), "level"), "sumax")


@query("p05_output_types", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v, event_type AS b, user_id FROM events")
def _(d):
    rows = d.table("events").select("event_id", F.when(c("event_id") % 5 == 0, float("nan")).otherwise(c("value")).alias("v"), F.encode("event_type", "UTF-8").alias("b"), "user_id")
    return rows.select(*(readers.output_column(rows, n) for n in rows.columns))


# --- time, filters ----------------------------------------------------------------------------------


@query("t02_checked_window", relations("w") + "SELECT count(*) AS n, min(te)::DOUBLE AS first FROM w")
def _(d):
    return window.checked(window.window(d.steps(), START, END)).agg(F.count("*").alias("n"), F.min("te").alias("first"))


@query("t04_gauge_axis", relations("steps") + "SELECT t, t - min(t) OVER () AS at FROM steps QUALIFY lead(t) OVER (ORDER BY t) IS NOT NULL")
def _(d):
    return window.axis(window.window(d.steps())).select("t", "at")


@query("w01_step_lengths", relations("steps") + "SELECT t, lead(t) OVER (ORDER BY t) - t AS dt FROM steps QUALIFY dt IS NOT NULL")
def _(d):
    return window.window(d.steps()).select("t", "dt")


@query("w02_running_sum", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events")
def _(d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.table("events").select("event_id", "user_id", r(F.sum("value").over(w), 4).alias("total"))


@query("w03_first_and_last", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY user_id")
def _(d):
    by = F.struct("ts", "event_id")
    return d.table("events").groupBy("user_id").agg(F.min_by("event_id", by).alias("first"), F.max_by("event_id", by).alias("last"))


@query("w04_group_boundaries", "SELECT user_id AS id, event_id AS place, (sum(flag) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS grp FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS flag FROM events)")
def _(d):
    return lines.numbered_groups(d.table("events").select(c("user_id").alias("id"), c("event_id").alias("place"), "event_type"), "id", "place", "event_type").select("id", "place", "grp")


@query("w18_sorted_nodes", relations("nodes") + "SELECT row_number() OVER (ORDER BY id) AS place, id FROM nodes")
def _(d):
    return window.numbered(d.nodes().select("id"), "id").select("place", "id")


@query("w19_first_ten", "SELECT c_name AS name FROM customer ORDER BY c_name LIMIT 10")
def _(d):
    return readers.find(d.table("customer").select(c("c_name").alias("name"), c("c_custkey").cast("string").alias("uuid")), 10).select("name")


@query("w20_ranks", "SELECT o_orderkey AS id, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER v AS quarter, sum(o_shippriority) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM (SELECT *, (o_orderkey % 7)::BIGINT AS o_shippriority, o_orderkey % 100 AS day FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_shippriority), v AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(d):
    rows = d.table("orders").select(c("o_orderkey").alias("id"), "o_custkey", (c("o_orderkey") % 7).alias("p"), (c("o_orderkey") % 100).alias("day"))
    w, v = Window.partitionBy("o_custkey").orderBy("p"), Window.partitionBy("o_custkey").orderBy("id")
    near = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-30, 0)
    return rows.select("id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(v).cast("long").alias("quarter"), F.sum("p").over(near).alias("recent"))


@query("d02_iso_times", "SELECT event_id, strftime(make_timestamp((1704067200 + event_id * 61) * 1000000), '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def _(d):
    ms = (1704067200 + c("event_id") * 61) * 1000
    return d.table("events").select("event_id", F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


_CUT = (3.0, 5.0, 117.0, 79.0)


@query("f03_two_step_filter", relations("lines") + f"SELECT id FROM (SELECT id, greatest(x0, x1) >= 3 AND least(x0, x1) <= 117 AND greatest(y0, y1) >= 5 AND least(y0, y1) <= 79 AS near, {_side('3.0', '5.0', 'x0', 'y0', 'x1', 'y1')} AS a, {_side('117.0', '79.0', 'x0', 'y0', 'x1', 'y1')} AS b, {_side('x0', 'y0', '3.0', '5.0', '117.0', '79.0')} AS e, {_side('x1', 'y1', '3.0', '5.0', '117.0', '79.0')} AS f FROM lines) WHERE near AND sign(a) * sign(b) <= 0 AND sign(e) * sign(f) <= 0 AND NOT (a = 0 AND b = 0)")
def _(d):
    near = d.lines().where((F.greatest("x0", "x1") >= 3) & (F.least("x0", "x1") <= 117) & (F.greatest("y0", "y1") >= 5) & (F.least("y0", "y1") <= 79))
    return near.where(G.crosses(tuple(map(c, ("x0", "y0", "x1", "y1"))), tuple(map(F.lit, _CUT)))).select("id")


@query("f08_rows_by_key", "SELECT l_orderkey AS id, l_linenumber AS place FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(d):
    chosen = d.table("orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("id"))
    return readers.selected(d.table("lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("place")), chosen)


@query("f11_only_missing", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN 1.0 WHEN c_custkey % 3 = 0 THEN c_acctbal END AS level FROM customer")
def _(d):
    rows = d.table("customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 4 != 0, 1.0).alias("level"))
    return readers.write_back(rows, d.table("customer").where("c_custkey % 3 = 0").select(c("c_custkey").alias("id"), c("c_acctbal").alias("level")), "id", "level", overwrite=False)


@query("f13_manhole_rule", _ZONAL + "SELECT p.id, CASE WHEN p.id % 3 < 2 AND p.id % 7 = 0 AND lowest IS NOT NULL THEN lowest ELSE 3.0 END::DOUBLE AS drain_level FROM points p LEFT JOIN near USING (id)")
def _(d):
    kind = F.when(c("id") % 3 == 0, 102).when(c("id") % 3 == 1, 105).otherwise(101)
    manholes = _points(d).withColumn("calculation_type", kind).withColumn("manhole_indicator", (c("id") % 7).cast("int")).withColumn("drain_level", F.lit(3.0))
    return sampling.drain_level(manholes, d.pixels(), GRID, 30.0, overwrite=True, value="z", inspection_only=True).select("id", "drain_level")


@query("f17_edges_with_obstacles", relations("lines") + "SELECT id FROM lines WHERE kcu IN (3, 51) AND id IN (SELECT end_id FROM lines)")
def _(d):
    return readers.selected(d.lines().where(c("kcu").isin(3, 51)).select("id"), d.lines().select(c("end_id").alias("id")))


@query("f18_peaks_high_enough", relations("pixels") + "SELECT row, col FROM pixels JOIN (SELECT row, min(z) AS lowest FROM pixels GROUP BY row) USING (row) WHERE z > lowest + 20 - 0.1")
def _(d):
    p = d.pixels().select("row", "col", "z")
    return p.join(p.groupBy("row").agg(F.min("z").alias("lowest")), "row").where(leak.stands_out(c("z"), c("lowest"), 20.0, leak.search_precision(20.0))).select("row", "col")


@query("f19_valid_requests", _REQUESTS + "SELECT id, sign_fits AND method_fits AND threshold_fits AS valid FROM valid")
def _(d):
    return _requests(d).select("id", "valid")


@query("f20_flow_variables", _REQUESTS + "SELECT id, variable FROM req WHERE variable IN ('q', 'u1', 'au', 'qp', 'up1', 'ts_max')")
def _(d):
    return _requests(d).where(c("kind") == "flow").select("id", "variable")


@query("f21_growing", "SELECT id, bool_and(coalesce(v > p, true)) AS strict, bool_and(coalesce(v >= p, true)) AS loose FROM (SELECT event_id // 3 AS id, user_id % 7 AS v, lag(user_id % 7) OVER (PARTITION BY event_id // 3 ORDER BY event_id) AS p FROM events) GROUP BY id")
def _(d):
    rows = d.table("events").groupBy(F.floor(c("event_id") / 3).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (c("user_id") % 7).alias("v")))), lambda s: s["v"]).alias("v"))
    return rows.select("id", G.grows(c("v")).alias("strict"), G.grows(c("v"), False).alias("loose"))


# --- variables and aggregates -----------------------------------------------------------------------


@query("v01_u1_abs_max", relations("line_w") + "SELECT entity_id, round(max(abs(u1)), 6) AS u1_abs_max FROM line_w GROUP BY entity_id")
def _(d):
    return _line(d, Request("u1", "max", "abs")).select("entity_id", r("u1_abs_max").alias("u1_abs_max"))


@query("v02_vol_last", relations("node_w") + "SELECT entity_id, round((array_agg(vol ORDER BY t))[-1], 6) AS vol_last FROM node_w GROUP BY entity_id")
def _(d):
    return _node(d, Request("vol", "last")).select("entity_id", r("vol_last").alias("vol_last"))


def _per_area(name: str, variable: str, raw: str, method: str, sign: str | None = None) -> None:
    request = Request(variable, method, sign)
    how = "CASE WHEN count(rain) < count(*) THEN NULL ELSE sum(rain / sumax * dt) * 1000 END" if method == "sum" else "max(rain / sumax) * 1000"

    @query(name, relations("node_w", "nodes") + f"SELECT entity_id, round({how}, 3) AS {request.column} FROM node_w JOIN nodes ON nodes.id = entity_id GROUP BY entity_id")
    def _(d):
        values = d.node_ts().withColumnRenamed("rain", raw).join(d.nodes().select(c("id").alias("entity_id"), "sumax"), "entity_id")
        return time_aggregate(values, d.steps(), [request], START, END).select("entity_id", r(request.column, 3).alias(request.column))


_per_area("v06_infiltration_mm", "infiltration_rate_simple_mm", "infiltration_rate_simple", "sum")
_per_area("v07_lateral_mm", "q_lat_mm", "q_lat", "sum", "net")
_per_area("v08_intercepted_mm", "intercepted_volume_mm", "intercepted_volume", "max")
_per_area("v09_sources_mm", "q_sss_mm", "q_sss", "sum", "net")


@query("v15_no_sign", relations("line_w") + f"SELECT entity_id, round(max({_Q}), 6) AS q_max, round(max({_Q}), 6) AS q_net_max FROM line_w GROUP BY entity_id")
def _(d):
    return _line(d, Request("q", "max"), Request("q", "max", "net")).select("entity_id", r("q_max").alias("q_max"), r("q_net_max").alias("q_net_max"))


@query("a15_hybrid", _GRAD + f"SELECT l.id AS entity_id, round(max((b.s1 - a.s1) / {_LEN}), 6) AS grad_max, round(min((a.s1 + b.s1) / 2), 6) AS wl_at_xsec_min FROM lines l JOIN node_w a ON a.entity_id = l.start_id JOIN node_w b ON b.entity_id = l.end_id AND b.t = a.t GROUP BY l.id")
def _(d):
    both = graph.gradients(d.lines(), d.node_ts()).join(graph.levels_between(d.lines(), d.node_ts()), ["entity_id", "t"])
    return time_aggregate(both, d.steps(), [Request("grad", "max"), Request("wl_at_xsec", "min")], START, END).select("entity_id", r("grad_max").alias("grad_max"), r("wl_at_xsec_min").alias("wl_at_xsec_min"))


@query("a16_node_sums", relations("line_q", "lines") + "SELECT id, round(sum(q), 2) AS q FROM (SELECT start_id AS id, q FROM lines JOIN line_q USING (id) UNION ALL SELECT end_id, q FROM lines JOIN line_q USING (id)) GROUP BY id")
def _(d):
    both = d.lines().join(_flows(d), "id").select(F.explode(F.array("start_id", "end_id")).alias("id"), "q")
    return both.groupBy("id").agg(r(F.sum("q"), 2).alias("q"))


@query("a20_wide_crest", relations("pixels", extra="wide AS (SELECT s.s_suppkey AS id, q.col, max(q.z) AS z FROM supplier s JOIN pixels q ON abs(q.row - s.s_suppkey * 3 % 100) <= 1 AND q.col >= s.s_suppkey % 50 AND q.col < s.s_suppkey % 50 + 20 GROUP BY ALL)") + "SELECT id, round(avg(z), 6) AS level FROM wide GROUP BY id")
def _(d):
    return sampling.crest_level(_levees(d), d.pixels(), GRID, 10.0, value="z").select("id", r("level").alias("level"))


@query("r11_lowest_along", relations("pixels", extra=_ALONG) + "SELECT id, (col - id % 50)::BIGINT AS place, low AS level FROM wide")
def _(d):
    return sampling.levels_along(_levees(d), d.pixels(), GRID, 10.0, True, value="z").select("id", "place", "level")


@query("a32_lower_bank", "SELECT l_orderkey AS id, round(least(max(l_extendedprice) FILTER (WHERE l_linenumber % 2 = 0), max(l_extendedprice) FILTER (WHERE l_linenumber % 2 = 1)), 3) AS bank FROM lineitem GROUP BY l_orderkey")
def _(d):
    side = lambda k: F.max(F.when(c("l_linenumber") % 2 == k, c("l_extendedprice")))
    return d.table("lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.round(F.least(side(0), side(1)), 3).alias("bank"))


@query("a33_missing_area", "SELECT s_suppkey AS id, (10 + s_suppkey % 20) * 20 / 2.0::DOUBLE - s_suppkey % 5 * 25.0 AS area, floor(((10 + s_suppkey % 20) * 20 / 2.0::DOUBLE - s_suppkey % 5 * 25.0) / 25)::BIGINT AS n_pixels FROM supplier WHERE (10 + s_suppkey % 20) * 10 > s_suppkey % 5 * 25")
def _(d):
    i = c("s_suppkey")
    zero = F.lit(0.0)
    triangles = d.table("supplier").select(i.alias("id"), zero.alias("x1"), zero.alias("y1"), (10 + i % 20).cast("double").alias("x2"), zero.alias("y2"), zero.alias("x3"), F.lit(20.0).alias("y3"))
    pixels = d.table("supplier").where(i % 5 > 0).select(i.alias("id"), F.lit(0).alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), i % 5)).alias("col"))
    return cells.missing_area(triangles, pixels, 5.0)


@query("a36_totals", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def _(d):
    return d.table("orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("a37_rollup", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(d):
    rows = d.table("orders").select(c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"), "o_custkey")
    return rows.rollup("status", "priority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("a37_cube", "SELECT o_orderstatus AS status, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(d):
    rows = d.table("orders").select(c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"), "o_totalprice")
    return rows.cube("status", "priority").agg(r(F.sum("o_totalprice"), 2).alias("total"))


# --- joins ------------------------------------------------------------------------------------------


@query("j02_series_of_line_ends", relations("lines", "node_ts") + "SELECT entity_id, t, s1 FROM node_ts WHERE entity_id IN (SELECT start_id FROM lines WHERE kcu = 100 UNION SELECT end_id FROM lines WHERE kcu = 100)")
def _(d):
    ends = graph.ends_of_lines(d.lines().where("kcu = 100")).withColumnRenamed("id", "entity_id")
    return readers.selected(d.node_ts(), ends, "entity_id").select("entity_id", "t", "s1")


@query("j07_gauge_segments", "SELECT s_suppkey::INTEGER AS gauge, k::INTEGER AS segment, (s_suppkey + 30 * k)::DOUBLE AS gx0, ([5, 35, s_suppkey % 11])[k + 1]::DOUBLE AS gy0 FROM supplier, range(3) r(k)")
def _(d):
    i = c("s_suppkey")
    points = F.array(_pt(i, F.lit(5)), _pt(i + 30, F.lit(35)), _pt(i + 60, i % 11), _pt(i + 90, F.lit(45)))
    return gauge.gauge_segments(d.table("supplier").select(i.cast("int").alias("gauge"), points.alias("points"))).select("gauge", "segment", "gx0", "gy0")


@query("j08_starts_left", relations("lines", extra=_CROSS) + "SELECT gauge, id, direction = 1 AS starts_left FROM crossed")
def _(d):
    return gauge.crossings(d.lines(), _gauges(d)).select("gauge", "id", (c("direction") == 1).alias("starts_left"))


@query("j09_bound_flows", relations("lines", "line_q") + "SELECT id, round(q, 3) AS q FROM lines LEFT JOIN line_q USING (id)")
def _(d):
    return readers.write_back(d.lines().select("id"), _flows(d), "id", "q").select("id", r("q", 3).alias("q"))


@query("j11_shared_edges", "SELECT id, side_xmax - side_xmin + side_ymax - side_ymin AS length FROM (" + _NEAR + ")")
def _(d):
    found = graph.resolved_neighbours(*_cells(d))
    return found.select("id", (c("side_xmax") - c("side_xmin") + c("side_ymax") - c("side_ymin")).alias("length"))


@query("j13_cell_pairs", "SELECT location, count(*) AS n FROM (" + _NEAR + ") GROUP BY location")
def _(d):
    return leak.cell_pairs(graph.resolved_neighbours(*_cells(d))).groupBy("location").agg(F.count("*").alias("n"))


@query("j14_potential_edges", "WITH nodes AS MATERIALIZED (SELECT DISTINCT user_id AS id, (user_id % 15 * 10)::DOUBLE AS x, (user_id // 15 * 10)::DOUBLE AS y FROM events), " + _CELLS + ", e AS MATERIALIZED (SELECT l.id AS edge, a.id AS s, b.id AS t, a.x AS fx0, a.y AS fy0, b.x AS fx1, b.y AS fy1 FROM near l JOIN nodes a ON a.id = l.start_id JOIN nodes b ON b.id = l.end_id), o AS MATERIALIZED (SELECT id, id - 1 AS from_edge, id + 1 AS to_edge, x - 5 AS x0, y + 2 AS y0, x + 15 AS x1, y + 7 AS y1 FROM nodes WHERE id % 4 = 0)" + f" SELECT DISTINCT o.id AS obstacle, e.edge FROM o JOIN e ON (e.s IN (o.id, o.id + 1) OR e.t IN (o.id, o.id + 1)) AND e.edge NOT IN (o.from_edge, o.to_edge) WHERE sign({_side('fx0', 'fy0', 'x0', 'y0', 'x1', 'y1')}) * sign({_side('fx1', 'fy1', 'x0', 'y0', 'x1', 'y1')}) <= 0 AND sign({_side('x0', 'y0', 'fx0', 'fy0', 'fx1', 'fy1')}) * sign({_side('x1', 'y1', 'fx0', 'fy0', 'fx1', 'fy1')}) <= 0 AND NOT ({_side('fx0', 'fy0', 'x0', 'y0', 'x1', 'y1')} = 0 AND {_side('fx1', 'fy1', 'x0', 'y0', 'x1', 'y1')} = 0)")
def _(d):
    nodes, (_, near) = d.nodes(), _cells(d)
    end = lambda k, i: nodes.select(c("id").alias(k), c("x").alias(f"fx{i}"), c("y").alias(f"fy{i}"))
    flow = near.join(end("start_id", 0), "start_id").join(end("end_id", 1), "end_id").withColumnRenamed("id", "edge")
    owned = flow.select(F.explode(F.array("start_id", "end_id")).alias("cell"), "edge")
    obstacles = nodes.where("id % 4 = 0").selectExpr("id", "array(id, id + 1) AS cells", "id - 1 AS from_edge", "id + 1 AS to_edge", "x - 5 AS x0", "y + 2 AS y0", "x + 15 AS x1", "y + 7 AS y1")
    return cells.potential_edges(obstacles, owned, flow.select("edge", "fx0", "fy0", "fx1", "fy1"))


@query("j15_channel_sections", "SELECT o_orderkey AS channel, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(d):
    sections = d.table("lineitem").select(c("l_orderkey").alias("channel"), "l_linenumber")
    return d.table("orders").select(c("o_orderkey").alias("channel")).join(sections, "channel", "left").groupBy("channel").agg(F.count("l_linenumber").alias("n"))


_DIST = "WITH RECURSIVE p AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst, (10 + s_suppkey % 7)::DOUBLE AS length FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, s_suppkey // 4, 30.0 FROM supplier WHERE s_suppkey > 3 AND s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey // 2, s_suppkey, 5.0 FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 10 = 0), way AS (SELECT src AS far, dst AS node, min(length) AS way, 1 AS n FROM p GROUP BY src, dst UNION ALL SELECT w.far, p.dst, min(w.way + p.length), w.n + 1 FROM way w JOIN p ON p.src = w.node WHERE w.n < 26 AND p.dst <> w.far GROUP BY w.far, p.dst, w.n), best AS (SELECT far, node, min(way) AS way FROM way GROUP BY far, node), farthest AS (SELECT node, max(way) AS way FROM best GROUP BY node) "


def _mains(d: Derived) -> DataFrame:
    """The tree of pipes with ways that meet again, and some that lead back."""
    s = d.table("supplier").select(c("s_suppkey").alias("i"))
    tree = s.where("i > 1").select(c("i").alias("id"), c("i").alias("src"), F.floor(c("i") / 2).alias("dst"), (10 + c("i") % 7).cast("double").alias("length"))
    short = s.where("i > 3 and i % 3 = 0").select((c("i") + 1_000_000).alias("id"), c("i").alias("src"), F.floor(c("i") / 4).alias("dst"), F.lit(30.0).alias("length"))
    back = s.where("i > 0 and i % 10 = 0").select((c("i") + 2_000_000).alias("id"), F.floor(c("i") / 2).alias("src"), c("i").alias("dst"), F.lit(5.0).alias("length"))
    return tree.unionByName(short).unionByName(back)


_MAINS = "m AS (SELECT s_suppkey AS id, s_suppkey AS src, (10 + s_suppkey % 7)::DOUBLE AS length FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey + 1000000, s_suppkey, 30.0 FROM supplier WHERE s_suppkey > 3 AND s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 2000000, s_suppkey // 2, 5.0 FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 10 = 0)"


@query("j19_meeting_ways", _DIST.rstrip() + f", {_MAINS} SELECT m.id, m.length + coalesce(f.way, 0) AS distance FROM m LEFT JOIN farthest f ON f.node = m.src")
def _(d):
    return network.upstream_distance(_mains(d))


@query("j18_many_classes", _DIST.rstrip() + f", {_MAINS}, g AS (SELECT m.id, m.length + coalesce(f.way, 0) AS distance FROM m LEFT JOIN farthest f ON f.node = m.src) SELECT id, CASE WHEN distance < 500 THEN floor(distance * 40) / 1000 END::DOUBLE AS gradient FROM g")
def _(d):
    table = d.spark.range(20000).select((c("id") / 40).alias("low"), ((c("id") + 1) / 40).alias("high"), (c("id") / 1000).alias("gradient"))
    return network.gradient_of(network.upstream_distance(_mains(d)), table).select("id", "gradient")


@query("j20_pipe_ends", relations("pixels", extra="pts AS (SELECT c_custkey AS id, c_custkey * 7 % 1000 + 0.25::DOUBLE AS x0, c_custkey * 13 % 1000 + 0.75::DOUBLE AS y0, c_custkey * 3 % 1000 + 0.25::DOUBLE AS x1, c_custkey * 17 % 1000 + 0.75::DOUBLE AS y1 FROM customer)") + "SELECT p.id, a.z AS start_z, b.z AS end_z FROM pts p LEFT JOIN pixels a ON a.row = floor((1000 - y0) / 10) AND a.col = floor(x0 / 10) LEFT JOIN pixels b ON b.row = floor((1000 - y1) / 10) AND b.col = floor(x1 / 10)")
def _(d):
    i = c("c_custkey")
    pts = d.table("customer").select(i.alias("id"), (i * 7 % 1000 + 0.25).alias("x0"), (i * 13 % 1000 + 0.75).alias("y0"), (i * 3 % 1000 + 0.25).alias("x1"), (i * 17 % 1000 + 0.75).alias("y1"))
    first = raster.sample(pts, d.pixels(), GRID, "z", "x0", "y0").withColumnRenamed("z", "start_z")
    return raster.sample(first, d.pixels(), GRID, "z", "x1", "y1").select("id", "start_z", c("z").alias("end_z"))


@query("j21_surface_where_missing", relations("pixels", extra="points AS (SELECT c_custkey AS id, c_custkey * 7 % 1100 + 0.25::DOUBLE AS x, c_custkey * 13 % 1000 + 0.75::DOUBLE AS y FROM customer)") + "SELECT p.id, CASE WHEN p.id % 2 = 0 THEN 1.5 ELSE q.z END::DOUBLE AS level FROM points p LEFT JOIN pixels q ON q.row = floor((1000 - p.y) / 10) AND q.col = floor(p.x / 10)")
def _(d):
    have = _points(d).select("id", F.when(c("id") % 2 == 0, 1.5).alias("level"))
    sampled = raster.sample(_points(d), d.pixels(), GRID, "z").select("id", c("z").alias("level"))
    return readers.write_back(have, sampled, "id", "level", overwrite=False)


@query("j22_code_lookup", relations("landuse") + "SELECT code, count(*) AS n, count(name) AS named FROM (SELECT code, n.n_name AS name FROM landuse LEFT JOIN nation n ON n.n_nationkey = code) GROUP BY code")
def _(d):
    table = d.table("nation").select("n_nationkey", c("n_name").alias("name"))
    return raster.reclass(d.landuse().select("row", "col", "code"), table, "code", "n_nationkey", "name").groupBy("code").agg(F.count("*").alias("n"), F.count("name").alias("named"))


def _dykes(d: Derived) -> DataFrame:
    """Chains of ten dykes end to end; heights step by chain."""
    i = c("s_suppkey")
    row = F.floor(i / 10)
    return d.table("supplier").select(i.alias("id"), row.alias("chain"), (i % 10 * 10).cast("double").alias("x0"), (row * 5).cast("double").alias("y0"), (i % 10 * 10 + 10).cast("double").alias("x1"), (row * 5).cast("double").alias("y1"), (row % 4 + i % 2 * 0.25).alias("height"))


@query("j23_adjacent_dykes", "SELECT s_suppkey AS u, s_suppkey + 1 AS v FROM supplier WHERE s_suppkey % 10 < 9 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)")
def _(d):
    return lines.adjacent(_dykes(d), height=0.5)


@query("r19_merged_dykes", "SELECT s_suppkey // 10 AS chain, min(s_suppkey) AS merged, count(*) AS n, round(avg(s_suppkey // 10 % 4 + s_suppkey % 2 * 0.25::DOUBLE), 6) AS mean, max(s_suppkey // 10 % 4 + s_suppkey % 2 * 0.25::DOUBLE) AS highest FROM supplier GROUP BY 1")
def _(d):
    return lines.merged_levees(_dykes(d), "chain", 0.5).select("chain", "merged", "n", r("mean").alias("mean"), "highest")


@query("r20_counts_by_threshold", "SELECT t AS threshold, CASE WHEN t > 0.25 THEN count(DISTINCT s_suppkey // 10) ELSE count(*) END AS n FROM supplier, (SELECT unnest([0.1, 0.2, 0.25, 0.3, 0.5])::DOUBLE AS t) GROUP BY t")
def _(d):
    return lines.merged_counts(_dykes(d), "chain", [0.1, 0.2, 0.25, 0.3, 0.5])


@query("j24_members", "SELECT s_suppkey AS line, s_suppkey // 10 AS merged FROM supplier")
def _(d):
    dykes = _dykes(d)
    whole = dykes.groupBy(c("chain").alias("merged")).agg(F.first("y0").alias("y")).select("merged", F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct((k * 10).cast("double").alias("x"), c("y").alias("y"))).alias("points"))
    return cells.members(whole, dykes)


@query("j25_tiles_of_cells", relations("nodes") + "SELECT id, (floor((x - 5) / 25) + i)::BIGINT AS tile_col, (floor((y - 5) / 25) + j)::BIGINT AS tile_row FROM nodes, range(2) a(i), range(2) b(j) WHERE (floor((x - 5) / 25) + i) * 25 <= x + 5 AND (floor((y - 5) / 25) + j) * 25 <= y + 5")
def _(d):
    span = lambda v: F.explode(F.sequence(F.floor((c(v) - 5) / 25), F.floor((c(v) + 5) / 25)))
    return d.nodes().select("id", "y", span("x").alias("tile_col")).select("id", "tile_col", span("y").alias("tile_row"))


@query("j26_as_of", "SELECT e.event_id, l.event_id AS last_click FROM events e ASOF LEFT JOIN (SELECT user_id, event_id, event_id AS at FROM events WHERE event_id % 11 = 0) l ON l.user_id = e.user_id AND l.at <= e.event_id")
def _(d):
    e = d.table("events").select("event_id", "user_id", c("event_id").alias("at"))
    clicks = e.where("event_id % 11 = 0").select("user_id", "at", c("event_id").alias("last_click"))
    return joins.as_of(e, clicks, "user_id", "at", "last_click").select("event_id", "last_click")


@query("j26_interval", "SELECT p_partkey AS id, s_suppkey AS interval FROM part JOIN supplier ON p_retailprice >= s_suppkey * 13 % 1000 + 500 AND p_retailprice < s_suppkey * 13 % 1000 + 500 + s_suppkey % 40")
def _(d):
    i = c("s_suppkey")
    spans = d.table("supplier").select(i.alias("interval"), (i * 13 % 1000 + 500).cast("double").alias("low"), (i * 13 % 1000 + 500 + i % 40).cast("double").alias("high"))
    return joins.within(d.table("part").select(c("p_partkey").alias("id"), c("p_retailprice").alias("at")), spans, "at", "low", "high", 25.0).select("id", "interval")
