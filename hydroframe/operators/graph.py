"""Nodes and flowlines joined: gradients, levels between nodes, flows by node, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import geometry as G
from hydroframe.sources.scratch import Scratch


def with_ends(lines: DataFrame, values: DataFrame, *columns: str, key: str = "entity_id", by: tuple[str, ...] = ()) -> DataFrame:
    """lines with columns of both end nodes, as start_<c> and end_<c>; by: further columns that both ends share, such as t."""
    start = values.select(F.col(key).alias("start_id"), *by, *(F.col(c).alias(f"start_{c}") for c in columns))
    end = values.select(F.col(key).alias("end_id"), *by, *(F.col(c).alias(f"end_{c}") for c in columns))
    return lines.join(start, "start_id").join(end, ["end_id", *by])


def gradients(lines: DataFrame, node_ts: DataFrame) -> DataFrame:
    """entity_id, t, grad: the rise of the water level from start to end by the line's length."""
    size = G.length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    both = with_ends(lines, node_ts, "s1", by=("t",))
    return both.select(F.col("id").alias("entity_id"), "t", F.try_divide(F.col("end_s1") - F.col("start_s1"), size).alias("grad"))


def bed_gradients(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    size = G.length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    both = with_ends(lines, nodes, "dmax", key="id")
    return both.select("id", F.try_divide(F.col("end_dmax") - F.col("start_dmax"), size).alias("bed_grad"))


def levels_between(lines: DataFrame, node_ts: DataFrame) -> DataFrame:
    """entity_id, t, wl_at_xsec: the mean level of both ends."""
    both = with_ends(lines, node_ts, "s1", by=("t",))
    return both.select(F.col("id").alias("entity_id"), "t", ((F.col("start_s1") + F.col("end_s1")) / 2).alias("wl_at_xsec"))


def flow_per_node(nodes: DataFrame, lines: DataFrame, flows: DataFrame, out: bool) -> DataFrame:
    """id, x, y: flow out of (or into) each node along both axes, summed over its lines.

    flows is (id, q) with one aggregated flow for each line.  Out of the start node
    goes what is positive, out of the end node what is negative; in is the reverse.
    A node's sum is NULL if one of its lines has no value; nodes without lines have 0.
    """
    a = G.angle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    joined = lines.join(flows, "id").select("start_id", "end_id", F.greatest("q", F.lit(0.0)).alias("p"), F.least("q", F.lit(0.0)).alias("n"), F.cos(a).alias("c"), F.sin(a).alias("s"), F.col("q").isNull().alias("none"))
    first, second = ("p", "n") if out else ("n", "p")
    pick = lambda node, part: F.struct(F.col(node).alias("id"), F.when(~F.col("none"), F.abs(F.col(part) * F.col("c"))).alias("x"), F.when(~F.col("none"), F.abs(F.col(part) * F.col("s"))).alias("y"))
    each = joined.select(F.explode(F.array(pick("start_id", first), pick("end_id", second))).alias("e")).select("e.*")
    whole = lambda c: F.when(F.count(c) < F.count(F.lit(1)), None).otherwise(F.sum(c))
    total = each.groupBy("id").agg(whole("x").alias("x"), whole("y").alias("y"), F.lit(True).alias("met"))
    return nodes.select("id").join(total, "id", "left").select("id", *(F.when(F.col("met").isNull(), 0.0).otherwise(F.col(c)).alias(c) for c in ("x", "y")))


def lines_of_nodes(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines with an end among the nodes."""
    ids = nodes.select(F.col("id").alias("_n")).distinct()
    ends = lines.select("id", F.explode(F.array("start_id", "end_id")).alias("_n"))
    return lines.join(ends.join(ids, "_n", "left_semi").select("id").distinct(), "id", "left_semi")


def ends_of_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(F.array("start_id", "end_id")).alias("id")).distinct()


def nodes_of_lines(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    return nodes.join(ends_of_lines(lines), "id", "left_semi")


def linkless(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    return nodes.join(ends_of_lines(lines), "id", "left_anti")


def in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose point lies in (xmin, ymin, xmax, ymax)."""
    xmin, ymin, xmax, ymax = box
    if not (xmin < xmax and ymin < ymax):
        raise ValueError("the box is empty")
    return df.where(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def placed(df: DataFrame, *coordinates: str) -> DataFrame:
    """Rows whose coordinates are all finite and not the sentinel."""
    for c in coordinates:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != -9999) & (F.abs(F.col(c)) < float("inf")))
    return df


def lines_by_end(lines: DataFrame) -> DataFrame:
    """node and the ids of its lines, in order."""
    ends = lines.select("id", F.explode(F.array_distinct(F.array("start_id", "end_id"))).alias("node"))
    return ends.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("lines"))


def resolved_neighbours(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells on both sides of a line, where the second lies (right, top, left, bottom), and the side they share.

    cells is (id, xmin, ymin, xmax, ymax); lines join the cells of their end nodes.
    """
    one = cells.select(F.col("id").alias("start_id"), *(F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    two = cells.select(F.col("id").alias("end_id"), *(F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    both = lines.select("id", "start_id", "end_id").join(one, "start_id").join(two, "end_id")
    where = F.when(F.col("a_xmax") == F.col("b_xmin"), "right").when(F.col("a_ymax") == F.col("b_ymin"), "top").when(F.col("a_xmin") == F.col("b_xmax"), "left").when(F.col("a_ymin") == F.col("b_ymax"), "bottom")
    shared = {f"side_{c}": (F.greatest if c.endswith("min") else F.least)(f"a_{c}", f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")}
    found = both.select("id", "start_id", "end_id", where.alias("location"), *(v.alias(k) for k, v in shared.items()))
    return found.where("location is not null and side_xmin <= side_xmax and side_ymin <= side_ymax")


def components(links: DataFrame) -> DataFrame:
    """(id, part) of every vertex of links (u, v): part is the least id that links reach.

    In turns, the greater and the smaller neighbours of a vertex hang on the least one, until
    all links are stars; no vertex gathers its neighbours in a list.
    """
    scratch = Scratch(links.sparkSession, "components")
    now = scratch.write(links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v").distinct())
    sign, before = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), None
    while (mark := sign(now)) != before:
        before, last = mark, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        now = scratch.write(now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.drop(last)
    return now.select(F.col("u").alias("id"), F.col("v").alias("part")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("part"))).distinct()
