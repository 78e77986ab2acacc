"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.textkit import Tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours hang on the least neighbour of their common vertex."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    out = joined.where("v > u") if large else joined
    moved = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(id, comp) of every vertex of edges (u, v): comp is the least id that links reach.

    Alternating large-star and small-star steps; each round is written to the
    shared folder, and the one before dropped.  Loops and repeated links do no harm;
    nulls aren't allowed; an empty table gives none.
    """
    tables = tables or Tables(edges.sparkSession, "components")
    links = tables.write(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = links.agg(F.count("*"), mark).first()
    while before[0]:
        last, links = links, tables.write(_star(_star(links, True), False), "links")
        tables.drop(last)
        now = links.agg(F.count("*"), mark).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()
