"""Scenario metadata: links, attachments, rasters and their time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.operators.window import sequence_of_steps

#: Result codes of the downloads that take no time, and of those that need one.
STATIC = {"maximum depth": "depth-max-dtri", "maximum level": "s1-max-dtri", "damage": "total-damage"}
TIMED = {"depth": "depth-dtri", "level": "s1-dtri", "rain": "rain-quad"}


def link(results: Column, code: str) -> Column:
    """The attachment of the first result with this code, else NULL."""
    return F.get(F.filter(results, lambda r: r["result_type"]["code"] == code), F.lit(0))["attachment_url"]


def attachments(results: Column) -> Column:
    """Name to attachment of every result that has one; NULL if none has."""
    some = F.filter(results, lambda r: r["attachment_url"].isNotNull())
    return F.when(F.size(some) > 0, F.map_from_entries(F.transform(some, lambda r: F.struct(r["result_type"]["name"].alias("key"), r["attachment_url"].alias("value")))))


def rasters(scenarios: DataFrame, temporal: bool | None = None) -> DataFrame:
    """scenario, code, name, temporal of every result with a raster; of one kind, if asked for."""
    rows = scenarios.select(F.col("name").alias("scenario"), F.explode("result_set").alias("r")).where("r.raster is not null")
    rows = rows.select("scenario", "r.result_type.code", "r.result_type.name", F.coalesce("r.raster.temporal", F.lit(False)).alias("temporal"), "r.raster.uuid", "r.raster.first_value_timestamp", "r.raster.last_value_timestamp")
    return rows if temporal is None else rows.where(F.col("temporal") == temporal)


def steps(rows: DataFrame, interval_hours: float | None) -> DataFrame:
    """rows (temporal, first_value_timestamp, last_value_timestamp in ms) with one row for each time step, as an ISO time."""
    interval = F.lit(None).cast("long") if interval_hours is None else F.lit(int(interval_hours * 3600000)).cast("long")
    every = sequence_of_steps(F.col("first_value_timestamp"), F.col("last_value_timestamp"), interval, F.col("temporal"))
    return rows.withColumn("ms", F.explode(every)).withColumn("step", F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss"))


def step_label(name: Column, asked: Column, got: Column) -> Column:
    """name_<step>, or both steps where another than the asked one came."""
    clean = lambda c: F.regexp_replace(c, "[-:]", "")
    return F.when(asked == got, F.concat_ws("_", name, clean(got))).otherwise(F.concat_ws("_", name, F.lit("get"), clean(asked), F.lit("got"), clean(got)))


def with_source(style: Column, token: str, source: Column) -> Column:
    """A style's text with another source in the place of every <token>...</token>'s content."""
    return F.regexp_replace(style, F.lit(f"<{token}>[^<]*</{token}>"), F.concat(F.lit(f"<{token}>"), source, F.lit(f"</{token}>")))


def request_payload(uuid: Column, west: Column, south: Column, east: Column, north: Column, size: Column) -> Column:
    """The JSON of a request for a raster within bounds: its box as text, and width and height in whole pixels."""
    box = F.concat_ws(",", *(c.cast("string") for c in (west, south, east, north)))
    pixels = lambda a, b: F.ceil(F.round((b - a) / size, 5)).cast("int")
    return F.to_json(F.struct(uuid.alias("raster"), box.alias("bbox"), pixels(west, east).alias("width"), pixels(south, north).alias("height")))


def named(rasters: DataFrame) -> DataFrame:
    """rasters (code) that have a name of their own, with name, and timed."""
    name = F.create_map(*[F.lit(x) for known in (STATIC, TIMED) for k, v in known.items() for x in (v, k)])[F.col("code")]
    return rasters.drop("name").withColumn("name", name).where("name is not null").withColumn("timed", F.col("code").isin(list(TIMED.values())))
