"""Readers and writers: a mesh with its results, lookup tables, scenario JSON, series files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id bigint, x double, y double, node_type int, sumax double, dmax double"
LINES = "id bigint, start_id bigint, end_id bigint, kcu int, content_type string, content_pk bigint, dpumax double, x0 double, y0 double, x1 double, y1 double"
LANDUSE = "Code int, Landuse string, Friction double, Permeability double, Interception double, Crop_type int"
SOIL = "Code int, Soiltype string, Max_infiltration_rate double, Hydraulic_conductivity double"
RESULT = "result_type: struct<code: string, name: string, has_raster: boolean>, attachment_url: string, raster: struct<uuid: string, temporal: boolean, first_value_timestamp: bigint, last_value_timestamp: bigint>"
SCENARIO = f"name string, uuid string, model_name string, result_set array<struct<{RESULT}>>"


def mesh(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, lines) of a folder with nodes.parquet and lines.parquet."""
    return spark.read.schema(NODES).parquet(f"{folder}/nodes.parquet"), spark.read.schema(LINES).parquet(f"{folder}/lines.parquet")


def series(results: DataFrame, variables: list[str], start: float | None = None, end: float | None = None) -> DataFrame:
    """entity_id, t and the variables, between two times inclusive; both reach the scan.  A variable that results lack is NULL."""
    if start is not None:
        results = results.where(F.col("t") >= start)
    if end is not None:
        results = results.where(F.col("t") <= end)
    return results.select("entity_id", "t", *(F.col(v) if v in results.columns else F.lit(None).cast("double").alias(v) for v in variables))


def lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of codes in a file with semicolons and a header."""
    return spark.read.schema(schema).options(sep=";", header=True).csv(path)


def lookup_rows(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """A table of codes out of landed lines with semicolons."""
    return lines.select(F.from_csv(column, schema, {"sep": ";"}).alias("r")).select("r.*")


#: What begins a geometry's text, by kind.
POINTS_OF = {"point": "POINT", "line": "LINESTRING", "polygon": "POLYGON"}


def features(table: DataFrame, geometry: str = "wkt", layer: str | None = None, column: str = "layer") -> DataFrame:
    """The rows of a vector table, or of one of its layers, with kind and points (array<struct<x, y>>) of their WKT.

    Points, lines and polygons of one ring; other texts and NULL give no points.
    """
    rows = table if layer is None else table.where(F.col(column) == layer)
    text = F.upper(F.trim(F.col(geometry)))
    kind = F.lit(None).cast("string")
    for name, word in POINTS_OF.items():
        kind = F.when(text.rlike(rf"^{word} ?Z?\s*\("), name).otherwise(kind)
    pairs = F.split(F.regexp_replace(text, r"^[A-Z ]*\(+|\)+$", ""), r"\s*,\s*")
    number = lambda p, i: F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    points = F.transform(pairs, lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    return rows.withColumn("kind", kind).withColumn("points", F.when(F.col("kind").isNotNull(), points))


def fields(df: DataFrame) -> DataFrame:
    """name and kind of every column, and how many rows have a value in it."""
    each = [F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.count(F.col(name)).alias("n")) for name, kind in df.dtypes]
    return df.agg(F.array(*each).alias("f")).select(F.inline("f"))


def scenarios(raw: DataFrame, column: str = "value") -> DataFrame:
    """Scenario rows of landed JSON texts; a text that can't be read gives NULLs."""
    return raw.select(F.from_json(column, SCENARIO).alias("s")).select("s.*")


def find(rows: DataFrame, limit: int = 10, **contains: str) -> DataFrame:
    """Scenarios whose columns contain the given parts, whatever the case; the first by name."""
    for name, part in contains.items():
        rows = rows.where(F.lower(F.col(name)).contains(part.lower()))
    return rows.orderBy("name", "uuid").limit(limit)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def add_column(df: DataFrame, name: str, kind: str = "double") -> DataFrame:
    """df with an empty column of that name, unless it has one."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def write_back(df: DataFrame, new: DataFrame, key: str, column: str, overwrite: bool = True) -> DataFrame:
    """df with column from new where new has the key; without overwrite only where df has none."""
    taken = new.select(key, F.col(column).alias("_new"))
    df = add_column(df, column)
    best = F.coalesce("_new", column) if overwrite else F.coalesce(column, "_new")
    return df.join(taken, key, "left").withColumn(column, best).drop("_new")


def selected(df: DataFrame, chosen: DataFrame | None, key: str = "id") -> DataFrame:
    """The chosen rows, or all if nothing is chosen."""
    return df if chosen is None else df.join(chosen.select(key).distinct(), key, "left_semi")


def part(df: DataFrame, k: int, n: int, key: str = "id") -> DataFrame:
    """The k-th (from 1) of n parts of the key's range; parts of equal width, so no row is counted or moved."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df
    width = (high - low + 1) / n
    return df.where((F.col(key) >= low + width * (k - 1)) & (F.col(key) < low + width * k))


def output_column(df: DataFrame, name: str) -> Column:
    """A value as sinks take it: bytes as UTF-8, NaN as NULL, other kinds as strings."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind in ("double", "float"):
        return F.when(F.isnan(c), None).otherwise(c).alias(name)
    if kind in ("int", "bigint", "smallint", "tinyint", "boolean", "string"):
        return c.alias(name)
    return (F.decode(c, "UTF-8") if kind == "binary" else c.cast("string")).alias(name)


def write_series_csv(series: DataFrame, path: str) -> None:
    """A table of time steps and gauges as CSV: whole seconds, values with six decimals, quoted names."""
    columns = [F.format_string("%d", F.col("t").cast("long")).alias("timestep")]
    columns += [F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in series.columns if c != "t"]
    series.orderBy("t").select(*columns).coalesce(1).write.mode("overwrite").options(header=True, quoteAll=False).csv(path)


def write_tiles(pixels: DataFrame, path: str, tile: int = 1000) -> None:
    """Pixels by tile, so that a window's read skips other tiles."""
    tiled = pixels.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    tiled.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)


def settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Settings of one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_settings(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def with_new_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with empty real columns; a name that it has raises."""
    if taken := [n for n in names if n in df.columns]:
        raise ValueError(f"columns exist: {', '.join(taken)}")
    return df.select("*", *(F.lit(None).cast("double").alias(n) for n in names))


# The settings that a new model starts with.
NUMERICAL = {"id": 1, "convergence_eps": 0.00001, "integration_method": 0, "max_degree": 5, "max_nonlin_iterations": 20, "use_of_cg": 20, "use_of_nested_newton": 0}
INFILTRATION = {"id": 1, "infiltration_rate": 0, "infiltration_rate_file": "rasters/infiltration.tif"}


def replaced_settings(models: DataFrame, row: dict, key: str = "id") -> DataFrame:
    """A table of settings that holds this row for each model, in place of what it had."""
    return models.select(key, *(F.lit(v).alias(k) for k, v in row.items() if k != key))


def without(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """df with NULL in a column where the condition holds."""
    return df.withColumn(column, F.when(condition, None).otherwise(F.col(column)))
