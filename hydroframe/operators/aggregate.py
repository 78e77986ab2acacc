"""Time aggregation: requests compiled to one aggregate for each kind of entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import aggregates as A
from hydroframe.functions.registry import BY_NAME, Request
from hydroframe.operators.window import window

#: Node variables that are another one by area.
BY_AREA = {"rain_depth": "rain", "infiltration_rate_simple_mm": "infiltration_rate_simple", "q_lat_mm": "q_lat", "intercepted_volume_mm": "intercepted_volume", "q_sss_mm": "q_sss"}


def prepared(request: Request, columns: list[str], cfl: float = 1.0) -> Column:
    """The request's variable with its sign, before aggregation; NULL where the results lack it."""
    name = request.variable
    if problems := request.problems():
        raise ValueError("; ".join(problems))

    def raw(c: str) -> Column:
        return A.valid(F.col(c)) if c in columns else F.lit(None).cast("double")

    if name in BY_AREA:
        v = A.per_area(raw(BY_AREA[name]), F.col("sumax"))
    elif name == "uc":
        v = A.speed(raw("ucx"), raw("ucy"))
    elif name == "ts_max":
        v = A.largest_step(F.col("length"), raw("u1"), F.col("kcu"), cfl)
    else:
        v = raw(name)
    if BY_NAME[name].kind == "flow" and name != "ts_max" and "kcu" in columns:
        v = A.direction(v, F.col("kcu"))
    return A.SIGNED[request.sign or ""](v)


def time_aggregate(values: DataFrame, steps: DataFrame, requests: list[Request], start: float | None = None, end: float | None = None, cfl: float = 1.0, key: str = "entity_id") -> DataFrame:
    """One row for each entity of values (key, t, variables), one column for each request.

    The window joins as a small dimension; all requests share one scan and one
    aggregate with partial sums.  Bounds of the window are also filters of the scan: its
    end, and the last step at or before its start, which the dimension has.
    """
    win = window(steps, start, end)
    if start is not None:
        held = steps.where(F.col("t") <= start).agg(F.max("t").alias("t"))
        values = values.where(F.col("t") >= F.coalesce(held.scalar(), F.lit(float("-inf"))))
    if end is not None:
        values = values.where(F.col("t") < end)
    inputs = values.columns
    joined = values.join(win, "t")
    columns = [prepared(r, inputs, cfl).alias(f"_{i}") for i, r in enumerate(requests)]
    staged = joined.select(key, "te", "dt", *columns)
    return staged.groupBy(key).agg(*(A.aggregate(r, F.col(f"_{i}"), F.col("te"), F.col("dt")).alias(r.column) for i, r in enumerate(requests)))
