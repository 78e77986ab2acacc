"""Time aggregation as a table function, so that a list of requests runs from SQL.

    SELECT * FROM time_aggregate(TABLE(values), 's1 max; q sum net; ucx above_thres pos 5.0', 30000, 2000000)

values holds the rows of all entities: the entity's key first, then t and variables in
any order.  The function's columns follow from the requests before anything runs, and a
request that can't be compiled raises then.  Spark deals the rows by entity and sorts
them by t; each entity's steps are those of its own rows, and its last value isn't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from hydroframe.functions.registry import BY_NAME, METHODS, NOT_REDUCING, SENTINEL, SIGNS, TURNED, Request
from hydroframe.operators.aggregate import BY_AREA


def requests_of(text: str) -> list[Request]:
    """Requests of a text: variable, method, and if need be a sign and a threshold, separated by semicolons."""
    out = []
    for part in filter(None, map(str.strip, text.split(";"))):
        variable, method, *more = part.split()
        signs, limits = [x for x in more if x in SIGNS], [x for x in more if x not in SIGNS]
        if len(signs) > 1 or len(limits) > 1:
            raise ValueError(f"can't read the request {part}")
        request = Request(variable, method, signs[0] if signs else None, float(limits[0]) if limits else None)
        if problems := request.problems():
            raise ValueError("; ".join(problems))
        out.append(request)
    if not out:
        raise ValueError("there is no request")
    return out


def values_of(request: Request, column) -> np.ndarray:
    """The request's variable with its sign, NaN where it is missing; column gives one of the rows' columns."""
    name = request.variable
    with np.errstate(divide="ignore", invalid="ignore"):
        if name in BY_AREA:
            area = column("sumax")
            v = np.where(area != 0, column(BY_AREA[name]) / area, np.nan)
        elif name == "uc":
            v = np.hypot(column("ucx"), column("ucy"))
        elif name == "ts_max":
            v = np.where(np.isin(column("kcu"), NOT_REDUCING), 9999.0, column("length") / np.abs(column("u1")))
        else:
            v = column(name)
    if BY_NAME[name].kind == "flow" and name != "ts_max":
        kcu = column("kcu")
        v = np.where((kcu >= TURNED[0]) & (kcu <= TURNED[1]), -v, v)
    known = ~np.isnan(v)
    if request.sign == "pos":
        v = np.where(known & (v < 0), 0.0, v)
    elif request.sign == "neg":
        v = np.where(known & (v >= 0), 0.0, v)
    return np.abs(v) if request.sign == "abs" else v


def aggregated(request: Request, v: np.ndarray, te: np.ndarray, dt: np.ndarray) -> float | None:
    """The request's method over the values that hold from te for dt seconds."""
    known = v[~np.isnan(v)]
    method, limit = request.method, request.threshold
    if METHODS[method][1]:
        return float(100.0 * dt[v > limit if method == "above_thres" else v < limit].sum() / dt.sum())
    if method == "max_time":
        return float(te[np.argmax(np.where(np.isnan(v), SENTINEL, v))])
    if method == "sum":
        out = float((v * dt).sum())
    elif method in ("first", "last"):
        out = float(v[0 if method == "first" else -1])
    elif not len(known):
        return None
    else:
        out = float({"min": np.min, "max": np.max, "mean": np.mean, "median": np.median, "first_non_empty": lambda x: x[0], "last_non_empty": lambda x: x[-1]}[method](known))
    return None if np.isnan(out) else out * request.multiplier


class TimeAggregate:
    """The table function: rows of one entity, in the order of t, become one row."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.asked: tuple[str, float | None, float | None] = ("", None, None)

    @staticmethod
    def analyze(values: AnalyzeArgument, requests: AnalyzeArgument, start: AnalyzeArgument | None = None, end: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(values.dataType, StructType) or "t" not in values.dataType.names or values.dataType.names[0] == "t":
            raise ValueError("the first argument is a table: a key, t, and variables")
        key = values.dataType.fields[0]
        schema = StructType().add(key.name, key.dataType)
        for request in requests_of(str(requests.value)):
            schema.add(request.column, DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn("t")])

    def eval(self, values: Row, requests: str, start: float | None = None, end: float | None = None) -> None:
        self.rows.append(values)
        self.asked = (requests, start, end)

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        text, start, end = self.asked
        number = lambda x: np.nan if x is None or x == SENTINEL or abs(float(x)) == float("inf") else float(x)
        names = set(self.rows[0].__fields__)
        t = np.array([float(r["t"]) for r in self.rows])
        te = t[:-1] if start is None else np.maximum(t[:-1], float(start))
        dt = (t[1:] if end is None else np.minimum(t[1:], float(end))) - te
        used = np.flatnonzero(dt > 0)
        if not len(used):
            return
        held = [self.rows[i] for i in used]
        column = lambda name: np.array([number(r[name]) for r in held]) if name in names else np.full(len(held), np.nan)
        found = [aggregated(q, values_of(q, column), te[used], dt[used]) for q in requests_of(text)]
        yield (self.rows[0][0], *found)


def register(spark: SparkSession, name: str = "time_aggregate") -> None:
    """Make the function known to a session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(TimeAggregate))
