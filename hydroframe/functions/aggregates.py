"""Derived variables, signs and time methods as Columns.

A missing value is NULL within the engine.  v is the value that holds from te
for dt seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydroframe.functions.registry import NOT_REDUCING, SENTINEL, TURNED, Request


def valid(v: Column) -> Column:
    """NULL in place of the sentinel, NaN and infinities."""
    v = v.cast("double")
    return F.when((v == SENTINEL) | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def direction(v: Column, kcu: Column) -> Column:
    """Turned for the links between 1D and 2D."""
    return F.when(kcu.between(*TURNED), -v).otherwise(v)


SIGNED: dict[str, Callable[[Column], Column]] = {
    "": lambda v: v,
    "net": lambda v: v,
    "pos": lambda v: F.when(v.isNull() | (v >= 0), v).otherwise(0.0),
    "neg": lambda v: F.when(v.isNull() | (v < 0), v).otherwise(0.0),
    "abs": F.abs,
}


def per_area(v: Column, sumax: Column) -> Column:
    return F.try_divide(v, sumax)


def speed(ucx: Column, ucy: Column) -> Column:
    return F.sqrt(ucx * ucx + ucy * ucy)


def largest_step(length: Column, u1: Column, kcu: Column, cfl: float = 1.0) -> Column:
    """The time step that the flow allows; 9999 for kinds that don't limit it, and without bound at rest."""
    return F.when(kcu.isin(NOT_REDUCING), 9999.0).when(u1 == 0, F.lit(float("inf"))).otherwise(F.try_divide(length * cfl, F.abs(u1)))


def whole_sum(x: Column) -> Column:
    """A sum that is NULL if any value is."""
    return F.when(F.count(x) < F.count(F.lit(1)), None).otherwise(F.sum(x))


def aggregate(request: Request, v: Column, te: Column, dt: Column) -> Column:
    """The request's method over the rows of a group, times its multiplier."""
    method, limit = request.method, request.threshold
    finite = v.isNotNull()
    if method == "sum":
        out = whole_sum(v * dt)
    elif method == "min":
        out = F.min(v)
    elif method == "max":
        out = F.max(v)
    elif method == "max_time":
        return F.min_by(te, F.struct(-F.coalesce(v, F.lit(SENTINEL)), te))
    elif method == "mean":
        out = F.avg(v)
    elif method == "median":
        out = F.median(v)
    elif method == "first":
        out = F.min_by(F.struct(v.alias("v")), te)["v"]
    elif method == "first_non_empty":
        out = F.min_by(v, F.when(finite, te))
    elif method == "last":
        out = F.max_by(F.struct(v.alias("v")), te)["v"]
    elif method == "last_non_empty":
        out = F.max_by(v, F.when(finite, te))
    elif method in ("above_thres", "below_thres"):
        met = (v > limit) if method == "above_thres" else (v < limit)
        return 100.0 * F.sum(F.when(met, dt).otherwise(0.0)) / F.sum(dt)
    else:
        raise ValueError(f"unknown method {method}")
    return out * F.lit(request.multiplier) if request.multiplier != 1 else out
