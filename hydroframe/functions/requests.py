"""Tables of requests (variable, sign, method, threshold): the rules and names of the registry as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.registry import BY_NAME, METHODS, SIGNS


def _names(found: list[str]) -> Column:
    return F.array(*map(F.lit, found)).cast("array<string>")


def column_name(variable: Column, sign: Column, method: Column, threshold: Column) -> Column:
    """variable[_sign]_method[_threshold], in lower case, dots as underscores; missing and empty parts are left out."""
    parts = [variable, F.nullif(sign, F.lit("")), F.nullif(method, F.lit("")), threshold.cast("double").cast("string")]
    return F.lower(F.replace(F.concat_ws("_", *parts), F.lit("."), F.lit("_")))


def kind(variable: Column) -> Column:
    """flow, node, or a hybrid of both; NULL for an unknown variable."""
    return F.create_map(*[F.lit(x) for v in BY_NAME.values() for x in (v.name, v.kind)])[variable]


def signed(variable: Column) -> Column:
    return variable.isin([v.name for v in BY_NAME.values() if v.signed])


def problems(variable: Column, sign: Column, method: Column, threshold: Column) -> Column:
    """Why a request can't be compiled, as an array of short names; empty if it can."""
    methods = F.create_map(*[x for v in BY_NAME.values() for x in (F.lit(v.name), _names(list(v.methods)))])[variable]
    sign_given = F.coalesce(sign, F.lit("")) != ""
    limited = F.coalesce(method.isin([m for m, (*_, limit) in METHODS.items() if limit]), F.lit(False))
    tests = {
        "variable": methods.isNull(),
        "sign": methods.isNotNull() & sign_given & ~(F.coalesce(sign.isin(list(SIGNS)), F.lit(False)) & signed(variable)),
        "method": methods.isNotNull() & F.when(F.size(methods) == 0, method.isNotNull()).otherwise(~F.coalesce(F.array_contains(methods, method), F.lit(False))),
        "threshold": methods.isNotNull() & method.isin(list(METHODS)) & (limited != threshold.isNotNull()),
    }
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items())), lambda x: x.isNotNull())


def told(requests: DataFrame) -> DataFrame:
    """requests with name, kind, problems, and valid."""
    args = [F.col(c) for c in ("variable", "sign", "method", "threshold")]
    return requests.withColumns({"name": column_name(*args), "kind": kind(args[0]), "problems": problems(*args)}).withColumn("valid", F.size("problems") == 0)
