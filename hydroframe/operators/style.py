"""Classification expressions over aggregation columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of flowlines that the Courant number is shown for.
COURANT_KCU = [0, 1, 2, 3, 5, 100, 101]


def balance(positive: list[str], negative: list[str]) -> Column:
    """Sum of the positive columns less the sum of the negative ones; missing values count as 0."""
    total = lambda names: sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names if n), F.lit(0.0))
    return total(positive) - total(negative)


def level_change(first: Column, last: Column, z: Column) -> Column:
    return F.coalesce(last, z) - F.coalesce(first, z)


def resultant(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def rotation(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(x, y))


def flow_rotation(v: Column, azimuth: Column) -> Column:
    """The direction of an arrow along a line: turned where the flow is negative."""
    return azimuth + F.when(v < 0, -90.0).otherwise(90.0)


def rescale(v: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Linear between low and high, clamped."""
    share = F.least(F.greatest(F.try_divide(F.abs(v) - low, high - low), F.lit(0.0)), F.lit(1.0))
    return F.lit(to_low) + share * (to_high - to_low)


def courant(u: Column, dt: Column | float, length: Column) -> Column:
    return F.try_divide(F.abs(u) * dt, length)


def over_courant(df: DataFrame, threshold: float, dt: float) -> DataFrame:
    n = courant(F.col("u1"), F.lit(dt), F.col("length"))
    return df.where(F.col("kcu").isin(COURANT_KCU)).withColumn("courant", n).where(F.col("courant") > threshold)


def slows(c1: Column, c2: Column, c3: Column) -> Column:
    """Whether a line limits the time step too often."""
    return (c1 > 10) | (c2 > 50) | (c3 > 80)


def classes(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """class, low, high: n equal classes from the least to the greatest value."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / n
    return ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("class")).select("class", (F.col("lo") + step * F.col("class")).alias("low"), (F.col("lo") + step * (F.col("class") + 1)).alias("high"))


def label(v: Column) -> Column:
    return F.concat(F.round(F.abs(v)).cast("long").cast("string"), F.lit(" m³"))
