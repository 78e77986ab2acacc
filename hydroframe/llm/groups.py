"""Rows met with what is known of their group, where one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast at most: of n rows, no more than n / s can be in groups of s or more.
MOST_HOT = 100_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: int, size: str, most: int = MOST_HOT) -> DataFrame:
    """rows left-joined with groups (one row a key; size: its rows among the n_rows), whatever a group's size.

    Groups of n_rows / most rows and more are at most `most`, and are broadcast; what
    stays has fewer rows a key, and meets by a shuffle.  Rows without a group get nulls.
    """
    least = max(2, -(-n_rows // most))
    hot = F.broadcast(groups.where(F.col(size) >= least))
    met = rows.join(hot, key, "left")
    if least == 2:
        return rows.join(F.broadcast(groups.where(F.col(size) >= 2)), key, "left")
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size).between(2, least - 1)), key, "left")
    return met.where(F.col(size).isNotNull()).unionByName(rest)
