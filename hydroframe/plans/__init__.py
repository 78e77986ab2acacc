"""Registered queries and their SQL."""

from hydroframe.plans import inventory, shapes  # noqa: F401
from hydroframe.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
