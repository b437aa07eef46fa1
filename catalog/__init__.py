"""Registered queries, each next to the SQL that states its result."""

from catalog.base import ORACLES, QUERIES
from catalog import basics, cleaning, indicators, models, statistics  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
