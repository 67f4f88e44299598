"""All queries of the engine and their SQL."""

from __future__ import annotations

from placeloom.plans import lookup_queries, source_queries  # noqa: F401
from placeloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
