"""Every registered query of the engine with its oracle SQL."""

from __future__ import annotations

from tracewright.plans import lineage, orders, parsing, reports, resolution, rules, texts  # noqa: F401  they register their queries
from tracewright.plans.registry import ORACLES, QUERIES

FLAGSHIP = "find_by_table"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
