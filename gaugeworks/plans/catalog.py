"""All named queries, gathered by importing the modules that register them."""

from gaugeworks.plans import dashboards, live, stored, tables, tiered  # noqa: F401
from gaugeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
