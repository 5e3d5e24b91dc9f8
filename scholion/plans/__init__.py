"""The registered queries."""

from scholion.plans import graphs, rankings, relational, searchers, texts  # noqa: F401
from scholion.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
