"""All queries of the library, by name, with their SQL."""

from pathloom.plans import answer_queries, graph_queries, scalar_queries  # noqa: F401
from pathloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
