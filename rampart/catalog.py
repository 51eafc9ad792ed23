"""All queries of the posture engine by name, with their SQL."""

from rampart.plans import graph_queries, review_queries, source_queries, state_queries  # noqa: F401  they register their queries
from rampart.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
