"""Queries over the fixture tables."""

from tidemark.plans import episode_queries, geometry_queries, join_queries, more_queries, restructure_queries, source_queries, stat_queries, table_queries, text_queries, told_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
