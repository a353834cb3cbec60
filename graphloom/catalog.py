"""All queries by name, with their DuckDB equivalents."""

from __future__ import annotations

from graphloom.plans import queries_graph, queries_methods, queries_results, queries_runs, queries_sources, queries_text  # noqa: F401  they register themselves
from graphloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
