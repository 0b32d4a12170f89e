"""Registered queries: name to callable, and name to DuckDB SQL."""

from tidemark.plans import streams  # noqa: F401  registers its queries
from tidemark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
