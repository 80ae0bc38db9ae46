"""Registered queries over the driver's tables, with their check SQL."""

from corpuslens.plans import (  # noqa: F401  (importing registers the queries)
    features, scores, aggregates, searches, joins, retrieval, gaps, updates, sources,
)
from corpuslens.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
