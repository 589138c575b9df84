"""All registered queries of the core library and their oracle SQL."""

from __future__ import annotations

from lectern.plans import analytics, projects, records, retrieval, reviews, scalars, state, streams  # noqa: F401  they register
from lectern.plans.registry import ORACLE, QUERIES

FLAGSHIP = "hybrid_rrf"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
