"""The queries of the ledger library and their SQL."""

from __future__ import annotations

from .plans import store_queries  # noqa: F401  (registers its queries)
from .plans.ledger_queries import ORACLE_SQL, QUERIES

FLAGSHIP = "category_breakdown"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
