"""The registered queries of the reconciliation engine, and their SQL."""

from __future__ import annotations

from . import reconcile_queries, text_queries  # noqa: F401  (they register their queries)
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
