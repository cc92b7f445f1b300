"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from . import document_queries, label_queries, value_queries  # noqa: F401  register their queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
