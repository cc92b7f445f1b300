"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
