"""The catalogue's queries by name, and their SQL."""

from __future__ import annotations

from . import pipeline_queries, remaining_queries, scalar_queries, search_queries, statistics_queries  # noqa: F401  they register
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
