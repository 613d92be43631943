"""All queries of the engine and their SQL."""

from __future__ import annotations

from .plans import aggregates, clustering, enrichment, joins, lifecycle, normalize, pairs, quality, ranking, reads, search, stories, streams, tables  # noqa: F401
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
