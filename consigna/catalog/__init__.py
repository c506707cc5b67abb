"""Every operator as a query over the supplied tables, with the same question in SQL."""

from __future__ import annotations

from consigna.catalog import documents, loading, lookups, records, store, stream, suggest, texts  # noqa: F401
from consigna.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
