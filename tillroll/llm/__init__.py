"""Operators over text for the preparation of training data."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
