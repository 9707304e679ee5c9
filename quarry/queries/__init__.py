"""Registered queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

from quarry.queries.registry import ORACLE, QUERIES
from quarry.queries import catalog, evaluation, relational, sheets  # noqa: F401,I001  (they register themselves)

__all__ = ["ORACLE", "QUERIES"]
