"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import allocation_queries, collective_queries, diff_queries, job_queries, state_queries, task_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
