"""Named queries over the harness tables, and the SQL that must give the same rows."""

from __future__ import annotations

from docflow.plans import corpus_queries, entity_queries, platform_queries, retrieval_queries, structure_queries, text_queries  # noqa: F401
from docflow.plans.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
