"""All queries of the library and their SQL."""

from __future__ import annotations

from tessera.plans import file_queries, image_queries, report_queries

QUERIES: dict = image_queries.QUERIES | file_queries.QUERIES | report_queries.QUERIES
ORACLE_SQL: dict[str, str] = image_queries.ORACLE_SQL | file_queries.ORACLE_SQL | report_queries.ORACLE_SQL
