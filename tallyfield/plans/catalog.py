"""Registered queries and the SQL that states their results."""

from __future__ import annotations

from . import fact_queries, match_queries

QUERIES = fact_queries.QUERIES | match_queries.QUERIES
ORACLE_SQL = fact_queries.SQL | match_queries.SQL
