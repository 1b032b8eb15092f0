"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from . import log_queries, vector_queries

QUERIES = vector_queries.QUERIES | log_queries.QUERIES
ORACLE = vector_queries.ORACLE | log_queries.ORACLE
