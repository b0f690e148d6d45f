"""All queries of the core library and their SQL equivalents."""

from __future__ import annotations

from strandlog.plans import log_queries, log_sql, problems, problems_sql

QUERIES = {**log_queries.QUERIES, **problems.QUERIES}
ORACLE = {**log_sql.ORACLE, **problems_sql.ORACLE}
