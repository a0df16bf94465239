"""All queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from treeloom.plans import algebra_queries, report_queries, retrieval_queries, statement_queries, store_queries, tree_queries, unified_queries
from treeloom.plans.common import Query

MODULES = (report_queries, tree_queries, retrieval_queries, algebra_queries, statement_queries, store_queries, unified_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.found.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.found.sql.items()}
