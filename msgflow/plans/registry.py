"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from msgflow.plans import engine_queries, service_queries, skew_queries

MODULES = (skew_queries, engine_queries, service_queries)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
