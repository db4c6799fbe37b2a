"""Registered queries over the driver tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from tessera.plans import context_queries, global_queries, graph_queries, run_queries, search_queries, update_queries

MODULES = (search_queries, graph_queries, update_queries, context_queries, run_queries, global_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
