"""Names every query of the engine, and its SQL twin where SQL can express it."""

from __future__ import annotations

from lodestone.plans import memory_queries, retrieval_queries, service_queries, table_queries, text_queries

_PARTS = (retrieval_queries, text_queries, memory_queries, table_queries, service_queries)


def queries():
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
