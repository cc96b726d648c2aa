"""All queries of the library except those of the llm subpackage, and their SQL."""

from __future__ import annotations

from . import chunks, contexts, documents, gates, hygiene, retrieval, rules, stores, streams

MODULES = (hygiene, retrieval, documents, chunks, rules, stores, contexts, gates, streams)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in MODULES for k, q in m.SQL.items()}
