"""Queries of the llm subpackage and their SQL."""

from __future__ import annotations

from . import found_queries

MODULES = (found_queries,)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in MODULES for k, q in m.SQL.items()}
