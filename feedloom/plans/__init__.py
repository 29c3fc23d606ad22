"""Queries over the tables and their SQL counterparts."""

from __future__ import annotations

from feedloom.plans import api, dealt, functions, names_eval, relational, scans, stateful, storage

MODULES = [dealt, scans, relational, functions, names_eval, stateful, api, storage]


def core_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def core_oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
