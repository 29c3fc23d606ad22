"""Queries of the llm problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from feedloom.llm import graph_queries, names_queries, text_queries

MODULES = [graph_queries, names_queries, text_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
