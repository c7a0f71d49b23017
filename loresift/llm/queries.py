"""Queries of the problems for training text, by name, with their SQL."""

from __future__ import annotations

from . import duplicate_queries, leak_queries, line_queries, packing_queries, page_queries, quality_queries, sentence_queries, term_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (term_queries, quality_queries, duplicate_queries, page_queries, line_queries, packing_queries, leak_queries, sentence_queries):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
