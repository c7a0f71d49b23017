"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.curate import curate
from ..operators.index import build_index
from ..operators.search import search
from ..session import table
from . import corpus_queries, incremental_queries, retrieval_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (incremental_queries, corpus_queries, retrieval_queries):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Curate the crawled pages, index what is exported, and answer a ranked query."""
    exported = curate(table(spark, folder, "crawled_pages"))
    return search(build_index(exported), retrieval_queries.RANKED)
