"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .terms import marked_terms


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "documents")).where(F.col("mark").isNotNull()).select("term", "mark")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "documents")).select("term", "occurrences", "documents", "mark")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}

_COUNTS = """
WITH tok AS (
  SELECT doc_id, lower(t) AS term
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*')) AS t FROM documents) WHERE length(t) >= 2),
n AS (SELECT count(*) AS docs FROM documents WHERE text IS NOT NULL),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM tok GROUP BY term),
m AS (SELECT c.*, CASE WHEN occurrences < 4 THEN 'rare' WHEN documents > 0.4 * n.docs THEN 'common' END AS mark FROM c, n)
"""

SQL = {
    "p1_found": _COUNTS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _COUNTS + "SELECT term, occurrences, documents, mark FROM m",
}
