"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import leaks


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_passages"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_passages"))


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans}

SQL = {
    "p9_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents WHERE text <> ''),
p AS (SELECT item_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM eval_passages WHERE text <> ''),
pw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM p WHERE len(w) >= 12)),
dw AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN pw USING (k)""",
}
