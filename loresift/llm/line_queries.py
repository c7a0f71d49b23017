"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import lines


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(table(spark, folder, "documents"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, folder, "documents"))


def p6_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return lines.maximal_blocks(table(spark, folder, "documents"))


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean, "p6_blocks": p6_blocks}

_LINES = """
WITH raw AS (
  SELECT doc_id, source_domain, string_split(text, chr(10)) AS ls FROM documents WHERE source_domain IS NOT NULL AND text <> ''),
l AS (SELECT doc_id, source_domain, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM raw),
c AS (SELECT doc_id, source_domain, line_no,
        regexp_replace(trim(regexp_replace(lower(line), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS k FROM l),
k AS (SELECT source_domain, k FROM c WHERE length(k) >= 25 GROUP BY source_domain, k HAVING count(DISTINCT doc_id) >= 5),
hit AS (SELECT DISTINCT doc_id, line_no::INT AS line_no FROM c JOIN k USING (source_domain, k))
"""

SQL = {
    "p6_found": _LINES + "SELECT doc_id, line_no FROM hit",
    "p6_clean": _LINES
    + """, d AS (SELECT doc_id, list(line_no) AS gone FROM hit GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN d.gone IS NULL THEN t.text
  ELSE array_to_string([string_split(t.text, chr(10))[i] FOR i IN range(1, len(string_split(t.text, chr(10))) + 1) IF NOT list_contains(d.gone, i)], chr(10)) END AS text
FROM documents t LEFT JOIN d USING (doc_id)""",
}
