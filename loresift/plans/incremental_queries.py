"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import OVERLAP_MS, export_changes, with_file_times
from ..session import table, work_path


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    writes, runs, entries = (table(spark, folder, t) for t in ("crawled_pages", "export_runs", "export_entries"))
    return export_changes(spark, work_path(spark, "p5"), with_file_times(writes), runs, entries, overlap=OVERLAP_MS).select("url", "source_domain")


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
WITH cur AS (
  SELECT url, source_domain, md5(html) AS h,
         row_number() OVER (PARTITION BY url, source_domain ORDER BY coalesce(timestamp, -9000000000000000) DESC, _id DESC) AS rn
  FROM crawled_pages WHERE html IS NOT NULL),
exported AS (
  SELECT e.url, e.source_domain, e.content_hash,
         row_number() OVER (PARTITION BY e.url, e.source_domain ORDER BY e.run_id DESC, e.timestamp DESC, e.content_hash DESC) AS rn
  FROM export_entries e JOIN export_runs r ON e.run_id = r.run_id AND r.status = 'success')
SELECT c.url, c.source_domain
FROM cur c LEFT JOIN exported x ON x.rn = 1 AND c.url IS NOT DISTINCT FROM x.url AND c.source_domain IS NOT DISTINCT FROM x.source_domain
WHERE c.rn = 1 AND c.h IS DISTINCT FROM x.content_hash""",
}
