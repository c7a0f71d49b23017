"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import duplicates


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.similar_pairs(table(spark, folder, "documents"), threshold=0.6, size=3)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.duplicate_groups(table(spark, folder, "documents"), threshold=0.8, size=5)


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
def _pairs(size: int, threshold: float) -> str:
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text <> ''),
s AS (SELECT DISTINCT doc_id, {run} AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT doc_id_a, doc_id_b FROM p JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b WHERE k >= {threshold} * (x.n + y.n - k))"""


SQL = {
    "p4_found": f"WITH {_pairs(3, 0.6)} SELECT doc_id_a, doc_id_b FROM pairs",
    "p4_groups": f"""WITH RECURSIVE {_pairs(5, 0.8)},
e AS (SELECT doc_id_a AS a, doc_id_b AS b FROM pairs UNION SELECT doc_id_b, doc_id_a FROM pairs),
walk AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b),
c AS (SELECT a, min(b) AS class_id FROM walk GROUP BY a), l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT c.a AS doc_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (a)""",
}
