"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .packing import packed


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """How full each container is and what it holds."""
    pieces = packed(table(spark, folder, "documents"))
    return pieces.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """A packing that grants every source the same share of the containers, whatever it holds."""
    documents = table(spark, folder, "documents")
    # one name for every source; the sources of a collection are few, and no text is read
    names = [r.source for r in documents.where("source IS NOT NULL").select("source").distinct().collect()]
    return packed(documents, targets={n: 1.0 for n in names})


def p8_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing holds of each document: all of it, in one piece unless it exceeds a container."""
    return packed(table(spark, folder, "documents")).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("container_id").alias("containers"))


QUERIES = {"p8_pack": p8_pack, "p8_containers": p8_containers, "p8_mixture": p8_mixture, "p8_totals": p8_totals}
SQL = {
    "p8_totals": """
WITH s AS (SELECT doc_id, CASE WHEN n_tokens >= 0 THEN n_tokens
  ELSE coalesce(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')), 0) END::BIGINT AS tokens FROM documents)
SELECT doc_id, tokens, greatest(1, (tokens + 2047) // 2048) AS pieces, greatest(1, (tokens + 2047) // 2048) AS containers FROM s""",
}
