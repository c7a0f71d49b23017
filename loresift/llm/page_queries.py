"""Queries of problems 3 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import main_text, residue


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_block_hashes(table(spark, folder, "crawled_pages"))


def p3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(table(spark, folder, "crawled_pages"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_writes(table(spark, folder, "crawled_pages"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct writes that remain."""
    pages = table(spark, folder, "crawled_pages")
    writes = pages.where(F.col("html").isNotNull()).select("_id").distinct()
    return writes.join(residue.residue_writes(pages), "_id", "left_anti")


QUERIES = {"p3_found": p3_found, "p3_main_text": p3_main_text, "p7_found": p7_found, "p7_clean": p7_clean}
SQL: dict[str, str] = {}
