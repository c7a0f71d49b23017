"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import quality


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.junk_fields(table(spark, folder, "documents"))


def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


QUERIES = {"p2_found": p2_found, "p2_statistics": p2_statistics}
SQL: dict[str, str] = {}
