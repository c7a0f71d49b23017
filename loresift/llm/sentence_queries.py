"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import sentences


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence ends of the documents named in ``sentence_sample``."""
    wanted = table(spark, folder, "sentence_sample").select("doc_id").distinct()
    documents = table(spark, folder, "documents").join(wanted, "doc_id", "left_semi")
    return sentences.sentences(documents).select("doc_id", "end_pos").distinct()


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "documents"))


QUERIES = {"p10_found": p10_found, "p10_sentences": p10_sentences}
SQL: dict[str, str] = {}
