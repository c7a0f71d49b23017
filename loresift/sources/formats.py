"""JSON lines, tables, qrels, rank lists and stored wiki interface responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.urls import category_name, title_to_url


def read_documents_jsonl(spark: SparkSession, path: str, min_line: int = 50, min_text: int = 50) -> DataFrame:
    """Documents of a JSON lines export. Lines and texts below so many bytes, broken lines and lines
    without an id are left out."""
    lines = spark.read.text(path).where(F.octet_length("value") >= min_line)
    rows = lines.select(F.from_json("value", schemas.DOCUMENT).alias("d")).select("d.*")
    return rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= min_text))


def write_documents_jsonl(documents: DataFrame, path: str) -> None:
    documents.select("doc_id", "url", "title", "text").write.mode("overwrite").json(path)


def write_metadata(documents: DataFrame, path: str) -> None:
    """The export's metadata as a flat parquet table."""
    documents.select(*[c.split()[0] for c in schemas.METADATA.split(", ")]).write.mode("overwrite").parquet(path)


def write_document_table(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "url", "title").write.mode("overwrite").csv(path, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_document_table(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, url, title`` from tab-separated lines; malformed lines are dropped."""
    return spark.read.schema(schemas.DOCUMENT_TABLE).csv(path, sep="\t", mode="DROPMALFORMED", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).where(F.col("doc_id").isNotNull())


def write_zipf_csv(ranked: DataFrame, path: str, limit: int = 10_000) -> None:
    ranked.where(F.col("rank") <= limit).select("rank", "frequency", "term").write.mode("overwrite").csv(path, header=True)


def read_zipf_csv(spark: SparkSession, path: str, max_rank: int | None = None) -> DataFrame:
    """Rank list with positive ranks and frequencies, up to ``max_rank``."""
    rows = spark.read.schema(schemas.ZIPF).csv(path, header=True).where("rank > 0 AND frequency > 0")
    return rows if max_rank is None else rows.where(F.col("rank") <= max_rank)


def read_qrels_json(spark: SparkSession, path: str, by: str = "urls", strict: bool = True) -> DataFrame:
    """``qid, query, key, grade`` from nested judgements; ``by`` is ``urls`` or ``docs``.

    Strict reading leaves out queries without url judgements; else document ids stand in for them.
    """
    queries = spark.read.schema(schemas.QRELS).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")
    judged = F.col("relevant_urls") if by == "urls" else F.col("relevant_docs")
    if by == "urls" and not strict:
        judged = F.coalesce(judged, F.col("relevant_docs"))
    return queries.where(judged.isNotNull()).select(F.col("id").alias("qid"), "query", F.explode(judged).alias("key", "grade"))


def write_qrels_json(qrels: DataFrame, path: str) -> None:
    """``qid, query, key, grade`` as one JSON object per query."""
    nested = qrels.groupBy(F.col("qid").alias("id"), "query").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "grade")))).alias("relevant_urls"))
    nested.write.mode("overwrite").json(path)


def read_mediawiki_categories(spark: SparkSession, path: str) -> DataFrame:
    """``category`` of every stored category listing, each once."""
    items = spark.read.schema(schemas.CATEGORIES).json(path).select(F.explode("query.allcategories").alias("item"))
    return items.select(category_name(F.col("item")).alias("category")).where(F.col("category").isNotNull()).distinct()


def read_mediawiki_members(spark: SparkSession, path: str, source_domain: str) -> DataFrame:
    """``title, url`` of the articles (namespace 0) of stored member listings, each once."""
    items = spark.read.schema(schemas.MEMBERS).json(path).select(F.explode("query.categorymembers").alias("m"))
    titles = items.where("m.ns = 0 AND m.title <> ''").select("m.title").distinct()
    return titles.select("title", title_to_url(F.col("title"), source_domain).alias("url"))


def read_mediawiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """``title, html`` of stored page responses."""
    return spark.read.schema(schemas.PARSED).json(path).select("parse.title", F.col("parse.text").alias("html")).where(F.col("html").isNotNull())
