"""Schemas of the tables and files."""

DOCUMENT = "doc_id BIGINT, url STRING, title STRING, text STRING"
PAGE = "_id STRING, url STRING, html STRING, source STRING, source_domain STRING, timestamp BIGINT, content_hash STRING"
METADATA = "doc_id BIGINT, url STRING, title STRING, source STRING, source_domain STRING, timestamp BIGINT, text_length INT"
ZIPF = "rank INT, frequency BIGINT, term STRING"
DOCUMENT_TABLE = "doc_id BIGINT, url STRING, title STRING"
QRELS = "queries ARRAY<STRUCT<id INT, query STRING, relevant_docs MAP<STRING,INT>, relevant_urls MAP<STRING,INT>>>, relevance_levels MAP<STRING,STRING>"
CATEGORIES = "query STRUCT<allcategories ARRAY<MAP<STRING,STRING>>>, continue STRUCT<accontinue STRING>"
MEMBERS = "query STRUCT<categorymembers ARRAY<STRUCT<ns INT, title STRING>>>, continue STRUCT<cmcontinue STRING>"
PARSED = "parse STRUCT<title STRING, text STRING>"
