"""Readers and writers of the collection's file formats, all with explicit schemas."""

from .formats import (  # noqa: F401
    read_document_table,
    read_documents_jsonl,
    read_mediawiki_categories,
    read_mediawiki_members,
    read_mediawiki_pages,
    read_qrels_json,
    read_zipf_csv,
    write_document_table,
    write_documents_jsonl,
    write_metadata,
    write_qrels_json,
    write_zipf_csv,
)
from .wiki import read_all_categories, read_category_members  # noqa: F401

#: Readers by name, for configurations that name their source: each takes the session and a path.
READERS = {
    "jsonl": read_documents_jsonl,
    "documents_table": read_document_table,
    "qrels": read_qrels_json,
    "zipf": read_zipf_csv,
    "wiki_pages": read_mediawiki_pages,
    "wiki_categories": read_mediawiki_categories,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def open_source(spark, kind: str, path: str, **options):
    """The rows of a named kind of source."""
    if kind not in READERS:
        raise ValueError(f"no source is called {kind}; there are {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
