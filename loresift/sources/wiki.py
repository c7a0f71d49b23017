"""Stored responses of a wiki's interface as a Spark data source that follows continuation tokens.

A listing is a folder. Its first response is ``first.json``; a response that names a token in its
``continue`` field goes on in ``next-<hash of the token>.json``. Every listing is a partition, so listings
are read in parallel and the responses of one in their order, as they would be asked for. A listing whose
next response is missing ends there.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import category_name, is_valid, normalize_crawl, title_to_url

NAME = "stored_wiki"
SCHEMA = "listing string, page int, item map<string, string>"


def response_name(token: str | None) -> str:
    """The file of the response that a token asks for."""
    return "first.json" if not token else f"next-{hashlib.md5(token.encode()).hexdigest()}.json"


class _Reader(DataSourceReader):
    def __init__(self, folder: str, kind: str, token: str):
        self.folder, self.kind, self.token = folder, kind, token

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).iterdir()) if p.is_dir()]

    def read(self, partition):
        folder, name, page, seen = Path(partition.value), response_name(None), 0, set()
        while name not in seen and (folder / name).is_file():
            seen.add(name)
            try:
                answer = json.loads((folder / name).read_text(encoding="utf-8"))
            except ValueError:  # a broken answer ends the listing, as a failed request does
                return
            for item in answer.get("query", {}).get(self.kind, []):
                yield folder.name, page, {str(k): None if v is None else str(v) for k, v in item.items()}
            token = answer.get("continue", {}).get(self.token)
            if not token:
                return
            name, page = response_name(token), page + 1


class StoredWiki(DataSource):
    """Options: ``path``, ``kind`` (the list in the answers) and ``token`` (the field that continues it)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"), self.options["kind"], self.options["token"])


def _items(spark: SparkSession, path: str, kind: str, token: str) -> DataFrame:
    spark.dataSource.register(StoredWiki)
    return spark.read.format(NAME).option("path", path).option("kind", kind).option("token", token).load()


def read_all_categories(spark: SparkSession, path: str, source_domain: str, allowed: list[str] | None = None) -> DataFrame:
    """``url`` of every category of the stored listings, normalised, each once."""
    title = category_name(F.col("item"))
    full = F.when(title.startswith("Category:"), title).otherwise(F.concat(F.lit("Category:"), title))
    urls = _items(spark, path, "allcategories", "accontinue").where(title.isNotNull()).select(normalize_crawl(title_to_url(full, source_domain)).alias("url"))
    return urls.where(is_valid(F.col("url"), allowed)).distinct()


def read_category_members(spark: SparkSession, path: str, source_domain: str, allowed: list[str] | None = None) -> DataFrame:
    """``listing, url`` of the articles (namespace 0) of every stored category, each once."""
    items = _items(spark, path, "categorymembers", "cmcontinue").where((F.col("item")["ns"] == "0") & (F.coalesce(F.col("item")["title"], F.lit("")) != ""))
    urls = items.select("listing", normalize_crawl(title_to_url(F.col("item")["title"], source_domain)).alias("url"))
    return urls.where(is_valid(F.col("url"), allowed)).distinct()
