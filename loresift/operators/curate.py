"""From crawled pages to the exported collection: filters, keep-first deduplication, dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import clean_html, informative
from ..functions.urls import is_noise, normalize_export
from ..session import spread, staged

MIN_HTML = 100


COLUMNS = ["_id", "url", "source", "source_domain", "timestamp"]


def cleaned(pages: DataFrame) -> DataFrame:
    """Every delivery with its normalised url, title and text, whether it passes the quality filter, and
    a number of its own (``row``). Html that is too short or whose url is noise is not parsed."""
    rows = spread(pages.select(*COLUMNS, "html")).withColumn("norm_url", normalize_export(F.col("url")))
    usable = ~is_noise(F.col("norm_url")) & (F.length("html") >= MIN_HTML)
    found = rows.select(*COLUMNS, "norm_url", clean_html(F.when(usable, F.col("html"))).alias("c"))
    return _numbered(found.select(*COLUMNS, "norm_url", "c.title", "c.text"))


def exported_documents(documents: DataFrame) -> DataFrame:
    """The same of ``documents`` that have title and text already."""
    rows = documents.select(F.col("doc_id").cast("string").alias("_id"), *COLUMNS[1:], normalize_export(F.col("url")).alias("norm_url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select("*", informative(F.col("title"), F.col("text")).alias("passes"), F.monotonically_increasing_id().alias("row"))


def with_reasons(clean: DataFrame) -> DataFrame:
    """``row, _id, url, reason`` of every write: ``noise``, ``duplicate``, ``low_quality`` or ``exported``.

    In order of ``(url, _id)`` the first page of a normalised url that passes is exported; later
    ones are duplicates whatever their quality; earlier ones are low quality. Only keys and flags are
    exchanged; the first of a url is a partial aggregate, so a url that many pages share meets in no task.
    """
    flags = clean.select("row", "_id", "url", "norm_url", "passes").groupBy("_id").agg(F.min(F.struct("row", "url", "norm_url", "passes")).alias("w")).select("_id", "w.*")
    place = F.struct(F.coalesce("url", F.lit("")).alias("url"), F.col("_id").alias("id"))
    kept = flags.where("passes").where(~is_noise(F.col("norm_url")))
    first = kept.groupBy(F.col("norm_url").alias("of")).agg(F.min(place).alias("first"))
    reason = (
        F.when(is_noise(F.col("norm_url")), "noise")
        .when(place > F.col("first"), "duplicate")
        .when(place == F.col("first"), "exported")
        .otherwise("low_quality")
    )
    return flags.join(first, F.expr("norm_url = of"), "left").select("row", "_id", "url", reason.alias("reason"))


def dense_ids(rows: DataFrame, order: list[str], name: str = "doc_id") -> DataFrame:
    """Ids 0, 1, 2, ... in the given total order without gathering the rows in one place: each
    range partition numbers its own rows and is offset by the sizes of the ones before it, one row
    of which there is for every partition."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.expr("shiftleft(1L, 33) - 1")
    # the number of a row is its partition above 33 bits and its place in the partition below
    fixed = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    parted = fixed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(low))
    sizes = parted.groupBy("_part").count()
    offsets = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return parted.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_at", "_part", "_place", "_before")


def export(clean: DataFrame) -> DataFrame:
    """``doc_id, url, title, text, source, source_domain, timestamp, text_length`` of the export of
    written ``cleaned`` rows: the decisions are made on keys, then the rows are fetched once."""
    kept = dense_ids(with_reasons(clean).where("reason = 'exported'").select("row", "url", "_id"), ["url", "_id"]).select("row", "doc_id")
    return clean.join(kept, "row").select(
        "doc_id", F.col("norm_url").alias("url"), "title", "text",
        F.coalesce("source", F.lit("Unknown")).alias("source"), F.coalesce("source_domain", F.lit("unknown")).alias("source_domain"),
        F.coalesce("timestamp", F.lit(0)).alias("timestamp"), F.length("text").alias("text_length"),
    )


def curate(pages: DataFrame) -> DataFrame:
    """The export of crawled pages."""
    return export(staged(cleaned(pages), "cleaned"))


def skip_report(pages: DataFrame) -> DataFrame:
    """``reason, n``."""
    return reason_counts(cleaned(pages))


def reason_counts(clean: DataFrame) -> DataFrame:
    # decided from written rows: row numbers differ when they are made again
    return with_reasons(staged(clean.drop("text"), "flags")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
