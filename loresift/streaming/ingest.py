"""Streaming ingest of crawled pages into the page store."""

from __future__ import annotations

import signal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.store import PageStore, latest, needs_update
from ..session import work_path


def ingest_stream(spark: SparkSession, source: str, store: PageStore, checkpoint: str, files_per_batch: int = 1000):
    """A query that merges new files of ``source`` into the store and ends when all are read.

    The checkpoint remembers which files were read; the store remembers the last batch it committed,
    so a batch delivered again after a failure changes nothing.
    """
    reader = spark.readStream.schema(schemas.PAGE).option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # a stream reads folders; one file is its folder seen through a filter
        folder, name = source.rsplit("/", 1)
        pages = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        pages = reader.parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(batch, number)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_on_signal(query, signals=(signal.SIGINT, signal.SIGTERM)) -> None:
    """Stop a query when the process is asked to end. What its batches committed stays; the checkpoint
    lets the next run go on where this one stopped."""
    for number in signals:
        signal.signal(number, lambda *_: query.stop())


def ingest_report(spark: SparkSession, source: str, root: str, now: int, max_age_days: int = 30) -> DataFrame:
    """One row ``crawled, updated, skipped``: how many pages of a source a store would take, by the rules of
    ``needs_update``, and how many it has already."""
    fetched = latest(spark.read.schema(schemas.PAGE).parquet(source).where("html IS NOT NULL").select("url", "source_domain", "_id", "timestamp", F.md5("html").alias("hash")))
    stored = PageStore(spark, root).read()
    stored = spark.createDataFrame([], schemas.PAGE) if stored is None else stored
    wanted = needs_update(stored.select("url", "source_domain", "content_hash", "timestamp"), fetched, now, max_age_days)
    marked = fetched.select("url", "source_domain").join(wanted, ["url", "source_domain"], "left")
    counts = marked.agg(F.count(F.lit(1)).alias("crawled"), F.count("reason").alias("updated"))
    return counts.withColumn("skipped", F.col("crawled") - F.col("updated"))


def ingest(spark: SparkSession, source: str, root: str | None = None) -> DataFrame:
    """Run the stream to its end and return the stored pages."""
    root = root or work_path(spark, "store")
    store = PageStore(spark, root)
    query = ingest_stream(spark, source, store, f"{root}/_checkpoint")
    query.awaitTermination()
    stored = store.read()
    return spark.createDataFrame([], schemas.PAGE) if stored is None else stored
