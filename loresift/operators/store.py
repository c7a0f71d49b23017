"""The page store: keyed upserts with change detection, lookups, counts, migration."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import Commit, CommitLog

KEY = ["url", "source_domain"]
DAY = 86_400


def latest(writes: DataFrame) -> DataFrame:
    """The last write of every page: greatest timestamp (null oldest), then greatest ``_id``."""
    at = F.struct(F.col("timestamp").isNotNull().alias("known"), F.col("timestamp").alias("ts"), F.col("_id").alias("id"))
    columns = [c for c in writes.columns if c not in KEY]
    return writes.groupBy(*KEY).agg(F.max_by(F.struct(*columns), at).alias("w")).select(*KEY, "w.*")


def needs_update(stored: DataFrame, fetched: DataFrame, now: int, max_age_days: int = 30) -> DataFrame:
    """``url, source_domain, reason``: fetched pages that are missing, changed, or stored too long.

    ``fetched`` holds ``html``, or its MD5 as ``hash`` where the html need not travel. ``stored`` holds one row per page; a page stored strictly longer than the limit is stale.
    """
    old = stored.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("timestamp").alias("old_time"), F.lit(True).alias("known"))
    known = F.col("hash") if "hash" in fetched.columns else F.md5("html")
    joined = fetched.select(*KEY, known.alias("hash")).join(old, KEY, "left")
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(~F.col("hash").eqNullSafe(F.lower("old_hash")), "changed")
        .when(F.lit(now) - F.coalesce("old_time", F.lit(0)) > max_age_days * DAY, "stale")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*KEY, "reason")


def lookup(pages: DataFrame, url: str, source_domain: str | None = None) -> DataFrame:
    """At most one page; both predicates reach the scan."""
    found = pages.where(F.col("url") == url)
    if source_domain is not None:
        found = found.where(F.col("source_domain") == source_domain)
    return found.limit(1)


def count_by_source(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_domain").agg(F.count(F.lit(1)).alias("n"))


def docs_per_day(pages: DataFrame) -> DataFrame:
    """``day, n``; pages without a timestamp belong to no day."""
    day = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd")
    return pages.where(F.col("timestamp").isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def latest_n(pages: DataFrame, n: int = 10) -> DataFrame:
    """The pages crawled last; ties go to the greater ``_id``."""
    return pages.select("_id", "url", "timestamp").distinct().orderBy(F.col("timestamp").desc_nulls_last(), F.desc("_id")).limit(n)


def backfill_domain(pages: DataFrame, default: Column | str) -> DataFrame:
    """Migration: pages without a source domain get one. Running it again changes nothing."""
    value = F.lit(default) if isinstance(default, str) else default
    return pages.withColumn("source_domain", F.coalesce("source_domain", value))


def resume_points(states: DataFrame) -> DataFrame:
    """``_id, category_index, article_index, category_url, finished`` where each crawler goes on: the
    category at its saved index, counted from 0; site crawlers have no categories and go on anywhere."""
    index = F.coalesce("current_category_index", F.lit(0))
    size = F.coalesce(F.size("categories"), F.lit(0))
    return states.select(
        "_id", index.alias("category_index"), F.coalesce("current_article_index", F.lit(0)).alias("article_index"),
        F.when(index < size, F.element_at("categories", F.greatest(index + 1, F.lit(1)))).alias("category_url"), (F.col("categories").isNotNull() & (index >= size)).alias("finished"),
    )


class StateStore:
    """The saved state of every crawler: one row per ``_id``, the last one saved. A state is a small row and
    there are as many as crawlers, so each save writes them all and a commit names the folder that counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, root)

    def read(self) -> DataFrame | None:
        done = self.log.commits()
        return self.spark.read.parquet(done[-1].output) if done else None

    def _commit(self, rows: DataFrame) -> None:
        done = self.log.commits()
        output = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(output)
        if not self.log.publish(Commit((done[-1].number if done else 0) + 1, -1, output)):
            raise RuntimeError("another state was saved first; save again")

    def save(self, states: DataFrame) -> None:
        """Replace the states of the given ids."""
        old = self.read()
        self._commit(states if old is None else old.join(states.select("_id"), "_id", "left_anti").select(*states.columns).unionByName(states))

    def get(self, crawler: str) -> dict | None:
        rows = self.read()
        row = rows.where(F.col("_id") == crawler).first() if rows is not None else None
        return row.asDict() if row else None

    def clear(self, crawler: str) -> None:
        """Forget one crawler's state, so that it starts anew."""
        if (rows := self.read()) is not None:
            self._commit(rows.where(F.col("_id") != crawler))


class PageStore:
    """One row per page in a folder, in ``buckets`` by page key; a commit names the folder of every bucket
    that counts. An upsert rewrites only the buckets that its writes fall into."""

    COLUMNS = ["_id", *KEY, "html", "source", "timestamp", "content_hash"]

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets, self.log = spark, root.rstrip("/"), buckets, CommitLog(spark, root)

    def _folders(self) -> dict[int, str]:
        commits = self.log.commits()
        return {int(k): v for k, v in json.loads(commits[-1].output).items()} if commits else {}

    def lookup(self, url: str, source_domain: str | None) -> DataFrame | None:
        """At most one page, from the one bucket that can hold it."""
        key = F.pmod(F.xxhash64(F.lit(url), F.lit(source_domain).cast("string")), F.lit(self.buckets))
        bucket = self.spark.range(1).select(key.alias("b")).first().b
        rows = self._rows([f for b, f in self._folders().items() if b == bucket])
        return None if rows is None else rows.where((F.col("url") == url) & F.col("source_domain").eqNullSafe(source_domain)).limit(1)

    def _rows(self, folders) -> DataFrame | None:
        return self.spark.read.parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        return self._rows(list(self._folders().values()))

    def upsert(self, writes: DataFrame, batch: int | None = None) -> bool:
        """Merge writes into the store. A ``batch`` number that was committed before is skipped and gives
        False, so that a stream may deliver a batch again after a failure. If another writer commits
        meanwhile this one raises and changes nothing; a stream then delivers the batch again."""
        done = self.log.commits()
        if batch is not None and done and max(c.watermark for c in done) >= batch:
            return False
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        fresh = writes.where(F.col("html").isNotNull()).withColumn("content_hash", F.md5("html")).select(*self.COLUMNS)
        folders = self._folders()
        # at most as many rows as there are buckets
        touched = {r.b for r in fresh.select(bucket.alias("b")).distinct().collect()}
        old = self._rows([folders[b] for b in touched if b in folders])
        merged = latest(fresh if old is None else old.select(*self.COLUMNS).unionByName(fresh))
        output = f"{self.root}/data/{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(output)
        folders |= {b: f"{output}/bucket={b}" for b in touched}
        number = (done[-1].number if done else 0) + 1
        if not self.log.publish(Commit(number, -1 if batch is None else batch, json.dumps(folders))):
            raise RuntimeError("another writer committed first; run again")
        return True
