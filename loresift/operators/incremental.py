"""Processing only new or changed records (problem 5).

The source is an append log of writes whose sequence grows with every commit to it; the commit log of
this job tells what its earlier runs delivered. A run

1. fixes an upper bound at its start (the greatest sequence number it can see, and the last run on
   record) and never looks beyond it, so that writes arriving meanwhile belong to the next run;
2. reads the high watermark of its last commit, and of the log only what came after it; what failed runs
   left behind has no commit and is never seen;
3. merges that with the narrow state of the last commit (page, current write, hash delivered) and marks
   exactly the pages whose current write differs from what was delivered;
4. publishes its output, the new state and the new watermark in one atomic step: a commit file that
   names them, created only if no other run took its number.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["url", "source_domain"]


_AT = "struct<known: boolean, ts: bigint, id: string>"


def current_writes(writes: DataFrame) -> DataFrame:
    """``url, source_domain, at, current_md5``: place in time and MD5 of each page's current write.

    The current write has the greatest ``(timestamp, _id)``; a null timestamp is the oldest. Writes
    with null html are ignored, repeated deliveries of one write change nothing, null keys form a
    page of their own. Only the hash, never the html, is carried past the scan.
    """
    order = F.struct(F.col("timestamp").isNotNull().alias("known"), F.col("timestamp").alias("ts"), F.col("_id").alias("id"))
    return (
        writes.where(F.col("html").isNotNull())
        .select(*KEY, order.cast(_AT).alias("at"), F.md5("html").alias("md5"))
        .groupBy(*KEY)
        .agg(F.max(F.struct("at", "md5")).alias("last"))
        .select(*KEY, "last.at", F.col("last.md5").alias("current_md5"))
    )


def current_state(writes: DataFrame) -> DataFrame:
    """``url, source_domain, current_md5`` of each page's current write."""
    return current_writes(writes).select(*KEY, "current_md5")


def run_bounds(runs: DataFrame) -> tuple[int | None, int]:
    """``(low, upper)``: the last successful run and the last run of any status, fixed once."""
    row = runs.agg(F.max(F.when(F.col("status") == "success", F.col("run_id"))).alias("low"), F.max("run_id").alias("upper")).first()
    return row.low, row.upper or 0


def delivered_state(runs: DataFrame, entries: DataFrame, low: int | None = None) -> DataFrame:
    """``url, source_domain, run, content_hash`` as of the last successful run that delivered the page.

    Entries of failed or unknown runs are no deliveries, nor is anything beyond the watermark
    ``low`` where one is given. Repeated entries of one run collapse to one; were two of one run to
    disagree, the later export of them counts.
    """
    done = runs.where("status = 'success'").select("run_id").distinct()
    if low is not None:
        entries, done = entries.where(F.col("run_id") <= low), done.where(F.col("run_id") <= low)
    return (
        entries.join(done, "run_id", "left_semi")
        .groupBy(*KEY)
        .agg(F.max(F.struct("run_id", "timestamp", "content_hash")).alias("last"))
        .select(*KEY, F.col("last.run_id").cast("long").alias("run"), F.col("last.content_hash").alias("content_hash"))
    )


def changed_pages(writes: DataFrame, runs: DataFrame, entries: DataFrame, low: int | None = None) -> DataFrame:
    """``url, source_domain, current_md5, content_hash`` of every page that is new or changed.

    Both sides are grouped by the page key, so the join needs no further exchange. Defined results:
    empty writes give no rows; empty runs or entries make every page new; extra columns are ignored.
    """
    now, then = current_state(writes).alias("n"), delivered_state(runs, entries, low).alias("d")
    same = F.lit(True)
    for key in KEY:
        same = same & F.col(f"n.{key}").eqNullSafe(F.col(f"d.{key}"))
    return (
        now.join(then, same, "left")
        .where(~F.col("n.current_md5").eqNullSafe(F.col("d.content_hash")))
        .select(*[F.col(f"n.{k}") for k in KEY], "current_md5", "content_hash")
    )


@dataclass
class Commit:
    """One published run: its number, the sequence bound it covers, and where its output lies."""

    number: int
    watermark: int
    output: str


class CommitLog:
    """An append-only log of commits in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))

    def commits(self) -> list[Commit]:
        """All commits in order."""
        found = []
        for status in self._fs.listStatus(self._path(f"{self.root}/_commits")):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = self._fs.open(status.getPath())
                try:
                    found.append(Commit(**json.loads(bytes(stream.readAllBytes()).decode())))
                finally:
                    stream.close()
        return sorted(found, key=lambda c: c.number)

    def publish(self, commit: Commit) -> bool:
        """Create the commit file unless another run took its number; False if one did.

        The file is complete before it gets its name, and getting the name is one step that fails if
        the name is taken: a hard link on a disk, a rename without overwriting where there are none.
        """
        staging = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(staging)
        try:
            stream.write(bytearray(json.dumps(commit.__dict__).encode()))
        finally:
            stream.close()
        final = self._path(f"{self.root}/_commits/{commit.number:09d}.json")
        if self._fs.getScheme() == "file":
            try:
                os.link(staging.toUri().getPath(), final.toUri().getPath())
                self._fs.delete(staging, False)
                return True
            except FileExistsError:
                self._fs.delete(staging, False)
                return False
            except OSError:  # a mounted file system without links
                pass
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(staging, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as error:
            self._fs.delete(staging, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise


class IncrementalJob:
    """Runs ``transform`` over the rows a log gained since the last successful run, exactly once.

    ``sequence`` names a column that grows with every commit of the source. Only rows with
    ``watermark < sequence <= upper`` are read (the predicate reaches the scan). A run that dies
    leaves an output folder that no commit names: the next run reads the same rows again and
    readers never see the orphan. Null sequences have no place in the order and are rejected.
    """

    def __init__(self, spark: SparkSession, root: str, sequence: str = "sequence"):
        self.spark, self.root, self.sequence = spark, root.rstrip("/"), sequence
        self.log = CommitLog(spark, root)

    def run(self, source: DataFrame, transform) -> Commit | None:
        """Process and publish the next slice; None if there is nothing new."""
        done = self.log.commits()
        low = done[-1].watermark if done else None
        bounds = source.agg(F.max(self.sequence).alias("top"), F.count(F.when(F.col(self.sequence).isNull(), 1)).alias("bad")).first()
        if bounds.bad:
            raise ValueError(f"{bounds.bad} rows have no {self.sequence}")
        if bounds.top is None or (low is not None and bounds.top <= low):
            return None
        piece = source.where(F.col(self.sequence) <= F.lit(bounds.top))
        if low is not None:
            piece = piece.where(F.col(self.sequence) > F.lit(low))
        output = f"{self.root}/data/{uuid.uuid4().hex}"
        transform(piece).write.parquet(output)
        commit = Commit((done[-1].number if done else 0) + 1, int(bounds.top), output)
        if not self.log.publish(commit):
            raise RuntimeError("another run committed first; run again")
        return commit

    def read(self) -> DataFrame:
        """All published output."""
        paths = [c.output for c in self.log.commits()]
        if not paths:
            raise ValueError("nothing was published yet")
        return self.spark.read.parquet(*paths)


#: Milliseconds that a log told by file times is read again, for clocks that differ. Reading a write
#: again changes nothing, as the state decides what is delivered.
OVERLAP_MS = 3_600_000


def with_file_times(writes: DataFrame) -> DataFrame:
    """Scanned ``writes`` with ``sequence``: the time at which its file was added to the log. Filters on
    it leave out whole files before they are opened."""
    return writes.select("*", F.col("_metadata.file_modification_time").alias("sequence"))


def export_changes(spark: SparkSession, root: str, writes: DataFrame, runs: DataFrame, entries: DataFrame, sequence: str = "sequence", overlap: int = 0) -> DataFrame:
    """Deliver the new and changed pages as one commit under ``root`` and return what was published:
    ``url, source_domain, current_md5, content_hash``.

    ``runs`` and ``entries`` are the record of other exports; whatever has the greatest run number, one
    of theirs or a commit under ``root``, tells what was delivered of a page. ``sequence`` names a column
    of ``writes``, a number or a time, that grows with every commit to the log; writes down to ``overlap`` below the watermark
    are read again, and all of them if there is no such column (the watermark is then the last run on record). Defined results: a second run without new writes delivers nothing; a run that died
    before its commit is as if it never was; of two runs at once one raises and delivers nothing; empty
    writes deliver nothing.
    """
    log = CommitLog(spark, root)
    done = log.commits()
    _, last_run = run_bounds(runs)
    number = max(last_run, done[-1].number if done else 0) + 1
    if sequence in writes.columns:
        mark = done[-1].watermark if done else None
        timed = writes.schema[sequence].dataType.typeName() == "timestamp"
        bound = (lambda n: F.timestamp_millis(F.lit(n))) if timed else F.lit
        if mark is not None:
            writes = writes.where(F.col(sequence) > bound(mark - overlap))
        top = writes.agg(F.max(F.unix_millis(sequence) if timed else sequence).alias("top")).first()["top"]
        upper = max(x for x in (top, mark, -1) if x is not None)
        writes = writes.where(F.col(sequence) <= bound(upper + timed))  # times are cut to milliseconds
    else:
        upper = last_run
    now = current_writes(writes)
    then = delivered_state(runs.where(F.col("run_id") <= last_run), entries)
    if done:
        state = spark.read.parquet(f"{done[-1].output}")
        now = now.unionByName(state.select(*KEY, "at", "current_md5")).groupBy(*KEY).agg(F.max(F.struct("at", "current_md5")).alias("w")).select(*KEY, "w.*")
        own = state.select(*KEY, F.col("delivered_run").alias("run"), F.col("delivered_md5").alias("content_hash"))
        then = then.unionByName(own).groupBy(*KEY).agg(F.max(F.struct("run", "content_hash")).alias("d")).select(*KEY, "d.*")
    n, d = now.alias("n"), then.alias("d")
    same = F.lit(True)
    for key in KEY:
        same = same & F.col(f"n.{key}").eqNullSafe(F.col(f"d.{key}"))
    changed = ~F.col("n.current_md5").eqNullSafe(F.col("d.content_hash"))
    output = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    n.join(d, same, "left").select(
        *[F.col(f"n.{k}") for k in KEY], "at", "current_md5", "content_hash", changed.alias("changed"),
        F.when(changed, F.lit(number)).otherwise(F.col("run")).cast("long").alias("delivered_run"), F.col("current_md5").alias("delivered_md5"),
    ).write.parquet(output)
    if not log.publish(Commit(number, upper, output)):
        raise RuntimeError("another run committed first; run again")
    return spark.read.parquet(output).where("changed").select(*KEY, "current_md5", "content_hash")
