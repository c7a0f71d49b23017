"""Session helpers: table loading, the shared working folder, and materialised stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may not have it, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="loresift-")) / "loresift-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of a table's files: equal as long as the table is unchanged."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def spread(df: DataFrame) -> DataFrame:
    """A scanned ``df`` over all cores where it has fewer partitions than that, as a small table in
    one file has; large tables pass unchanged and are not shuffled. Anything but a scan passes
    unchanged too: to count its partitions would run it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("Join", "Aggregate", "Window", "Sort", "Repartition", "Deduplicate", "Generate")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares.

    A cluster names it in ``spark.checkpoint.dir`` and that setting always wins. Only where it is
    unset (tests, a laptop) a temporary folder is made, and then noted in the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loresift-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the shared folder is cleaned by its owner
        pass


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/loresift/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs one re-read and never a recomputation, and
    lets a result be used several times without being computed several times.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
