"""Problem 1: how often every distinct term occurs, and in how many documents.

Method: recursive radix spilling. Every input task counts the terms of its own documents in DuckDB,
so few rows per task and term leave it, however common the term: what is held is summed and handed on
whenever it reaches a limit. These partial counts are partitioned by the top bits of a term hash and
spilled to the shared folder. Partitions whose counted bytes do not fit the memory of one task are split
by the next bits, again and again, all of a level in one job. Each leaf is then summed by DuckDB in one
task straight from its files. Nothing is spilled to a disk of the executor's own.

Defined results: null texts hold no terms and do not count as documents, empty texts count as
documents; repeated rows count each time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged, work_path

#: A term: fixed by the problem statement.
TERM = "[A-Za-z][A-Za-z']*"

#: Marks the row that carries the number of documents; no term is empty.
DOCS = ""

PARTIAL = "term string, h long, occurrences long, documents long"

#: Shares of a task's memory: a row of partial counts that it holds, a character that it counts at a time.
#: Counts beyond that are handed on; longer texts are counted in pieces.
HELD_BYTES, CHAR_BYTES = 300, 64
#: Bytes that DuckDB's grouping needs for a row besides its term.
ROW_BYTES = 100


def _connection(memory_mb: int):
    import duckdb

    return duckdb.connect(config={"memory_limit": f"{memory_mb}MB", "threads": 1, "preserve_insertion_order": False, "temp_directory": ""})


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """``(texts, whole, last)``: tables of whole texts, or of a piece of one text that is longer than
    ``limit``, cut where no term can stand."""
    texts: list[str] = []
    size = 0
    for value in batch.column("text"):
        text = value.as_py()
        if texts and size + len(text) > limit:
            yield pa.table({"text": texts}), True, True
            texts, size = [], 0
        if len(text) <= limit:
            texts.append(text)
            size += len(text)
            continue
        at = 0
        while at < len(text):
            end = min(len(text), at + limit)
            while end < len(text) and (text[end] == "'" or text[end].isascii() and text[end].isalpha()):
                end += 1
            yield pa.table({"text": [text[at:end]]}), False, end == len(text)
            at = end
    if texts:
        yield pa.table({"text": texts}), True, True


def _count_partials(batches: Iterator[pa.RecordBatch], min_chars: int, memory_mb: int) -> Iterator[pa.RecordBatch]:
    con = _connection(memory_mb)
    most, limit, held, docs = (memory_mb << 20) // HELD_BYTES, (memory_mb << 20) // CHAR_BYTES, 0, 0
    for name in ("part", "pieces"):
        con.execute(f"CREATE TABLE {name} (term VARCHAR, occurrences BIGINT, documents BIGINT)")
    per_text = f"""SELECT lower(t) AS term, count(*) AS n FROM (SELECT row_number() OVER () AS r, regexp_extract_all(text, $pattern) AS ts FROM texts), unnest(ts) AS u(t)
      WHERE length(t) >= {int(min_chars)} GROUP BY r, term"""
    for batch in batches:
        docs += batch.num_rows
        for texts, whole, last in _pieces(batch, limit):
            con.register("texts", texts)
            held += con.execute(f"INSERT INTO {'part' if whole else 'pieces'} SELECT term, sum(n)::BIGINT, count(*) FROM ({per_text}) GROUP BY term", {"pattern": TERM}).fetchone()[0]
            con.unregister("texts")
            if not whole and (last or held > most):
                _fold(con, "pieces")  # one text's terms, however often it has them
                if last:
                    con.execute("INSERT INTO part SELECT term, occurrences, 1 FROM pieces")
                    con.execute("TRUNCATE pieces")
            if held > most and last:
                yield from _batches(con, _PARTIALS)
                con.execute("TRUNCATE part")
                held = 0
    yield from _batches(con, _PARTIALS)
    yield pa.RecordBatch.from_pydict({"term": [DOCS], "h": pa.array([_DOCS_HASH], pa.int64()), "occurrences": pa.array([0], pa.int64()), "documents": pa.array([docs], pa.int64())})


def _fold(con, name: str) -> None:
    con.execute(f"CREATE TABLE folded AS SELECT term, sum(occurrences)::BIGINT AS occurrences, 1::BIGINT AS documents FROM {name} GROUP BY term")
    con.execute(f"DROP TABLE {name}")
    con.execute(f"ALTER TABLE folded RENAME TO {name}")


_HASH = "('0x' || md5(term)[:15])::BIGINT"
#: The hash of the empty term.
_DOCS_HASH = int(hashlib.md5(b"").hexdigest()[:15], 16)
_PARTIALS = f"SELECT term, {_HASH} AS h, sum(occurrences)::BIGINT AS occurrences, sum(documents)::BIGINT AS documents FROM part GROUP BY term"


def _batches(con, query: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(query).to_arrow_reader(100_000)


def _sum_leaves(batches: Iterator[pa.RecordBatch], memory_mb: int) -> Iterator[pa.RecordBatch]:
    """Each input row names the files of a few leaves; DuckDB sums them as it reads them."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    for batch in batches:
        for folders in batch.column("folders").to_pylist():
            con = _connection(memory_mb)
            system, _ = fs.FileSystem.from_uri(folders[0])
            files = [f.path for folder in folders for f in system.get_file_info(fs.FileSelector(fs.FileSystem.from_uri(folder)[1])) if f.path.endswith(".parquet")]
            con.register("leaf", ds.dataset(files, filesystem=system, format="parquet"))
            yield from _batches(con, "SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(documents)::BIGINT AS documents FROM leaf GROUP BY term")
            con.close()


def _digit(level: int, bits: int):
    """The ``level``-th group of hash bits, counted from the top of 60."""
    return F.shiftright(F.col("h"), 60 - bits * (level + 1)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def term_counts(documents: DataFrame, text: str = "text", min_chars: int = 2, bits: int = 4, leaf_rows: int = 4_000_000, memory_mb: int = 256) -> DataFrame:
    """``term, occurrences, documents`` of every distinct term, and one row with the empty term
    whose ``documents`` is the number of non-null texts.

    ``leaf_rows``, and half of ``memory_mb``, bound what one task sums; ``bits`` is the radix of a split.
    """
    spark = documents.sparkSession
    rows = (
        spread(documents.select(F.col(text).alias("text")).where(F.col("text").isNotNull()))
        .mapInArrow(lambda it: _count_partials(it, min_chars, memory_mb), PARTIAL)
        .withColumn("prefix", F.lit("t"))
    )
    fan, level, leaves, large = 1 << bits, 0, [], ["t"]
    while True:
        path = work_path(spark, f"terms-{level}")
        # each digit goes to few writers, as many as there are tasks to share among the digits
        writers = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // (fan * len(large)))
        here = rows.withColumn("radix", _digit(level, bits))
        here.repartition("prefix", "radix", F.pmod("h", F.lit(writers))).write.option("compression", "zstd").partitionBy("prefix", "radix").parquet(path)
        written = spark.read.schema(f"{PARTIAL}, prefix string, radix int").parquet(path)
        last, large = bits * (level + 2) > 60, []
        # one row for every partition of the level reaches the driver
        for r in written.groupBy("prefix", "radix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + ROW_BYTES).alias("bytes")).collect():
            if not last and (r.n > leaf_rows or r.bytes > memory_mb << 19):
                large.append(f"{r.prefix}-{r.radix}")
            else:
                leaves.append((f"{path}/prefix={r.prefix}/radix={r.radix}", r.bytes))
        if not large:
            return _summed(spark, leaves, min(leaf_rows * ROW_BYTES, memory_mb << 19) // 8, memory_mb)
        level += 1
        place = F.concat_ws("-", "prefix", "radix")
        rows = written.where(place.isin(large)).withColumn("prefix", place)


def _summed(spark, leaves: list[tuple[str, int]], share: int, memory_mb: int) -> DataFrame:
    """Small neighbours share a task; a leaf is never cut."""
    groups, held = [], 0
    for folder, size in sorted(leaves):
        if groups and held + size <= share:
            groups[-1].append(folder)
            held += size
        else:
            groups.append([folder])
            held = size
    schema = "term string, occurrences long, documents long"
    if not groups:
        return spark.createDataFrame([], schema)
    work = spark.createDataFrame([(g,) for g in groups], "folders array<string>").repartition(len(groups))
    return work.mapInArrow(lambda it: _sum_leaves(it, memory_mb), schema)


def marked_terms(documents: DataFrame, text: str = "text", rare_below: int = 4, common_above: float = 0.4, **options) -> DataFrame:
    """``term, occurrences, documents, mark``: ``rare`` below ``rare_below`` occurrences in all,
    ``common`` in more than ``common_above`` of the documents with a text, else null.

    A term that is both keeps ``common`` only if it is not rare; rare comes first.
    """
    counts = staged(term_counts(documents, text, **options), "terms")
    total = counts.where(F.col("term") == DOCS).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("total")).first().total
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("documents") > F.lit(common_above * total), "common")
    return counts.where(F.col("term") != DOCS).withColumn("mark", mark)


def python_counts(texts: list[str | None]) -> dict[str, tuple[int, int]]:
    """The plain computation, for tests."""
    counts: dict[str, tuple[int, int]] = {}
    for text in texts:
        terms = [t.lower() for t in re.findall(TERM, text or "") if len(t) >= 2]
        for term in set(terms):
            a, b = counts.get(term, (0, 0))
            counts[term] = (a + terms.count(term), b + 1)
    return counts
