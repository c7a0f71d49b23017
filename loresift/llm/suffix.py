"""Repeated runs of symbols in groups of documents, by suffix arrays that no task must hold whole.

A document is a sequence of symbols (line identifiers). All suffixes of all documents of a group, sorted,
are its suffix array; a run of symbols that several documents share is a common prefix of neighbours
in it. Every repeated run begins with a symbol that itself occurs in several documents, so only suffixes
that begin with such a symbol are sorted. The array is built in parts: all suffixes of one group that
begin with one symbol lie in one part, and where such a bundle exceeds ``bundle_rows`` it is dealt over
several parts by document. A part receives the repeated stretches of a document once, however many of
its suffixes it sorts, and sorts symbol by symbol, each time only what is still tied with others; a run
may have any length. For a common prefix it reports in how many documents it occurs; as a document never
lies in two parts of a bundle, the reports of dealt bundles add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

REPORT = "grp long, first long, parent long, prefix long, length int, documents long, occurrences long, low long, high long"
_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _mix(prefix: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the prefix one symbol longer."""
    with np.errstate(over="ignore"):
        h = prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbol.view(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def prefix_hash(symbols: list[int]) -> int:
    """The hash of a run."""
    state = np.zeros(1, dtype=np.int64)
    for symbol in symbols:
        state = _mix(state, np.array([symbol], dtype=np.int64))
    return int(state[0])


def _report(grp, doc, symbol, joined, own, hot, min_documents: int) -> Iterator[list[np.ndarray]]:
    """Sort the suffixes at the ``own`` places by one more symbol at a time and yield the common prefixes.

    ``joined`` tells whether the next place follows in the same document. Of a bundle that lies here
    alone, a prefix is dropped if fewer than ``min_documents`` hold it, or if it is longer than one symbol
    and one longer prefix occurs as often; of a dealt (``hot``) bundle everything is reported.
    """
    before = np.concatenate(([False], joined[:-1]))
    low = np.where(before, np.roll(symbol, 1), _LOWEST)
    high = np.where(before, np.roll(symbol, 1), _HIGHEST)
    at, length = np.flatnonzero(own), 1
    prefix = _mix(np.zeros(len(at), dtype=np.int64), symbol[at])
    parent = np.zeros(len(at), dtype=np.int64)
    upper = np.zeros(len(at), dtype=np.int64)  # the row of the shorter prefix in the last report
    held: list[np.ndarray] | None = None
    while len(at):
        _, row = np.unique(_mix(grp[at].copy(), prefix), return_inverse=True)
        order = np.lexsort((doc[at], row))
        row, at, prefix, parent, upper = row[order], at[order], prefix[order], parent[order], upper[order]
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (doc[at][1:] != doc[at][:-1])))
        documents = np.add.reduceat(fresh.astype(np.int64), starts)
        occurrences = np.diff(np.append(starts, len(at)))
        if held is not None:
            alone = ~held[-1]
            only = np.zeros(len(alone), dtype=bool)
            only[upper[starts]] = occurrences == held[6][upper[starts]]
            stays = ~(alone & only) | (held[4] == 1)
            yield [c[stays] for c in held[:-1]]
        keep = (documents >= min_documents) | hot[at[starts]]
        s = starts[keep]
        held = [grp[at[s]], symbol[at[s]] if length == 1 else held[1][upper[s]], parent[s], prefix[s], np.full(len(s), length, dtype=np.int32), documents[keep], occurrences[keep],
                np.minimum.reduceat(low[at], starts)[keep], np.maximum.reduceat(high[at], starts)[keep], hot[at[s]]]
        kept_row = np.cumsum(keep) - 1
        longer = keep[row] & joined[at + length - 1]
        at, parent, upper = at[longer], prefix[longer], kept_row[row[longer]]
        prefix = _mix(parent.copy(), symbol[at + length])
        length += 1
    if held is not None:
        yield held[:-1]


def _parts(batches: Iterator[pa.RecordBatch], min_documents: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    lists = {c: rows.column(c).combine_chunks() for c in ("places", "symbols", "targets", "hot")}
    sizes = np.diff(lists["places"].offsets.to_numpy())
    grp, doc, target = (np.repeat(rows.column(c).to_numpy(), sizes) for c in ("grp", "doc", "target"))
    places, symbol, targets = (lists[c].flatten().to_numpy() for c in ("places", "symbols", "targets"))
    hot = lists["hot"].flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    joined = np.append((row[1:] == row[:-1]) & (places[1:] == places[:-1] + 1), False)
    for columns in _report(grp, doc, symbol, joined, targets == target, hot, min_documents):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in REPORT.split(", ")])


def repeated_places(sequences: DataFrame, min_documents: int, limit_bytes: int = 16 << 20) -> DataFrame:
    """``grp, doc, body, at, symbol, n``: every place of a symbol that ``n >= min_documents`` documents of
    the group hold, written once. Counted with partial aggregation, so a symbol leaves a task once for
    every document, however often the document has it."""
    from .lines import bounded_broadcast

    places = sequences.select("grp", "doc", F.xxhash64("symbols").alias("body"), F.posexplode("symbols").alias("at", "symbol")).where(F.col("symbol").isNotNull())
    counts = places.select("grp", "symbol", "doc").distinct().groupBy("grp", "symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents)
    return staged(places.join(bounded_broadcast(staged(counts, "symbols"), 40, limit_bytes), ["grp", "symbol"]).select("grp", "doc", "body", "at", "symbol", "n"), "places")


def common_prefixes(places: DataFrame, min_documents: int, bundle_rows: int = 200_000, part_rows: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """``grp, first, parent, prefix, length, documents, occurrences, low, high`` of the runs of symbols,
    of any length, that at least ``min_documents`` documents of their group hold.

    ``places`` is what ``repeated_places`` gives. ``parent`` is the run without its last symbol; ``low``
    and ``high`` are equal if one symbol stands before every occurrence. Runs longer than one symbol may be
    missing if a longer one occurs as often.
    """
    if parts is None:
        total = places.count()
        parts = max(int(places.sparkSession.sparkContext.defaultParallelism), -(-2 * total // part_rows))
    dealt = F.when(F.col("n") > bundle_rows, F.pmod(F.xxhash64("doc", F.lit(7)), F.ceil(F.col("n") / bundle_rows))).otherwise(F.lit(0))
    target = F.pmod(F.xxhash64("grp", "symbol", dealt), F.lit(parts)).cast("int")
    stretch = F.struct("at", "symbol", target.alias("target"), (F.col("n") > bundle_rows).alias("hot"))
    stretches = places.groupBy("grp", "doc", "body").agg(F.array_sort(F.collect_set(stretch)).alias("s"))
    shipped = stretches.select(
        "grp", "doc", F.explode(F.array_distinct("s.target")).alias("target"), F.col("s.at").alias("places"), F.col("s.symbol").alias("symbols"), F.col("s.target").alias("targets"), F.col("s.hot").alias("hot")
    )
    reports = shipped.repartition(parts, "target").mapInArrow(lambda it: _parts(it, min_documents), REPORT)
    return (
        reports.groupBy("grp", "first", "prefix", "length")
        .agg(F.first("parent").alias("parent"), F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("documents") >= min_documents)
    )


def maximal_runs(runs: DataFrame, least: int = 2) -> DataFrame:
    """The runs of at least ``least`` symbols that no longer run contains wherever they occur, neither one
    that goes on further nor one that begins before."""
    longer = runs.select("grp", F.col("parent").alias("prefix"), "occurrences").distinct()
    return runs.where((F.col("length") >= least) & (F.col("low") != F.col("high"))).join(longer, ["grp", "prefix", "occurrences"], "left_anti")
