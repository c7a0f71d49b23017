"""Problem 8: documents into containers of fixed capacity, at the sources' target proportions.

Method: mixture-controlled packing. Documents are dealt by hash over shards of bounded size. Each
shard keeps one queue per source and fills one window after another by deficit round-robin: every
window grants each source its share of the capacity, the source that is owed most gives the largest
document that still fits, and what it gives is taken off its account. The last gap of a window goes
to the best fit of all sources. Accounts are carried from window to window, and from shard to shard:
what the earlier shards left a source short of is known from the shards' totals (a running sum over
a small table), so shards pack in parallel as if one after the other.

Defined results: every row gets at least one piece; only a document larger than the capacity is cut,
into full containers and one remainder; a document without tokens is a piece of 0 tokens; a null or
negative size is counted from the text; a null source is a source of its own; equal sizes go by
document id. Sources without a given target get what they hold of all tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Python's ``\\w+|[^\\w\\s]`` for Java: letters and all numbers, without combining marks.
TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

PIECES = "doc_id long, piece_no int, tokens int, container_id long"

#: A window with less room than this share of the capacity takes the best fit of all sources: more fills
#: windows better, less keeps each window closer to the targets.
GAP = 0.35


def token_count(text: Column, given: Column) -> Column:
    """The given count, or that of the text where none is given."""
    counted = F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))
    return F.coalesce(F.when(given >= 0, given), counted).cast("long")


class _Queues:
    """The pieces of one shard, per source in stacks by size. The sizes at hand are the bits of one number,
    so the largest that fits is found without a search and taken without a shift."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["source", "tokens", "doc_id", "piece_no"], kind="stable")
        self.names: list[str] = []
        self.stacks: list[dict[int, list[tuple[int, int]]]] = []
        self.held: list[int] = []
        for name, own in rows.groupby("source", sort=True):
            stacks: dict[int, list[tuple[int, int]]] = {}
            for size, doc, piece in zip(own.tokens.tolist(), own.doc_id.tolist(), own.piece_no.tolist(), strict=True):
                stacks.setdefault(size, []).append((doc, piece))
            self.names.append(name)
            self.stacks.append(stacks)
            self.held.append(sum(1 << size for size in stacks))
        self.least = np.array([self._least(s) for s in range(len(self.names))], dtype=np.int64)

    def _least(self, source: int) -> int:
        held = self.held[source]
        return (held & -held).bit_length() - 1 if held else np.iinfo(np.int64).max

    def largest(self, source: int, room: int) -> int:
        """Size of the largest piece of the source that fits."""
        return (self.held[source] & ((2 << room) - 1)).bit_length() - 1

    def take(self, source: int, size: int) -> tuple[int, int]:
        """The last piece of that size."""
        stack = self.stacks[source][size]
        item = stack.pop()
        if not stack:
            self.held[source] ^= 1 << size
            self.least[source] = self._least(source)
        return item


def pack_shard(rows: pd.DataFrame, capacity: int, share: dict[str, float], carried: dict[str, float], first: int, gap: float = GAP) -> pd.DataFrame:
    """Assign the pieces of one shard; ``carried`` is what earlier shards still owe each source."""
    queues = _Queues(rows)
    shares = np.array([share.get(n, 0.0) for n in queues.names])
    owed = np.array([carried.get(n, 0.0) for n in queues.names])
    never = np.iinfo(np.int64).max
    out, window = [], first
    while (queues.least < never).any():
        owed += shares * capacity
        room = capacity
        while True:
            fits = queues.least <= room
            if not fits.any():
                break
            if room <= capacity * gap:
                options = np.flatnonzero(fits)
                best = max(options.tolist(), key=lambda s: (queues.largest(s, room), owed[s]))
            else:
                best = int(np.argmax(np.where(fits, owed, -np.inf)))
            size = queues.largest(best, room)
            doc, piece = queues.take(best, size)
            owed[best] -= size
            room -= size
            out.append((doc, piece, size, window))
            if room == 0 and not (queues.least == 0).any():
                break
        window += 1
    frame = pd.DataFrame(out, columns=["doc_id", "piece_no", "tokens", "container_id"])
    return frame.astype({"doc_id": "int64", "piece_no": "int32", "tokens": "int32", "container_id": "int64"})


def packed(documents: DataFrame, capacity: int = 2048, targets: dict[str, float] | None = None, shard_tokens: int = 8_000_000, shard_rows: int = 50_000, gap: float = GAP) -> DataFrame:
    """``doc_id, piece_no, tokens, container_id`` of every piece of every document.

    ``targets`` names wanted shares by source (they are scaled to 1 with the rest of the sources).
    """
    size = token_count(F.col("text"), F.col("n_tokens"))
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("unnamed"), size.alias("size"))
    # a null source is kept apart from one named by the empty string
    rows = rows.select("doc_id", F.when(F.col("unnamed"), F.lit("\0none")).otherwise(F.col("source")).alias("source"), "size")
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")
    pieces = rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "doc_id", "source", "piece_no", F.least(F.col("size") - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("tokens")
    )
    pieces = staged(pieces, "pieces")
    total = pieces.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(1, -(-total.tokens // shard_tokens), -(-total["rows"] // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(shards)).cast("int"))

    held = dealt.groupBy("shard", "source").agg(F.sum("tokens").alias("tokens"))
    by_source = held.groupBy("source").agg(F.sum("tokens").alias("all"))
    wanted = F.col("all") / F.lit(float(max(1, total.tokens)))
    for name, value in (targets or {}).items():
        wanted = F.when(F.col("source") == name, F.lit(float(value))).otherwise(wanted)
    weights = by_source.select("source", wanted.alias("w"))
    shares = weights.crossJoin(F.broadcast(weights.agg(F.sum("w").alias("sum")))).select("source", F.try_divide("w", "sum").alias("share"))
    in_shard = held.groupBy("shard").agg(F.sum("tokens").alias("shard_tokens"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    accounts = (
        held.join(in_shard, "shard")
        .join(shares, "source")
        .withColumn("given", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .join(_tokens_before(in_shard), "shard")
        .select("shard", "source", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("earlier") - F.col("given")).alias("carried"))
    )

    def fill(key, rows: pd.DataFrame, account: pd.DataFrame) -> pd.DataFrame:
        share = dict(zip(account.source, account.share, strict=True))
        carried = dict(zip(account.source, account.carried, strict=True))
        return pack_shard(rows, capacity, share, carried, int(key[0]) << 32, gap)

    return dealt.groupBy("shard").cogroup(staged(accounts, "accounts").groupBy("shard")).applyInPandas(fill, PIECES)


def _tokens_before(in_shard: DataFrame) -> DataFrame:
    """``shard, earlier``: the tokens of all earlier shards, one row per shard."""
    block = in_shard.withColumn("block", F.floor(F.col("shard") / 4096))
    sums = block.groupBy("block").agg(F.sum("shard_tokens").alias("t"))
    starts = sums.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("start"))
    inner = Window.partitionBy("block").orderBy("shard")
    return block.withColumn("here", F.sum("shard_tokens").over(inner) - F.col("shard_tokens")).join(starts, "block").select("shard", (F.col("start") + F.col("here")).alias("earlier"))
