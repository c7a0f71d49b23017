"""Long runs of tokens that many pages of one host share, by suffix arrays of bounded parts.

A page is a stream of tokens in which every text unit stands between two ``EDGE`` tokens. A *piece* is
what a repeated run is made of: ``PIECE`` tokens of one unit in a row, wherever they begin, edges included,
or a whole shorter unit with both its edges. A run of any length is covered by the pieces in it, so no run
is ever cut; a notice with one changed word is covered on both sides of it. The end of one unit with the
beginning of the next is no piece: it would say of two short texts that they are half repeated.

A host's streams are dealt over parts of about ``part_tokens`` by article, so that an article with all
its pages lies in one part, or in several if it alone is too large. A part concatenates its streams,
sorts their suffixes by doubling ranks to the depth at which pieces end (deeper order decides nothing),
takes the longest common prefixes of neighbours, and counts the articles of every stretch of the suffix
array whose common prefix holds a piece. The counts of parts add up, as they share no article; articles
that lie in several parts are reported by name and counted after.

Not every count must leave its part. A piece on the floor's share of a host is expected on the same
share of a part; one that stays below it by more than six standard deviations is not reported. Articles
are dealt by hash, so a piece at the floor loses a part's count with a probability below 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .lines import bounded_broadcast

#: The token around units; no word has it.
EDGE = 0
#: Stands for tokens that are in no repeated run; no stored token has it.
RARE = np.uint32(1 << 31)
#: Tokens of a piece.
PIECE = 5
#: Bytes of a stored token.
WIDTH = 3
#: Tokens that a Python worker remembers.
REMEMBERED = 200_000


class Tokens(dict):
    """Numbers of the tokens seen so far; never that of ``EDGE``."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = number = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) % ((1 << 8 * WIDTH) - 1) + 1
        return number


def packed(tokens: list[int]) -> bytes:
    """Token numbers as stored."""
    return np.asarray(tokens, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :WIDTH].tobytes()


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(tokens, ends)`` of a binary column: all streams in a row, and where each ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WIDTH)
    tokens = np.zeros(len(raw), dtype=np.uint32)
    for k in range(WIDTH):
        tokens |= raw[:, k].astype(np.uint32) << np.uint32(8 * k)
    return tokens, (offsets[1:] - offsets[0]) // WIDTH


def pieces(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, depths)`` of all pieces."""
    n = len(tokens)
    at = np.arange(n)
    edges = np.flatnonzero(tokens == EDGE)
    following = np.append(edges, n)[np.searchsorted(edges, at, side="right")]
    whole = following - at + 1  # up to the next edge
    depth = np.where(tokens == EDGE, np.minimum(whole, PIECE), PIECE)
    last = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    starts = np.flatnonzero((whole >= depth) & (at + depth <= last))
    return starts, depth[starts]


def names(tokens: np.ndarray, starts: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every piece."""
    h = np.zeros(len(starts), dtype=np.uint64)
    wide = tokens.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PIECE):
            live = depths > k if k > 1 else slice(None)
            x = h[live] * np.uint64(0x9E3779B97F4A7C15) + wide[starts[live] + k] + np.uint64(1)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            h[live] = x ^ (x >> np.uint64(29))
    return h.view(np.int64)


def _ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal values."""
    return np.unique(values, return_inverse=True)[1].astype(np.int32) + np.int32(1)


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, lcp)``: the suffixes at ``starts`` sorted by at least ``depth`` tokens, and the common
    prefix of each with the one before it, cut at what was sorted."""
    n, span = len(tokens), 1
    levels = [_ranks(tokens)]
    while span < depth:
        rank = levels[-1].astype(np.int64)
        rank *= int(rank.max()) + 1
        rank[:-span] += levels[-1][span:]
        levels.append(_ranks(rank))
        span *= 2
    order = starts[np.argsort(levels[-1][starts], kind="stable")]
    lcp = np.zeros(len(order), dtype=np.int64)
    above, below = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        rank, i, j = levels[k], above + lcp[1:], below + lcp[1:]
        inside = (i < n) & (j < n) & (lcp[1:] + (1 << k) <= span)
        lcp[1:] += (inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])) * (1 << k)
    return order, lcp


def without_rare(tokens: np.ndarray, ends: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(tokens, ends, place)``: the streams with each row of tokens that occur too seldom as one ``RARE``,
    and where each token stood. No repeated run holds such a token, so they need not be sorted."""
    _, number, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rare = (counts < least)[number] & (tokens != EDGE)
    place = np.flatnonzero(~rare | ~np.concatenate(([False], rare[:-1])))
    kept = np.where(rare, RARE, tokens)[place]
    return kept, np.searchsorted(place, ends), place


def shared(tokens: np.ndarray, ends: np.ndarray, owner: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every piece that at least ``least`` owners of streams hold: ``(names, group, holder)``, the names
    by number of the piece, then one entry per piece and owner."""
    none = np.zeros(0, dtype=np.int64)
    original = tokens
    tokens, ends, place = without_rare(tokens, ends, least)
    starts, depths = pieces(tokens, ends)
    clear = np.concatenate(([0], np.cumsum(tokens == RARE)))
    usable = clear[starts + depths] == clear[starts]
    starts, depths = starts[usable], depths[usable]
    if not len(starts):
        return none, none, none
    deep = np.zeros(len(tokens), dtype=np.int64)
    deep[starts] = depths
    order, lcp = suffix_array(tokens, starts, PIECE)
    fresh = lcp < deep[order]
    fresh[0] = True
    group = np.cumsum(fresh) - 1
    large = np.bincount(group)[group] >= least
    order, group = order[large], group[large]
    if not len(order):
        return none, none, none
    stream = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    owners, numbers = np.unique(owner, return_inverse=True)
    pair, first = np.unique(group * len(owners) + numbers[stream[order]], return_index=True)
    group = pair // len(owners)
    keep = np.bincount(group)[group] >= least
    group, pair, first = group[keep], pair[keep], first[keep]
    _, heads, group = np.unique(group, return_index=True, return_inverse=True)
    at = order[first[heads]]
    return names(original, place[at], deep[at]), group, owners[pair % len(owners)]


_REPORT = "grp long, symbol long, article long, n long"


def _part(rows: pa.Table) -> pa.RecordBatch:
    """What one part of a host reports: pieces with the number of its articles that hold them, and
    one row per piece and article that may lie in other parts too."""
    grp, floor, subs = (rows.column(c)[0].as_py() for c in ("grp", "floor", "subs"))
    tokens, ends = unpacked(rows.column("tokens"))
    sub = rows.column("sub").to_numpy()
    here = len(np.unique(sub))
    expected = floor * here / subs
    least = floor if here == subs else max(1.0, expected - 6 * expected**0.5)
    symbols, group, holder = shared(tokens, ends, sub, least)
    places, first = np.unique(sub, return_index=True)
    divided = rows.column("divided").to_numpy(zero_copy_only=False)[first]
    articles = rows.column("article").to_numpy()[first]
    at = np.searchsorted(places, holder)
    open_ = divided[at] if len(at) else np.zeros(0, dtype=bool)
    counts = np.bincount(group[~open_], minlength=len(symbols))
    pairs = np.unique(np.stack((group[open_], articles[at[open_]])), axis=1) if open_.any() else np.zeros((2, 0), dtype=np.int64)
    named = pa.concat_arrays([pa.nulls(len(symbols), pa.int64()), pa.array(pairs[1])])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(named), grp)), pa.array(np.concatenate((symbols, symbols[pairs[0]]))), named, pa.array(np.concatenate((counts, np.zeros(pairs.shape[1], dtype=np.int64))))],
        names=["grp", "symbol", "article", "n"],
    )


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host and part; one part is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("grp", "part")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, start])
            if held and key != last:
                yield _part(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield _part(pa.Table.from_batches(held))


def covered_pieces(streams: DataFrame, share: float, min_articles: int, part_tokens: int = 1 << 19) -> DataFrame:
    """``grp, symbol``: names of the pieces on at least ``share`` of the group's articles.

    ``streams`` has ``grp long, article long, doc long, n_tokens int, tokens binary``. Sizes of articles
    and groups are counted first, from their numbers alone; then every stream is exchanged once.
    """
    articles = staged(streams.groupBy("grp", "article").agg(F.sum("n_tokens").alias("size")).withColumn("buckets", F.ceil(F.col("size") * 4 / part_tokens)), "articles")
    hosts = staged(
        articles.groupBy("grp").agg(
            F.greatest(F.lit(min_articles), F.ceil(F.count(F.lit(1)) * share)).cast("long").alias("floor"),
            F.greatest(F.lit(1), F.ceil(F.sum("size") / part_tokens)).cast("long").alias("parts"),
            F.sum(F.greatest(F.lit(1), "buckets")).cast("long").alias("subs"),
        ),
        "hosts",
    )
    large = articles.where("buckets > 1").select(F.col("grp").alias("of"), F.col("article").alias("one"), "buckets")
    total = hosts.agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(2 * int(streams.sparkSession.sparkContext.defaultParallelism), int(total))
    bucket = F.coalesce(F.pmod(F.xxhash64("doc", F.lit(5)), F.col("buckets")), F.lit(0))
    dealt = (
        streams.join(bounded_broadcast(large, 32), F.expr("grp = of AND article = one"), "left")
        .join(bounded_broadcast(hosts, 48), "grp")
        .select("grp", F.xxhash64("article", bucket).alias("sub"), "article", F.col("buckets").isNotNull().alias("divided"), "floor", "subs", "parts", "tokens")
        .withColumn("part", F.pmod("sub", "parts"))
    )
    parts = dealt.repartition(tasks, "grp", "part").sortWithinPartitions("grp", "part")
    reports = parts.select("grp", "part", "sub", "article", "divided", "floor", "subs", "tokens").mapInArrow(_reports, _REPORT)
    counts = reports.groupBy("grp", "symbol", "article").agg(F.sum("n").alias("n")).groupBy("grp", "symbol").agg((F.sum("n") + F.count("article")).alias("n"))
    return counts.join(bounded_broadcast(hosts, 48), "grp").where("n >= floor").select("grp", "symbol")


def units_covered(tokens: np.ndarray, ends: np.ndarray, grp: np.ndarray, keys: np.ndarray, least: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Whether each unit of the streams has at least ``least`` of its tokens in covered pieces, and how
    many units each stream has. ``keys`` are the sorted ``mixed`` names of covered pieces."""
    starts, depths = pieces(tokens, ends)
    lengths = np.diff(np.concatenate(([0], ends)))
    hashes = mixed(np.repeat(grp, lengths)[starts], names(tokens, starts, depths))
    if len(keys):
        hit = keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes
    else:
        hit = np.zeros(len(hashes), dtype=bool)
    steps = np.bincount(starts[hit], minlength=len(tokens) + 1) - np.bincount(starts[hit] + depths[hit], minlength=len(tokens) + 1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(steps)[:-1] > 0)))
    edges = np.flatnonzero(tokens == EDGE)
    whose = np.searchsorted(ends, edges, side="right")
    begins = np.flatnonzero(whose[1:] == whose[:-1])
    first, last = edges[begins] + 1, edges[begins + 1]
    return inside[last] - inside[first] >= least * (last - first), np.bincount(whose[begins], minlength=len(ends))


def mixed(grp: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Names of pieces mixed with their group."""
    with np.errstate(over="ignore"):
        return symbol.astype(np.int64).view(np.uint64) ^ (grp.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
