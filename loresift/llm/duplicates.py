"""Problem 4: near-duplicate documents with small edits.

Documents are sets of word shingles. Every set gets a fingerprint of 128 bits (the low bits of 128
minimum hashes), whose Hamming distance estimates the Jaccard similarity, and is put into shards:
one per band of ``ROWS`` minimum hashes. A document lies in as many shards as there are bands, so
documents near a shard's boundary meet in another one. Within a shard a vantage-point tree over the
fingerprints finds the pairs within the radius that the similarity allows, pruning branches by the
triangle inequality; exact similarities of the shingle sets decide.

One tree over the whole collection cannot do it: fingerprints of unrelated texts all lie about 62
bits apart while the radius for a similarity of 0.6 is 44, so no branch is ever pruned and the work is
quadratic. The bands bound what a tree has to hold.

Texts with equal shingle sets are collapsed to their smallest document before anything is compared
and expanded at the end. A shard that a large part of all rows shares is cut into blocks, and pairs
of blocks are compared in tasks of their own. Nothing is capped.

Defined results: null or empty texts and texts below ``min_words`` words match nothing; a document
never pairs with itself, repeated rows of one document count once; pairs come out once, smaller key
first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from .vptree import close_pairs, distance

ROWS = 4
BANDS = 40
BITS = 128
#: Farthest fingerprints of a pair at similarity t: mean BITS * (1 - t) / 2 plus this many deviations.
DEVIATIONS = 4.0

_WORD = re.compile(r"[^\W_]+")
_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, size=(2, max(ROWS * BANDS, BITS)), dtype=np.int64).astype(np.uint64)
_SEEDS[0] |= np.uint64(1)


def radius(threshold: float) -> int:
    """Hamming distance that a pair at the threshold practically never exceeds."""
    p = (1 - threshold) / 2
    return int(BITS * p + DEVIATIONS * (BITS * p * (1 - p)) ** 0.5)


def _spread(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; remembers the hashes of words."""

    def __init__(self, size: int, min_words: int):
        self.size, self.min_words, self.known = size, min_words, {}

    def __call__(self, text: str) -> np.ndarray | None:
        import xxhash

        words = _WORD.findall(text.lower())
        if len(words) < max(self.min_words, self.size):
            return None
        known = self.known
        if len(known) > 500_000:
            known.clear()
        codes = []
        for w in words:
            code = known.get(w)
            if code is None:
                code = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            codes.append(code)
        h = np.array(codes, dtype=np.uint64)
        n = len(h) - self.size + 1
        mixed = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.size):
                mixed = _spread(mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(mixed)


def _sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x BANDS) and fingerprints (documents x 2 words)."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = np.concatenate(sets)
    least = np.empty((_SEEDS.shape[1], len(sets)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(_SEEDS.shape[1]):
            least[k] = np.minimum.reduceat((flat ^ _SEEDS[1, k]) * _SEEDS[0, k], starts)
        keys = np.empty((len(sets), BANDS), dtype=np.uint64)
        for band in range(BANDS):
            key = np.full(len(sets), band + 1, dtype=np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = _spread(key * np.uint64(0x9E3779B97F4A7C15) + least[k])
            keys[:, band] = key
    bits = (_spread(least[:BITS]) & np.uint64(1)).astype(np.uint64)
    words = [np.bitwise_or.reduce(bits[64 * w : 64 * (w + 1)] << np.arange(64, dtype=np.uint64)[:, None], axis=0) for w in range(BITS // 64)]
    return keys, np.stack(words, axis=1)


SKETCH = "doc_id long, n int, same binary, keys array<long>, f0 long, f1 long"


def _sketches(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingler = Shingler(size, min_words)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            docs, sets = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                found = shingler(text.as_py())
                if found is not None:
                    docs.append(doc)
                    sets.append(found)
            if not docs:
                continue
            keys, prints = _sketch(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    pa.array(prints[:, 0].view(np.int64).copy()),
                    pa.array(prints[:, 1].view(np.int64).copy()),
                ],
                names=["doc_id", "n", "same", "keys", "f0", "f1"],
            )


def _shard_pairs(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one partition whose rows come sorted by shard; ``side`` keeps block pairs apart.

    Rows of one shard may span batches. Small shards of equal size are compared together.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = table.column("key").to_numpy()
        cell = table.column("cell").to_numpy()
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = table.slice(cut)
        if cut:
            yield from _compare(table.slice(0, cut), reach)
    if rest is not None and rest.num_rows:
        yield from _compare(rest, reach)


def _compare(table: pa.Table, reach: int) -> Iterator[pa.RecordBatch]:
    key, cell, doc, side = (table.column(c).to_numpy() for c in ("key", "cell", "doc_id", "side"))
    points = np.stack([table.column(c).to_numpy() for c in ("f0", "f1")], axis=1).view(np.uint64)
    change = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
    starts = np.concatenate(([0], change))
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [], []
    for size in np.unique(sizes[sizes > 1]):
        own = starts[sizes == size]
        if size <= 16:  # a leaf of a tree, many at once
            a, b = np.triu_indices(size, 1)
            rows = own[:, None] + np.arange(size)
            i, j = rows[:, a].ravel(), rows[:, b].ravel()
            near = distance(points[i], points[j]) <= reach
            left.append(i[near])
            right.append(j[near])
        else:
            for start in own:
                i, j = close_pairs(points[start : start + size], reach)
                left.append(i + start)
                right.append(j + start)
    if not left:
        return
    i, j = np.concatenate(left), np.concatenate(right)
    keep = (cell[i] < 0) | (side[i] != side[j])  # block against block, or all of one shard
    i, j = i[keep], j[keep]
    pairs = np.unique(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def hot_keys(bands: DataFrame, rows: int, share: int = 64) -> DataFrame:
    """``key, blocks``: shards of about ``rows`` documents and more, by counting one document in
    ``share``. It only decides how the work is cut, never what is compared."""
    seen = bands.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(share)) == 0).groupBy("key").count()
    return seen.where(F.col("count") * share >= rows).select("key", F.ceil(F.col("count") * share / rows).cast("int").alias("blocks"))


def candidate_pairs(sketches: DataFrame, threshold: float, hot_rows: int = 50_000) -> DataFrame:
    """``a, b``: pairs of sketched documents that share a shard and have near fingerprints."""
    bands = sketches.select("doc_id", "f0", "f1", F.explode("keys").alias("key"))
    hot = staged(hot_keys(sketches.select("doc_id", F.explode("keys").alias("key")), hot_rows), "hot")
    reach = radius(threshold)
    whole = F.lit(-1).cast("int")
    count = hot.count()
    if count:
        bands = bands.join(F.broadcast(hot) if count <= 100_000 else hot, "key", "left").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).cast("int"))
        # block i meets block j in the cell i * blocks + j (i < j), and itself in a shard of its own
        cells = F.when(F.col("own").isNull(), F.array(F.struct(whole.alias("cell"), F.lit(0).alias("side")))).otherwise(
            F.concat(
                F.array(F.struct((-F.col("own") - 2).alias("cell"), F.lit(0).alias("side"))),
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")),
                    lambda o: F.struct((F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own"))).cast("int").alias("cell"), (o < F.col("own")).cast("int").alias("side")),
                ),
            )
        )
        bands = bands.withColumn("c", F.explode(cells)).select("key", "c.cell", "c.side", "doc_id", "f0", "f1")
        shards = bands.repartition("key", "cell")
    else:
        shards = bands.select("key", whole.alias("cell"), F.lit(0).alias("side"), "doc_id", "f0", "f1").repartition("key")
    return shards.sortWithinPartitions("key", "cell").mapInArrow(lambda it: _shard_pairs(it, reach), "a long, b long").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(size, min_words)
    for batch in batches:
        sets = [shingler(t.as_py()) for t in batch.column("text")]
        offsets = np.concatenate(([0], np.cumsum([0 if s is None else len(s) for s in sets])))
        flat = np.concatenate([s for s in sets if s is not None] or [np.zeros(0, dtype=np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))], names=["doc_id", "shingles"])


def verified(documents: DataFrame, pairs: DataFrame, threshold: float, size: int, min_words: int) -> DataFrame:
    """``a, b, similarity`` of the pairs whose shingle sets reach the threshold exactly."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = documents.join(needed, "doc_id", "left_semi").mapInArrow(lambda it: _shingle_rows(it, size, min_words), "doc_id long, shingles array<long>")
    sets = staged(sets.dropDuplicates(["doc_id"]), "shingles")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("both"), (F.size("s") + F.size("t")).alias("sum"))
    return joined.where(F.col("both") >= threshold * (F.col("sum") - F.col("both"))).select("a", "b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))


def similar(documents: DataFrame, threshold: float = 0.8, size: int = 5, min_words: int = 20, **options) -> tuple[DataFrame, DataFrame]:
    """``(copies, links)``: ``doc_id, rep`` of every sketched document, where documents of equal
    shingle sets share a representative, and ``a, b, similarity`` between representatives."""
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    sketches = staged(spread(texts).mapInArrow(lambda it: _sketches(it, size, min_words), SKETCH), "sketches")
    reps = sketches.groupBy("same").agg(F.min("doc_id").alias("rep"))
    copies = staged(sketches.select("doc_id", "same").distinct().join(reps, "same").select("doc_id", "rep"), "copies")
    alone = sketches.join(copies.where("doc_id <> rep").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "f0", "f1", "keys")
    pairs = staged(candidate_pairs(alone, threshold, **options), "pairs").where("a < b")
    return copies, staged(verified(texts, pairs, threshold, size, min_words), "links")


def similar_pairs(documents: DataFrame, threshold: float, size: int, min_words: int = 20, class_rows: int = 5_000, **options) -> DataFrame:
    """``doc_id_a, doc_id_b`` of every pair at the threshold, copies included.

    The pairs of a class of copies are made in as many tasks as it has ``class_rows`` members; their
    number is quadratic by definition. ``duplicate_groups`` is the form that does not grow with them.
    """
    copies, links = similar(documents, threshold, size, min_words, **options)
    # only classes that have something to pair
    many = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / class_rows).alias("salts"))
    same = copies.join(many, "rep")
    x = same.select("rep", F.col("doc_id").alias("x"), F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"))
    y = same.select("rep", F.col("doc_id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    within = x.join(y, ["rep", "salt"]).where("x < y").select("x", "y")
    members = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    others = copies.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = links.select("a", "b").join(members, "a").join(others, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return within.union(across).distinct().select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))


def components(links: DataFrame) -> DataFrame:
    """``id, label``: every node of the links ``a, b`` with the smallest node it is connected to.

    Each round takes the least label of the neighbours and then that label's own label; every round
    is written to the shared folder, so lineage stays flat. Labels only fall, so the rounds end; their
    number grows with the logarithm of the longest chain, or with its length at worst.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    before = None
    while True:
        told = edges.join(labels, edges.b == labels.id).select(F.col("a").alias("id"), "label")
        least = labels.union(told).groupBy("id").agg(F.min("label").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        labels = staged(least.join(up, "label", "left").select("id", F.coalesce("top", "label").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first().s
        if now == before:
            return labels
        before = now


def duplicate_groups(documents: DataFrame, threshold: float = 0.8, size: int = 5, min_words: int = 20, **options) -> DataFrame:
    """``doc_id, class_id, links``: every document, its class, and how many documents it matches."""
    copies, links = similar(documents, threshold, size, min_words, **options)
    labels = components(links)
    count = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    both = links.select("a", "b").union(links.select("b", "a"))
    partners = both.join(count.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    classes = (
        copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .join(partners.withColumnRenamed("a", "rep"), "rep", "left")
        .join(count, "rep")
        .select("doc_id", F.coalesce("label", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    )
    return documents.select("doc_id").distinct().join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
