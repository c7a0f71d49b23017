"""The inverted index as three DataFrames: documents, postings, vocabulary."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import MIN_TOKEN, STOP_WORDS, indexable, raw_tokens
from ..session import spread, staged

#: Stems that a Python worker remembers.
REMEMBERED = 1_000_000
_TOKEN = re.compile("[A-Za-z][A-Za-z']*")
_STOP = frozenset(STOP_WORDS)


@dataclass
class Index:
    """``docs(doc_id, url, title, doc_len)``, ``postings(term, doc_id, tf)``, ``terms(term, df)``, and the
    one row ``totals(size, documents, postings, vocabulary)``. What a search needs besides postings and
    documents is stored with them and not counted again."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame | None = None
    totals: DataFrame | None = None

    def vocabulary(self) -> DataFrame:
        """``term, df``."""
        return _document_counts(self.postings) if self.terms is None else self.terms

    def statistics(self) -> DataFrame:
        """One row: ``size`` is N of the idf, the greatest document id plus one, holes included."""
        if self.totals is not None:
            return self.totals
        sizes = self.docs.agg((F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).alias("size"), F.count(F.lit(1)).alias("documents"))
        counts = self.vocabulary().agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.count(F.lit(1)).alias("vocabulary"))
        return sizes.crossJoin(F.broadcast(counts))  # one row each

    def size(self) -> int:
        """N of the idf, read once."""
        if "_size" not in self.__dict__:
            self._size = self.statistics().first()["size"]
        return self._size

    def stored(self, write) -> Index:
        """The index with every part written by ``write(frame, name)``; postings and vocabulary are sorted by
        term within range partitions, so that term filters skip files."""
        postings = write(clustered(self.postings), "postings")
        terms = write(_document_counts(postings).sort("term"), "terms")
        part = Index(write(self.docs, "docs"), postings, terms)
        return Index(part.docs, postings, terms, write(part.statistics(), "totals"))

    def save(self, path: str) -> None:
        """As parquet folders under ``path``."""

        def write(frame: DataFrame, name: str) -> DataFrame:
            frame.write.mode("overwrite").parquet(f"{path}/{name}")
            return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/{name}")

        self.stored(write)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "terms", "totals")))


def _document_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("df"))


def indexed(documents: DataFrame) -> DataFrame:
    """The documents that are indexed, with null urls and titles as empty strings."""
    return documents.where(indexable(F.col("text"))).select("doc_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "text")


class Stemmer(dict):
    """Stems of the tokens seen so far."""

    def __missing__(self, token: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = value = stem(token)
        return value


def tokens_of(text: str) -> list[str]:
    """The tokens of one text without stop words; what ``functions.text.tokenize`` gives."""
    return [t for t in map(str.lower, _TOKEN.findall(text)) if len(t) >= MIN_TOKEN and t not in _STOP]


def token_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, token, n`` of the unstemmed tokens."""
    return _counted(documents, lambda t: t, "token").select("doc_id", F.inline(F.arrays_zip(F.col("token"), F.col("n"))).alias("token", "n"))


def _counted(documents: DataFrame, form, name: str) -> DataFrame:
    """Per document its length and the counts of its terms, in the same row: no shuffle is needed."""

    def run(batches):
        for batch in batches:
            lengths, terms, counts, offsets = [], [], [], [0]
            for text in batch.column("text"):
                tokens = tokens_of(text.as_py())
                found = Counter(map(form, tokens))
                lengths.append(len(tokens))
                terms.extend(found)
                counts.extend(found.values())
                offsets.append(len(terms))
            offset = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("url"), batch.column("title"), pa.array(lengths, pa.int32())]
                + [pa.ListArray.from_arrays(offset, pa.array(terms, pa.string())), pa.ListArray.from_arrays(offset, pa.array(counts, pa.int32()))],
                names=["doc_id", "url", "title", "doc_len", name, "n"],
            )

    return spread(indexed(documents).select("doc_id", "url", "title", "text")).mapInArrow(run, f"doc_id long, url string, title string, doc_len int, {name} array<string>, n array<int>")


def build_index(documents: DataFrame) -> Index:
    """Index ``documents(doc_id, url, title, text)``; texts below 50 bytes are left out.

    One map-only pass tokenises, stems and counts; it is written once, documents and postings are
    two views of its columns.
    """
    packed = staged(_counted(documents, Stemmer().__getitem__, "term"), "index")
    postings = packed.select("doc_id", F.inline(F.arrays_zip(F.col("term"), F.col("n"))).alias("term", "tf")).select("term", "doc_id", "tf")
    return Index(packed.select("doc_id", "url", "title", "doc_len"), postings)


def clustered(postings: DataFrame) -> DataFrame:
    """Postings in order of their terms, so that a filter on terms skips row groups."""
    return postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def term_frequencies(documents: DataFrame) -> DataFrame:
    """``term, frequency``: how often each stem occurs. A task sums its own documents first."""

    def run(batches):
        stems, counts = Stemmer(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(tokens_of(text.as_py()))
            if len(counts) > REMEMBERED:
                yield _term_batch(counts, stems)
                counts = Counter()
        yield _term_batch(counts, stems)

    partial = spread(indexed(documents).select("text")).mapInArrow(run, "term string, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("frequency"))


def _term_batch(counts: Counter, stems: Stemmer) -> pa.RecordBatch:
    merged: Counter[str] = Counter()
    for token, n in counts.items():
        merged[stems[token]] += n
    return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.int64())], names=["term", "n"])


def zipf(frequencies: DataFrame, limit: int = 10_000) -> DataFrame:
    """``rank, frequency, term, theory`` of the most frequent terms; ties in order of the term.

    The cut comes before the ranking, so only ``limit`` rows are ranked in one place.
    """
    top = frequencies.orderBy(F.desc("frequency"), "term").limit(limit)
    order = Window.orderBy(F.desc("frequency"), "term")
    rank = F.row_number().over(order)
    return top.select(rank.alias("rank"), "frequency", "term").withColumn("theory", F.first("frequency").over(Window.orderBy("rank")) / F.col("rank"))


def build_statistics(documents: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row of counters and averages of an index build."""

    def run(batches):
        for batch in batches:
            found = [tokens_of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"tokens": pa.array(map(len, found), pa.int64()), "chars": pa.array((sum(map(len, f)) for f in found), pa.int64()), "bytes": batch.column("bytes")})

    docs = spread(indexed(documents).select("text", F.octet_length("text").cast("long").alias("bytes"))).mapInArrow(run, "tokens long, chars long, bytes long")
    base = docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("token_chars"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("text_bytes"),
    )
    terms = frequencies.agg(F.count(F.lit(1)).alias("vocabulary"), F.coalesce(F.sum(F.length("term") * F.col("frequency")), F.lit(0)).alias("stem_chars"))
    per = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return base.crossJoin(F.broadcast(terms)).select(  # one row each
        "documents", "tokens", "token_chars", "stem_chars", "text_bytes", "vocabulary",
        per("tokens", "documents").alias("tokens_per_document"),
        per("token_chars", "tokens").alias("mean_token_length"),
        per("stem_chars", "tokens").alias("mean_stem_length"),
        F.when(F.col("token_chars") > 0, F.round(100 * (F.col("token_chars") - F.col("stem_chars")) / F.col("token_chars"), 6)).otherwise(F.lit(0.0)).alias("reduction_percent"),
    )


def raw_token_rows(documents: DataFrame) -> DataFrame:
    """``doc_id, pos, token``: every token of every indexed text with its position."""
    return indexed(documents).select("doc_id", F.posexplode(raw_tokens(F.col("text"))).alias("pos", "token"))
