"""Problem 6: lines that one site repeats in many of its documents.

Method: each source's documents become sequences of line identifiers; suffix arrays over them
(``suffix.common_prefixes``) give every block of consecutive lines that several documents share,
through common prefixes of neighbouring suffixes; blocks in at least ``min_documents`` documents of
the source are deleted. A block may be a single line, and of a longer block every tail repeats as
well, so the lines that open a block are the lines of all blocks.

Defined results: documents with null source or null or empty text repeat nothing and stay as they
are; a line counts once per document; repeated rows of one document are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from .suffix import common_prefixes, maximal_runs, repeated_places

#: White space as Python's str.split sees it, but for line breaks and blanks.
SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def comparable(text: Column) -> Column:
    """A text as its lines are compared, but for blanks around them: lower case, single blanks, digit runs
    as ``0``. Done for all lines at once, as nothing in it reaches over a line break."""
    blanks = F.translate(F.lower(text), SPACE, " " * len(SPACE))
    return F.regexp_replace(F.regexp_replace(blanks, "  +", " "), "[0-9]+", "0")


def line_sequences(documents: DataFrame, min_chars: int = 25) -> DataFrame:
    """``grp, doc, symbols``: per document its line identifiers, null for lines that never count."""

    def symbol(line: Column) -> Column:
        return F.when(F.length(line) >= min_chars, F.xxhash64(line))

    rows = documents.select("doc_id", "source_domain", "text").where(F.col("source_domain").isNotNull() & (F.length("text") > 0))
    lines = F.transform(F.split(comparable(F.col("text")), "\n"), lambda x: symbol(F.trim(x)))
    return spread(rows).select(F.xxhash64("source_domain").alias("grp"), F.col("doc_id").alias("doc"), lines.alias("symbols"))


def bounded_broadcast(small: DataFrame, row_bytes: int, limit_bytes: int = 16 << 20) -> DataFrame:
    """``small`` with a broadcast hint if its counted size stays under the limit, else as it is."""
    return F.broadcast(small) if small.count() * row_bytes <= limit_bytes else small


def repeated_blocks(documents: DataFrame, min_documents: int = 5, min_chars: int = 25, **options) -> tuple[DataFrame, DataFrame]:
    """``(places, blocks)``, both written once; see ``suffix`` for their columns."""
    sequences = staged(line_sequences(documents, min_chars), "lines")
    places = repeated_places(sequences, min_documents)
    return places, staged(common_prefixes(places, min_documents, **options), "blocks")


def repeated_lines(documents: DataFrame, min_documents: int = 5, min_chars: int = 25, **options) -> DataFrame:
    """``doc_id, line_no`` of every line of a repeated block."""
    places, blocks = repeated_blocks(documents, min_documents, min_chars, **options)
    opening = bounded_broadcast(blocks.where("length = 1").select("grp", F.col("first").alias("symbol")), 32)
    return places.join(opening, ["grp", "symbol"]).select(F.col("doc").alias("doc_id"), (F.col("at") + 1).alias("line_no")).distinct()


def without_repeated_lines(documents: DataFrame, min_documents: int = 5, min_chars: int = 25, **options) -> DataFrame:
    """``doc_id, text``: every document without its repeated lines; all documents come out."""
    drop = repeated_lines(documents, min_documents, min_chars, **options).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("no"))),
        lambda s: ~F.array_contains("drop", s["no"]),
    )
    joined = documents.select("doc_id", "text").join(drop, "doc_id", "left")
    clean = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"))
    return joined.select("doc_id", clean.alias("text"))


def maximal_blocks(documents: DataFrame, min_documents: int = 5, min_chars: int = 25, **options) -> DataFrame:
    """``grp, first, length, documents, occurrences, prefix``: repeated blocks of two lines and more that
    no longer repeated block contains wherever they occur."""
    _, blocks = repeated_blocks(documents, min_documents, min_chars, **options)
    return maximal_runs(blocks).select("grp", "first", "length", "documents", "occurrences", "prefix")
