"""Problem 9: held-out passages that leaked into documents.

Method: one Aho-Corasick automaton over the normalised passages scans every normalised document
once. Any run of ``min_words`` shared words contains one of the passage's windows of half that
length taken at a fixed stride, so only those windows are patterns: the automaton stays small and
misses nothing. Where a pattern hits, the match is extended word by word in both directions, kept if
it reaches ``min_words``, and mapped to code point offsets of the original text.

Defined results: null or empty texts and passages match nothing; a passage shorter than
``min_words`` cannot leak; repeated rows of a document give the same rows once; passages that share
sentences are all reported. Passages are held in blocks of at most ``block_chars`` characters; a
larger set is matched block by block, each against all documents.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

SPANS = "doc_id long, item_id long, start int, end int, words int"


class _Letters(dict):
    """Maps every character that is no letter to a blank, for str.translate."""

    def __missing__(self, code: int) -> int:
        self[code] = code if unicodedata.category(chr(code))[0] == "L" else 32
        return self[code]


_LETTERS = _Letters()
_RUN = re.compile("[^ ]+")


def normalised(text: str) -> list[str]:
    """The words of a text: runs of letters, lower-cased."""
    return text.translate(_LETTERS).lower().split()


class Matcher:
    """The automaton over one block of passages."""

    def __init__(self, passages: list[tuple[int, str]], min_words: int):
        import ahocorasick

        self.min_words = min_words
        self.window = max(1, min_words // 2)
        self.words = {item: normalised(text) for item, text in passages}
        starts: dict[str, list[tuple[int, int]]] = {}
        for item, words in self.words.items():
            if len(words) < min_words:
                continue
            for at in range(0, len(words) - self.window + 1, min_words - self.window + 1):
                starts.setdefault(" " + " ".join(words[at : at + self.window]) + " ", []).append((item, at))
        self.automaton = ahocorasick.Automaton()
        for pattern, places in starts.items():
            self.automaton.add_word(pattern, (len(pattern), places))
        self.empty = not starts
        if starts:
            self.automaton.make_automaton()

    def spans(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Per leaked item the longest match: ``(start, end, words)`` in code points of ``text``."""
        if self.empty or not text:
            return {}
        own = normalised(text)
        line = " " + " ".join(own) + " "
        found: dict[int, tuple[int, int]] = {}
        for end, (length, places) in self.automaton.iter(line):
            word = line.count(" ", 0, end - length + 2) - 1
            for item, at in places:
                theirs = self.words[item]
                left = 0
                while left < min(word, at) and own[word - left - 1] == theirs[at - left - 1]:
                    left += 1
                right = self.window
                while word + right < len(own) and at + right < len(theirs) and own[word + right] == theirs[at + right]:
                    right += 1
                if left + right >= self.min_words and left + right > found.get(item, (0, 0))[1]:
                    found[item] = (word - left, left + right)
        if not found:
            return {}
        places = [m.span() for m in _RUN.finditer(text.translate(_LETTERS))]
        return {item: (places[first][0], places[first + count - 1][1], count) for item, (first, count) in found.items()}


#: The automaton of the block that this worker scanned for last: it is built once per worker, not per task.
_LAST: dict[str, Matcher] = {}


def _matcher(key: str, held, min_words: int) -> Matcher:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Matcher(held.value, min_words)
    return _LAST[key]


def _scan(batches: Iterator[pa.RecordBatch], key: str, held, min_words: int) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(key, held, min_words)
    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for item, (start, end, words) in matcher.spans(text.as_py()).items():
                out.append((doc, item, start, end, words))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "start", "end", "words"])


def leaked_spans(documents: DataFrame, passages: DataFrame, min_words: int = 12, block_chars: int = 32 << 20) -> DataFrame:
    """``doc_id, item_id, start, end, words``: the longest shared run of each leaked passage."""
    texts = spread(documents.select("doc_id", "text").where(F.length("text") > 0))
    items = passages.select("item_id", "text").where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first().chars
    blocks = max(1, -(-size // block_chars))
    result = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        held = documents.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in own.collect()])
        spans = texts.mapInArrow(lambda it, key=uuid.uuid4().hex, held=held: _scan(it, key, held, min_words), SPANS)
        result = spans if result is None else result.unionByName(spans)
    return result


def leaked(documents: DataFrame, passages: DataFrame, min_words: int = 12, **options) -> DataFrame:
    """``doc_id, item_id`` of every document and passage it contains in part."""
    return leaked_spans(documents, passages, min_words, **options).select("doc_id", "item_id").distinct()
