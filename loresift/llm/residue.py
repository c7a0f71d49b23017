"""Problem 7: writes that hold template residue, filler, an error or a demand for scripts.

Method: labelled exemplars of residue are kept in an inverted index from terms to exemplars. The main
body of every write (problem 3) is cut into
passage windows: sentences, pairs of short sentences, and the whole body if it is short. For each
window the index yields the exemplars that share terms with it, and the TF-IDF containment says what
share of the window's weight they cover. Windows that are covered almost wholly mark the write.
Where nothing but headings remains of a page, its noscript text and all that it shows are looked at
too: a message that a host serves on most of its pages counts as boilerplate there.

Windows of which less than half of the terms are in the index weigh too little and are dropped where the
body is read, so the text is read once and only the other windows are kept, with the exemplar terms of
every write. Inverse document frequencies come from all writes. Terms outside the index weigh as much as a term
that occurs once: an article that merely mentions an error message holds enough of them around it.

Defined results: null html gives no case; an empty page without any text gives none; repeated
deliveries of a write give one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .main_text import boilerplate, each_main, parsed
from .residue_exemplars import EXEMPLARS, SLOT

_SLOTS = re.compile(r"\{\{[^{}\n]{1,60}\}\}|\[\[[^\[\]\n]{1,60}\]\]|\$\{[^{}\n]{1,60}\}|\{[A-Za-z][\w.\- ]{0,40}\}|<%=?[^%\n]{1,60}%>|%%[\w.\- ]{1,40}%%|@@[\w.\- ]{1,40}@@|__[A-Za-z][\w.\-]{0,40}?__|#[A-Za-z][\w.\-]{1,40}#|\[[^\[\]\n]{1,40} HERE\]")
_SLOT_SIGNS = re.compile(r"[{\[<%@#]|__")
_TERM = re.compile(f"{SLOT}|[\\u3040-\\u30ff\\u3400-\\u9fff]+|[^\\W\\d_]+")
_WIDE = re.compile("[\\u3040-\\u30ff\\u3400-\\u9fff]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Stands between the terms of a kept window, whose first says what kind it is.
BLANK = " "
WHOLE, PASSAGE = "body", "passage"
#: Terms of a body that is compared as a whole.
SHORT_BODY = 40
#: Neighbouring sentences below so many terms are also looked at as a pair.
SHORT_SENTENCE = 10


def terms(text: str) -> list[str]:
    """Lower-cased words without numbers; two-letter pieces of scripts without blanks; slots."""
    if _SLOT_SIGNS.search(text):
        text = _SLOTS.sub(f" {SLOT} ", text)
    found = _TERM.findall(text.lower())
    if text.isascii() or not _WIDE.search(text):
        return found
    result = []
    for m in found:
        if "\u3040" <= m[0] <= "\u9fff":
            result.extend(m[k : k + 2] for k in range(max(1, len(m) - 1)))
        else:
            result.append(m)
    return result


_TERMS = sorted({t for x in EXEMPLARS for t in terms(x)})
_NUMBERS = {t: k for k, t in enumerate(_TERMS)}


class ExemplarIndex:
    """The inverted index with weights."""

    def __init__(self, frequencies: dict[str, int], writes: int, exemplars: list[str] = EXEMPLARS):
        self.postings: dict[str, list[int]] = {}
        for number, text in enumerate(exemplars):
            for term in set(terms(text)):
                self.postings.setdefault(term, []).append(number)
        self.unknown = float(np.log(writes + 1) + 1)
        self.idf = {t: float(np.log((writes + 1) / (frequencies.get(t, 0) + 1)) + 1) for t in self.postings}

    def containment(self, window: list[str], exemplars: int) -> tuple[float, float]:
        """Share of the window's weight that its ``exemplars`` best exemplars cover, and that weight."""
        postings = self.postings
        if 2 * sum(t in postings for t in window) < len(window):  # the rest weighs at least as much
            return 0.0, 0.0
        counts = Counter(window)
        known = [t for t in counts if t in postings]
        weight = {t: counts[t] * self.idf.get(t, self.unknown) for t in counts}
        total = sum(weight.values())
        covered, left = 0.0, set(known)
        for _ in range(exemplars):
            gain: Counter[int] = Counter()
            for t in left:
                for number in self.postings[t]:
                    gain[number] += weight[t]
            if not gain:
                break
            best, value = min(gain.items(), key=lambda g: (-g[1], g[0]))
            covered += value
            left = {t for t in left if best not in self.postings[t]}
        return covered / total, covered

    def covers(self, window: str, threshold: float) -> bool:
        """Whether exemplars cover a window: three of them a whole body, one a passage."""
        kind, *found = window.split(BLANK)
        if kind == WHOLE:
            return self.containment(found, 3)[0] >= threshold
        share, covered = self.containment(found, 1)
        return share >= threshold and covered >= self.unknown / 2


def windows(lines: list[tuple[bool, str]]) -> tuple[list[str], set[int]]:
    """The windows of a text that may be residue, and the numbers of its exemplar terms; ``lines`` tells
    of each line whether it is a heading."""
    out, known, size = [], set(), 0
    for heading, line in lines:
        last: tuple[list[str], int] = ([], 0)
        for sentence in _SENTENCE.split(line):
            found = terms(sentence)
            size += len(found)
            numbers = [k for k in map(_NUMBERS.get, found) if k is not None]
            known.update(numbers)
            n = len(numbers)
            if heading:
                continue
            pair = 0 < len(last[0]) + len(found) and len(last[0]) < SHORT_SENTENCE and len(found) < SHORT_SENTENCE
            for window, part in ((found, n), (last[0] + found, last[1] + n)) if pair and last[0] else ((found, n),):
                if window and 2 * part >= len(window) and (len(window) >= 3 or SLOT in window):
                    out.append(BLANK.join((PASSAGE, *window)))
            last = (found, n)
    if size <= 2 * SHORT_BODY:
        whole = terms(" ".join(x for _, x in lines))
        if whole and len(whole) <= SHORT_BODY and 2 * sum(t in _NUMBERS for t in whole) >= len(whole):
            out.append(BLANK.join((WHOLE, *whole)))
    return out, known


def _read(key: str, blocks, spare) -> list[tuple]:
    """Windows and terms of a main body, and of what stands in its place if it has no article text."""
    lines = [(b.element in _HEADINGS, b.text) for b in blocks]
    parts = [lines]
    if all(heading for heading, _ in lines):
        parts += spare()
    found, known = [], set()
    for part in parts:
        more, numbers = windows(part)
        found += more
        known |= numbers
    return [(key, found, sorted(known))]


def _spare(page: dict):
    """The noscript text and all blocks of a page, when they are asked for."""
    return lambda: [[(False, x) for x in page["noscript"].split("\n")], [(e in _HEADINGS, t) for t, e in zip(page["texts"], page["elements"], strict=True)]]


def _mark(batches: Iterator[pa.RecordBatch], index: ExemplarIndex, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [any(index.covers(window, threshold) for window in found) for found in batch.column("windows").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id").filter(pa.array(hit, pa.bool_()))], names=["_id"])


def read_bodies(pages: DataFrame, **options) -> DataFrame:
    """``_id, windows, known`` of the main body of every write, written once."""
    table = parsed(pages)
    return staged(each_main(table, boilerplate(table, **options), _read, "_id string, windows array<string>, known array<int>", spare=_spare), "bodies")


def residue_index(bodies: DataFrame) -> ExemplarIndex:
    """The index, weighted by how many writes hold each exemplar term. As many rows as terms
    reach the driver."""
    counts = bodies.select(F.explode("known").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()
    return ExemplarIndex({_TERMS[r.number]: r.n for r in counts}, bodies.count())


def residue_writes(pages: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``_id`` of every write to exclude."""
    stored = read_bodies(pages, **options)
    index = pages.sparkSession.sparkContext.broadcast(residue_index(stored))
    return stored.where(F.size("windows") > 0).select("_id", "windows").mapInArrow(lambda it: _mark(it, index.value, threshold), "_id string").distinct()
