"""Problem 10: sentence boundaries across languages and scripts.

Method: semi-Markov dynamic programming. Within a line, every place where a sentence might end is a
candidate. The best cut of the line is the sequence of whole spans with the greatest total score,
where a span is scored jointly by its length, its opening words, its closing words, the candidates
it passes over, and whether it holds whole quotations and brackets.

A quotation or bracket with words before it in its sentence, or with the sentence going on behind it,
belongs to that sentence, whatever it holds: a span loses for each of its ends that lies inside one. A
quotation that makes sentences of its own is cut like other text. Marks without a partner in their line
say nothing.

Defined results: null and empty texts have no sentences; a line break always ends a sentence; white
space around a line belongs to none; a blank ends a sentence in Thai.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread

ROWS = "doc_id long, sentence_no int, start_pos int, end_pos int"

# Abbreviations of the languages at hand, lower case, without the last period.
#: They never end a sentence, because a name, number or noun must follow.
LEADING = frozenset(
    "mr mrs ms dr prof gen col sgt capt lt cmdr st hon rev gov sen rep vs no nos nr vol vols p pp fig figs ed eds approx ca cf sec ch art"
    " hr fr dipl ing bzgl evtl ggf inkl exkl abb s str"
    " m mm mme mlle mgr me"
    " sr sra srta dra d dña núm pág págs"
    " им ул д стр рис тов гр проф акад см"
    " z b d h u a v i e g ej".split()
)
#: They end a sentence only if what follows looks like the opening of one.
EITHER = frozenset("jr sr inc ltd co corp bros etc usw u.s a.m p.m al esp bd jh г гг др пр т.п т.д".split())
#: Month names that follow a day number and a period.
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember"
    " jan feb mär apr jun jul aug sep sept okt nov dez".split()
)

_STOPS = ".!?…。！？｡．؟۔।॥։።"
_WIDE = "。！？｡"
_CLOSERS = "\"'”’»)]）】」』›〉》“"
_PAIRS = {"«": "»", "“": "”", "„": "“”", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》"}
_ENDING = {c for closing in _PAIRS.values() for c in closing}
#: Letters with which a sentence goes on after a quotation, in scripts without case.
_PARTICLES = "とっ的はがをにのもや"
_CANDIDATE = re.compile(f"[{re.escape(_STOPS)}]+[{re.escape(_CLOSERS)}]*(?:[ \\u00a0\\u202f]+[»”])*")
_BEFORE = re.compile(r"[^\s\"'“”„«»()\[\]（）「」]+$")
_FIRST = re.compile(r"[^\s]+")
_THAI = re.compile("[\\u0e00-\\u0e7f]")
_BULLET = re.compile(r"[\s\-–—•*·+]*(?:\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]+)?\s*$")

class _Line:
    """Candidates of one line with what their scores need."""

    def __init__(self, line: str):
        self.line = line
        self.thai = len(_THAI.findall(line)) * 2 > sum(c.isalpha() for c in line)
        ends = [(m.start(), m.end()) for m in _CANDIDATE.finditer(line)]
        places = [(stop, end) for stop, end in ends if self._open_after(stop, end)]
        if self.thai:
            places += [(m.start(), m.start()) for m in re.finditer(r"\s+", line)]
        places = sorted({end: (stop, end) for stop, end in places if end < len(line)}.values(), key=lambda p: p[1])
        self.cuts = [(0, 0), *places, (len(line), len(line))]
        self.weight = [0.0, *(self._weight(stop, end) for stop, end in places), 0.0]
        self.inside = self._insides()

    def _open_after(self, stop: int, end: int) -> bool:
        """A boundary needs white space after it, unless the script writes none."""
        line = self.line
        if end >= len(line) or line[end].isspace():
            return True
        return any(c in _WIDE for c in line[stop:end]) or (line[stop] in "！？" or _wide(line[end]) and line[stop] in "!?…")

    def _weight(self, stop: int, end: int) -> float:
        """Log odds that a sentence ends here, from its closing and the next opening words."""
        line = self.line
        if self.thai and not line[stop : end].strip():
            return 8.0
        marks = line[stop:end]
        rest = line[end:].lstrip()
        if not rest:
            return 4.0
        closed = any(c in _CLOSERS for c in marks)
        opening = 0.0
        lead = next((c for c in rest if c.isalnum() or c in "\"'“„«‘「『¿¡(—–-,，、;；:："), rest[0])
        if lead in ",，、;；:：":
            return -8.0
        if lead in "—–-":
            opening = -1.0 if closed else 1.0
            after = next((c for c in rest if c.isalpha()), "")
            opening += -6.0 if after.islower() else 1.0
        elif lead.islower():
            opening = -7.0
        elif lead.isupper() or lead.istitle():
            opening = 2.0
        elif lead in "\"'“„«‘「『¿¡(":
            opening = 1.5
            after = next((c for c in rest if c.isalnum()), "")
            opening += -3.0 if after.islower() and lead not in "(" else 0.0
        elif lead.isdigit():
            opening = 0.5
        elif closed and line[end : end + 1] in tuple(_PARTICLES):
            opening = -8.0
        else:
            opening = 1.0
        if any(c in marks for c in "!?！？؟。｡।॥։።۔"):
            return 3.0 + opening
        if "…" in marks or ".." in marks:
            return 1.0 + opening
        return opening + self._period(stop, rest, closed)

    def _period(self, stop: int, rest: str, closed: bool) -> float:
        """What the word before a single period says."""
        found = _BEFORE.search(self.line[:stop])
        word = found.group(0) if found else ""
        low = word.lower()
        tail = low.rsplit(".", 1)[-1]
        follow = _FIRST.match(rest)
        nxt = follow.group(0).strip("\"'“”„«».,;:!?").lower() if follow else ""
        if closed:
            return 2.5
        if low in EITHER or tail == "" and low.rstrip(".") in EITHER:
            return -0.5 if low not in ("г", "гг") else -4.0
        if low in LEADING or tail in LEADING and "." in low:
            return -9.0
        if len(tail) == 1 and tail.isalpha() and _cased(tail):
            return -7.0
        if word.isdigit() and (len(word) <= 2 and nxt in MONTHS):
            return -9.0
        if _BULLET.fullmatch(self.line[: stop + 1]) and word:
            return -9.0
        return 2.5

    def _pairs(self) -> list[tuple[int, int]]:
        """Places of the opening and closing marks of quotations and brackets."""
        found, stack, straight = [], [], -1
        for at, c in enumerate(self.line):
            if c == '"':
                if straight >= 0:
                    found.append((straight, at))
                straight = -1 if straight >= 0 else at
            elif c in _ENDING and (top := next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][1]), -1)) >= 0:
                found.append((stack[top][0], at))
                del stack[top:]
            elif c in _PAIRS:
                stack.append((at, _PAIRS[c]))
        return found

    def _belongs(self, start: int, end: int) -> bool:
        """Whether what stands between two marks is part of a sentence around it."""
        line = self.line
        before = line[:start].rstrip()
        if before and before[-1] not in _STOPS + _CLOSERS and not _BULLET.fullmatch(before):
            return True
        within = line[start + 1 : end].rstrip()
        if not within or within[-1] not in _STOPS + _CLOSERS:
            return True
        after = line[end + 1 :].lstrip()
        return bool(after) and (after[0].islower() or after[0] in ",;:—–-，、；：" + _PARTICLES)

    def _insides(self) -> list[int]:
        """Per cut the number of quotations and brackets of a sentence that it lies in."""
        result = [0] * len(self.cuts)
        ends = [end for _, end in self.cuts]
        for start, end in self._pairs():
            first, last = bisect_right(ends, start), bisect_right(ends, end)
            if first < last and self._belongs(start, end):
                for k in range(first, last):
                    result[k] += 1
        return result

    def best(self) -> list[int]:
        """Ends of the best spans. A span may pass over any number of candidates: starts are tried
        from the nearest on until no farther one can reach the score at hand, as the passed weights
        and the length only grow."""
        n = len(self.cuts)
        passed = [0.0]
        for w in self.weight[1:]:
            passed.append(passed[-1] + max(0.0, w))
        score, back = [0.0] + [float("-inf")] * (n - 1), [0] * n
        most = [0.0]  # the greatest score up to each cut
        for j in range(1, n):
            for i in range(j - 1, -1, -1):
                size = self._size(i, j)
                if most[i] + self.weight[j] - (passed[j - 1] - passed[i]) - max(0.0, (size - 600) / 300) < score[j]:
                    break
                gain = score[i] + self._span(i, j, passed)
                if gain >= score[j]:
                    score[j], back[j] = gain, i
            most.append(max(most[-1], score[j]))
        ends, j = [], n - 1
        while j:
            ends.append(self.cuts[j][1])
            j = back[j]
        return ends[::-1]

    def _size(self, i: int, j: int) -> int:
        return len(self.line[self.cuts[i][1] : self.cuts[j][1]].strip())

    def _span(self, i: int, j: int, passed: list[float]) -> float:
        value = self.weight[j]
        value -= passed[j - 1] - passed[i]  # candidates inside that would have ended a sentence
        value -= 9.0 * (self.inside[i] + self.inside[j])  # quotations and brackets that it holds in part
        size = self._size(i, j)
        if not any(c.isalnum() for c in self.line[self.cuts[i][1] : self.cuts[j][1]]):
            value -= 6.0
        elif size < 4:
            value -= 2.0
        elif size > 600:
            value -= (size - 600) / 300
        return value


def _wide(c: str) -> bool:
    return unicodedata.east_asian_width(c) in "WF"


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def spans(text: str | None) -> list[tuple[int, int]]:
    """Code point spans of the sentences of a text."""
    result, base = [], 0
    for line in (text or "").split("\n"):
        body = line.strip()
        if body:
            start = base + len(line) - len(line.lstrip())
            at = 0
            for end in _Line(body).best():
                lead = len(body[at:end]) - len(body[at:end].lstrip())
                if end > at + lead:
                    result.append((start + at + lead, start + at + len(body[at:end].rstrip())))
                at = end
        base += len(line) + 1
    return result


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, numbers, starts, ends = [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for number, (start, end) in enumerate(spans(text.as_py())):
                docs.append(doc)
                numbers.append(number)
                starts.append(start)
                ends.append(end)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(x, pa.int32()) for x in (numbers, starts, ends))], names=["doc_id", "sentence_no", "start_pos", "end_pos"])


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, sentence_no, start_pos, end_pos`` of every sentence of every document."""
    return spread(documents.select("doc_id", "text").where("text <> ''")).mapInArrow(_split, ROWS)
