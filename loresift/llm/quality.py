"""Problem 2: per-document statistics that tell prose and readable titles from lists, tables and junk.

Method: gradient-boosted trees on document statistics. Labelling rules that abstain where they are
unsure mark documents as prose or structural junk; the trees are fitted to these weak labels of all
documents and see every statistic, also where the rules abstain; their probabilities are
calibrated on a holdout of texts in ten languages that was checked by hand. All statistics are computed over whole texts of
all documents, once; bins, trees and letter pairs come from sums over all of them.

Defined results: a null or empty text has zero statistics and null probability; so has a null or
blank title. Repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from . import ranks
from .boosting import SHARES, Block, Level, Trees, grow_together, histogram
from .quality_holdout import TEXTS, TITLES

# Very common words of the languages at hand.
COMMON = frozenset(
    "the of and to in a is that it for was on are as with his they at be this have from or had by but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them would like so these her him has more could go come did no over such our"
    " der die das und ist nicht ein eine einer einem zu den von mit sich des auf für im dem als auch es an er hat aus bei nach wird sind wie vor noch nur oder aber zum zur kaum bereits ohne wurde neben"
    " le la les de des et est un une du en que qui dans par pour sur pas au ce plus ne se son avec il sont fut près depuis après"
    " el los las y es por con una del para que en su se lo como más fue según tras cuando queda un al"
    " и в не на что с по это как из у за от то был к же он для через который где до уже рядом".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile("[.!?…。！？।؟:;\"'”’»」)]\\s*$")
_STOP = re.compile("[.!?…。！？।؟]")
_BULLET = re.compile(r"^\s*(?:[-–—•*·+▪‣○●◦>#]|\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_FIELD = re.compile(r"^[^.!?。]{1,60}?\s*(?:[:=|]|\t)\s*[^.!?。]{0,40}$")
_HEX = re.compile(r"\b(?:[0-9a-fA-F]{2}\b\s*){4,}|\b[0-9a-fA-F]{8,}\b")
_WIDE = re.compile("[\\u0e00-\\u0e7f\\u3040-\\u30ff\\u3400-\\u9fff]")

_VOWEL = re.compile("[aeiouy]")

TEXT_FEATURES = [
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_share", "prose_share", "bullet_lines", "field_lines",
    "separator_ratio", "distinct_words", "mean_line_length", "stops_per_100", "hex_share", "repeated_share", "vowelless_share", "upper_ratio",
]
TITLE_FEATURES = [
    "length", "letter_share", "digit_share", "symbol_share", "vowel_share", "longest_consonants", "longest_letters", "starts_upper", "mixed_runs",
    "latin1_share", "hex_like", "pair_rarity", "words",
]


class _Classes(dict):
    """Maps every character to the letter of its class, for str.translate: W letters of scripts
    without blanks, U upper case, L other letters, D digits, M combining marks, S symbols."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isspace():
            kind = c
        elif _WIDE.match(c):
            kind = "W"
        elif unicodedata.category(c)[0] == "M":
            kind = "M"
        elif c.isupper():
            kind = "U"
        elif c.isdigit():
            kind = "D"
        else:
            kind = "L" if c.isalnum() else "S"
        self[code] = kind
        return kind


_CLASSES = _Classes()


def _is_prose_line(line: str, classes: str, found: list[str]) -> bool:
    """A line that reads as sentences: long enough, stopped, and not a field or bullet; ``found`` are its lower-case words."""
    wide = classes.count("W")
    words = line.count(" ") + 1 + wide / 3
    if words < 5 or line.count("|") >= 2 or line.count(">") >= 2 or _BULLET.match(line):
        return False
    blanks = classes.count(" ")
    if len(line) - blanks - classes.count("S") - classes.count("D") < 0.55 * (len(line) - blanks):
        return False
    if not _STOP.search(line):
        return wide * 2 > len(line)
    if wide >= 6:
        return True
    cased = [w for w in found if w != w.upper()]
    # sentences of these languages hold function words; strings of nouns don't
    return 2 * len(cased) < words or sum(w in COMMON for w in cased) >= 0.09 * len(cased)


def text_statistics(text: str) -> list[float]:
    """The statistics named in ``TEXT_FEATURES``."""
    classes = text.translate(_CLASSES)
    pairs = [(x, c) for x, c in zip(text.split("\n"), classes.split("\n"), strict=False) if x and not x.isspace()]
    lines = [x for x, _ in pairs]
    count = {k: classes.count(k) for k in "WULDMS"}
    chars = max(1, sum(count.values()))
    split = [_WORD.findall(x) for x in lines]  # no word spans lines
    words = [w for found in split for w in found]
    split = [[w.lower() for w in found] for found in split]
    low = [w for found in split for w in found]
    n = max(1, len(words))
    seen = Counter(low)
    triples = Counter(zip(low, low[1:], low[2:], strict=False))
    total = max(1, sum(map(len, lines)))
    spaced = [w for w in seen if len(w) > 3 and w.isascii()]
    stops = len(_STOP.findall(text))
    return [
        float(len(words)),
        sum(map(len, words)) / n,
        count["S"] / chars,
        count["D"] / chars,
        sum(bool(_END.search(x[-8:])) for x in lines) / max(1, len(lines)),
        sum(c for w, c in seen.items() if w in COMMON) / n,
        sum(len(x) for (x, c), found in zip(pairs, split, strict=True) if _is_prose_line(x, c, found)) / total,
        sum(len(x) for x in lines if _BULLET.match(x)) / total,
        sum(len(x) for x in lines if len(x) <= 110 and _FIELD.match(x)) / total,
        sum(map(text.count, "|=>_/\\+#*~")) / chars,
        len(seen) / n,
        total / max(1, len(lines)),
        100 * stops / n if words else 0.0,
        sum(map(len, _HEX.findall(text))) / total if count["D"] > 0.1 * chars else 0.0,
        sum(c for c in triples.values() if c > 2) / max(1, len(low) - 2),
        sum(not _VOWEL.search(w) for w in spaced) / max(1, len(spaced)),
        count["U"] / chars,
    ]


def text_vote(s: dict[str, float]) -> int:
    """Weak label of a text: 1 junk, 0 prose, -1 unsure."""
    junk = [
        s["prose_share"] < 0.25,
        s["bullet_lines"] > 0.6,
        s["field_lines"] > 0.6,
        s["separator_ratio"] > 0.12,
        s["hex_share"] > 0.3 or s["digit_ratio"] > 0.35,
        s["repeated_share"] > 0.5 and s["distinct_words"] < 0.25,
        s["symbol_ratio"] > 0.4,
        s["stops_per_100"] < 0.5 and s["words"] > 20,
    ]
    prose = [s["prose_share"] > 0.7, s["bullet_lines"] < 0.2, s["field_lines"] < 0.25, s["separator_ratio"] < 0.05, s["repeated_share"] < 0.3, s["symbol_ratio"] < 0.25]
    if all(prose):
        return 0
    if sum(junk) >= 2 or s["prose_share"] < 0.2:
        return 1
    return -1


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter pairs of the titles that look like words. Only titles in Latin letters are held against
    them, so all pairs with another letter are one, named ""."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for title in batch.column("title").to_pylist():
            if title and title.strip() and re.match(r"[^\W\d_a-z]", title) and not re.search(r"[^\w\s'’()–,.&:-]", title):
                for w in _WORD.findall(title.lower()):
                    counts.update(a + b for a, b in zip(f"^{w}", f"{w}$", strict=True))
    latin: Counter[str] = Counter()
    for p, c in counts.items():
        latin[p if all("LATIN" in unicodedata.name(x, "") for x in p if x.isalpha()) else ""] += c
    yield pa.RecordBatch.from_arrays([pa.array(latin.keys(), pa.string()), pa.array(latin.values(), pa.int64())], names=["pair", "n"])


def pair_model(documents: DataFrame) -> dict[str, float]:
    """Log probability of letter pairs in the titles of all documents that look like words."""
    parts = documents.select("title").mapInArrow(_pair_counts, "pair string, n long")
    counts = {r.pair: r.n for r in parts.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values()) + 1000
    return {p: float(np.log((c + 0.5) / total)) for p, c in counts.items()} | {"": float(np.log(0.5 / total))}


def title_statistics(title: str, pairs: dict[str, float]) -> list[float]:
    """The statistics named in ``TITLE_FEATURES``."""
    t = title.strip()
    n = max(1, len(t))
    letters = [c for c in t if c.isalpha()]
    low = t.lower()
    run, longest, letter_run = 0, 0, 0
    for w in re.findall(r"[^\W\d_]+", low):
        letter_run = max(letter_run, len(w))
        run = 0
        for c in w:
            run = 0 if unicodedata.normalize("NFD", c)[0] in "aeiouy" or not c.isascii() and not "LATIN" in unicodedata.name(c, "") else run + 1
            longest = max(longest, run)
    known = [pairs.get(a + b, pairs[""]) for w in _WORD.findall(low) for a, b in zip(f"^{w}", f"{w}$", strict=True)]
    floor = pairs[""]
    latin = bool(letters) and all("LATIN" in unicodedata.name(c, "") for c in letters)
    return [
        float(len(t)),
        len(letters) / n,
        sum(c.isdigit() for c in t) / n,
        sum(not c.isalnum() and not c.isspace() and unicodedata.category(c)[0] != "M" for c in t) / n,
        sum(unicodedata.normalize("NFD", c)[0].lower() in "aeiouy" for c in letters) / max(1, len(letters)) if latin else 0.4,
        float(longest),
        float(letter_run),
        float(bool(t) and (t[0].isupper() or t[0].isalpha() and t[0].lower() == t[0].upper())),
        len(re.findall(r"[A-Za-z]\d|\d[A-Za-z]", t)) / n,
        sum(0x80 <= ord(c) <= 0xFF and not c.isalpha() or c in "ÃÂâ€œ™Ð" for c in t) / n,
        float(bool(re.fullmatch(r"(?:0x)?[0-9a-f:]{6,}", t)) or "%" in t and bool(re.search(r"%[0-9A-F]{2}", t))),
        (sum(known) / len(known) - floor) / max(1e-9, -floor) if known and latin else 0.3,
        float(len(t.split())),
    ]


def title_vote(s: dict[str, float]) -> int:
    """Weak label of a title: 1 unreadable, 0 readable, -1 unsure."""
    if s["hex_like"] or s["symbol_share"] > 0.45 or s["latin1_share"] > 0.25 or s["letter_share"] == 0:
        return 1
    if not s["starts_upper"] and s["words"] == 1 and s["length"] >= 6 and (s["longest_consonants"] >= 5 or s["mixed_runs"] > 0.15):
        return 1
    if s["starts_upper"] and s["symbol_share"] < 0.3 and s["longest_consonants"] < 6 and s["latin1_share"] < 0.1:
        return 0
    return -1


#: The two models: prefix of their columns, and statistics that they see.
MODELS = {"text": TEXT_FEATURES, "title": TITLE_FEATURES}
#: Rows in a partition of blocks, about. The statistics of no more rows than that are fitted on the driver, to the same trees.
PART_ROWS = 1 << 16
#: More partial sums than this are added up on the executors first.
PARTS = 32


def _columns(batch: pa.RecordBatch | pa.Table, model: str) -> np.ndarray:
    return np.stack([batch.column(f"{model}_{n}").to_numpy() for n in MODELS[model]], axis=1).reshape(-1, len(MODELS[model]))


def _statistics(batches: Iterator[pa.RecordBatch], pairs: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, titles = batch.column("text").to_pylist(), batch.column("title").to_pylist()
        known: dict[str, list[float]] = {}
        for t in titles:
            t = t if t and t.strip() else ""
            if t not in known:
                known[t] = title_statistics(t, pairs)
        rows = {"text": [text_statistics(t or "") for t in texts], "title": [known[t if t and t.strip() else ""] for t in titles]}
        some = {"text": [bool(t) for t in texts], "title": [bool(t and t.strip()) for t in titles]}
        arrays, names = [batch.column("doc_id")], ["doc_id"]
        for model, features in MODELS.items():
            vote = {"text": text_vote, "title": title_vote}[model]
            x = np.array(rows[model], dtype=float).reshape(len(rows[model]), len(features))
            votes = [vote(dict(zip(features, r, strict=True))) if s else None for r, s in zip(rows[model], some[model], strict=True)]
            arrays += [*(pa.array(x[:, k]) for k in range(x.shape[1])), pa.array(votes, pa.int8())]
            names += [*(f"{model}_{n}" for n in features), f"{model}_vote"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def statistics(documents: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """The statistics of texts and titles and their weak labels, ``text_vote`` and ``title_vote``: null
    where there is nothing to judge. Computed once, as the models need them several times."""
    schema = ", ".join(["doc_id long", *(c for m, names in MODELS.items() for c in (*(f"{m}_{n} double" for n in names), f"{m}_vote byte"))])
    known = documents.sparkSession.sparkContext.broadcast(pairs)
    return staged(spread(documents.select("doc_id", "text", "title")).mapInArrow(lambda it: _statistics(it, known.value), schema), "quality")


def _sure(batch: pa.RecordBatch | pa.Table, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the rows whose weak label is sure."""
    vote = batch.column(f"{model}_vote").fill_null(-1).to_numpy(zero_copy_only=False)
    return _columns(batch, model)[vote >= 0], vote[vote >= 0]


def _sum(arrays: Iterable[np.ndarray]) -> list[np.ndarray]:
    """One array, or none of none."""
    total = None
    for a in arrays:
        total = a if total is None else total + a
    return [] if total is None else [total]


def _added(parts: RDD) -> np.ndarray:
    """The sum of the arrays of all partitions."""
    return parts.treeReduce(np.add) if parts.getNumPartitions() > PARTS else _sum(parts.collect())[0]


def _summed(stats: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``count`` over all batches."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((count(b) for b in batches), np.zeros(size, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = stats.mapInArrow(part, "total binary").rdd.map(lambda r: np.frombuffer(r.total, dtype=np.int64))
    return _added(parts) if parts.getNumPartitions() else np.zeros(size, dtype=np.int64)


def _bin_edges(stats: DataFrame, rows: dict[str, int]) -> dict[str, list[np.ndarray]]:
    """Where bins end: quantiles over all rows with a sure label."""
    searches = {m: ranks.Search(len(MODELS[m]), ranks.quantile_ranks(n, SHARES)) for m, n in rows.items()}
    for done in range(ranks.PASSES):
        prefixes = {m: s.prefixes() for m, s in searches.items()}
        sizes = [256 * sum(map(len, p)) for p in prefixes.values()]
        counts = _summed(stats, lambda b: np.concatenate([ranks.count(_sure(b, m)[0], p, done) for m, p in prefixes.items()]), sum(sizes))  # noqa: B023
        for search, part in zip(searches.values(), np.split(counts, np.cumsum(sizes)[:-1]), strict=True):
            search.narrow(part)
    return {m: [np.unique(q) for q in ranks.quantiles(ranks.values(s.prefix), rows[m], SHARES)] for m, s in searches.items()}


def _blocks(batches: Iterator[pa.RecordBatch], models: dict[str, Trees]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrays, names = [], []
        for m, trees in models.items():
            x, y = _sure(batch, m)
            arrays += [pa.array([trees.binned(x).tobytes()], pa.binary()), pa.array([y.astype(np.int8).tobytes()], pa.binary())]
            names += [f"{m}_bins", f"{m}_labels"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _unpacked(row, models: list[str]) -> list[Block]:
    labels = [np.frombuffer(row[f"{m}_labels"], dtype=np.int8) for m in models]
    return [(np.frombuffer(row[f"{m}_bins"], dtype=np.uint8).reshape(len(MODELS[m]), len(y)), y) for m, y in zip(models, labels, strict=True)]


def _answer(blocks: list[Block], asked: list[Level | None]) -> np.ndarray:
    return np.concatenate([histogram(b, a).ravel() for b, a in zip(blocks, asked, strict=True) if a is not None])


def _fitted(stats: DataFrame) -> dict[str, Trees]:
    """Trees fitted to all rows with a sure label. Edges of bins and every level of every tree come from
    sums over all rows; both models share the passes."""
    names = list(MODELS)
    votes = stats.agg(F.count("*"), *(F.sum(F.when(F.col(f"{m}_vote") >= least, 1).otherwise(0)) for m in names for least in (0, 1))).first()
    rows, positive = ({m: votes[1 + 2 * k + least] or 0 for k, m in enumerate(names)} for least in (0, 1))
    models = {m: Trees().fit(np.zeros((2, len(MODELS[m]))), np.zeros(2)) for m in names if not rows[m]}
    names = [m for m in names if rows[m]]
    if votes[0] <= PART_ROWS:
        whole = stats.drop("doc_id").toArrow()
        return models | {m: Trees().fit(*_sure(whole, m)) for m in names}
    if not names:
        return models
    fresh = {m: Trees(edges=e) for m, e in _bin_edges(stats, {m: rows[m] for m in names}).items()}
    schema = ", ".join(f"{m}_bins binary, {m}_labels binary" for m in names)
    parts = -(-max(rows.values()) // PART_ROWS)
    blocks = staged(stats.mapInArrow(partial(_blocks, models=fresh), schema).coalesce(parts), "blocks").rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def sums(asked: list[Level | None]) -> list:
        flat, out = _added(blocks.mapPartitions(lambda part: _sum(_answer(_unpacked(r, names), asked) for r in part))), []
        for m, a in zip(names, asked, strict=True):
            shape = a.shape(len(MODELS[m])) if a else (0,)
            out.append(flat[: np.prod(shape)].reshape(shape))
            flat = flat[np.prod(shape) :]
        return out

    grow_together([fresh[m].growth(rows[m], positive[m]) for m in names], sums)
    blocks.unpersist()
    return models | fresh


def _models(stats: DataFrame, pairs: dict[str, float]) -> tuple[Trees, Trees]:
    """Text trees and title trees, calibrated."""
    fitted = _fitted(stats)
    holdout = {"text": [(text_statistics(t), y) for t, y in TEXTS], "title": [(title_statistics(t, pairs), y) for t, y in TITLES]}
    for m, known in holdout.items():
        fitted[m].calibrate(np.array([r for r, _ in known], dtype=float), np.array([y for _, y in known], dtype=float))
    return fitted["text"], fitted["title"]


def fit_models(documents: DataFrame) -> tuple[Trees, Trees, dict[str, float]]:
    """Text trees, title trees and letter pairs, from all documents."""
    pairs = pair_model(documents)
    return *_models(statistics(documents, pairs), pairs), pairs


def _score(batches: Iterator[pa.RecordBatch], models: tuple[Trees, Trees]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrays = [batch.column("doc_id"), *(batch.column(f"text_{n}") for n in TEXT_FEATURES)]
        for m, trees in zip(MODELS, models, strict=True):
            arrays.append(pa.array(trees.probability(_columns(batch, m)), mask=batch.column(f"{m}_vote").is_null().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *TEXT_FEATURES, "text_junk", "title_junk"])


def quality(documents: DataFrame) -> DataFrame:
    """``doc_id``, the text statistics, and the calibrated probabilities ``text_junk``, ``title_junk``."""
    pairs = pair_model(documents)
    stats = statistics(documents, pairs)
    models = documents.sparkSession.sparkContext.broadcast(_models(stats, pairs))
    schema = ", ".join(["doc_id long", *(f"{n} double" for n in TEXT_FEATURES), "text_junk double", "title_junk double"])
    return stats.mapInArrow(lambda it: _score(it, models.value), schema)


def junk_fields(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, field`` for every text or title that is more likely junk than not."""
    scored = quality(documents)
    fields = F.filter(
        F.array(F.when(F.col("text_junk") > threshold, F.lit("text")), F.when(F.col("title_junk") > threshold, F.lit("title"))), lambda f: f.isNotNull()
    )
    return scored.select("doc_id", F.explode(fields).alias("field")).distinct()
