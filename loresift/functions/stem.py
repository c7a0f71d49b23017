"""Porter stems as generated SQL that both Spark and other engines run.

A word is paired with its shape: ``1`` for a vowel, ``0`` for a consonant, where ``y`` is a vowel
after a consonant. A stem's shape is a prefix of its word's shape, the measure is the number of
``10`` in it. Every step of the algorithm is one CASE over the suffix that matches first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

# Suffixes and replacements of steps 2 and 3, suffixes of step 4, longest first where
# one contains another.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_SHAPES = {ord(c): "1" if c in "aeiou" else "0" for c in "abcdefghijklmnopqrstuvwxz'"}
_CONSONANTS = "bcdfghjklmnpqrstvwxzY''"


def _shape(word: str, dialect: str) -> str:
    marked = f"regexp_replace({word}, '^y', 'Y')"
    if dialect == "spark":
        marked = f"regexp_replace({marked}, '([aeiouy])y', '$1Y')"
    else:
        marked = f"regexp_replace({marked}, '([aeiouy])y', '\\1Y', 'g')"
    plain = _CONSONANTS.replace("''", "'")
    quoted = "bcdfghjklmnpqrstvwxzY" + ("\\'" if dialect == "spark" else "''")
    return f"translate({marked}, 'aeiouy{quoted}', '{'1' * 6}{'0' * len(plain)}')"


def _front(column: str, cut: int) -> str:
    return f"substr({column}, 1, length(w) - {cut})" if cut else column


def _measure(shape: str) -> str:
    return f"((length({shape}) - length(replace({shape}, '10', ''))) / 2)"


def _rules(rules: list[tuple[str, str]], least: str) -> str:
    whens = " ".join(
        f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {_measure(_front('sh', len(suffix)))} > {least} THEN concat({_front('w', len(suffix))}, '{new}') ELSE w END" for suffix, new in rules
    )
    return f"CASE {whens} ELSE w END"


def _double(word: str, shape: str) -> str:
    return f"(length({word}) >= 2 AND substr({word}, length({word}), 1) = substr({word}, length({word}) - 1, 1) AND {shape} LIKE '%0')"


def _cvc(word: str, shape: str) -> str:
    return f"({shape} LIKE '%010' AND substr({word}, length({word}), 1) NOT IN ('w', 'x', 'y'))"


def _steps() -> list[tuple[str, str]]:
    """``(columns besides token, w and sh, new w)`` of each step; ``w`` is the word, ``sh`` its shape."""
    plural = f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_front('w', 2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_front('w', 1)} ELSE w END"
    past = (
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_measure(_front('sh', 3))} > 0 THEN {_front('w', 1)} ELSE w END"
        f" WHEN w LIKE '%ed' AND {_front('sh', 2)} LIKE '%1%' THEN concat('!', {_front('w', 2)})"
        f" WHEN w LIKE '%ing' AND {_front('sh', 3)} LIKE '%1%' THEN concat('!', {_front('w', 3)}) ELSE w END"
    )
    # '!' marks a word that lost its ending and is mended by the next step
    base = "substr(w, 2)"
    mend = (
        f"CASE WHEN w NOT LIKE '!%' THEN w WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN concat({base}, 'e')"
        f" WHEN {_double(base, 'sh')} THEN CASE WHEN substr(w, length(w), 1) IN ('l', 's', 'z') THEN {base} ELSE substr(w, 2, length(w) - 2) END"
        f" WHEN {_measure('sh')} = 1 AND {_cvc(base, 'sh')} THEN concat({base}, 'e') ELSE {base} END"
    )
    final_y = f"CASE WHEN w LIKE '%y' AND {_front('sh', 1)} LIKE '%1%' THEN concat({_front('w', 1)}, 'i') ELSE w END"
    drop = " ".join(
        f"WHEN w LIKE '%{s}'"
        + (f" AND substr(w, length(w) - 3, 1) IN ('s', 't')" if s == "ion" else "")
        + f" THEN CASE WHEN {_measure(_front('sh', len(s)))} > 1 THEN {_front('w', len(s))} ELSE w END"
        for s in STEP4
    )
    last_e = f"CASE WHEN w LIKE '%e' AND ({_measure('sh')} > 1 OR ({_measure('sh')} = 1 AND NOT {_cvc(_front('w', 1), _front('sh', 1))})) THEN {_front('w', 1)} ELSE w END"
    last_l = f"CASE WHEN w LIKE '%ll' AND {_measure('sh')} > 1 THEN {_front('w', 1)} ELSE w END"
    return [
        ("plural", plural), ("past", past), ("mend", mend), ("final_y", final_y), ("two", _rules(STEP2, "0")), ("three", _rules(STEP3, "0")),
        ("four", f"CASE {drop} ELSE w END"), ("last_e", last_e), ("last_l", last_l),
    ]


def stem_sql(source: str, dialect: str) -> str:
    """SQL for ``token, stem`` of the distinct tokens of ``source`` (a relation with ``token``)."""
    query = f"SELECT token, token AS w FROM {source} WHERE length(token) > 2"
    for _, expression in _steps():
        word = "replace(w, '!', '')"
        query = f"SELECT token, {expression} AS w FROM (SELECT token, w, {_shape(word, dialect)} AS sh FROM ({query}) AS a) AS b"
    return f"SELECT token, w AS stem FROM ({query}) AS s UNION ALL SELECT token, token AS stem FROM {source} WHERE length(token) <= 2"


def stems_by_sql(vocabulary: DataFrame) -> DataFrame:
    """``token, stem`` of a DataFrame of distinct tokens, by the generated expressions.

    Exact, but the nested CASEs exceed what the JVM compiles, so ``stems`` is the faster one.
    """
    return vocabulary.sparkSession.sql(stem_sql("{words}", "spark"), words=vocabulary.select("token"))


def stems(vocabulary: DataFrame) -> DataFrame:
    """``token, stem`` of a DataFrame of distinct tokens, in Arrow batches."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array([stem(t) for t in batch.column("token").to_pylist()], pa.string())], names=["token", "stem"])

    return vocabulary.select("token").mapInArrow(run, "token string, stem string")


def stem(word: str) -> str:
    """The stem of one word, by the rules above in plain Python."""
    if len(word) <= 2:
        return word

    def shape(w: str) -> str:
        if "y" not in w:
            return w.translate(_SHAPES)
        out = ""
        for c in w:
            out += "1" if c in "aeiou" or (c == "y" and out[-1:] == "0") else "0"
        return out

    def measure(w: str, cut: int = 0) -> int:
        return shape(w)[: len(w) - cut].count("10")

    def vowel(w: str) -> bool:
        return "1" in shape(w)

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "0"

    def cvc(w: str) -> bool:
        return shape(w).endswith("010") and w[-1] not in "wxy"

    def first(w: str, rules, least: int) -> str:
        for suffix, new in rules:
            if w.endswith(suffix) and (suffix != "ion" or w[:-3][-1:] in ("s", "t")):
                return w[: len(w) - len(suffix)] + new if measure(w, len(suffix)) > least else w
        return w

    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w, 3) > 0 else w
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending):
                if vowel(w[: -len(ending)]):
                    w = w[: -len(ending)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif double(w):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif measure(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = first(w, STEP2, 0)
    w = first(w, STEP3, 0)
    w = first(w, [(s, "") for s in STEP4], 1)
    full = measure(w)
    if w.endswith("e") and (full > 1 or (full == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and full > 1:
        w = w[:-1]
    return w
