"""Tokens of the retrieval index as Column expressions; ASCII semantics throughout."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens start with a letter and go on with letters and apostrophes.
TOKEN = "[a-z][a-z']*"

#: Shortest token and shortest text (in bytes) that are indexed.
MIN_TOKEN, MIN_BYTES = 2, 50

# The stop words, removed before stemming.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have"
    " had what when where who which why how all each every both few more most other some such no nor not only own same"
    " so than too very can just should now you your we our us or if do did does about up out would could may might been"
    " also into over after before through between her him his she them their my me any there then these those am being"
    " here while during under again once"
).split()


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def raw_tokens(text: Column) -> Column:
    """All tokens of at least two letters, in order; none for null."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))
    return F.coalesce(F.filter(found, lambda t: F.length(t) >= MIN_TOKEN), F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Tokens without stop words, in order."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(STOP_WORDS))


def indexable(text: Column) -> Column:
    """Whether a text is long enough to be indexed."""
    return F.coalesce(F.octet_length(text) >= MIN_BYTES, F.lit(False))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")
