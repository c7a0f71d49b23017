"""Text, title and links of html pages."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements and classes that are no text of the page.
DROPPED = frozenset("script style noscript nav footer header".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE_CLASSES = frozenset(
    "global-navigation fandom-community-header page-header__actions page-side-tools page__right-rail notifications-placeholder"
    " wiki-sidebar WikiaBar wds-global-footer wiki-page-header page-footer global-footer".split()
)
BOILERPLATE_PARTS = {"id": ("onetrust", "cookie"), "class": ("cookie",)}

# Signs of a challenge instead of a page.
CAPTCHA = ["captcha", "please verify you are a human", "verify you are human", "g-recaptcha", "hcaptcha"]
CHALLENGE = ["cf-challenge", "challenge-platform", "challenges.cloudflare.com", "cf-ray", "ray id:", "attention required!"]
INTERSTITIAL = [
    "just a moment",
    "challenge-platform",
    "cf-chl",
    "attention required!",
    "checking if the site connection is secure",
    "please wait while we check your browser",
]


_PIECE = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(?P<raw>script|style)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)|<(/?)([a-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*|[^>]*)>|<[!?/][^>]*>""", re.I | re.S
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def _dropped(tag: str, rest: str) -> bool:
    """Whether an element is no text of the page."""
    if tag in DROPPED:
        return True
    if "=" in rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            value, name = "".join(values), name.lower()
            if name == "class" and not BOILERPLATE_CLASSES.isdisjoint(value.split()):
                return True
            if any(p in value for p in BOILERPLATE_PARTS.get(name, ())):
                return True
    return False


def clean(page: str | None) -> tuple[str, str]:
    """``(title, text)`` of a page: title element, else first heading; all strings joined by blanks.

    One pass over the tags. An end tag closes everything opened since its element; one without an open
    element is ignored."""
    if not page:
        return "", ""
    open_: list[tuple[str, bool]] = []
    pieces: list[str] = []
    titles: dict[str, list[str]] = {}
    current: str | None = None
    hidden = at = 0

    def text(end: int) -> None:
        if end > at and not hidden:
            pieces.append(page[at:end])
            if current:
                titles[current].append(page[at:end])

    for m in _PIECE.finditer(page):
        text(m.start())
        at = m.end()
        _, close, tag, rest = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if not close:
            if tag in VOID:
                continue
            hide = _dropped(tag, rest)
            if not rest.endswith("/"):
                open_.append((tag, hide))
                hidden += hide
                if tag in ("title", "h1") and not hidden and tag not in titles:
                    titles[tag], current = [], tag
            continue
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == tag:
                hidden -= sum(h for _, h in open_[k:])
                del open_[k:]
                break
        if tag == current:
            current = None
    text(len(page))
    title = entities.unescape("".join(titles.get("title", []))).strip() or entities.unescape("".join(titles.get("h1", []))).strip()
    return title, re.sub(r"\s+", " ", entities.unescape(" ".join(pieces))).strip()


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def clean_html(pages: pd.Series) -> pd.DataFrame:
    """``struct(title, text)`` of html; empty strings for null."""
    return pd.DataFrame([clean(p) for p in pages], columns=["title", "text"])


def informative(title: Column, text: Column) -> Column:
    """At least 350 characters and 60 words of three letters, of which 12 % differ, and a title."""
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z]{3,}"), F.lit(0))
    n = F.size(words)
    varied = F.size(F.array_distinct(words)) >= 0.12 * n
    # str.strip() also takes other white space than blanks
    bare = F.regexp_replace(title, r"^\s+|\s+$", "")
    return F.coalesce((F.length(text) >= 350) & (n >= 60) & varied & (F.length(bare) >= 3), F.lit(False))


def _any(low: Column, signs: list[str]) -> Column:
    found = F.lit(False)
    for sign in signs:
        found = found | low.contains(sign)
    return found


def has_captcha(page: Column, status: Column) -> Column:
    """Whether a response is a captcha: one kind of sign for refusing statuses, else both."""
    low = F.lower(page)
    human, challenge = _any(low, CAPTCHA), _any(low, CHALLENGE)
    return F.coalesce(F.when(status.isin(403, 429, 503), human | challenge).otherwise(human & challenge), F.lit(False))


def is_challenge(page: Column) -> Column:
    return F.coalesce(_any(F.lower(page), INTERSTITIAL), F.lit(False))
