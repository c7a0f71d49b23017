"""Links of pages and the breadth-first frontier over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain, is_content, is_valid, joined, let, normalize_crawl, normalized, parts, unescaped
from ..session import staged

#: The address of an anchor, in either quotation marks.
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']"""
_NEXT = r"""(?is)<a\s[^>]*class\s*=\s*["'][^"']*\bmw-nextlink\b[^>]*>"""
_LINK = r"(?is)<a\s[^>]*>.*?</a>"
#: Tags that open and close the elements that list articles, and the anchors in them.
_TAGS = r"(?is)<(?:/?(?:div|ul)(?:\s[^>]*)?|a\s[^>]*)>"
_MODERN = r"""(?is)^<div\s[^>]*class\s*=\s*["'][^"']*\bcategory-page__members\b"""
_LISTED = r"""(?is)^<(?:div|ul)\s[^>]*class\s*=\s*["'](?:[^"']*\s)?mw-category(?:-group)?[\s"']"""


def _step(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a computed column that later filters see as it is: the optimizer moves no
    filter below a generator, so the value is computed once and not again in every predicate."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _links(found: DataFrame) -> DataFrame:
    """``url, link`` from ``url, href``; each url is taken apart once."""
    full = _step(found, "pieces", parts(absolute(F.col("href"), F.col("url"))))
    return _step(full, "link", normalized(F.col("pieces"))).select("url", "link")


def absolute(href: Column, base: Column) -> Column:
    """``/x`` on the base's host (over https), ``http...`` and other schemes as they are, else the
    reference resolved against the base."""
    relative = let(parts(base), lambda b: let(parts(href), lambda h: joined(b, h)))
    return (
        F.when(href.startswith("/"), F.concat(F.lit("https://"), domain(base), href))
        .when(href.startswith("http") | href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .otherwise(relative)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``url, href``: every anchor's address, trimmed, without empty, fragment and script ones."""
    found = pages.where(F.col("html").isNotNull()).select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)))).alias("href"))
    return _usable(found)


def _usable(found: DataFrame) -> DataFrame:
    plain = _step(found.select("url", F.col("href").alias("raw")), "href", F.trim(unescaped(F.col("raw")))).select("url", "href")
    return plain.where((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.col("href").startswith("javascript:"))


def extract_links(pages: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """``url, link``: distinct normalised links to content on valid hosts."""
    return _links(page_links(pages)).where((F.col("link") != "") & is_valid(F.col("link"), allowed) & is_content(F.col("link"))).distinct()


def category_links(pages: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """``url, link``: links to category pages."""
    href = F.col("href")
    kept = page_links(pages).where(href.startswith("/wiki/Category:") | (href.contains("wiki/Category:") & href.startswith("http")))
    return _links(kept).where(is_valid(F.col("link"), allowed)).distinct()


def _inside(tags: Column, opening: str, once: bool) -> Column:
    """The anchors between an element whose tag matches ``opening`` and its end: nested elements of the
    same kind are counted. With ``once`` only the first such element counts."""

    def step(state: Column, tag: Column) -> Column:
        kind = F.lower(F.regexp_extract(tag, "^</?([A-Za-z]+)", 1))
        held, depth, out = state["kind"], state["depth"], state["out"]

        def move(depth: Column, kind: Column, out: Column) -> Column:
            return F.struct(depth.alias("depth"), kind.alias("kind"), out.alias("out"))

        closed = F.lit(-1 if once else 0)
        return (
            F.when(kind == "a", F.when(depth > 0, move(depth, held, F.concat(out, F.array(tag)))).otherwise(state))
            .when((depth == 0) & tag.rlike(opening), move(F.lit(1), kind, out))
            .when((depth > 0) & (kind == held), move(F.when(~tag.startswith("</"), depth + 1).when(depth == 1, closed).otherwise(depth - 1), held, out))
            .otherwise(state)
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kind"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(tags, start, step)["out"]


def article_links(pages: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """``url, link``: links of a category page to articles, whose wiki path holds no colon. Only what
    stands in the page's list of members counts; older pages have several lists and relative links."""
    rows = pages.where(F.col("html").contains("categor")).select("url", F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)).alias("tags"))
    modern = F.exists("tags", lambda t: t.rlike(_MODERN))
    listed = _step(rows, "modern", modern)
    anchors = _step(listed, "anchors", F.when(F.col("modern"), _inside(F.col("tags"), _MODERN, True)).otherwise(_inside(F.col("tags"), _LISTED, False)))
    found = anchors.select("url", "modern", F.explode("anchors").alias("tag"))
    hrefs = found.select("url", "modern", F.trim(unescaped(F.regexp_extract("tag", ANCHOR, 1))).alias("href"))
    href = F.col("href")
    path = F.when(href.startswith("/wiki/"), F.substr(href, F.lit(7))).when(F.col("modern") & href.startswith("http") & href.contains("/wiki/"), F.split_part(href, F.lit("/wiki/"), F.lit(2)))
    kept = hrefs.where(F.coalesce(path, F.lit("")) != "").where(~path.contains(":"))
    return _links(kept.select("url", "href")).where(is_valid(F.col("link"), allowed)).distinct()


def next_page(page: Column, base: Column) -> Column:
    """The link to the next page of a listing, or null."""
    text = lambda a: F.regexp_replace(a, "<[^>]*>", "")
    address = lambda a: F.trim(unescaped(F.regexp_extract(a, ANCHOR, 1)))
    usable = lambda h: h.startswith("/") | h.startswith("http")
    marked = address(F.regexp_extract(page, _NEXT, 0))
    others = F.filter(F.regexp_extract_all(page, F.lit(_LINK), F.lit(0)), lambda a: F.lower(text(a)).contains("next") & text(a).rlike("[0-9]") & usable(address(a)))
    href = F.when(marked != "", marked).otherwise(address(F.try_element_at(others, F.lit(1))))
    # only addresses that start with / or http are taken, so none is relative
    full = lambda h: F.when(h.startswith("/"), F.concat(F.lit("https://"), domain(base), h)).when(h.startswith("http"), h)
    return let(let(href, full), lambda f: F.when(f.isNotNull(), let(normalize_crawl(f), lambda x: F.when(is_valid(x), x))))


def frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """``url, depth``: every url within ``max_depth`` links of a seed, at its least depth.

    Each level is a join of the last level with the edges and an anti join with what was seen; it
    is written to the shared folder, so that the plan of a level does not hold those before it.
    """
    seen = staged(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    level = seen
    for depth in range(1, max_depth + 1):
        reached = edges.join(level.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct()
        level = staged(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
