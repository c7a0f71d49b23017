"""Problem 3: the main body of each page, without what the site puts on all its pages.

Method: per host, the token streams of the pages are concatenated and a suffix array over them gives the
runs of tokens that many of the host's articles share (``tokenruns``): at least ``share`` of them, and
``min_articles``. A text unit whose tokens lie in such runs is boilerplate, also where it holds a changing
word; units that no run covers are the page's own. Pages with one heading count as one article, so
copies of an article and repeated error pages do not make their own text boilerplate; pages without a
heading are one article too. A heading on more than half of a host's pages names the site, and its
pages count one by one. Units are blocks, or the link texts of a block that consists of links, with
case and digits folded. Blocks of the article (in the box of its h1) keep their digits, except where
a counter or date may stand: link bars, headings that open a box, long paragraphs of inner boxes, and
paragraphs beside an h1 that stands in the body itself.

What is unique to a page but belongs to a boilerplate box (readers' comments, teasers, advertisements)
goes with the box: a box that opens with a covered block of its own, and holds neither the page's
heading nor the page as a whole, is removed with all it contains. In the article, lists, tables and
quotes are no such boxes, nor are boxes that open with a section heading and do not close with covered
text. Covered blocks that stand between the h1 and the article's last own block are kept: section
headings are usual on some hosts, and notices stand in boxes or at the ends.

Defined results: null html gives no rows; repeated deliveries of a write give one; a page of a host
with fewer articles than ``min_articles`` keeps everything; a null host is a host of its own.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from .lines import bounded_broadcast
from .pages import Block, Box, parse
from .tokenruns import EDGE, Tokens, covered_pieces, mixed, packed, units_covered, unpacked

_DIGITS = re.compile(r"\d+")
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
#: Boxes that hold a page as a whole and are never removed with their content.
_WHOLE = frozenset(("", "html", "body", "main", "article"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Boxes that hold content rather than notices where they stand in the article.
_CONTENT = frozenset("table tr td th ul ol dl blockquote figure details".split())
#: Boxes that may be sections of the article.
_SECTIONS = frozenset("div section article main".split())
#: An h1 directly in one of these shares its box with menus and notices.
_FLAT = frozenset(("", "html", "body"))
_CONTROLS = frozenset(("button", "label"))
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Scripts that write no blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u9fff\uff00-\uff65]")
#: Words of a paragraph that may be a notice with a counter or a date.
NOTICE_WORDS = 4
#: The same in a box inside the article, where notices are sentences.
BOXED_WORDS = 12
#: Pages that are looked at together.
CHUNK = 1000
#: Largest table of covered pieces that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def _symbol(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.lower().encode("utf-8", "surrogatepass")) - (1 << 63)


#: Numbers of the tokens that this worker has seen.
_TOKENS = Tokens()


def units(block: Block, fold: bool = True) -> list[list[int]]:
    """Token numbers of a block's units: of its link texts if it is little else, else of the whole."""
    linked = len(block.parts) > 1 and sum(map(len, block.parts)) >= 0.6 * len(block.text)
    found = []
    for text in (" ".join(p.split()) for p in block.parts if not p.isspace()) if linked else (block.text,):
        low = text.lower()
        if fold:
            low = _DIGITS.sub("0", low)
        words = low.split() if low.isascii() or not _UNSPACED.search(low) else _TOKEN.findall(low)
        found.append([_TOKENS[t] for t in words])
    return [u for u in found if u]


def heading(blocks: list[Block], boxes: list[Box]) -> tuple[int, int]:
    """The block of the page's h1 and the box of its article, or -1 and -1."""
    found = [k for k, b in enumerate(blocks) if b.element == "h1"]
    if not found:
        return -1, -1
    top = next((k for k in found if boxes[blocks[k].box].tag not in ("header", "nav", "aside", "footer")), found[0])
    home = blocks[top].box
    while home > 0 and boxes[home].first == boxes[home].last:  # holds the h1 alone
        home = boxes[home].parent
    return top, home


def within(home: int, parents: list[int]) -> list[bool]:
    """Which boxes are the box ``home`` or stand in it; parents come before their children."""
    result: list[bool] = []
    for number, parent in enumerate(parents):
        result.append(number == home or parent >= 0 and result[parent])
    return result


def page_units(blocks: list[Block], boxes: list[Box], top: int, home: int) -> list[list[list[int]]]:
    """Units per block; see the module's text for which blocks have their digits folded."""
    inner = within(home, [x.parent for x in boxes])
    flat = home >= 0 and boxes[home].tag in _FLAT
    result = []
    for k, b in enumerate(blocks):
        fold = not inner[b.box]
        if not fold and k != top and boxes[b.box].tag not in _CONTENT:
            if b.box == home:
                fold = flat and b.element == "p" and len(_WORD.findall(b.text)) >= NOTICE_WORDS
            else:
                fold = len(b.parts) > 1 or b.element in _HEADINGS and boxes[b.box].first == k or b.element == "p" and len(_WORD.findall(b.text)) >= BOXED_WORDS
        result.append(units(b, fold))
    return result


PARSED = (
    "_id string, grp long, doc long, texts array<string>, elements array<string>, inside array<int>, tokens binary, n_tokens int, n_units array<int>,"
    " tags array<string>, firsts array<int>, lasts array<int>, parents array<int>, top int, home int, title long, noscript string"
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per write: its blocks with their units, its boxes, and the text for lack of scripts."""
    whole = [pa.int32(), pa.int32(), pa.int64()]
    kinds = [pa.list_(k) for k in (pa.string(), pa.string(), pa.int32())] + [pa.binary(), pa.int32()] + [pa.list_(k) for k in (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())] + whole
    for batch in (whole.slice(at, CHUNK) for whole in batches for at in range(0, whole.num_rows, CHUNK)):
        columns: list[list] = [[] for _ in kinds]
        hidden = []
        for value in batch.column("html"):
            page = value.as_py()
            blocks, boxes = parse(page)
            top, home = heading(blocks, boxes)
            own = page_units(blocks, boxes, top, home)
            stream = [EDGE]
            for unit in (u for us in own for u in us):
                stream.extend(unit)
                stream.append(EDGE)
            row = (
                [b.text for b in blocks], [b.element for b in blocks], [b.box for b in blocks], packed(stream), len(stream), [len(us) for us in own],
                [x.tag for x in boxes], [x.first for x in boxes], [x.last for x in boxes], [x.parent for x in boxes],
                top, home, _symbol(blocks[top].text) if top >= 0 else 0,
            )
            for column, item in zip(columns, row, strict=True):
                column.append(item)
            hidden.append("\n".join(" ".join(entities.unescape(_TAG.sub(" ", m)).split()) for m in _NOSCRIPT.findall(page)))
        arrays = [batch.column(c) for c in ("_id", "grp", "doc")] + [_arrow_lists(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(hidden, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _arrow_lists(column: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(column, kind)
    ends = np.cumsum([0, *map(len, column)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for own in column for x in own], kind.value_type))


_NAMES = "_id grp doc texts elements inside tokens n_tokens n_units tags firsts lasts parents top home title noscript".split()


@dataclass(slots=True)
class Kept:
    """A block of the main body."""

    text: str
    element: str


def main_blocks(page: dict, known: list[bool]) -> list[Kept]:
    """The blocks of the main body; ``known`` tells of every unit whether it is boilerplate."""
    shared, at = [], 0
    for n in page["n_units"]:
        shared.append(sum(known[at : at + n]) >= 0.7 * n)
        at += n
    elements, inside, tags, texts = page["elements"], page["inside"], page["tags"], page["texts"]
    headings = [k for k, e in enumerate(elements) if e == "h1"]
    top, home = page["top"], page["home"]
    if top >= 0 and shared[top]:  # the site's name, not the article's
        top = home = -1
    inner = within(home, page["parents"])
    flat = home >= 0 and tags[home] in _FLAT
    gone, loose = [False] * len(shared), [False] * len(shared)
    for number, (tag, first, last) in enumerate(zip(tags, page["firsts"], page["lasts"], strict=True)):
        if last < 0 or inside[first] != number:
            continue
        digits = _DIGITS.search(texts[first])
        if first == last and elements[first] == tag and page["n_units"][first] == 1 and not digits:
            loose[first] = tag in _SECTIONS  # a box of one text is as good as none
        if tag in _WHOLE or not shared[first] or any(first <= h <= last for h in headings):
            continue
        if inner[number]:
            if tag in _CONTENT or loose[first]:
                continue
            if tag in _SECTIONS and elements[first] in _HEADINGS and not digits and not (shared[last] and elements[last] not in _HEADINGS):
                loose[first : last + 1] = [True] * (last - first + 1)
                continue
        gone[first : last + 1] = [True] * (last - first + 1)

    def stands(k: int) -> bool:
        """Whether a block stands in the article's own flow."""
        return inner[inside[k]] and not gone[k] and (not flat or inside[k] == home or loose[k] or tags[inside[k]] in _CONTENT)

    end = max((k for k, s in enumerate(shared) if not s and stands(k)), default=-1)
    kept = (not g and (not s or top < k < end and stands(k) and elements[k] not in _CONTROLS) for k, (s, g) in enumerate(zip(shared, gone, strict=True)))
    return [Kept(t, e) for t, e, k in zip(texts, elements, kept, strict=True) if k]


def parsed(pages: DataFrame) -> DataFrame:
    """Every write with html, parsed once and written: all later steps read this table."""
    keyed = pages.where(F.col("html").isNotNull()).select("_id", F.xxhash64("source_domain").alias("grp"), F.xxhash64("url", "source_domain").alias("doc"), "html")
    return staged(spread(keyed).mapInArrow(_parsed, PARSED), "parsed")


def boilerplate(parsed: DataFrame, share: float = 0.05, min_articles: int = 3, **options) -> DataFrame:
    """``grp, symbol``: the pieces of token runs that enough distinct articles of the host share."""
    pages = parsed.select("grp", "title", "doc").distinct()
    sizes = pages.groupBy("grp").agg(F.count_distinct("doc").alias("pages"))
    titles = pages.groupBy("grp", "title").agg(F.count(F.lit(1)).alias("n")).join(sizes, "grp")
    names = staged(titles.where("2 * n > pages").where(F.col("pages") >= min_articles).select(F.col("grp").alias("of"), F.col("title").alias("name")), "names")
    streams = parsed.join(bounded_broadcast(names, 32), F.expr("grp = of AND title = name"), "left").select(
        "grp", F.when(F.col("name").isNull(), F.xxhash64("title")).otherwise(F.col("doc")).alias("article"), "doc", "n_tokens", "tokens"
    )
    return staged(covered_pieces(streams, share, min_articles, **options), "covered")


def each_main(
    parsed: DataFrame, covered: DataFrame, per_page, schema: str, limit_bytes: int = BROADCAST_BYTES, spare=lambda page: page["noscript"], salt_pages: int = 20_000
) -> DataFrame:
    """Apply ``per_page(_id, main blocks, spare text) -> rows`` to every write; ``spare`` is the noscript text if nothing else is given.

    The covered pieces are sent to all executors if their counted size allows it; else they are
    joined per host, each host's list being bounded by tokens per page over the share. A host's pages
    are then spread over as many salts as it has ``salt_pages``.
    """
    names = [part.split()[0] for part in schema.split(",")]
    needed = ["texts", "elements", "inside", "n_units", "tags", "firsts", "lasts", "parents", "top", "home"]

    def rows(batches, keys):
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                grp = batch.column("grp").to_numpy()
                known, n = units_covered(*unpacked(batch.column("tokens")), grp, _own_keys(batch, grp) if keys is None else keys)
                columns = [_python(batch.column(c)) for c in taken]
                pages = [dict(zip(taken, values, strict=True)) for values in zip(*columns, strict=True)]
                out, ends = [], np.cumsum(n)
                for page, start, end in zip(pages, ends - n, ends, strict=True):
                    out.extend(per_page(page["_id"], main_blocks(page, known[start:end].tolist()), spare(page)))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_arrow(schema))

    taken = ["_id", *needed, "noscript"]
    columns = [*taken, "grp", "tokens"]
    if covered.count() * 100 <= limit_bytes:
        table = covered.toArrow()
        held = parsed.sparkSession.sparkContext.broadcast(np.sort(mixed(table.column("grp").to_numpy(), table.column("symbol").to_numpy())))
        return parsed.select(*columns).mapInArrow(lambda it: rows(it, held.value), schema)
    salts = staged(parsed.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / salt_pages).alias("salts")), "salts")
    lists = covered.groupBy("grp").agg(F.collect_list("symbol").alias("own")).join(salts, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    hot = salts.where("salts > 1").select(F.col("grp").alias("of"), "salts")
    spread_out = parsed.join(bounded_broadcast(hot, 24), F.expr("grp = of"), "left").withColumn("salt", F.coalesce(F.pmod("doc", "salts"), F.lit(0)))
    return spread_out.join(lists, ["grp", "salt"], "left").select(*columns, "own").mapInArrow(lambda it: rows(it, None), schema)


def _python(column: pa.Array) -> list:
    """The values of a column; lists by slicing their values, which takes far less than one by one."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, ends = column.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    flat = values.to_pylist() if pa.types.is_string(values.type) else values.to_numpy().tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _own_keys(batch: pa.RecordBatch, grp: np.ndarray) -> np.ndarray:
    """The sorted names of the covered pieces of all hosts in a batch of the join's rows."""
    _, first = np.unique(grp, return_index=True)
    lists = [mixed(np.full(len(own), grp[k]), np.array(own, dtype=np.int64)) for k in first.tolist() if (own := batch.column("own")[k].as_py())]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.uint64)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (p.split() for p in schema.split(","))])


def block_md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def main_block_hashes(pages: DataFrame, **options) -> DataFrame:
    """``_id, block_md5`` of every block of every write's main body."""
    table = parsed(pages)
    covered = boilerplate(table, **options)
    return each_main(table, covered, lambda key, blocks, _: ((key, h) for h in {block_md5(b.text) for b in blocks}), "_id string, block_md5 string").distinct()


def main_texts(pages: DataFrame, **options) -> DataFrame:
    """``_id, text``: the main body of every write, its blocks one per line."""
    table = parsed(pages)
    covered = boilerplate(table, **options)
    return each_main(table, covered, lambda key, blocks, _: [(key, "\n".join(b.text for b in blocks))], "_id string, text string").dropDuplicates(["_id"])
