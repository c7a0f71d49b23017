"""Blocks of an html page with the boxes they stand in, by one pass over its tags.

A block is the visible text between two consecutive tags other than the inline ones. Broken markup
is read as browsers do: unknown closing tags are ignored, paragraphs and cells close each other, and
what is still open at the end is closed there.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

#: Fixed by the problem statement.
INLINE = frozenset("a b i em strong span sup code".split())
VOID = frozenset("br hr img input meta link wbr area base col embed source track param".split())
#: Elements that count as boxes, which menus, notices and articles stand in.
BOXES = frozenset("html body div section aside form nav header footer main article table tr td th ul ol dl blockquote figure fieldset details".split())
_CLOSED_BY = {
    "p": frozenset("p div section aside form nav header footer main article table ul ol dl blockquote h1 h2 h3 h4 h5 h6 hr pre".split()),
    "li": frozenset(["li"]),
    "td": frozenset("td th tr".split()),
    "th": frozenset("td th tr".split()),
    "tr": frozenset(["tr"]),
    "dd": frozenset("dd dt".split()),
    "dt": frozenset("dd dt".split()),
}
_PIECE = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<hidden>script|style|noscript)\b[^>]*>(?:.*?</(?P=hidden)\s*>|.*\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9]*)\b(?P<rest>[^>]*)>|<[!?][^>]*>",
    re.I | re.S,
)
_HEAD = re.compile(r"<head\b.*?(?:</head\s*>|(?=<body\b))", re.I | re.S)


@dataclass(slots=True)
class Box:
    """An element that holds blocks: its parent's number, tag, and the blocks it spans."""

    parent: int
    tag: str
    first: int
    last: int = -1


@dataclass(slots=True)
class Block:
    """A block: its text, the innermost box, the element it is directly in, and its link share."""

    text: str
    box: int
    element: str
    parts: list[str]


def parse(page: str) -> tuple[list[Block], list[Box]]:
    """Blocks and boxes of a page in document order; box 0 is the page."""
    hidden = _HEAD.search(page)
    if hidden:
        page = page[: hidden.start()] + page[hidden.end() :]
    boxes, blocks = [Box(-1, "", 0)], []
    stack: list[tuple[str, int]] = [("", 0)]
    texts: list[str] = []
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if texts:
            raw = "".join(texts)
            texts.clear()
            if raw and not raw.isspace():
                if "&" in raw:
                    raw = entities.unescape(raw)
                text = " ".join(raw.split())
                if text:
                    blocks.append(Block(text, stack[-1][1], next((t for t, _ in reversed(stack) if t), ""), list(parts)))
        parts.clear()

    for m in _PIECE.finditer(page):
        start = m.start()
        if start > at:
            texts.append(page[at:start])
        at = m.end()
        hides, close, tag, rest = m.groups()
        if tag is None:
            if hides and texts:
                flush()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if texts and close and tag == "a":
                parts.append(texts[-1])
            continue
        if texts:
            flush()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not rest.endswith("/"):
            while len(stack) > 1 and tag in _CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            box = stack[-1][1]
            if tag in BOXES:
                boxes.append(Box(box, tag, len(blocks)))
                box = len(boxes) - 1
            stack.append((tag, box))
        elif tag == "hr":
            while len(stack) > 1 and stack[-1][0] == "p":
                stack.pop()
    if at < len(page):
        texts.append(page[at:])
    flush()
    for number, block in enumerate(blocks):
        k = block.box
        while k >= 0:
            if boxes[k].last < 0:
                boxes[k].first = number
            boxes[k].last = number
            k = boxes[k].parent
    return blocks, boxes
