"""Leaf blocks of an HTML page: runs of text between block boundaries, with their ancestors.

A tolerant reader for pages as they are: tags that are never closed, end tags
without a start, missing ends of paragraphs and list items, quotes that run on,
and pages cut off anywhere. Comments, scripts, styles and other content that is
never shown give no blocks. Character references are decoded, also those
without a semicolon that HTML knows; others stay as they stand. A line break is
white space. Memory is that of the page; the work grows with its length.
"""

from __future__ import annotations

import re
from html import unescape

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is no markup, or is never shown.
RAW = {
    name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)
    for name in "script style title textarea iframe noembed noframes xmp".split()
}
UNSEEN = frozenset("template noscript svg math object audio video canvas datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of a page by their tag alone.
SECTIONS = frozenset("article aside dialog footer form header main menu nav search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROWS = frozenset("caption tbody thead tfoot tr td th".split())
#: Start tags that end an open element of the first group, unless one of the second is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
#: An end tag does not reach beyond these, but for those of the table itself.
WALLS = frozenset("table td th caption template".split())

MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class Element:
    """An open element; elements alike below the same parent are one."""

    __slots__ = ("name", "up", "path", "near", "hidden", "score", "below")

    def __init__(self, name: str, up: Element | None, path: frozenset, near: frozenset, hidden: bool):
        self.name, self.up, self.path, self.near, self.hidden = name, up, path, near, hidden
        self.score: float | None = None
        self.below: dict[tuple[str, str], Element] = {}

    def child(self, name: str, attributes: str) -> Element:
        """The element below, with the marks of itself and all its ancestors.

        Marks are tags and the words of class, id and role; those of the nearest
        element that is named, or a part of a page by its tag, count once more.
        """
        held = self.below.get((name, attributes))
        if held is None:
            marks = {f"t:{name}"}
            if name != "body":  # its classes tell of the page, not of a part of it
                for value in NAMED.findall(attributes):
                    marks.update("c:" + w.lower() for w in WORD.findall(value))
            path = self.path if marks <= self.path else self.path | marks
            named = len(marks) > 1 or name in SECTIONS
            near = frozenset("n:" + mark for mark in marks) if named else self.near
            held = Element(name, self, path, near, self.hidden or name in UNSEEN)
            self.below[name, attributes] = held
        return held


def root() -> Element:
    return Element("html", None, frozenset(), frozenset(), False)


class Reader:
    """Reads one page into (element, text, characters inside links)."""

    def __init__(self, top: Element):
        self.top = self.at = top
        self.blocks: list[tuple[Element, str, int]] = []
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, False

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.at, text, self.linked))
            self.pieces = []
            self.linked = 0

    def text(self, piece: str) -> None:
        if piece and not self.at.hidden:
            if "&" in piece:
                piece = unescape(piece)
            self.pieces.append(piece)
            if self.in_link:
                self.linked += len(piece.strip())

    def leave(self, names, walls) -> bool:
        """Close up to the nearest open element of *names* unless a wall comes first."""
        e = self.at
        while e.up is not None:
            if e.name in names:
                self.at = e.up
                return True
            if e.name in walls:
                return False
            e = e.up
        return False

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append(" ")
        elif name == "a":
            self.in_link = True
        elif name in UNSEEN:
            if not attributes.endswith("/"):
                self.flush()
                self.at = self.at.child(name, attributes)
        elif name in BLOCK:
            self.flush()
            if name == "hr":
                return
            if name == "body" and self.at is not self.top:
                return
            if self.at.name == "p" or (name in HEADINGS and self.at.name in HEADINGS):
                self.at = self.at.up
            if name in ENDS:
                ended, walls = ENDS[name]
                while self.leave(ended, walls):
                    pass
            self.at = self.at.child(name, attributes)
            self.in_link = False

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        elif name in BLOCK or name in UNSEEN:
            self.flush()
            if name != "body":
                if name in HEADINGS:
                    self.leave(HEADINGS, WALLS)
                else:
                    walls = frozenset(["table"]) if name in ROWS else WALLS - {name}
                    self.leave((name,), walls)


def blocks(page: str, top: Element | None = None) -> list[tuple[Element, str, int]]:
    """The leaf blocks of *page* in order: innermost block element, text, characters inside links."""
    reader = Reader(top or root())
    at = 0
    find = MARKUP.search
    while (found := find(page, at)) is not None:
        if found.start() > at:
            reader.text(page[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            reader.end(name)
            continue
        reader.start(name, found.group(3))
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.start() if end else len(page)
    reader.text(page[at:])
    reader.flush()
    return reader.blocks
