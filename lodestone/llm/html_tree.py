"""A page as a tree of block elements and stretches of text, small enough for a worker to hold page by page.

Elements that cannot hold prose (scripts, styles, templates, form controls, ...) and comments are left out with all that is in
them. Inline elements belong to the block that they are in; a start or end of a block ends the stretch of text before it.
Open paragraphs, list items and table cells are closed where the next one begins; end tags without a start are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of the HTML standard: blocks, elements read as raw text, and elements without an end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head template svg object audio video canvas select datalist button noscript noembed applet map".split())
#: A block that starts ends the nearest open one of these, unless an element of the second set is nearer.
_ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ITEMS |= {t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
_PIECE = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|noframes|xmp)\b[^>]*+>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")


@dataclass
class Page:
    """Nodes in page order, parents first: tag "" for a stretch of text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    #: Of a stretch: characters inside links.
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: str = "", text: str = "", linked: int = 0) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.attributes, attributes), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.parent) - 1


def attributes_of(raw: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip() else {}


def parse(source: str) -> Page:
    page = Page()
    page.add(-1, "html")
    stack = [("html", 0)]  # open blocks with their nodes
    unseen: list[str] = []  # open elements whose text is not read
    link = 0  # blocks open where a link began; 0: no link
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            words = " ".join("".join(run).split())
            run.clear()
            if words:
                page.add(stack[-1][1], "", text=words, linked=min(linked, len(words)))
            linked = 0

    def close(at: int) -> None:
        nonlocal link
        flush()
        del stack[at:]
        link = link if link <= len(stack) else 0

    def nearest(tags: set[str], stop: set[str]) -> int:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in tags:
                return at
            if stack[at][0] in stop:
                break
        return 0

    def read(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            plain = html.unescape(text) if "&" in text else text
            run.append(plain)
            linked += len(plain.strip()) if link else 0

    done = 0
    for m in _PIECE.finditer(source):
        read(source[done : m.start()])
        done = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br" and not unseen:
            run.append(" ")
        elif tag in UNSEEN:
            if m["end"]:
                if tag in unseen:
                    del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
            elif not m["attributes"].endswith("/"):
                unseen.append(tag)
            if tag not in ("noscript", "map"):
                flush()
        elif unseen and tag != "body":
            continue
        elif tag in ("html", "body") and not m["end"]:
            unseen.clear()
            if tag == "body" and len(stack) == 1:
                flush()
                stack.append(("body", page.add(0, "body", m["attributes"])))
        elif tag == "a":
            link = 0 if m["end"] else len(stack)
        elif tag in BLOCKS and m["end"]:
            if tag not in ("html", "body"):
                at = nearest({tag}, {"td", "th"} if tag == "p" else {"table"} if tag in ("td", "th", "tr") else set())
                close(at) if at else flush()
        elif tag in BLOCKS:
            at = nearest({"p"}, BLOCKS - {"p"})
            if at:
                close(at)
            if tag in _ITEMS:
                at = nearest(*_ITEMS[tag])
                if at:
                    close(at)
            flush()
            if tag not in VOID:
                stack.append((tag, page.add(stack[-1][1], tag, m["attributes"])))
    read(source[done:])
    flush()
    return page
