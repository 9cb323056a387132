"""Leaf blocks of web pages: runs of text within one block element, with the tags around them."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Elements whose raw text is not text of the page, inline elements that a block may lie in, elements
#: that break text into blocks, that hold nothing, and that end an open element of the same kind.
DROPPED = frozenset("script style title iframe textarea".split())
EMBEDDED = frozenset("svg math object canvas audio video noscript template map select datalist option button".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}}
#: Embedded elements whose text stands apart from the words around it.
_APART = frozenset("button select option datalist".split())
#: Elements that an open paragraph cannot contain.
_ENDS_P = BLOCKS - {"body", "html"}
#: An open element of SELF_CLOSING is looked for up to here.
_SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article body main aside nav form header footer blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    # quotes hold a value only behind an equals sign; elsewhere they are letters of a name or of a bare value
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]*|[\"'])|[^>=])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|/|$)", re.IGNORECASE) for t in DROPPED}
_NAME = re.compile(r"[a-z]+|[0-9]+")


class Element(NamedTuple):
    tag: str
    names: tuple[str, ...]  # words of class, id, role and label, lower-cased
    hidden: bool


class Node:
    """An element in its place: paths are linked, so that blocks share them whatever the depth."""

    __slots__ = ("element", "open", "parent", "way")

    def __init__(self, element: Element, parent: Node | None, way: int):
        self.element, self.parent, self.way, self.open = element, parent, way, True  # way: the same number for equal paths


class Block(NamedTuple):
    text: str
    at: Node | None  # the innermost element that holds the whole text
    linked: int  # characters within links
    bold: int  # characters within b or strong

    @property
    def path(self) -> tuple[Element, ...]:
        """The elements around the block, outermost first."""
        found, node = [], self.at
        while node:
            found.append(node.element)
            node = node.parent
        return tuple(found[::-1])


def _element(tag: str, attributes: str) -> Element:
    names, hidden = [], False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if key in ("class", "id", "role", "aria-label", "itemprop"):
                names += _NAME.findall(value)
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    return Element(tag, tuple(names), hidden)


def blocks_of(html: str | None) -> list[Block]:
    """The page's blocks in order: character references decoded, white space collapsed, none empty.

    Unclosed, stray and wrongly nested tags are taken as browsers take them, in the main: a new paragraph,
    list item or cell ends an open one, an end tag ends everything inside, one without a start is ignored.
    An element of ``EMBEDDED`` is in the path of a block whose whole text it holds. Only the raw text of ``DROPPED``
    is left out; without their end tag, script and style reach to the end of the page, the others hold nothing.
    Time and memory are linear in the page, however deep its elements lie.
    """
    html = html or ""
    found: list[Block] = []
    stack: list[tuple[str, Node | None]] = []  # open elements; links and bold text have no node
    places: dict[str, list[int]] = {}  # of the open elements in the stack, by tag
    blocks: list[int] = []  # places of the open block elements
    ways: dict[tuple[int, Element], int] = {}
    parts: list[tuple[str, bool, bool]] = []
    top: Node | None = None
    # the innermost element around all text since the last block: blocks open and close only between blocks' texts
    common: Node | None = None
    told = False
    endless: set[str] = set()  # raw elements without an end tag from here on
    at = 0

    def flush() -> None:
        nonlocal told, common
        if told:
            text = " ".join("".join(t for t, _, _ in parts).split())
            found.append(Block(text, common, sum(len(t.strip()) for t, a, _ in parts if a), sum(len(t.strip()) for t, _, b in parts if b)))
        parts.clear()
        told, common = False, None

    def add(text: str) -> None:
        nonlocal told, common
        if text:
            text = unescape(text) if "&" in text else text
            parts.append((text, bool(places.get("a")), bool(places.get("b") or places.get("strong"))))
            if text.strip():
                if not told:
                    told, common = True, top
                while common and not common.open:
                    common = common.parent

    def push(element: Element) -> None:
        nonlocal top
        places.setdefault(element.tag, []).append(len(stack))
        if element.tag in BLOCKS:
            blocks.append(len(stack))
        if element.tag in BLOCKS or element.tag in EMBEDDED:
            top = Node(element, top, ways.setdefault((top.way if top else 0, element), len(ways) + 1))
            stack.append((element.tag, top))
        else:
            stack.append((element.tag, None))

    def close(down_to: int) -> None:
        nonlocal top
        while len(stack) > down_to:
            tag, node = stack.pop()
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
            if node:
                node.open, top = False, node.parent

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while m := _TOKEN.search(html, at):
        add(html[at:m.start()])
        at = m.end()
        ended, opened = m.group(1), m.group(2)
        if ended:
            tag = ended.lower()
            inside = last((tag,))
            if inside >= 0:
                if blocks and blocks[-1] >= inside:
                    if tag not in BLOCKS and tag not in EMBEDDED:
                        continue  # an inline end tag does not end blocks inside
                    flush()
                close(inside)
            elif tag in ("p", "br"):
                flush()
            if tag in _APART:
                parts.append((" ", False, False))
        elif opened:
            tag, attributes = opened.lower(), m.group(3) or ""
            if tag in DROPPED:
                if not attributes.rstrip().endswith("/"):
                    end = None if tag in endless else _RAW_END[tag].search(html, at)
                    if end:
                        at = html.find(">", end.start()) + 1 or len(html)
                    elif tag in ("script", "style"):
                        at = len(html)
                    else:
                        endless.add(tag)
                parts.append((" ", False, False))
                continue
            if tag in BLOCKS:
                flush()
                if tag in _ENDS_P and places.get("p"):
                    close(last(("p",)))
                if tag in SELF_CLOSING and tag != "p" and (i := last(SELF_CLOSING[tag])) > last(_SCOPE):
                    close(i)
            if tag in VOID:
                if tag == "br" or tag in BLOCKS:
                    parts.append((" ", False, False))
                continue
            if tag in ("svg", "math") and attributes.rstrip().endswith("/"):
                continue
            if tag in _APART:
                parts.append((" ", False, False))
                if tag == "option" and stack and stack[-1][0] == tag:
                    close(len(stack) - 1)
            if tag in BLOCKS or tag in EMBEDDED or tag in ("a", "b", "strong"):
                push(_element(tag, attributes))
    add(html[at:])
    flush()
    return found
