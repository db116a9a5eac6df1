"""A forgiving HTML reader: elements with their children, and the blocks of text under an element."""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Iterator

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: An opening tag closes open elements of these kinds, up to the nearest element that can hold it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
HOLDS = frozenset("ul ol dl table select menu".split())


class Element:
    __slots__ = ("tag", "raw", "children", "_attributes")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []
        self._attributes: dict[str, str] | None = None

    @property
    def attributes(self) -> dict[str, str]:
        if self._attributes is None:
            self._attributes = {m[1].lower(): references.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(self.raw)} if self.raw.strip(" /") else {}
        return self._attributes

    @property
    def key(self) -> str:
        """Tag with its first class, or its id, digits alike: what template positions are compared by."""
        if not self.raw:
            return self.tag
        name = self.attributes.get("class", "").split()[:1] or self.attributes.get("id", "").split()[:1]
        return f"{self.tag}.{re.sub('[0-9]+', '0', name[0])}" if name else self.tag


def parse(page: str) -> Element:
    """The tree of a page. Counts of open tags and the places of block elements in the stack spare looking through deep nesting."""
    root = Element("#root")
    stack, solid, at, end = [root], [0], 0, len(page)
    opened: dict[str, int] = {}

    def push(x: Element) -> None:
        if x.tag not in INLINE:
            solid.append(len(stack))
        stack.append(x)
        opened[x.tag] = opened.get(x.tag, 0) + 1

    def cut(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag] -= 1
        while solid[-1] >= k:
            solid.pop()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                floor = solid[-1] if tag in INLINE else 0
                for k in range(len(stack) - 1, floor, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
            continue
        if tag not in INLINE and tag not in VOID and stack[solid[-1]].tag == "p":
            cut(solid[-1])
        if tag in CLOSES and any(opened.get(x) for x in CLOSES[tag]):
            k = len(stack) - 1
            while k and stack[k].tag not in HOLDS:
                if stack[k].tag in CLOSES[tag]:
                    cut(k)
                k -= 1
        node = Element(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            close = _ENDS[tag].search(page, at)
            at = close.end() if close else end
        elif tag not in VOID:
            push(node)
    return root


def blocks(node: Element, skip: Callable[[Element], bool]) -> Iterator[str]:
    """Texts of blocks in page order: references decoded, white space made one space, trimmed, empty ones left out."""
    held: list[str] = []

    def flush() -> Iterator[str]:
        if held:
            text = _SPACE.sub(" ", references.unescape("".join(held))).strip()
            held.clear()
            if text:
                yield text

    stack: list = [iter(node.children)]
    ends = [True]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if ends.pop():
                yield from flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag in VOID:
            if x.tag == "hr":
                yield from flush()
            elif x.tag == "br":
                held.append(" ")
        elif x.tag in RAW or skip(x):
            if x.tag not in INLINE:
                yield from flush()
        else:
            block = x.tag not in INLINE
            if block:
                yield from flush()
            stack.append(iter(x.children))
            ends.append(block)
    yield from flush()
