"""Union-free wrappers of same-host pages: what is constant, optional, repeated, and a slot for text.

A page is a stream of tokens, one for each place of a block element: a place is the chain of keys from the root, known by a hash, so
depth costs nothing. Places that recur on a page fold into one repeated token. Streams of one host are aligned token by token: equal places
meet, a token that some page lacks becomes optional, one that recurs on any page a repeated group, and texts that differ become slots; texts
that agree stay constants. A token also counts the letters of text under it, without links and boilerplate, so that the whole wrapper tells
where a host keeps its text; inline elements whose name leaves open what they are have tokens as well. Every step is a sum, minimum or
maximum, so the wrapper is the same in whatever order and parts pages are met, and a host that holds most pages is aligned in all tasks. No
alternation is ever needed, and no list or depth is capped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Set
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple
from zlib import crc32

import xxhash

from graphloom.llm.html_tree import INLINE, RAW, VOID, Element

#: Pages that must agree before a text counts as constant.
AGREE = 3
MAIN = ("article", "main")
#: Kinds of elements: by a listed name that may also be an article's, and boilerplate whatever the wrapper says.
OPEN, BOILERPLATE = 2, 3
COLUMNS = "path long, parent long, key string, pages long, times int, kind int, chars long, linked long, letters long, around long, own_low long, own_high long, whole_low long, whole_high long, page_low long, page_high long, place double"


def step(parent: int, key: str) -> int:
    """The hash of a place: of its parent's place and its key."""
    x = xxhash.xxh3_64_intdigest(key, seed=parent & (2**64 - 1))
    return x - 2**64 if x >= 2**63 else x


@dataclass
class Token:
    """A place on one page, or on all pages of a host: checksums are of its own text, of all text under it, and of the page; letters are of
    all text under it outside of links and boilerplate, around those of the article, main or page that it is in; kind is the highest of the
    elements there, without boilerplate.
    """

    path: int
    parent: int
    key: str
    pages: int = 1
    times: int = 1
    kind: int = 0
    chars: int = 0
    linked: int = 0
    letters: int = 0
    around: int = 0
    own: tuple[int, int] = (0, 0)
    whole: tuple[int, int] = (0, 0)
    page: tuple[int, int] = (0, 0)
    place: float = 0.0

    def meet(self, other: Token) -> None:
        """Align with the same place of other pages."""
        low = lambda a, b: (min(a[0], b[0]), max(a[1], b[1]))
        self.pages, self.times, self.kind = self.pages + other.pages, max(self.times, other.times), max(self.kind, other.kind)
        self.chars, self.linked, self.letters = self.chars + other.chars, self.linked + other.linked, self.letters + other.letters
        self.around += other.around
        self.own, self.whole, self.page = low(self.own, other.own), low(self.whole, other.whole), low(self.page, other.page)
        self.place = min(self.place, other.place)

    @property
    def constant(self) -> bool:
        """Whether all text under this place agrees on several pages that differ elsewhere."""
        return self.pages >= AGREE and self.whole[0] == self.whole[1] != 0 and self.page[0] != self.page[1]

    def row(self) -> tuple:
        return (self.path, self.parent, self.key, self.pages, self.times, self.kind, self.chars, self.linked, self.letters, self.around, *self.own, *self.whole, *self.page, self.place)


@dataclass
class _Frame:
    rest: Iterable
    token: Token
    path: int
    linked: bool
    holder: Token | None
    base: int
    outside: bool
    whole: int = 0
    letters: int = 0


def stream(root: Element, kind: Callable[[Element, bool], int] = lambda e, inside: 0) -> dict[int, Token]:
    """The tokens of a page by place, in page order. Inline elements count as text of their block; those whose kind is open are also places.

    kind: of an element, given whether it is in an article: BOILERPLATE, OPEN or other.
    """
    top = step(0, root.key)
    tokens = {top: Token(top, 0, root.key)}
    stack = [_Frame(iter(root.children), tokens[top], top, False, tokens[top], top, False)]
    bases: dict[int, int] = {}

    def place(f: _Frame, key: str, sort: int) -> Token:
        path = step(f.path, key)
        if path in tokens:
            tokens[path].times += 1
        else:
            tokens[path] = Token(path, f.path, key, place=float(len(tokens)))
        if sort != BOILERPLATE:
            tokens[path].kind = max(tokens[path].kind, sort)
        bases[path] = f.base
        return tokens[path]

    while stack:
        f = stack[-1]
        x = next(f.rest, None)
        if x is None:
            stack.pop()
            if f.holder and f.whole:
                f.holder.whole = (crc32(b"%d" % f.whole, f.holder.whole[0]),) * 2
                f.holder.letters += f.letters
            if stack and f.whole:
                stack[-1].whole = crc32(b"%d" % f.whole, stack[-1].whole) or 1
                stack[-1].letters += f.letters
        elif isinstance(x, str):
            text = x.strip()
            if text:
                f.token.chars += len(text)
                f.token.linked += len(text) if f.linked else 0
                f.token.own = (crc32(text.encode("utf-8", "surrogatepass"), f.token.own[0]) or 1,) * 2
                f.whole = crc32(text.encode("utf-8", "surrogatepass"), f.whole) or 1
                f.letters += 0 if f.linked or f.outside else len(text)
        elif x.tag in INLINE:
            sort = kind(x, f.base != top)
            holder = place(f, x.key, sort) if sort == OPEN else None
            stack.append(_Frame(iter(x.children), f.token, f.path, f.linked or x.tag == "a", holder, f.base, f.outside or sort == BOILERPLATE))
        elif x.tag not in VOID and x.tag not in RAW:
            sort = kind(x, f.base != top)
            own = place(f, x.key, sort)
            stack.append(_Frame(iter(x.children), own, own.path, False, own, own.path if x.tag in MAIN else f.base, f.outside or sort == BOILERPLATE))
    size, page = len(tokens), tokens[top].whole
    for t in tokens.values():
        t.page, t.place = page, t.place / size
    for path, base in bases.items():
        tokens[path].around = tokens[base].letters
    return tokens


@dataclass
class Wrapper:
    """The aligned tokens of pages that a task has met, by host and place."""

    tokens: dict[tuple[str, int], Token] = field(default_factory=dict)

    def align(self, host: str, page: dict[int, Token]) -> None:
        for path, t in page.items():
            old = self.tokens.get((host, path))
            if old is None:
                self.tokens[host, path] = t
            else:
                old.meet(t)

    def template(self, host: str) -> Template:
        """The template of one host."""
        own = (t for (h, _), t in self.tokens.items() if h == host and t.pages >= AGREE and t.page[0] != t.page[1])
        return template(Part(t.path, t.parent, t.key, t.pages, t.letters, t.around, t.kind, t.constant) for t in own)

    def constants(self, host: str) -> set[int]:
        return {p for (h, p), t in self.tokens.items() if h == host and t.constant}


@dataclass(frozen=True)
class Template:
    """What the wrapper of a host decides. constants: places of the template's own text; kept: slots that no open name drops."""

    constants: Set[int] = frozenset()
    kept: Set[int] = frozenset()


class Part(NamedTuple):
    """What a template is made from: a place that enough pages have."""

    path: int
    parent: int
    key: str
    pages: int
    letters: int
    around: int
    kind: int
    constant: bool


def template(parts: Iterable[Part]) -> Template:
    """The template of one host.

    Kept are, of open places, inline slots, as they are parts of a sentence, and blocks that hold more than half of the letters in slots of
    the article, main or page around them, over the pages that have them: they are the article, whatever their name. Around a block, text is
    taken for constant as far as the numbers of pages prove it: constants of n pages meet m others of N on n + m - N at least. A constant
    without a listed name that holds more than half of all letters around it is no template but an article in near copies, with all under it.
    """
    below: dict[int, list[Part]] = {}
    for t in parts:
        below.setdefault(t.parent, []).append(t)
    order: list[tuple[Part, Part, bool]] = []
    constants, copies = set(), set()
    stack = [(t, t, False) for t in below.get(0, [])]
    while stack:
        t, base, covered = stack.pop()
        order.append((t, base, covered))
        if t.parent in copies or (t.constant and not covered and not t.kind and 2 * t.letters > t.around):
            copies.add(t.path)
        elif t.constant:
            constants.add(t.path)
        stack.extend((x, t if t.key.partition(".")[0] in MAIN else base, covered or t.constant) for x in below.get(t.path, []))
    fixed: dict[int, int] = {}
    around: dict[int, list[tuple[int, float]]] = {}
    for t, base, covered in reversed(order):
        if t.constant:
            fixed[t.path] = t.letters
        if t.key.partition(".")[0] not in INLINE:
            fixed[t.parent] = fixed.get(t.parent, 0) + fixed.get(t.path, 0)
            if t.constant and not covered and t.letters:
                around.setdefault(base.path, []).append((t.pages, t.letters / t.pages))
    sums = {}
    for path, found in around.items():
        found.sort(reverse=True)
        sums[path] = [-n for n, _ in found], [0.0, *accumulate(x for _, x in found)], [0.0, *accumulate(n * x for n, x in found)]
    kept = set()
    for t, base, covered in order:
        slots = t.letters - fixed.get(t.path, 0)
        if t.kind == OPEN and slots > 0 and not covered:
            if t.key.partition(".")[0] not in INLINE:
                pages, each, all_ = sums.get(base.path, ([], [0.0], [0.0]))
                least = base.pages - t.pages
                k = bisect_left(pages, -least)
                if 2 * slots <= t.around - (all_[k] - least * each[k]):
                    continue
            kept.add(t.path)
    return Template(frozenset(constants), frozenset(kept))


def expression(tokens: Iterable[Token]) -> str:
    """The wrapper of one host as a union-free regular expression: constants quoted, slots as #TEXT, groups with + and ?."""
    below: dict[int, list[Token]] = {}
    for t in sorted(tokens, key=lambda t: (t.place, t.path)):
        below.setdefault(t.parent, []).append(t)
    pages = {t.path: t.pages for ts in below.values() for t in ts}
    out: list[str] = []
    stack: list = [iter(below.get(0, []))]
    while stack:
        t = next(stack[-1], None)
        if t is None:
            stack.pop()
            continue
        if isinstance(t, str):
            out.append(t)
            continue
        own = "" if t.own == (0, 0) else f"'{t.own[0]:x}'" if t.own[0] == t.own[1] else "#TEXT"
        out.append(f"<{t.key}>({own}")
        end = f"){'+' if t.times > 1 else ''}{'?' if t.pages < pages.get(t.parent, t.pages) else ''}"
        stack.append(iter([*below.get(t.path, []), end]))
    return "".join(out)
