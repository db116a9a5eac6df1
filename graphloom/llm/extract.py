"""HTML extraction by wrappers: the main text of every page.

Each host's wrapper (see wrappers) is aligned from all its pages: tasks align the pages they meet, and the rest is sums, minima and maxima per
place, so a host that holds most pages is never gathered. The wrapper tells template from text: places whose text agrees on several pages
that differ elsewhere are constants, the others hold slots. A page's article is its ``article`` elements, with each ``main`` instead of its
articles if that holds slots outside them, or else the lowest element that holds all slots which are neither boilerplate nor links. What of it
is left out, the wrapper decides first: constant containers go with or without a name, in article elements and outside of them, unless one
without a listed name holds most of the text around it, as an article does whose pages are near copies. Slots stay,
but for the kinds that are to be left out however much they vary (menus, headers, footers, sidebars, notices, adverts, forms, comments, by
element, role or name). Other listed names (legal, search, share ...) may be an article's as well: a slot so named stays if it holds most of
the slots' text around it, or is part of a sentence; where too few pages agree for a wrapper, and for lesser slots, the name stands. Of names
that only contain a listed word constants go and slots stay. A page on which nothing else is left is read as if its host had no constants.

Defined results: a null or empty html has empty text. A null url or one without a host belongs to the empty host. Repeated rows are judged
one by one. Pages may be nested to any depth. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Set
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import settle, strings
from graphloom.llm.html_tree import INLINE, RAW, VOID, Element, blocks, parse
from graphloom.llm.wrappers import AGREE, BOILERPLATE, COLUMNS, MAIN, OPEN, Part, Template, Wrapper, step, stream, template

#: Elements that are never article text, names (of classes, ids and roles, part by part) that mark such, and roles.
TAGS = frozenset("nav footer aside form noscript template svg button select dialog menu object audio video canvas head".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments commentlist reply replies respond disqus widget widgets copyright legal disclaimer search skip".split()
)
#: Listed names that an article may have as well: the wrapper decides.
EITHER = frozenset("subscription share sharing social widget widgets copyright legal disclaimer search skip".split())
#: Parts of names that say nothing by themselves: a name of such and listed ones alone marks boilerplate.
PLAIN = frozenset(
    "a an area bar block body bottom box btn button buttons col column container content count entry feed global group head header icon icons inner item items left link links list local main module outer page panel "
    "post posts primary right row secondary section site slot story text the thread title top unit wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Elements of running text, which stay in an article even where all pages agree on them.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr table tbody thead blockquote pre figcaption caption summary".split())
#: Elements that stay even where all pages agree on them.
LASTING = RUNNING.union(MAIN, ("body", "html"))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Places that a task holds before it hands them on.
HELD = 200_000


@lru_cache(1 << 16)
def naming(text: str) -> int:
    """BOILERPLATE, OPEN: one of the names is listed throughout, with a word that no article has or without; 1: a name contains a listed word;
    0: neither."""
    found = 0
    for name in text.split():
        parts = {p.lower() for p in _PART.findall(name)}
        listed = parts & NAMES
        if listed:
            found = max(found, 1 if any(p not in NAMES and p not in PLAIN and not p.isdigit() for p in parts) else OPEN if listed <= EITHER else BOILERPLATE)
    return found


def kind(e: Element, inside: bool) -> int:
    """What an element's tag, role and names say, as naming(). inside: of an article, whose own header stays."""
    if e.tag in TAGS or (e.tag == "header" and not inside):
        return BOILERPLATE
    if not e.raw or e.tag in ("body", "html"):
        return 0
    a = e.attributes
    if a.get("role", "").lower() in ROLES:
        return BOILERPLATE
    name = f"{a.get('class', '')} {a.get('id', '')}"
    if e.tag in MAIN:
        return 0 if {"comment", "comments", "reply"}.isdisjoint(p.lower() for p in _PART.findall(name)) else BOILERPLATE
    return naming(name)


def dropped(e: Element, inside: bool, own: int, known: Template) -> bool:
    """Whether an element is left out: of a kind that always is, or by what the host's wrapper decides on its place."""
    sort = kind(e, inside)
    if sort == BOILERPLATE:
        return True
    if own in known.constants and e.tag not in INLINE:
        return sort > 0 or e.tag not in LASTING
    return sort == OPEN and own not in known.kept


class Page:
    """The elements of a page in page order, without those under boilerplate, with what each holds of slots outside of links."""

    def __init__(self, root: Element, known: Template):
        self.elements, self.parents, self.skip = [root], [-1], set()
        top = step(0, root.key)
        good = [0]
        stack = [(iter(root.children), 0, top, False, False)]
        while stack:
            rest, block, path, linked, inside = stack[-1]
            x = next(rest, None)
            if x is None:
                stack.pop()
            elif isinstance(x, str):
                if not linked and path not in known.constants and x.strip():
                    good[block] += len(x.strip())
            elif x.tag in VOID or x.tag in RAW:
                continue
            elif x.tag in INLINE:
                if dropped(x, inside, step(path, x.key) if x.raw else 0, known):
                    self.skip.add(id(x))
                else:
                    stack.append((iter(x.children), block, path, linked or x.tag == "a", inside))
            else:
                own = step(path, x.key)
                if dropped(x, inside, own, known):
                    self.skip.add(id(x))
                    continue
                self.elements.append(x)
                self.parents.append(block)
                good.append(0)
                k = len(good) - 1
                stack.append((iter(x.children), k, own, False, inside or x.tag in MAIN))
        self.own, self.good = good, list(good)
        for k in range(len(good) - 1, 0, -1):
            self.good[self.parents[k]] += self.good[k]

    def article(self) -> list[Element]:
        """The article's elements in page order, none inside another."""
        n = len(self.elements)
        within, inner = [-1] * n, [0] * n
        for k in range(1, n):
            p = self.parents[k]
            within[k] = p if self.elements[p].tag in MAIN else within[p]
            if self.elements[k].tag == "article" and within[k] >= 0:
                inner[within[k]] += self.good[k]
        chosen = self._outermost(lambda k, tag: tag == "article" or (tag == "main" and self.good[k] > inner[k]))
        return chosen or self._outermost(lambda k, tag: tag == "main") or [self._lowest()]

    def _outermost(self, wanted: Callable[[int, str], bool]) -> list[Element]:
        """The wanted elements that are in no other wanted one."""
        covered, out = [False] * len(self.elements), []
        for k in range(1, len(self.elements)):
            covered[k] = covered[self.parents[k]]
            if not covered[k] and wanted(k, self.elements[k].tag):
                covered[k] = True
                out.append(self.elements[k])
        return out

    def _lowest(self) -> Element:
        """The lowest element that holds all there is of slots outside of links."""
        at = 0
        for k in range(1, len(self.elements)):
            if self.parents[k] == at and self.good[k] == self.good[0] > 0 and not self.own[at] and self.elements[k].tag not in RUNNING:
                at = k
        return self.elements[at]


def main_text(page: str, constants: Set[int], kept: Set[int] = frozenset()) -> str:
    """The text of a page whose host's template is of these constants and kept slots."""
    root = parse(page)
    for known in (Template(constants, kept), Template(kept=kept))[: 2 if constants else 1]:
        found = Page(root, known)
        text = "\n".join(b for e in found.article() for b in blocks(e, lambda x: id(x) in found.skip))
        if text:
            return text
    return ""


def host(url: str) -> str:
    try:
        return (urlsplit(url).netloc or "").lower()
    except ValueError:
        return ""


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split(" ") for x in f"host string, {COLUMNS}".split(", ")), strict=True)
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k] for k in kinds]
    met = Wrapper()

    def out() -> pa.RecordBatch:
        rows = [(h, *t.row()) for (h, _), t in met.tokens.items()]
        met.tokens.clear()
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], list(names))

    for b in batches:
        for url, page in zip(strings(b.column(0)), strings(b.column(1)), strict=True):
            met.align(host(url), stream(parse(page), kind))
            if len(met.tokens) > HELD:
                yield out()
    yield out()


def wrappers(pages: DataFrame) -> DataFrame:
    """The aligned tokens of every host: one row for each host and place."""
    own = pages.select("url", "html").mapInArrow(_streams, f"host string, {COLUMNS}")
    sums, least, most = ("pages", "chars", "linked", "letters", "around"), ("parent", "key", "own_low", "whole_low", "page_low", "place"), ("times", "kind", "own_high", "whole_high", "page_high")
    return own.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most))


def _templates(rows: pa.Table) -> pa.Table:
    found = template(map(Part, *(rows.column(c).to_pylist() for c in Part._fields)))
    lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (found.constants, found.kept)]
    made = pa.table([pa.array(rows.column("host").to_pylist()[:1], pa.string()), *lists], ["host", "constant", "kept"])
    return made if found.constants or found.kept else made.slice(0, 0)


def templates(tokens: DataFrame) -> DataFrame:
    """host, constant, kept: what the wrapper of each host decides, as long as its template has parts; no row where it decides nothing."""
    constant = F.expr("whole_low = whole_high and whole_low <> 0 as constant")
    met = settle(tokens.where(f"pages >= {AGREE} and page_low <> page_high").select("host", *Part._fields[:-1], constant), "places")
    return met.groupBy("host").applyInArrow(_templates, "host string, constant array<long>, kept array<long>")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[set[int], set[int]]] = {}
    for b in batches:
        texts = []
        for host_, page, constant, kept in zip(b.column(5).to_pylist(), strings(b.column(2)), b.column(3), b.column(4), strict=True):
            if host_ not in known:
                if len(known) >= 1000:
                    known.clear()
                known[host_] = set(constant.as_py() or ()), set(kept.as_py() or ())
            texts.append(main_text(page, *known[host_]) if page else "")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row."""
    found = settle(templates(wrappers(pages)), "templates")
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host_column().alias("host"))
    joined = hosted.join(found, "host", "left").select("page_id", "url", "html", "constant", "kept", "host")
    return joined.mapInArrow(_texts, "page_id long, url string, text string")


def _host_column():
    """As host(): between // and the next /, ? or #, in lower case."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
