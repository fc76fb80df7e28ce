"""Main text of web pages from parser events, text-to-tag ratios and smoothed clustering.

The standard library's parser streams a page's tags and text.  Events become
*lines* (the text of one block element) with the number of tags in each, and a
tree of the elements that hold them.  Then:

1. Each line has a text-to-tag ratio: its characters outside links over its
   tags.  Hints set a ratio to 0: an element that is boilerplate by tag, role,
   class or id (menus, headers, footers, sidebars, notices, adverts, forms,
   reader comments), or a line outside the articles of a page that has some.  A
   name is no hint on an element that holds an article or, on a page without
   articles, most of the text, nor where it tells a state (`has-sidebar`, `comments-open`).
2. Ratios are smoothed along the page with a Gaussian.  Lines whose smoothed
   and own ratios reach a share of the ratios' deviation (or of their mean, if
   that is less) form the content cluster.
3. The elements in which clustered lines stand are the content regions.  They
   bring back what the threshold cut off: lines without a hint that stand in a
   region, in a list, table or quotation of it, between two clustered lines or
   in the same article; and headings right before what is kept.  Lines of links
   come back only inside an article or between clustered lines.

Whatever the cluster and its regions don't hold is left out; a page of which
every line were clustered would come out whole.

White space in a block becomes one space; blocks are joined by an empty line.
The work is linear in the page's length, however deep its elements nest.

Defined results: null or empty html, and pages without text, give an empty
text of 0 characters; null keys and repeated rows stay rows of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements whose text is never shown as text.
_UNSEEN = frozenset(
    "head script style noscript template svg button select textarea iframe object canvas audio video datalist math".split()
)
#: Elements that are boilerplate by their tag; the latter unless a page stands in them.
_APART = frozenset("nav footer aside dialog menu".split())
_PERHAPS = frozenset(["header", "form"])
_ARTICLE = frozenset(["article", "main"])
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that belong to the flow of what holds them.
_FLOW = frozenset("ul ol dl li dt dd table tbody thead tfoot tr blockquote figure figcaption caption pre details summary header".split())
_PAGE = frozenset(["", "html", "body"])
#: An element of the key closes open ones of the value, up to the nearest list or table.
_CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "tbody": frozenset(["tr", "td", "th", "thead"]), "tfoot": frozenset(["tr", "td", "th", "tbody"]),
}
_SCOPE = frozenset("ul ol dl table select body html article main section div nav aside".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs masthead header footer sidebar sidenav aside widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal "
    "overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations "
    "pagination pager toolbar skip search hidden tagcloud copyright disclaimer".split()
)
#: Names of what readers wrote: long texts too.
_READERS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that make a name tell a page's state, not what the element is.
_STATES = frozenset("has have with without no not is open opened closed enabled disabled allow allowed on off".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Streams a page into lines and the elements that hold them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: element: [parent, tag, unseen, boilerplate for sure, boilerplate by name]
        self.elements: list[list] = [[-1, "", False, False, False]]
        self.stack: list[int] = [0]
        #: places in the stack of each open tag, and of open blocks
        self.open: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = [0]
        #: line: (element, text, tags, characters in links)
        self.lines: list[tuple[int, str, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((self.stack[-1], text, self.tags, min(self.linked, len(text))))
                self.tags = self.linked = 0
            self.text = []

    def _pop_to(self, depth: int, line: bool = True) -> None:
        if line:
            self.end_line()
        while len(self.stack) > depth:
            tag = self.elements[self.stack.pop()][1]
            self.open[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def _push(self, tag: str, unseen: bool, sure: bool, named: bool) -> None:
        self.open[tag].append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.elements.append([self.stack[-1], tag, unseen, sure, named])
        self.stack.append(len(self.elements) - 1)

    def _innermost(self, tags: frozenset[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in ("td", "th") and self.text:
            self.text.append(" ")
        closes = _CLOSES.get(tag)
        if closes:
            depth = self._innermost(closes)
            if depth and depth >= self._innermost(_SCOPE):
                self._pop_to(depth, line=tag not in ("td", "th"))
        if tag in _BLOCK:
            if self.elements[self.stack[self.blocks[-1]]][1] == "p":  # a block ends an open paragraph
                self._pop_to(self.blocks[-1])
            self.end_line()
        if tag in _VOID:
            return
        unseen, sure, named = tag in _UNSEEN, tag in _APART, tag in _PERHAPS
        page = tag in ("body", "html", "main")
        for key, value in attrs:
            if not value:
                unseen = unseen or key == "hidden"
            elif key == "class" or key == "id":
                for name in () if page else value.split():
                    tokens = {t.lower() for t in _TOKEN.findall(name)}
                    if not tokens & _STATES:
                        named = named or bool(tokens & _NAMES)
                        sure = sure or bool(tokens & _READERS)
            elif key == "role":
                sure = sure or (value.lower() in _ROLES and not page and tag != "article")
            elif key == "style":
                unseen = unseen or bool(_HIDDEN.search(value))
            elif key == "aria-hidden" or key == "hidden":
                unseen = unseen or value.lower() in ("true", "hidden", "")
        if tag == "header" and (self.open.get("article") or self.open.get("main")):
            named = False  # the heading of an article is part of it
        self._push(tag, unseen, sure, named)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        places = self.open.get(tag)
        if not places:
            if tag == "p":
                self.end_line()
        elif tag in _BLOCK or tag in _UNSEEN:
            self._pop_to(places[-1])
        elif self.blocks[-1] < places[-1]:  # an inline element's end may not close blocks in it
            self._pop_to(places[-1], line=False)

    def handle_data(self, data):
        self.text.append(data)
        if self.open.get("a"):
            self.linked += len(" ".join(data.split()))


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Values along a page under a Gaussian, mirrored at both ends."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(values, radius, mode="symmetric" if len(values) >= radius else "edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def clustered(ratios: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Which lines belong to the content cluster: smoothed and own ratios of at least a share of the deviation or the mean."""
    least = share * min(ratios.std(), ratios.mean())
    return (smoothed(ratios) >= least) & (ratios >= least) & (ratios > 0)


def _hinted(elements: list[list], lines: list[tuple[int, str, int, int]], wrapper: float, article: float) -> list[bool]:
    """Lines whose ratio doesn't count."""
    n = len(elements)
    parent, tag = [e[0] for e in elements], [e[1] for e in elements]
    sure = [e[3] for e in elements]
    for i in range(1, n):
        sure[i] = sure[i] or sure[parent[i]]
    # a name is wrong about an element with an article or, on a page without articles, with most of the text
    size, holds = [0] * n, [tag[i] in _ARTICLE and not sure[i] and not elements[i][4] for i in range(n)]
    for at, text, _, _ in lines:
        if not sure[at]:
            size[at] += len(text)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    inside = holds[:]
    for i in range(n - 1, 0, -1):
        inside[parent[i]] = inside[parent[i]] or inside[i]
    most = size[0] if any(h and size[i] for i, h in enumerate(holds)) else wrapper * size[0]
    out = [sure[i] or (elements[i][4] and not inside[i] and size[i] <= most) for i in range(n)]
    for i in range(1, n):
        out[i] = out[i] or out[parent[i]]
    # lines outside articles, where articles have a share of the text
    within = [tag[i] in _ARTICLE and not out[i] for i in range(n)]
    for i in range(1, n):
        within[i] = within[i] or within[parent[i]]
    plain = [(at, len(text) - linked) for at, text, _, linked in lines if not out[at]]
    held = sum(c for at, c in plain if within[at])
    if held and held >= article * sum(c for _, c in plain):
        return [out[at] or not within[at] for at, _, _, _ in lines]
    return [out[at] for at, _, _, _ in lines]


def _regions(elements: list[list], lines: list[tuple[int, str, int, int]], core: np.ndarray, hinted: list[bool]) -> list[bool]:
    """The clustered lines and those that the regions around them bring back."""
    n = len(elements)
    block, flow, articles = [0] * n, [0] * n, [-1] * n
    for i in range(1, n):
        parent, tag = elements[i][0], elements[i][1]
        block[i] = i if tag in _BLOCK else block[parent]
        # the element in whose flow a block's content stands
        flow[i] = flow[parent] if tag in _FLOW or tag not in _BLOCK else i
        articles[i] = i if tag in _ARTICLE else articles[parent]

    def region(line: int) -> int:
        own = block[lines[line][0]]
        return flow[elements[own][0]] if own and elements[own][1] not in _PAGE else own

    spots = np.flatnonzero(core).tolist()
    regions, held = {region(i) for i in spots}, {articles[lines[i][0]] for i in spots} - {-1}
    keep = core.tolist()
    first, last = (spots[0], spots[-1]) if spots else (0, -1)
    for i, (at, text, _, linked) in enumerate(lines):
        if not keep[i] and not hinted[i]:
            article, between = articles[at] in held, first < i < last
            links = 2 * linked > len(text)
            keep[i] = article or (between or not links) and region(i) in regions or between and not links
    for i in range(len(lines) - 2, -1, -1):  # headings right before what is kept
        if not keep[i] and not hinted[i] and keep[i + 1]:
            keep[i] = elements[block[lines[i][0]]][1] in _HEADING
    return keep


def main_text(html: str | None, share: float = 0.5, wrapper: float = 0.6, article: float = 0.25) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    elements = parser.elements
    unseen = [e[2] for e in elements]
    for i in range(1, len(elements)):
        unseen[i] = unseen[i] or unseen[elements[i][0]]
    lines = [x for x in parser.lines if not unseen[x[0]]]
    if not lines:
        return ""
    hinted = _hinted(elements, lines, wrapper, article)
    ratios = np.array([0.0 if h else (len(text) - linked) / max(1, tags) for (_, text, tags, linked), h in zip(lines, hinted)])
    if not ratios.any():  # nothing but links without a hint
        ratios = np.array([0.0 if h else 1.0 for h in hinted])
    keep = _regions(elements, lines, clustered(ratios, share), hinted)
    return "\n\n".join(x[1] for x, k in zip(lines, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text and its length in code points of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], [id_col, url_col, "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col))
    return rows.mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")
