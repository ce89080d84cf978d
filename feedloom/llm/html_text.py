"""Operator 6: main text of HTML pages.

Parser events of the standard library are streamed into lines, one per block
element, each with its text, the number of tags in it and the characters
inside links.  Over the lines, the ratio of text outside links to tags is
smoothed with a Gaussian and split into two clusters by a threshold; the lines
above it are content.

Elements marked as boilerplate by name, role, class or id are left out unless
the clusters say that they are the body: a marked element with two content
lines or more stays if it holds twice the text of all that is not marked (a
class or id word that bodies carry too), or if nothing else has text (a word or
element that bodies hardly carry).  Menus and scripts are never text.

The content lines then select the region:

* ``article`` or ``main`` elements, if they hold at least half of the content;
* else the smallest container that holds most of it, from the first content
  line to the last, with the headings before it and the paragraphs of the same
  parent next to them.

Of the region, lines below the threshold that are mostly links go; every other
line stays, however short.  All steps are linear in the page: an element's
lines are a range, and what it holds is a difference of running sums.

Defined cases: null or empty pages, and pages without text, give an empty
text; markup that is cut off or wrongly nested is closed as browsers would for
the elements used here; character references are decoded; any white space in
a block (no-break spaces too) becomes one space; class and id words of inline
elements say nothing; repeated rows are rows like any other; other columns of
the input are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices

SLICE_BYTES = 4 << 20
FEED_CHARS = 1 << 16
SIGMA = 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
                  "pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never page text.
SILENT = frozenset("head title script style noscript template iframe object svg canvas audio video map select datalist "
                   "button textarea math noframes".split())
#: Elements and roles that are never page text, and elements that hardly are.
MENUS = frozenset("nav dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                  "toolbar".split())
ASIDES = frozenset("header footer aside form".split())
#: Class or id words of adverts, notices, comments and menus, which bodies hardly carry.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored sidebar nav navbar navigation "
                   "breadcrumb breadcrumbs cookie cookies consent gdpr newsletter signup login searchbox comment comments "
                   "commentlist disqus respond reply replies pagination pager".split())
#: Words that bodies may carry as well.
WEAK = frozenset("sponsor promo promotion banner side rail menu header masthead topbar footer notice notices notification "
                 "alert popup modal overlay subscribe subscription search share sharing social related recommended widget "
                 "toolbar skip copyright legal disclaimer".split())
#: Elements whose class says something of the whole page.
WHOLE = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments".split())
#: An open element that a start tag closes, up to the given enclosing elements.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"})}
P_STAYS = frozenset("button table td th caption".split())


def marked(tag: str, attrs: dict, in_article: bool) -> int:
    """3: never text; 2 or 1: boilerplate by strong or weak marks; 0: not marked."""
    words = set(re.split(r"[^a-z]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())) if attrs else set()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return 3
    if tag in WHOLE:
        return 2 if words & COMMENTS else 0
    if tag in MENUS or (attrs.get("role") or "").lower() in ROLES:
        return 3
    if in_article:
        words.discard("header")
    if tag in ASIDES and not (tag == "header" and in_article):
        return 2
    return (2 if words & STRONG else 1 if words & WEAK else 0) if tag in BLOCK else 0


class Line:
    __slots__ = ("text", "tags", "linked", "element")

    def __init__(self, element: int):
        self.text, self.tags, self.linked, self.element = [], 0, 0, element


class Element:
    """An element by its number: those around it, its marks, and the range of
    lines that began while it was open."""
    __slots__ = ("tag", "up", "depth", "mark", "never", "article", "link", "heading", "first", "last")

    def __init__(self, tag: str, up: int, above: "Element | None", attrs: dict, first: int):
        in_article = above is not None and above.article
        self.tag, self.up, self.first, self.last = tag, up, first, None
        self.depth = above.depth + 1 if above else 0
        self.article = tag in ("article", "main") or in_article
        self.mark = marked(tag, attrs, in_article)
        self.never = self.mark == 3 or tag in SILENT or above is not None and above.never
        self.link = tag == "a" or above is not None and above.link
        self.heading = tag in HEADINGS or above is not None and above.heading


class LineParser(HTMLParser):
    """Collects the lines and elements of a page from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[int] = []                   # numbers of the open elements
        self.at: dict[str, list[int]] = {}          # places in ``open`` of each tag
        self.elements: list[Element] = []
        self.lines: list[Line] = []
        self.line: Line | None = None

    # A declaration that is not closed or not known is a comment.
    def parse_html_declaration(self, i):
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def _place(self, tags) -> int:
        """Place of the innermost open element of one of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=-1)

    def _here(self) -> Line:
        if self.line is None:
            self.line = Line(self.open[-1] if self.open else -1)
            self.lines.append(self.line)
        return self.line

    def _pop(self, place: int):
        for number in reversed(self.open[place:]):
            e = self.elements[number]
            self.at[e.tag].pop()
            if e.tag in BLOCK:
                self.line = None
            e.last = len(self.lines)
        del self.open[place:]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self.line = None
            elif tag == "br" and self.line is not None:
                self.line.text.append(" ")
            if self.line is not None:
                self.line.tags += 1
            return
        if tag in BLOCK:
            p = self._place(("p",))
            if p > self._place(P_STAYS):
                self._pop(p)
        if tag in CLOSES:
            shut, within = CLOSES[tag]
            border, place = self._place(within), self._place(shut)
            while place > border:
                self._pop(place)
                place = self._place(shut) if tag == "tr" else -1
        if tag in BLOCK:
            self.line = None
        above = self.elements[self.open[-1]] if self.open else None
        e = Element(tag, self.open[-1] if self.open else -1, above, dict(attrs), len(self.lines))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.elements))
        self.elements.append(e)
        if tag in BLOCK or self.line is not None:
            self._here().tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:    # "<div/>" opens a div in HTML
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag("br", [])
        place = self._place((tag,))
        if place >= 0:
            if self.line is not None:
                self.line.tags += 1
            self._pop(place)

    def handle_data(self, data):
        top = self.elements[self.open[-1]] if self.open else None
        if top is not None and top.never or self.line is None and not data.strip():
            return
        line = self._here()
        line.text.append(data)
        if top is not None and top.link:
            line.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends count only what is there."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach:reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The border between two clusters (midpoint of their means, iterated)."""
    t = float(values.mean())
    for _ in range(50):
        low, high = values[values <= t], values[values > t]
        if not len(low) or not len(high):
            return t
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = float(new)
    return t


class Page:
    """The lines of a page that have text, as arrays, and its elements."""

    def __init__(self, html: str):
        parser = LineParser()
        for at in range(0, len(html), FEED_CHARS):
            parser.feed(html[at:at + FEED_CHARS])
        parser.close()
        parser._pop(0)
        texts = [" ".join("".join(x.text).split()) for x in parser.lines]
        keep = [i for i, t in enumerate(texts) if t]
        lines = [parser.lines[i] for i in keep]
        self.texts, self.elements = [texts[i] for i in keep], parser.elements
        number = np.concatenate([[0], np.cumsum([bool(t) for t in texts])]).astype(np.int64)
        of = lambda get: np.array([get(e) for e in parser.elements], dtype=np.int64)
        self.first, self.last = number[of(lambda e: e.first)], number[of(lambda e: e.last)]
        self.up, self.depth, self.mark = of(lambda e: e.up), of(lambda e: e.depth), of(lambda e: e.mark)
        self.element = np.array([x.element for x in lines], dtype=np.int64)
        outside = np.array([max(0, len(t) - x.linked) for t, x in zip(self.texts, lines)], dtype=float)
        self.size, self.tags = outside, np.array([max(1, x.tags) for x in lines], dtype=float)
        self.links = np.array([2 * x.linked > len(t) for t, x in zip(self.texts, lines)], dtype=bool)
        known = lambda get: np.array([x.element >= 0 and get(parser.elements[x.element]) for x in lines], dtype=bool)
        self.article, self.heading = known(lambda e: e.article), known(lambda e: e.heading)

    def held(self, values: np.ndarray) -> np.ndarray:
        """Sum of the lines' values in each element."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.last] - total[self.first]

    def inside(self, elements) -> np.ndarray:
        """Whether a line lies in one of the elements."""
        step = np.zeros(len(self.texts) + 1, dtype=np.int64)
        for n in elements:
            step[self.first[n]] += 1
            step[self.last[n]] -= 1
        return np.cumsum(step[:-1]) > 0

    def content(self, usable: np.ndarray, sigma: float) -> np.ndarray:
        """Usable lines whose smoothed ratio is in the upper cluster."""
        if not usable.any():
            return usable
        smoothed = smooth(np.where(usable, self.size / self.tags, 0.0), sigma)
        return usable & (self.size > 0) & (smoothed >= threshold(smoothed[usable]))


def usable_lines(page: Page, sigma: float) -> np.ndarray:
    """Lines outside the marked elements, and in those that are the body."""
    every = np.ones(len(page.texts), dtype=bool)
    suspects = [n for n in np.flatnonzero(page.mark) if page.last[n] > page.first[n]]
    if not suspects:
        return every
    size, many = page.held(page.size), page.held(page.content(every, sigma))
    free = page.size[~page.inside(suspects)].sum()
    # the marked element around each one, if any, and the text beside it there
    around: dict[int, int] = {}
    stack: list[int] = []
    for n in suspects:                                  # in the order of their start tags
        while stack and page.last[stack[-1]] < page.last[n] or stack and page.last[stack[-1]] <= page.first[n]:
            stack.pop()
        around[n] = stack[-1] if stack else -1
        stack.append(n)
    gone, kept = set(), set()
    for n in suspects:
        outer = around[n]
        if outer in gone:
            gone.add(n)
            continue
        beside = free + (size[outer] - size[n] if outer in kept else 0)
        body = many[n] > 1 and (beside == 0 if page.mark[n] == 2 else size[n] >= 2 * beside)
        (kept if body else gone).add(n)
    return ~page.inside(gone)


def extract(html: str | None, sigma: float = SIGMA) -> str:
    """Main text of a page, blocks joined by an empty line."""
    page = Page(html or "")
    usable = usable_lines(page, sigma)
    if not usable.any():
        return ""
    content = page.content(usable, sigma)
    if not content.any():
        content = usable
    size, links, last_line = page.size, page.links & ~page.heading, len(page.texts) - 1
    if page.article.any() and size[content & page.article].sum() * 2 >= size[content].sum():
        region = page.article & usable & (content | ~links)
    else:
        region = container(page, content) & usable
        at = np.flatnonzero(content & region)
        first, last = at[0], at[-1]
        while first and region[first - 1] and (page.heading[first - 1] or _sibling(page, first - 1, first)):
            first -= 1
        while last < last_line and region[last + 1] and _sibling(page, last + 1, last):
            last += 1
        order = np.arange(len(page.texts))
        region &= (order >= first) & (order <= last) & (content | ~page.links)
    return "\n\n".join(t for t, k in zip(page.texts, region) if k)


def _sibling(page: Page, i: int, of: int) -> bool:
    """Whether line i is text of the same parent element as its neighbour."""
    a, b = page.element[i], page.element[of]
    return not page.links[i] and a >= 0 and b >= 0 and page.up[a] == page.up[b]


def container(page: Page, content: np.ndarray) -> np.ndarray:
    """Lines of the innermost element that holds most of the content, in more
    than one line (a single block that outweighs the rest is not yet a container
    of blocks); all lines if there is none."""
    if len(page.elements):
        size = np.where(content, page.size, 0.0)
        fit = (2 * page.held(size) > size.sum()) & (page.held(content) > 1)
        if fit.any():
            return page.inside([np.flatnonzero(fit)[page.depth[fit].argmax()]])
    return np.ones(len(page.texts), dtype=bool)


def extract_text(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Per row (page_id, url, html): page_id, url, text, n_chars."""
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2, SLICE_BYTES):
                texts = [extract(h, sigma) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(run, schema)
