"""Main text of raw web pages.

The standard library's parser streams events; text between block-level tags is a line. Each line has a text-to-tag
ratio; the ratios are smoothed with a Gaussian kernel and clustered by a threshold. The clusters select the content
*region*: the article elements, or else the main element, if that holds at least half of the clusters' mass, and else
the span of lines above the threshold. Every line of that region is kept, short ones too, but for elements that are
never part of an article: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments. An element that only its class, id or role marks as such is kept if the page's text is in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("head title script style noscript template iframe object svg math nav header footer aside form button select textarea menu dialog canvas audio video applet".split())
#: Words of a class, id or role that mark what is not the article.
MARKED = frozenset(
    "nav navbar navigation menu submenu topbar masthead header pageheader siteheader footer pagefooter sitefooter sidebar sidebars aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing social breadcrumb breadcrumbs pagination pager related recommended newsletter "
    "subscribe subscription signup login search widget toolbar skip copyright complementary contentinfo teaser tagcloud paywall".split()
)
#: Words that may stand beside those in a compound (``comment-list``); with any other word a compound marks nothing (``has-sidebar``).
BESIDE = frozenset(
    "list lists item items area section box block wrap wrapper container inner outer bar links link left right top bottom main site primary secondary global form forms button buttons icon icons post posts article articles stories story slot unit row "
    "text title thread trail message policy center middle".split()
)
#: Marked for what they are, however long.
READERS = frozenset("comment comments commentlist disqus respond reply replies related recommended teaser cookie cookies consent gdpr".split())
LAYOUT = frozenset(("html", "body", "main", "article"))
P_ENDS = BLOCK - {"option", "legend", "summary"}
SPLIT = re.compile(r"[^a-z]+")


#: Elements that are text themselves: a mark among other words (``share price``) says nothing about them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def marks(value: str, whole: bool = False) -> set[str]:
    """Marked words of those tokens of a class, id or role that consist of them and words that may stand beside them.

    If ``whole``, there are none unless all tokens are such.
    """
    out: set[str] = set()
    for token in value.lower().split():
        parts = {x for x in SPLIT.split(token) if len(x) > 1}
        if parts & MARKED and parts <= MARKED | BESIDE:
            out |= parts & MARKED
        elif whole:
            return set()
    return out


class Lines(HTMLParser):
    """Collects ``raw``: (parts of a line, tags since the line before, number of the article or main element it is in).

    A part is a text and the marked elements it is in; ``lines`` has the lines without what those hide.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.raw: list[tuple[list[tuple[str, tuple[int, ...]]], int, int]] = []
        self.open: list[tuple[str, bool, bool]] = []  # name, does it hide its content, is it marked
        self.count: Counter[str] = Counter()  # open elements by name: what is not open need not be looked for
        self.hidden = 0
        self.marked: tuple[int, ...] = ()  # open marked elements
        self.inside: list[bool] = []  # of each marked element: is it sure to hide its content
        self.around: set[int] = set()  # marked elements with an article or main element
        self.free: set[int] = {0}  # article and main elements outside marked ones
        self.outer: list[int] = [0]
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.tags = 0
        self.regions: list[int] = []
        self.kinds: list[str] = ["body"]

    def flush(self) -> None:
        if self.parts:
            self.raw.append((self.parts, self.tags, self.regions[-1] if self.regions else 0))
            self.parts = []
            self.tags = 0

    def lines(self) -> list[tuple[str, int, int]]:
        """A marked element outside articles is shown if half of the text is in it (a quarter, with an article) and no unmarked article has text."""
        total, mass, shown = 0, [0] * len(self.inside), set()
        free = False
        for parts, _, region in self.raw:
            for text, within in parts:
                n = len("".join(text.split()))
                total += n
                free |= bool(n and region and region in self.free and not within)
                for m in within:
                    mass[m] += n
        if not free:
            shown = {m for m, n in enumerate(mass) if not self.inside[m] and n > total * (0.25 if m in self.around else 0.5)}
        out, tags = [], 0
        for parts, k, region in self.raw:
            tags += k
            text = " ".join("".join(t for t, within in parts if shown.issuperset(within)).split())
            if text:
                out.append((text, tags, region))
                tags = 0
        return out

    def pop(self, at: int) -> None:
        for name, hides, marked in self.open[at:]:
            self.count[name] -= 1
            self.hidden -= hides
            if marked:
                self.marked = self.marked[:-1]
            if name in ("article", "main") and self.regions:
                self.regions.pop()
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append((" ", self.marked))
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            if self.open and tag in P_ENDS:
                self.close_implied("p", ("article", "aside", "blockquote", "body", "button", "div", "figure", "li", "main", "section", "table", "td"))
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.close_implied(tag, ("ul", "ol", "dl", "table", "menu", "select"))
        hides, found = tag in NEVER, set()
        if attrs and not hides and tag not in ("html", "body"):
            for k, v in attrs:
                if k == "hidden" or (k == "aria-hidden" and v == "true"):
                    hides = True
                elif v and k in ("class", "id", "role"):
                    found |= marks(v, tag in PROSE)
            if tag in LAYOUT:
                found &= {"comment", "comments", "teaser", "related"}
        self.open.append((tag, hides, bool(found)))
        self.count[tag] += 1
        self.hidden += hides
        if tag in ("article", "main"):
            self.kinds.append(tag)
            self.outer.append(self.regions[-1] if self.regions else 0)
            self.regions.append(len(self.kinds) - 1)
            if not found:
                self.around.update(self.marked)
                if not self.marked:
                    self.free.add(self.regions[-1])
        if found:
            self.marked += (len(self.inside),)
            self.inside.append(bool(self.regions) or bool(found & READERS))

    def close_implied(self, tag: str, within: tuple[str, ...]) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop(i)
                return
            if self.open[i][0] in within:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop(i)
                return
            if tag not in BLOCK and self.open[i][0] in ("article", "body", "main", "section", "div"):
                return  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append((data, self.marked))


def smoothed(ratios: list[float], sigma: float = 1.5) -> list[float]:
    """Gaussian smoothing over neighbouring lines, with weights renormalised at the ends."""
    r = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - r), min(len(ratios), i + r + 1)
        w = kernel[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(w, ratios[lo:hi])) / sum(w))
    return out


def main_text(html: str | None) -> str:
    """The article's lines joined by a newline; the empty string if there are none."""
    p = Lines()
    p.feed(html or "")
    if p.rawdata.startswith("<!--"):  # a comment without an end goes on to the end of the page
        p.rawdata = ""
    p.close()
    p.flush()
    lines = p.lines()
    if not lines:
        return ""
    score = smoothed([len(t) / (1 + k) for t, k, _ in lines])
    level = 0.5 * sum(score) / len(score)
    above = [i for i, s in enumerate(score) if s >= level]
    mass = sum(score[i] for i in above)
    for kind in ("article", "main"):
        within = [outermost(p, region, kind) for _, _, region in lines]
        if sum(score[i] for i in above if within[i]) >= 0.5 * mass:
            chosen = {within[i] for i in above if within[i]}
            return "\n".join(t for (t, _, _), w in zip(lines, within) if w in chosen)
    return "\n".join(t for t, _, _ in lines[above[0] : above[-1] + 1])


def outermost(p: Lines, region: int, kind: str) -> int:
    """The outermost element of the kind around a region, 0 if there is none."""
    out = 0
    while region:
        if p.kinds[region] == kind:
            out = region
        region = p.outer[region]
    return out


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; null html counts as empty and gives an empty text.

    Rows are independent, so repeated rows, ties and extra columns have no effect; an empty table stays empty.
    Broken markup is read as the parser reports it; unclosed paragraphs end at the next block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
