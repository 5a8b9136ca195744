"""Main text of web pages from parser events, text-to-tag ratios per line, smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import wide_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas select datalist button textarea option audio video map".split())
#: Elements that are never part of an article, and those that may wrap one by accident.
HARD, SOFT = frozenset("nav footer aside".split()), frozenset("form dialog menu header fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
ARTICLE = frozenset(("article", "main"))
#: Words in class, id or role. Comments are never part of an article, whatever element holds them.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies gdpr "
    "dialog alert footer masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo "
    "promotion related recommended search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Elements whose text counts as a block of the element around them.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: What starts a tag, comment or declaration.
TAG_OPEN = re.compile(r"<[a-zA-Z/!?]")
#: Width of the smoothing, in lines. Clusters are apart if the low mean is under this share of the high one.
SIGMA, APART = 1.5, 0.5
#: A marked article, or a block of the high cluster, is dropped if its mean ratio is under this share of the best one's or the cluster's.
THIN = 0.1


class Line:
    __slots__ = ("chrome", "container", "parent", "parts", "tags")

    def __init__(self, chrome: bool, container: int, parent: int):
        self.chrome, self.container, self.parent, self.parts, self.tags = chrome, container, parent, [], 1


class Events(HTMLParser):
    """Gathers lines: the text between the bounds of block elements, with how many tags it holds and where it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple] = []  # (tag, silent, hard, soft, container, number)
        #: Where each tag is open, and where elements are that are not inline: no event walks the open elements.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.numbers = 0
        self.line: Line | None = None

    def parse_marked_section(self, i, report=1):
        """``<![`` of whatever kind is a comment up to the next ``>``, as browsers take it; the library raises at some."""
        return self.parse_bogus_comment(i, report)

    def push(self, entry: tuple) -> None:
        self.places.setdefault(entry[0], []).append(len(self.open))
        if entry[0] not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append(entry)

    def shut(self, i: int) -> None:
        """Close the element at place i and all inside it."""
        for entry in self.open[i:]:
            self.places[entry[0]].pop()
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()
        del self.open[i:]

    def at(self) -> tuple:
        return self.open[-1] if self.open else ("", False, False, False, -1, 0)

    def kind(self, tag: str, attrs) -> tuple[bool, bool, bool]:
        silent, hard, soft = tag in SILENT, tag in HARD, tag in SOFT
        for name, value in attrs:
            if name in ("class", "id", "role"):
                words = set(re.split(r"[^a-z0-9]+", (value or "").lower()))
                hard = hard or bool(words & COMMENT_WORDS)
                soft = soft or bool(words & CHROME_WORDS)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value.lower()):
                silent = True
        return silent, hard, soft

    def handle_starttag(self, tag, attrs):
        if tag in INLINE and not attrs:
            if self.line:
                self.line.tags += 1
            if tag == "br" and self.line:
                self.line.parts.append(" ")
            elif tag not in VOID:
                self.push((tag, *self.at()[1:]))
            return
        if tag not in INLINE:
            self.line = None
            self.close_implied(tag)
        elif self.line:
            self.line.tags += 1
            if tag == "br":
                self.line.parts.append(" ")
        if tag in VOID:
            return
        _, silent, hard, soft, container, parent = self.at()
        s, h, f = self.kind(tag, attrs)
        if tag in ("body", "html"):
            s = h = f = False
        self.numbers += 1
        if tag in ARTICLE and not (hard or h):
            # words in its class are its topic: share prices, related work, search results
            soft = f = False
            container = container if container >= 0 else self.numbers
        elif tag == "header" and container >= 0 and not any(True for n, v in attrs if n in ("class", "id", "role")):
            f = False  # the heading of an article
        self.push((tag, silent or s, hard or h, soft or f, container, parent if tag in INLINE or tag in BLOCKS else self.numbers))

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; an item, cell or row ends the one before it."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        if self.blocks:
            name = self.open[self.blocks[-1]][0]
            if name == "p" or name in ends:
                self.shut(self.blocks[-1])

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.line = None
        elif self.line:
            self.line.tags += 1
        where = self.places.get(tag)
        # an inline element ends inside the block that it stands in only
        if where and not (tag in INLINE and self.blocks and self.blocks[-1] > where[-1]):
            self.shut(where[-1])

    def handle_startendtag(self, tag, attrs):
        if tag in INLINE or tag in VOID:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        _, silent, hard, soft, container, parent = self.at()
        if silent:
            return
        if self.line is None:
            if data.isspace():
                return
            self.line = Line(hard or soft, container, parent)
            self.lines.append(self.line)
        self.line.parts.append(data)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that are left are scaled to one."""
    r = int(3 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k)[r : r + len(x)] / np.convolve(np.ones(len(x)), k)[r : r + len(x)]


def threshold(x: np.ndarray) -> float:
    """The bound between two clusters of x: midway between their means, from the mean of all until it holds still."""
    t = float(x.mean())
    for _ in range(50):
        low, high = x[x < t], x[x >= t]
        if not len(low) or not len(high):
            return float(x.min())
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def whole_tags(html: str) -> str:
    """html without a tag that its end cuts off: the parser would try it again at each later ``<``."""
    end = html.rfind(">") + 1
    cut_off = TAG_OPEN.search(html, end)
    return html[: cut_off.start()] if cut_off else html


def main_text(html: str) -> str:
    """Blocks of the article in page order, joined by an empty line.

    Lines in menus, footers, asides, forms, notices, adverts and comments never count. The others get their smoothed
    text-to-tag ratio, and two clusters of ratios part content from the rest, if they are clearly apart; else every block
    is content. Content brings along the blocks around it: those of the articles that the page marks, if content is in
    one, and other such articles unless their mean ratio is far under the content's; else all blocks of the same parents, and
    all between the first and the last content.
    """
    events = Events()
    events.feed(whole_tags(html))
    events.close()
    found = [(" ".join("".join(line.parts).split()), line) for line in events.lines]
    found = [(text, line) for text, line in found if text]
    if not found:
        return ""
    usable = np.array([not line.chrome for _, line in found])
    raw = np.array([len(text) / line.tags if ok else 0.0 for (text, line), ok in zip(found, usable, strict=True)])
    ratio = smoothed(raw)
    if not usable.any():
        return ""
    high = ratio >= threshold(ratio[usable])
    content, low = usable & high, raw[usable & ~high]
    level = raw[content].mean()
    if len(low) and low.mean() >= APART * level:
        content = usable
    else:  # a thin block beside a long one has a high smoothed ratio only
        content = content & (raw >= THIN * level)
    marked = {found[i][1].container for i in np.flatnonzero(content)} - {-1}
    if marked:  # what the page marks as articles, where the clusters agree: each with all its blocks
        size: dict[int, list[float]] = {}
        for (text, line), ok, r in zip(found, usable, ratio, strict=True):
            if ok and line.container >= 0:
                own = size.setdefault(line.container, [0.0, 0.0])
                own[0] += len(text) * float(r)
                own[1] += len(text)
        marked |= {c for c, (weight, length) in size.items() if weight >= THIN * level * length}
        content = usable & np.array([line.container in marked for _, line in found])
    else:
        at = np.flatnonzero(content)
        parents = {found[i][1].parent for i in at}
        inside = np.arange(len(found))
        inside = (inside > at[0]) & (inside < at[-1])
        content = usable & (inside | np.array([line.parent in parents for _, line in found]))
    return "\n\n".join(found[i][0] for i in np.flatnonzero(content))


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars (code points).

    Null or empty html gives empty text. Repeated pages and null ids each give a row; other columns of pages are not
    read. Nothing is shuffled; each page is parsed by itself, in one pass whose state is the open elements and lines. Any
    text is a page: malformed declarations are comments, stray end tags are left out, and deep nesting costs no more a tag.
    """
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())], names=schema.names)

    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = own.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return html_text(wide_table(spark, sf_dir, "pages"))
