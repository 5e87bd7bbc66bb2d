"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams its events; a page becomes a list of lines, one for each block
of text between block-level tags, each with its text, how much of it links hold, the number of tags met since the line
before, and the element that holds it. A line's ratio of text outside links to tags is smoothed with a Gaussian over its
neighbours on the same side of the borders of articles and doubted elements. A region is an article or main element, or
else the block element that directly holds a line; its ratio is the mean of its lines' smoothed ratios, weighted
by their length, times the share of its text outside links, and articles' ratios weigh more (ARTICLE). Regions above a
threshold (a share of the lines' standard deviation, at most the best region's ratio) are the content, with all their
lines, short ones too. The page's own article is content whatever its ratio: a main element, an article with a
heading of first order, or one without any heading that is the only one. (Articles with lesser headings alone are cards of
other stories, which the ratios judge.) Beside it, regions count that hold at least a third as much text.

Elements that by name or role are menus, headers, footers, sidebars, forms or dialogs never give
lines, nor do scripts, styles and hidden parts. Outside articles, lists and regions of links mostly (LINKED, three links or more) are
menus, which go if anything else is there. A class or id of noise words (menus, adverts, notices,
comments) makes a block element doubted: a region of its own, also inside an article. Its text goes where there is an article
outside of it, and within an article or on a page without one where undoubted text comes to more than a share of it
(DOUBTED; for comments, to anything at all), so that a page or article whose text is wrongly named keeps it. An element
that holds an article or main element isn't doubted.

Null, empty and text-free pages give an empty text. Character references are decoded, white space
inside a line becomes one space, lines are joined by one space; nothing is cut. Unclosed and
misnested tags are closed by the next end tag of an element around them; a tag that the page's end
cuts off is dropped. Repeated rows repeat in the result, ties can't arise, columns besides key, url and html are left out,
so their names can't clash. Time and memory are in proportion to the page's length, however many tags stay open: about
10 bytes a character and 250 bytes an open element, for one page at a time and a chunk's results.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, text_chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never content.
NOISE = frozenset("head title script style noscript template nav footer aside form button select option textarea fieldset iframe object svg canvas dialog menu audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A block element is doubted if all words of one of its classes, or of its id, are among these.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget header masthead "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "discussion disqus replies respond pagination pager toc skip".split()
)
#: Of these, the words that say nothing inside an article, which has such parts itself.
OWN_WORDS = frozenset("alert discussion header masthead notice notices".split())
REGIONS = frozenset(("article", "main"))
#: What an article's ratio is multiplied by; the share of a doubted element's text that other text must come to.
ARTICLE, DOUBTED = 2.0, 1 / 16
#: Share of links that makes a list or region a menu. Share of the page's own article that a region beside it must come to.
LINKED, BESIDE = 0.6, 1 / 3
COMMENT_WORDS = frozenset(("comment", "comments"))
REMARK_WORDS = COMMENT_WORDS | frozenset("discussion disqus replies respond".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset(("ul", "ol", "dl", "table"))
WORD = re.compile(r"[a-z]+|[0-9]+", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")
SPACE = re.compile(r"\s+")
TAG = re.compile(r"<[/!?a-zA-Z]")


class Line(NamedTuple):
    """zone: the article or doubted element around the line, else 0. within: its innermost list, else 0."""

    text: str
    linked: int
    links: int
    tags: int
    region: int
    zone: int
    within: int


class Open(NamedTuple):
    """An open element; block: the place in the stack of the innermost block element."""

    name: str
    region: int = 0
    noise: bool = False
    zone: int = 0
    in_article: bool = False
    within: int = 0
    block: int = -1


class Lines(HTMLParser):
    """Collects lines from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[Open] = []
        self.open: Counter[str] = Counter()  # open elements by name
        self.parts: list[str] = []
        self.tags = self.regions = self.linked = self.links = self.lists = 0
        self.articles: dict[int, set[str]] = {}  # region -> main, and the headings in it
        self.doubted: dict[int, tuple[int, int, bool, bool]] = {}  # region, zone and place in an article around it; whether it is remarks
        self.cleared: set[int] = set()  # doubted elements with an article inside

    def _top(self) -> Open:
        return self.stack[-1] if self.stack else Open("")

    def _end_line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self._top()
                self.lines.append(Line(text, min(self.linked, len(text)), self.links, self.tags, top.region, top.zone, top.within))
                self.tags = 0
            self.parts = []
            self.linked = self.links = 0

    def _is_noise(self, tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
        if tag in NOISE or tag == "header" and not in_article:
            return True
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    return True
            elif name == "role":
                if value.lower() in NOISE_ROLES:
                    return True
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
            elif name == "aria-hidden" and value == "true":
                return True
        return False

    def _doubts(self, tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool | None:
        """Whether a doubted element is by name one of remarks; None if it isn't doubted."""
        if tag in INLINE or tag in ("html", "body", "main"):
            return None
        signs = COMMENT_WORDS if tag == "article" else NOISE_WORDS - OWN_WORDS if in_article else NOISE_WORDS
        for name, value in attrs:
            if value and name in ("class", "id"):
                for token in value.split():
                    words = WORD.findall(CAMEL.sub(r"\1 \2", token).lower())
                    if words and (signs.intersection(words[:1]) if tag == "article" else signs.issuperset(words)):
                        return not REMARK_WORDS.isdisjoint(words)
        return None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        top = self._top()
        if tag not in INLINE:
            self._end_line()
            if tag == "p" and top.block >= 0 and self.stack[top.block].name == "p":
                self._close("p")
                top = self._top()
        elif tag == "a":
            self.links += 1
        if tag in VOID:
            return
        _, region, noise, zone, in_article, within, block = top
        noise = noise or self._is_noise(tag, attrs, in_article)
        remarks = self._doubts(tag, attrs, in_article) if attrs and not noise else None
        if remarks is not None:
            self.regions += 1
            self.doubted[self.regions] = (region, zone, in_article, remarks)
            region = zone = self.regions
        elif tag in REGIONS and zone not in self.articles:
            self.regions += 1
            if not noise:
                around = zone
                while around in self.doubted and around not in self.cleared:
                    self.cleared.add(around)
                    around = self.doubted[around][1]
                self.articles[self.regions] = {"main"} if tag == "main" else set()
            region = zone = self.regions
            in_article = True
        elif tag in HEADINGS and zone in self.articles:
            self.articles[zone].add(tag)
        elif tag not in INLINE and tag not in HEADINGS and tag not in ("p", "li", "blockquote", "pre", "ul", "ol", "tr", "td", "tbody") and not in_article:
            self.regions += 1
            region = self.regions
        if tag in LISTS:
            self.lists += 1
            within = self.lists
        self.open[tag] += 1
        self.stack.append(Open(tag, region, noise, zone, in_article, within, block if tag in INLINE else len(self.stack)))

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()

    def _close(self, tag: str) -> None:
        while True:  # the tag is open
            name = self.stack.pop().name
            self.open[name] -= 1
            if name == tag:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        if self.open[tag]:
            self._close(tag)

    def handle_data(self, data):
        if not self._top().noise:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)

    def finish(self) -> None:
        # what remains of a tag that the page's end cut off isn't text
        if cut := TAG.search(self.rawdata, self.rawdata.rfind(">") + 1):
            self.rawdata = self.rawdata[: cut.start()]
        self.close()
        self._end_line()
        self._clear()

    def _clear(self) -> None:
        """Lines of doubted elements that hold an article go to what is around these."""
        places: dict[tuple[int, int], tuple[int, int]] = {}
        for i, line in enumerate(self.lines):
            at, passed = (line.region, line.zone), []
            while at[1] in self.cleared and at not in places:
                passed.append(at)
                around, zone, in_article, _ = self.doubted[at[1]]
                at = (around if in_article else at[0], zone)
            at = places.get(at, at)
            places |= dict.fromkeys(passed, at)
            self.lines[i] = line._replace(region=at[0], zone=at[1])


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a kernel cut at two deviations and renormalised at the ends."""
    reach = max(1, int(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, "full")[reach : reach + len(x)]
    return full(values) / full(np.ones(len(values)))


def without_doubted(parser: Lines) -> list[Line]:
    """The lines without those of doubted elements that lose against other text."""
    size: dict[int, int] = {}
    for line in parser.lines:
        size[line.zone] = size.get(line.zone, 0) + len(line.text)
    articles = sum(n for zone, n in size.items() if zone in parser.articles)
    undoubted = sum(n for zone, n in size.items() if zone not in parser.doubted)
    lost = set()
    for zone, (_, around, in_article, remarks) in parser.doubted.items():
        against = size.get(around, 0) if in_article and around in parser.articles else undoubted
        if zone in size and (articles and not in_article or against > (0 if remarks else DOUBTED * size[zone])):
            lost.add(zone)
    return [line for line in parser.lines if line.zone not in lost]


def without_menus(lines: list[Line], articles: dict[int, set[str]]) -> list[Line]:
    """The lines without lists and regions outside articles that are links mostly, if anything is left."""
    sums: dict[tuple[str, int], list[int]] = {}
    places = [(("list", x.within), ("region", x.region)) if x.zone not in articles else () for x in lines]
    for line, at in zip(lines, places, strict=True):
        for place in at:
            own = sums.setdefault(place, [0, 0, 0])
            own[0], own[1], own[2] = own[0] + len(line.text), own[1] + line.linked, own[2] + line.links
    menus = {place for place, (n, linked, links) in sums.items() if place != ("list", 0) and links >= 3 and linked >= LINKED * n}
    return [line for line, at in zip(lines, places, strict=True) if not menus.intersection(at)] or lines


def own_articles(lines: list[Line], articles: dict[int, set[str]]) -> set[int]:
    """The articles that are content whatever their ratio."""
    there = {x.zone for x in lines if x.zone in articles}
    bare = {r for r in there if not articles[r]}
    return {r for r in there if articles[r] & {"main", "h1"}} or (bare if len(there) == 1 else set())


def main_text(html: str, sigma: float = 1.0, share: float = 0.5) -> str:
    parser = Lines()
    parser.feed(html)
    parser.finish()
    lines = without_menus(without_doubted(parser), parser.articles)
    if not lines:
        return ""
    zones = np.array([x.zone for x in lines])
    runs = np.split(np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines]), np.flatnonzero(np.diff(zones)) + 1)
    ratio = np.concatenate([smooth(run, sigma) for run in runs])
    sums: dict[int, list[float]] = {}
    for line, r in zip(lines, ratio.tolist(), strict=True):
        own = sums.setdefault(line.region, [0.0, 0, 0])
        own[0], own[1], own[2] = own[0] + r * len(line.text), own[1] + len(line.text), own[2] + line.linked
    scores = {region: (ARTICLE if region in parser.articles else 1.0) * total / n * (1 - linked / n) for region, (total, n, linked) in sums.items()}
    least = min(share * float(ratio.std()), max(scores.values()))
    kept = own_articles(lines, parser.articles)
    beside = BESIDE * max((sums[r][1] for r in kept), default=0)
    chosen = kept | {region for region, x in scores.items() if x >= least and sums[region][1] >= beside}
    return " ".join(x.text for x in lines if x.region in chosen)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """key, url, text, n_chars (code points): one row per page."""
    out, _ = arrow_schema("text string, n_chars bigint")
    schema = pages.select(key, url).schema.add(out[0]).add(out[1])

    def run(batches):
        for batch, sources in text_chunks(batches, "html"):
            texts = [main_text(s, sigma, share) for s in sources]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, schema)
