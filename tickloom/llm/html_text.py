"""Main text of web pages by text-to-tag ratios over a streaming parser's events.

* The standard library's parser reports tags and text; a line ends at every tag that begins or
  ends a block. Each line has its characters, the tags met since the last line, the share
  of its text in links, and the elements that hold it.
* Lines inside menus, page headers, footers, sidebars, notices, adverts, scripts, styles and
  comments, known by tag, role, class or id, are set aside. Of a class or id the last word counts
  that says more than a place or a container; headings and paragraphs are not judged by it. A block
  so named stays if it holds every article of the page, or most text, mostly outside links; comments
  never do. A form is set aside unless it holds most of the page's text.
* The others' ratios of characters to tags are smoothed by a Gaussian over neighbouring lines
  and split into two clusters by a threshold between their means; the upper one is content.
* The region is the smallest element that holds nearly all content: `article` or `main` where
  they have most of it, otherwise the element reached by going down from the root while one
  child has at least 90 %. All lines of the region are kept, short ones too, so a one-word
  paragraph between long ones stays; outside `article` and `main`, lines of links only go.

Null and empty pages have an empty text. Pages without any block have one line. Repeated rows
and nulls in other columns pass through; further columns are not read. Character references
are decoded by the parser, white space inside a line becomes one space, lines are joined by
one space.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: A start tag that ends an open element, and the elements beyond which it does not reach.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
SCOPES = frozenset("article section div td th li blockquote body main table button".split())
NOISE_TAGS = frozenset("head title nav footer aside script style noscript template svg annotation button select option textarea iframe object canvas dialog menu input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form".split())
# Words of class and id names that mark what is not the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense advertorial sponsor sponsored promo promotion promotions banner banners sidebar sidebars sidenav aside rail menu menus nav navbar navigation "
    "topnav breadcrumb breadcrumbs pagination pager masthead topbar header footer colophon cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist disqus respond replies reply discussion newsletter subscribe subscription signup login share sharing social follow related recommended recommendations "
    "popular trending widget widgets toolbar skip copyright legal disclaimer search searchbox form".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
# Words after which a name still means what stands before.
PLACE_WORDS = frozenset(
    "area bar block box bottom btn button buttons center col column container content count desktop group icon icons inner item items left link links list main message mobile outer "
    "panel posts primary right row secondary section sections slot stories articles small large teaser text title tools top unit wide wrap wrapper zone".split()
)
# A name with one of these tells of a layout, and a header after one of the others is the article's.
LAYOUT_WORDS = frozenset("has is no with without".split())
ARTICLE_WORDS = frozenset("article content entry post story".split())
UNNAMED = frozenset("html body main p h1 h2 h3 h4 h5 h6".split())
MAIN = ("article", "main")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_MARKED = re.compile(r"<!\[[^>]*(>|$)")


class Line:
    __slots__ = ("form", "links", "named", "path", "tags", "text")

    def __init__(self, text: str, tags: int, links: int, path: tuple[int, ...], form: int | None, named: tuple[int, ...]):
        self.text, self.tags, self.links, self.path, self.form, self.named = text, tags, links, path, form, named


class Element:
    __slots__ = ("form", "inside", "named", "noise", "number", "tag")

    def __init__(self, tag: str, number: int, noise: bool, form: int | None, inside: bool, named: tuple[int, ...]):
        self.tag, self.number, self.noise, self.form, self.inside, self.named = tag, number, noise, form, inside, named


def _noise_word(name: str) -> str | None:
    """The word that makes a class or id name noise."""
    words = _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())
    if LAYOUT_WORDS.intersection(words[:-1]):
        return None
    while len(words) > 1 and words[-1] in PLACE_WORDS and words[-1] not in NOISE_WORDS:
        words.pop()
    if not words or words[-1] not in NOISE_WORDS or words[-1] == "header" and ARTICLE_WORDS.intersection(words):
        return None
    return words[-1]


def _named(attributes: list[tuple[str, str | None]], tag: str) -> set[str]:
    """Words of class and id that mark an element as noise."""
    if tag in UNNAMED:
        return set()
    found = {w for name, value in attributes if value and name in ("class", "id") for w in map(_noise_word, value.split()) if w}
    # An article is only set aside as a comment or an advert.
    return found & {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related", "recommended"} if tag == "article" else found


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(
        value and (name == "role" and value.lower() in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true") for name, value in attributes
    )


class Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tags_of: dict[int, str] = {0: ""}
        self.open: list[Element] = [Element("", 0, False, None, False, ())]
        self.pieces: list[str] = []
        # Named blocks, and whether as comments; and the named blocks around each article.
        self.comments: dict[int, bool] = {}
        self.articles: list[tuple[int, ...]] = []
        self.tags = self.linked = self.count = self.anchors = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        top = self.open[-1]
        if text and not top.noise:
            self.lines.append(Line(text, self.tags, self.linked, tuple(e.number for e in self.open), top.form, top.named))
        if text:
            self.tags = 0
        self.pieces, self.linked = [], 0

    def _close(self, k: int) -> None:
        self.anchors -= sum(e.tag == "a" for e in self.open[k:])
        del self.open[k:]

    def _reach(self, wanted: tuple[str, ...], stops) -> None:
        """Close the highest of the wanted elements below the first stop."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in wanted:
                self._close(k)
                return
            if tag in stops:
                return

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSES:
                self._reach(*CLOSES[tag])
            elif tag not in ("br", "option", "legend", "caption"):
                self._reach(("p",), SCOPES)
        if tag in VOID:
            return
        top = self.open[-1]
        inside = top.inside or tag in MAIN
        words, hidden = _named(attributes, tag), _hidden(attributes)
        noise = top.noise or tag in NOISE_TAGS or tag in ("header", "label") and not top.inside or hidden or bool(words) and tag not in BLOCKS
        if noise and tag in MAIN and not hidden and all(e.tag in ("nav", "header") for e in self.open if e.noise):
            # A menu or header that was never closed.
            noise = False
        self.count += 1
        self.tags_of[self.count] = tag
        named = top.named
        if words and not noise:
            named = (*named, self.count)
            self.comments[self.count] = bool(words & COMMENT_WORDS)
        if tag in MAIN and not noise and not words and not any(self.comments[n] for n in named):
            self.articles.append(named)
        form = self.count if tag == "form" and top.form is None else top.form
        self.open.append(Element(tag, self.count, noise, form, inside, named))
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if self.open[k].tag in ("article", "main", "td", "th") and tag not in MAIN and tag not in ("tr", "table", "tbody", "body", "html", "div", "section", "form"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].noise:
            return
        self.pieces.append(data)
        if self.anchors > 0:
            self.linked += len("".join(data.split()))


def smoothed(values: list[float], spread: float = 1.0) -> list[float]:
    reach = math.ceil(2 * spread)
    kernel = [math.exp(-(k * k) / (2 * spread * spread)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - reach):
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Between the means of two clusters."""
    low, high = min(values), max(values)
    for _ in range(20):
        middle = (low + high) / 2
        lower, upper = [v for v in values if v < middle], [v for v in values if v >= middle]
        if not lower or not upper:
            break
        new = sum(lower) / len(lower), sum(upper) / len(upper)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _region(lines: list[Line], content: list[bool], tags_of: dict[int, str]) -> tuple[list[Line], bool]:
    """The lines of the region, and whether it is marked as the article."""
    mass: dict[int, int] = {}
    for line, is_content in zip(lines, content, strict=True):
        for number in line.path if is_content else ():
            mass[number] = mass.get(number, 0) + len(line.text)
    total = mass.get(0, 0)
    for tag in MAIN:
        marked = [x for x in lines if any(tags_of[n] == tag for n in x.path)]
        if marked and 2 * sum(mass.get(n, 0) for n in {next(n for n in x.path if tags_of[n] == tag) for x in marked}) >= total:
            return marked, True
    root = 0
    while True:
        children = {x.path[x.path.index(root) + 1] for x in lines if root in x.path and x.path[-1] != root}
        best = max(children, key=lambda n: (mass.get(n, 0), -n), default=None)
        # A paragraph alone is no region: its neighbours belong to it.
        if best is None or mass.get(best, 0) < 0.9 * total or tags_of[best] in ("p", "h1", "h2", "h3", "b", "i", "em", "strong", "span", "a", "li", "pre", "blockquote"):
            break
        root = best
    return [x for x in lines if root in x.path], False


def _unnamed(events: Events) -> list[Line]:
    """The lines outside blocks named as noise, except blocks that hold the article."""
    size: dict[int, int] = {}
    links: dict[int, int] = {}
    whole = 0
    for x in events.lines:
        whole += len(x.text)
        for n in x.named:
            size[n] = size.get(n, 0) + len(x.text)
            links[n] = links.get(n, 0) + x.links
    kept = set()
    for n, is_comment in events.comments.items():
        holds_all = all(n in around for around in events.articles)
        much = 2 * size.get(n, 0) >= whole and 2 * links.get(n, 0) < size.get(n, 0)
        if not is_comment and holds_all and (events.articles or much):
            kept.add(n)
    out, tags = [], 0
    for x in events.lines:
        tags += x.tags
        if kept.issuperset(x.named):
            x.tags, tags = tags, 0
            out.append(x)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    events = Events()
    events.feed(_MARKED.sub("", html))
    events.close()
    events.end_line()
    lines = _unnamed(events)
    sizes: dict[int | None, int] = {}
    for x in lines:
        sizes[x.form] = sizes.get(x.form, 0) + len(x.text)
    whole = sum(sizes.values())
    lines = [x for x in lines if x.form is None or 2 * sizes[x.form] >= whole]
    if not lines:
        return ""
    ratios = smoothed([len(x.text) / max(1, x.tags) for x in lines])
    cut = threshold(ratios)
    chosen, marked = _region(lines, [v >= cut for v in ratios], events.tags_of)
    if not marked:
        chosen = [x for x in chosen if 10 * x.links < 9 * len("".join(x.text.split()))]
    return " ".join(x.text for x in chosen)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars, one row per page."""
    table = pages.select(*[F.col(c) for c in keep], F.col(html).cast("string").alias("__html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[: len(keep)])
    return table.mapInArrow(read, f"{kinds}, text string, n_chars long")


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.parquet(f"{folder}/pages.parquet"))
