"""Main text of web pages from streaming parser events.

Events of the standard library's parser are gathered into lines, one a block element. Blocks of
menus, forms, notices and the like are left out by element and by names in their class and id that
say nothing else. When an element ends its shape is known, and with it what a name alone leaves open:
an element named after readers' comments goes, and so does an article without a heading within another
article; one whose name only hints at menus or adverts goes if most of its text is links; an unnamed one outside
of an article that is nearly all links is a menu if the page has other text. Of the others, the ratio of text to tags is smoothed with a Gaussian, and lines above the threshold
(the smoothed ratios' standard deviation) mark content. The region of a marked line, which is the
article or main element around it or else its parent element, is content as a whole, so that short
paragraphs between long ones stay.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements whose text is never article text.
LEFT_OUT = frozenset(
    "script style noscript template svg math canvas iframe object audio video head title nav aside footer form "
    "button select option textarea input label menu dialog".split()
)
#: Words of a class or id, or roles, that say the same.
WORDS_OUT = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget "
    "complementary contentinfo search".split()
)
#: Words for what readers write below an article; a name that begins or ends with one means that, but with a word that only says whether there are any.
COMMENTS = frozenset("comment comments disqus replies reply responses discussion".split())
WHETHER = frozenset("allow allowed closed disabled enabled has hide no off on open policy show with without".split())
#: Share of link text from which an element that is named like a menu, or has no telling name, is one, and links that it needs.
NAMED_LINKS, PLAIN_LINKS, LEAST_LINKS = 0.5, 0.8, 3
#: Words that say nothing of what a block is: a name of these and the ones above means the same as without them.
NEUTRAL = frozenset(
    "area bar block bottom box container content global group inner item items left list main outer page panel primary "
    "right secondary section site text the top wrap wrapper".split()
)
#: Left out too, but only outside of an article.
HEADERS = frozenset(("header", "masthead"))
REGIONS = frozenset(("article", "main"))
#: A start of these closes an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl div section article main body html td th".split())
WORD = re.compile("[a-z]+")
SIGMA = 1.0


HEADINGS = frozenset(("h1", "h2", "h3", "h4"))


class Element(NamedTuple):
    """An open element, and what had been seen when it began."""

    tag: str
    left_out: bool
    hint: bool
    nested: bool
    region: int
    number: int
    lines: int
    chars: int
    link_chars: int
    links: int
    headings: int


OUTSIDE = Element("", False, False, False, 0, 0, 0, 0, 0, 0, 0)


class Lines(HTMLParser):
    """Blocks in page order: text, tags seen in them, and the region that they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
        self.scopes: list[int] = []
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.count = 0
        self.region_of_text = 0
        self.begun = False
        self.chars = self.link_chars = self.links = self.anchors = self.headings = 0
        self.menus: list[tuple[int, int]] = []  # of lines, from and to

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.region_of_text))
            self.tags = 0
        self.text, self.begun = [], False

    def out(self, tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> bool | None:
        """Whether an element goes by what it is called; None if its shape has to tell."""
        if tag in LEFT_OUT or (tag == "header" and not in_region):
            return True
        hint = False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name in ("class", "id", "role") and value and tag not in ("html", "body"):
                out = WORDS_OUT if in_region else WORDS_OUT | HEADERS
                for words in map(WORD.findall, value.lower().split()):
                    if words and (words[0] in COMMENTS or words[-1] in COMMENTS) and not WHETHER & set(words):
                        return True
                    if tag in REGIONS or not out.intersection(words):
                        continue
                    if out | NEUTRAL >= set(words):
                        return True
                    hint = True
        return None if hint else False

    def settle(self, element: Element) -> None:
        """At an element's end: whether its lines stay."""
        if element.tag not in BLOCKS or element.left_out or element.tag in ("html", "body"):
            return
        self.flush()
        lines, chars, links = len(self.lines) - element.lines, self.chars - element.chars, self.link_chars - element.link_chars
        if not lines or not chars:
            return
        if element.hint and links >= NAMED_LINKS * chars:
            del self.lines[element.lines :]
        elif element.nested and self.headings == element.headings:
            del self.lines[element.lines :]
        elif not element.region < 0 and links >= PLAIN_LINKS * chars and self.links - element.links >= LEAST_LINKS:
            self.menus.append((element.lines, len(self.lines)))

    def push(self, element: Element) -> None:
        """Open elements are found by tag without a search: each costs the same however deep the page is."""
        self.places[element.tag].append(len(self.stack))
        if element.tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(element)

    def close_from(self, place: int) -> None:
        while len(self.stack) > place:
            element = self.stack[-1]
            self.settle(element)
            self.stack.pop()
            self.places[element.tag].pop()
            if element.tag in SCOPES:
                self.scopes.pop()
            self.anchors -= element.tag == "a"

    def close(self) -> None:
        super().close()
        self.close_from(0)
        self.flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            last = max((self.places[t][-1] for t in CLOSES.get(tag, {"p"}) if self.places[t]), default=-1)
            if last >= (self.scopes[-1] if self.scopes else 0):
                self.close_from(last)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        around = self.stack[-1] if self.stack else OUTSIDE
        region, in_region = around.region, around.region < 0
        self.count += 1
        if tag in REGIONS and not around.left_out:
            region = -self.count  # negative: an article or main element
        elif tag in BLOCKS and not in_region:
            region = self.count if tag not in ("p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6") else around.number
        out = self.out(tag, attrs, in_region)
        self.links += tag == "a"
        self.anchors += tag == "a"
        self.headings += tag in HEADINGS
        nested = tag == "article" and bool(self.places["article"])
        self.push(Element(tag, around.left_out or out is True, out is None, nested, region, self.count, len(self.lines), self.chars, self.link_chars, self.links, self.headings))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1].tag == tag and tag in ("svg", "path", "iframe"):
            self.close_from(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if self.places[tag]:
            self.close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        around = self.stack[-1] if self.stack else OUTSIDE
        if around.left_out:
            return
        seen = len(data) - data.count(" ")
        self.chars += seen
        self.link_chars += seen if self.anchors else 0
        if not self.begun and data.strip():
            self.region_of_text, self.begun = around.region, True
        self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian over neighbouring lines, weights of missing neighbours left out."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def read_lines(html: str | None) -> list[tuple[str, int, int]]:
    """The blocks that aren't left out: text, tags, region."""
    parser = Lines()
    try:
        parser.feed(html or "")
        parser.close()
    except AssertionError:  # a marked section that the parser doesn't know
        parser = Lines()
        parser.feed((html or "").replace("<![", "&lt;!["))
        parser.close()
    menu = np.zeros(len(parser.lines), bool)
    for start, end in parser.menus:
        menu[start:end] = True
    return parser.lines if menu.all() else [line for line, m in zip(parser.lines, menu) if not m]


def marked_lines(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """Which lines have a smoothed ratio of text to tags above the threshold."""
    ratios = smoothed(np.array([len(t) / max(1, n) for t, n, _ in lines]))
    return ratios >= min(float(ratios.std()), float(ratios.max()))


def main_text(html: str | None) -> str:
    """The article's blocks, joined by newlines; empty if there are none."""
    lines = read_lines(html)
    if not lines:
        return ""
    marked = marked_lines(lines)
    regions = {r for (_, _, r), m in zip(lines, marked) if m}
    if any(r < 0 for r in regions):
        regions = {r for r in regions if r < 0}
    return "\n".join(t for t, _, r in lines if r in regions)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page; null and empty pages have an empty text. No shuffle.

    Rows that repeat an id or have none are read one by one; other columns don't matter. Bytes that aren't UTF-8
    become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = (h.as_py() or b"" for h in batch.column(2).cast(pa.binary()))
            texts = [main_text(raw.decode("utf-8", "replace")) for raw in raws]
            yield pa.record_batch(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    return extract(table(spark, sf_dir, "pages"))
