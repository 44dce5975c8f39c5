"""Main text of web pages by smoothed text-to-tag ratios of lines.

The standard library's parser streams a page's events; each line (a block of text
between block-level tags) gets its ratio of text outside links to tags.  Elements
that are boilerplate by tag, role, or words of their class or id make the tags of
the lines within count `DULL` times; one that is so by its words alone does not
where it holds an article, a main heading or, in several lines, most of the page's text.
Regions are the lines of one article or main element or, outside these, of one block, those
in boilerplate apart.  Ratios are smoothed with a Gaussian along each region; regions whose
ratios (those of `LEAST` or more) add up to `PART` of the best one's are content, with what lies in
their blocks and with gaps of up to `GAP` lines between them.

Rules: a null or empty html gives an empty text; broken markup is read as far as
it goes; character references are decoded; nothing is cut off by length or depth, and
work is linear in both;
repeated rows come back once each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit, textkit

_UNSEEN = frozenset("script style noscript template head title svg iframe object canvas button select option textarea label input fieldset".split())
_DULL_TAGS = frozenset("nav footer aside form dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd mark meta q s samp small span strike strong sub sup time tt u var wbr link".split())
#: Tags that don't end a line: what they hold flows with the text around, or isn't text.
_FLOWING = _INLINE | frozenset("script style template noscript input button label select option textarea svg iframe object canvas".split())
_DULL_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu topbar header masthead footer sidebar rail aside widget "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending "
    "breadcrumb breadcrumbs pagination pager toolbar copyright legal disclaimer contentinfo complementary search skip".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_DULL_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Beginnings of class names that tell of a layout, or of a part of an article, not of the element's kind.
_ABOUT = ("has-", "no-", "with-", "without-", "is-", "not-", "entry-", "article-", "post-", "story-", "page-")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CLOSES_P = frozenset("p div ul ol li table section article aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre hr main figure dl dt dd".split())
#: What a boilerplate element makes of each tag of its lines.
DULL = 4096
#: Part of the best region's ratios that content reaches, and the least ratio that adds to a region's.
PART, LEAST = 0.25, 0.1
#: Lines of other regions that content takes in between two of its lines.
GAP = 3


def _kind(tag: str, attrs: list) -> tuple[bool, int]:
    """Whether an element is never text, and how dull it is: 0, 1 by its words alone, 2 surely."""
    unseen, dull = tag in _UNSEEN, 2 if tag in _DULL_TAGS else 1 if tag == "header" else 0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "")):
            unseen = True
        elif name == "role" and value in _DULL_ROLES:
            dull = 2
        elif name in ("class", "id") and value and not dull and tag not in ("html", "body", "main", "h1") and tag not in _INLINE:
            for token in value.lower().replace("_", "-").split():
                words = _WORDS.findall(token)
                if not _COMMENTS.isdisjoint(words):
                    dull = 2
                elif not token.startswith(_ABOUT) and not _DULL_WORDS.isdisjoint(words):
                    dull = max(dull, 1)
    return unseen, dull


class _Open(NamedTuple):
    """An open element, and what is near it: positions in the list of open elements, -1 for none."""

    tag: str
    block: int
    unseen: bool
    dull: int  # the innermost dull element that holds it
    body: int  # the block of the innermost article or main element, or 0
    p: int  # the p that a new block ends
    item: int  # the li or p that a new li ends


_OUTSIDE = _Open("", 0, False, -1, 0, -1, -1)


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, characters in links, block that holds it, innermost dull element or -1,
    block of the innermost article or main element or 0).

    Dull elements are numbered as they open, each with the one around it (`around`), so what holds
    for all of a line's is worked out in one pass over them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag, where it is open
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.outer = [0]  # of each block, the one around it
        self.at = _OUTSIDE
        self.around: list[int] = []
        self.sure: list[bool] = []  # of each dull element: whether by more than its words
        self.excused: list[bool] = []  # whether it holds what a dull element doesn't hold

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, max(1, self.tags), self.linked, self.at.block, self.at.dull, self.at.body))
            self.tags = self.linked = 0
        self.text = []

    def push(self, tag: str, attrs: list) -> None:
        unseen, dull = _kind(tag, attrs)
        within = self.at.dull
        if tag in ("article", "main", "h1") and not dull and within >= 0:  # what holds these is dull by more than words, or not at all
            self.excused[within] = True
        if tag == "header" and self.places["article"]:  # an article's own
            dull = 0
        if dull:
            self.around.append(within)
            self.sure.append(dull == 2)
            self.excused.append(False)
            within = len(self.sure) - 1
        block = self.at.block
        if tag not in _INLINE and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "dt", "dd"):
            self.outer.append(block)
            block = len(self.outer) - 1
        here = len(self.open)
        p = here if tag == "p" else self.at.p if tag in _INLINE else -1
        item = here if tag in ("p", "li") else -1 if tag in ("ul", "ol", "menu") else self.at.item
        body = block if tag in ("article", "main") else self.at.body
        self.at = _Open(tag, block, self.at.unseen or unseen, within, body, p, item)
        self.open.append(self.at)
        self.places[tag].append(here)

    def pop(self, size: int) -> None:
        for element in self.open[size:]:
            self.places[element.tag].pop()
        del self.open[size:]
        self.at = self.open[-1] if self.open else _OUTSIDE

    def close_before(self, tag: str) -> None:
        """What a new block ends: an open p, or the item before it."""
        place = self.at.item if tag == "li" else self.at.p
        if place >= 0:
            self.pop(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in _FLOWING:
            self.flush()
        if tag not in _VOID:
            if tag in _CLOSES_P:
                self.close_before(tag)
            self.push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in _FLOWING:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in _FLOWING:
            self.flush()
        if self.places[tag]:
            self.pop(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.at.unseen:
            self.text.append(data)
            if self.places["a"]:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Ratios under a Gaussian window of radius 2, renormalised at the ends."""
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / (2 * sigma * sigma))
    return np.convolve(ratios, kernel, "full")[2:-2] / np.convolve(np.ones(len(ratios)), kernel, "full")[2:-2]


def line_ratios(lines: list[tuple], dull: np.ndarray) -> np.ndarray:
    """Characters outside links to tags; the tags of dull lines count DULL times."""
    return np.array([max(0, len(t) - linked) / tags for t, tags, linked, *_ in lines]) / np.where(dull, DULL, 1)


def selected(ratios: np.ndarray, dull: np.ndarray, blocks: np.ndarray, bodies: np.ndarray, outer: list[int]) -> np.ndarray:
    """Which lines the content regions hold; outer has the block around each block."""
    region = 2 * np.where(bodies > 0, bodies, blocks) + dull
    order = np.argsort(region, kind="stable")
    names, starts = np.unique(region[order], return_index=True)
    levels = np.concatenate([smoothed(part) for part in np.split(ratios[order], starts[1:])])
    sums = np.add.reduceat(np.where(levels >= LEAST, levels, 0), starts)
    content = names[(sums > 0) & (sums >= PART * sums.max())]
    holds = np.zeros((len(outer), 2), bool)
    holds[content // 2, content % 2] = True
    within = holds.tolist()
    for b in range(1, len(outer)):  # a block lies in what the blocks around it lie in
        up = within[outer[b]]
        within[b] = [within[b][0] or up[0], within[b][1] or up[1]]
    keep = np.array(within)[blocks, dull.astype(int)] | np.isin(region, content)
    at = np.flatnonzero(keep)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if 1 < j - i <= GAP + 1 and not dull[i : j + 1].any():
            keep[i:j] = True
    return keep


def dull_lines(page: _Lines) -> np.ndarray:
    """Which lines lie in a dull element that nothing excuses."""
    count = len(page.around)
    held, several, excused = [0] * count, [0] * count, page.excused.copy()
    for text, _, linked, _, d, _ in page.lines:
        if d >= 0:
            held[d] += len(text) - linked
            several[d] += 1
    for d in range(count - 1, -1, -1):  # what an element holds, those around it hold too
        up = page.around[d]
        if up >= 0:
            held[up] += held[d]
            several[up] += several[d]
            excused[up] |= excused[d]
    most = sum(len(t) - linked for t, _, linked, *_ in page.lines) / 2
    dull = [False] * (count + 1)  # the last one stands for none
    for d in range(count):
        free = not page.sure[d] and (excused[d] or held[d] > most and several[d] > 2)
        dull[d] = not free or dull[page.around[d]]
    return np.array([dull[d] for *_, d, _ in page.lines])


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    dull = dull_lines(parser)
    blocks, bodies = (np.array([line[k] for line in lines]) for k in (3, 5))
    keep = selected(line_ratios(lines, dull), dull, blocks, bodies, parser.outer)
    return "\n".join(t for (t, *_), k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of pages."""
    schema = pages.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in textkit.slices(whole)):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return sparkkit.mapped(pages.select(id_col, url_col, F.col(html_col).cast("string").alias("_html")), run, schema)
