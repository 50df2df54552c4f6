"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. Elements whose role or name says that they hold no
article text (navigation, footers, forms, scripts, adverts, comments ...) are stripped with the markup; by name no article and no
element with most of the page's text is. The text
lengths of the remaining lines, links not counted, are summed over sliding windows, on every page. The text surges where the sum
of a window rises above a threshold (on pages without article or with cards alone at most half of the page's largest sum) and dives where it falls to
the floor; the lines between surge and dive are kept, and those that join them without a list of links between.
An article tag raises the weights of its lines and settles the edges, nothing else: its lines weigh a surge more than their length,
so the text surges at the article's first line and dives behind its last one, however short its paragraphs are, and windows
don't reach over its ends. Cards (articles with a line of links that don't surge by length, on a page that does elsewhere) aren't raised.

Cases: null, empty or text-free html gives the empty text, and so does a page without article whose windows all stay at the floor; unclosed tags, comments and quotes are read to the end of
the page; nothing is cut, whatever the length; repeated pages give repeated rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import in_slices

# Lines in a window, and the characters that a window needs to surge and to stay.
WINDOW = 3
SURGE = 80
FLOOR = 12
# Above this share of linked characters a line is a list of links.
LINKED = 0.7

# Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
STRIPPED = frozenset("head nav footer aside form noscript template svg canvas object button select dialog menu script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in the class, id or role of an element that holds no article text.
STRIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios kommentare cookie cookies "
    "consent copyright disqus footer masthead menu nav navbar navigation newsletter notice pagination popup promo promotion related replies respond "
    "share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
# An end tag is implied where the next of these opens.
_CLOSED_BY = {
    "p": BLOCKS - {"body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
}
_MARKUP = re.compile(r"<!--|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass
class Line:
    text: str
    linked: int
    article: int  # number of the innermost article or main element that holds it, 0 outside


def _names_noise(attributes: str) -> bool:
    for groups in _NAMES.findall(attributes):
        for name in "".join(groups).split():
            if not STRIPPED_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(name)):
                return True
    return False


class _Reader:
    """Walks over the markup once and collects lines. ``spared``: numbers of elements that are not stripped by their class, id or role."""

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        self.lines: list[Line] = []
        self._parts: list[str] = []
        self._linked = 0
        self._open: list[tuple[str, bool, bool, int, int]] = []  # element, whether it strips at all and for good, its number if named, length before
        self._spared = spared
        self.length = 0  # unlinked text that only names strip, or nothing
        self.named: list[int] = []  # that of each element with such a name
        self._for_good = 0
        self._stripped = self._links = self._seen = 0
        self._articles: list[int] = []  # numbers of the open ones

    def text(self, piece: str) -> None:
        if self._for_good or not piece:
            return
        piece = unescape(piece)
        if not self._links:
            self.length += len(piece.strip())
        if self._stripped:
            return
        self._parts.append(piece)
        if self._links:
            self._linked += len(piece.strip())

    def end_line(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.lines.append(Line(text, min(self._linked, len(text)), self._articles[-1] if self._articles else 0))
            self._parts, self._linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.end_line()
            while self._open and name in _CLOSED_BY.get(self._open[-1][0], ()):
                self._pop()
        elif name == "br":
            self._parts.append(" ")
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            return
        header = name == "header" and not self._articles
        for_good, number = name in STRIPPED or header, -1
        if "=" in attributes and not for_good and name not in ("html", "body"):
            for_good = bool(_HIDDEN.search(attributes))
            if not for_good and name not in ("article", "main") and _names_noise(attributes):
                number = len(self.named)
                self.named.append(0)
        stripped = for_good or number >= 0 and number not in self._spared
        self._open.append((name, stripped, for_good, number, self.length))
        self._stripped += stripped
        self._for_good += for_good
        if name in ("article", "main"):
            self._seen += 1
            self._articles.append(self._seen)
        self._links += name == "a"

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.end_line()
        if not any(name == x[0] for x in self._open):
            return
        while self._pop() != name:
            pass

    def _pop(self) -> str:
        name, stripped, for_good, number, before = self._open.pop()
        self._stripped -= stripped
        self._for_good -= for_good
        if number >= 0:
            self.named[number] = self.length - before
        if name in ("article", "main"):
            self._articles.pop()
        self._links -= name == "a"
        return name

    def finish(self) -> None:
        self.end_line()
        while self._open:
            self._pop()


def page_lines(html: str) -> list[Line]:
    """The lines of a page: text without stripped elements, its linked characters, the article that holds it.

    An element that holds most of the page's unlinked text is not stripped for its name, unless an article lies outside such elements.
    """
    reader = _read(html, _Reader())
    if not any(x.article for x in reader.lines):
        spared = frozenset(i for i, length in enumerate(reader.named) if 2 * length > reader.length)
        if spared:
            reader = _read(html, _Reader(spared))
    return reader.lines


def _read(html: str, reader: _Reader) -> _Reader:
    at, n = 0, len(html)
    low = None
    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            reader.text(html[at:])
            break
        reader.text(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            reader.close(name)
            continue
        reader.open(name, attributes)
        if name in RAW:  # markup means nothing up to the end tag
            low = low or html.lower()
            low = low if len(low) == n else re.sub("[A-Z]", lambda c: c[0].lower(), html)
            end = low.find("</" + name, at)
            reader.text(html[at : n if end < 0 else end])
            at = n if end < 0 else end
    reader.finish()
    return reader


def _inside(weight: list[int], window: int, surge: int, floor: int) -> list[bool]:
    """Which lines lie between surge and dive of the window sums, with the unlinked ones that join them."""
    total = np.concatenate([[0], np.cumsum(weight)])
    ends = np.minimum(np.arange(len(weight)) + window, len(weight))
    out, inside = [], False
    for here, own in zip(total[ends] - total[:-1], weight, strict=True):
        if inside and here <= floor:
            inside = False
        elif not inside and here >= surge and own > 0:
            inside = True
        out.append(inside and own > 0)
    for order in (range(1, len(out)), range(len(out) - 2, -1, -1)):
        step = 1 if order.step < 0 else -1
        for i in order:
            out[i] = out[i] or out[i + step] and weight[i] > 0
    return out


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE, floor: int = FLOOR) -> list[Line]:
    """The lines between surge and dive of the window sums; no window reaches over the ends of an article."""
    lists = [x.linked > LINKED * len(x.text) for x in lines]
    weight = [0 if linked else len(x.text) - x.linked for x, linked in zip(lines, lists, strict=True)]
    articles: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(lines):
        articles[x.article].append(i)
    surging = {a for a, own in articles.items() if any(_inside([weight[i] for i in own], window, surge, floor))}
    linked = {a for a, own in articles.items() if a and a not in surging and any(lists[i] for i in own)}
    cards = linked if surging else set()
    if not articles.keys() - linked - {0}:  # without an article of its own, a short page surges at half of its largest window
        total = np.concatenate([[0], np.cumsum(weight)])
        largest = int(np.max(total[window:] - total[:-window], initial=total[-1] if len(weight) < window else 0))
        surge = min(surge, max(floor + 1, largest // 2))
    # Runs of lines for the windows: those of an article, those between two articles; cards stand aside.
    runs: dict[tuple[int, int], list[int]] = defaultdict(list)
    before = 0
    for i, x in enumerate(lines):
        if x.article and x.article not in cards:
            before = x.article
            weight[i] = len(x.text) + surge
        runs[(x.article, 0 if x.article else before)].append(i)
    kept = set()
    for own in runs.values():
        kept.update(i for i, inside in zip(own, _inside([weight[i] for i in own], window, surge, floor), strict=True) if inside)
    return [x for i, x in enumerate(lines) if i in kept]


def main_text(html: str | None) -> str:
    return "\n\n".join([x.text for x in main_lines(page_lines(html or ""))])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in in_slices(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
