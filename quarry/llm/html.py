"""HTML extraction by text-to-tag ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, ship, text_of, tidy, type_of

#: What ends a line, besides the source's own line ends.
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li link main meta nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is not shown as text.
HIDDEN = frozenset("head noscript script style svg template textarea title".split())
#: Elements that stand in a head; any other, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
#: What hides the rest of a page if it isn't closed, as in browsers: the parser takes it as raw text.
RAW = frozenset("script style".split())
COLUMNS = "text string, lines int, kept int"
#: Characters that the parser gets at a time.
CHUNK = 1 << 16


class Lines(HTMLParser):
    """Collects (text, number of tags) a line from the parser's events."""

    def __init__(self, shown: frozenset[int] = frozenset()) -> None:
        """shown: which hidden elements, by number, are not to be hidden."""
        super().__init__(convert_charrefs=True)
        self.shown, self.seen = shown, 0
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.hidden: list[str] = []
        self.numbers: list[int] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BREAKS:
            self.end_line()
        if self.hidden and tag == "body":  # a head that was never closed
            self.hidden.clear()
            self.numbers.clear()
        elif self.hidden == ["head"] and tag not in IN_HEAD:
            self.close_from(0)
        self.tags += 1
        if tag in HIDDEN:
            self.seen += 1
            if self.seen not in self.shown:
                self.hidden.append(tag)
                self.numbers.append(self.seen)

    def close_from(self, at: int) -> None:
        del self.hidden[at:], self.numbers[at:]

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in BREAKS:
            self.end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in self.hidden:
            self.close_from(len(self.hidden) - 1 - self.hidden[::-1].index(tag))
        if tag in BREAKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.hidden == ["head"] and data.strip():
            self.close_from(0)
        if self.hidden:
            return
        first, *more = data.split("\n")
        self.parts.append(first)
        for x in more:
            self.end_line()
            self.parts.append(x)


def lines_of(html: str) -> list[tuple[str, int]]:
    """The lines of a page, fed to the parser in chunks; whatever is malformed is text. A head
    ends where something begins that can't stand in it; where other hidden elements are never
    closed, scripts and styles apart, the page is read again with their text shown."""
    shown: frozenset[int] = frozenset()
    while True:
        parser = Lines(shown)
        for i in range(0, len(html), CHUNK):
            parser.feed(html[i : i + CHUNK])
        parser.close()
        parser.end_line()
        more = shown.union(n for n, tag in zip(parser.numbers, parser.hidden) if tag not in RAW and tag != "head")
        if more == shown:
            return parser.lines
        shown = more


def smoothed(ratios: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut off, and scaled anew, at the ends."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    full = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def two_means(values: np.ndarray) -> float:
    """The threshold that clusters values into low and high: midway between the means of
    the two sides, repeated until it stays. All values alike: that value."""
    low, high = float(values.min()), float(values.max())
    cut = (low + high) / 2
    for _ in range(100):
        above = values > cut
        if above.all() or not above.any():
            return cut
        new = (values[above].mean() + values[~above].mean()) / 2
        if math.isclose(new, cut, rel_tol=1e-9):
            break
        cut = float(new)
    return cut


def extract_text(html: str, radius: int = 2, sigma: float = 1.0, share: float = 1.0) -> tuple[str, int, int]:
    """(text, lines, lines kept). A line's ratio is its characters by its tags, or by 1 where
    it has none. Smoothed logarithms of the ratios are clustered in two; a line is content
    if it has text and its smoothed value is over ``share`` of the way from the lowest
    value to the threshold between the clusters."""
    lines = lines_of(html)
    if not lines:
        return "", 0, 0
    ratios = np.array([len(t) / max(1, n) for t, n in lines])
    smooth = smoothed(np.log1p(ratios), radius, sigma)
    low = float(smooth.min())
    cut = low + share * (two_means(smooth) - low)
    kept = [t for (t, _), v in zip(lines, smooth) if t and (v > cut or math.isclose(v, cut))]
    return "\n".join(kept), len(lines), len(kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = [extract_text(h) for h in part.column(1).to_pylist()]
            texts, lines, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(kept, pa.int32())], names=["page_id", "text", "lines", "kept"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text, lines, kept`` for each row; ids are of any type. Null and empty pages
    give an empty text of 0 lines; null ids and repeated rows are rows like any other, an
    empty table gives none; other columns are left out. Lines of one value are on one side of
    the threshold, all kept where all are alike."""
    ship(pages.sparkSession)
    return pages.select(col(id_col).alias("page_id"), text_of(html_col).alias("html")).mapInArrow(tidy(_run), f"page_id {type_of(pages, id_col)}, {COLUMNS}")
