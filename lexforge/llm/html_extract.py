"""Main content of web pages by text-to-tag ratio.

The standard library's parser streams its events; nothing builds a tree. A line
ends at a line break of the source and at each block-level tag. For each line
the characters of visible text (outside scripts, styles and the like) are
divided by its tags. The logarithms of the ratios (plus one, else one long
paragraph would set the scale) are smoothed by a Gaussian over neighbouring
lines, and a threshold splits them in two clusters: two-means on the smoothed
values of one page. Lines of the upper cluster are the content.

Defined cases: a null page has null content and no lines; an empty page, or one
without visible text, has empty content; if all smoothed values are equal, all
lines are content. Broken markup is read as browsers' leniency in the parser
allows; unclosed scripts hide what follows, as in the parser; what stands after a
page's last ">" is text. A row with a null page_id or url is extracted like others.
Equal lines are each kept or not by their surroundings. Repeated rows are repeated.
An empty table gives no rows. Other columns are not used, whatever their names.
Whole pages are parsed, of any length, in time that grows with their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIGMA = 1.5
RADIUS = 3
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main meta nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template svg head title".split())


class LineEvents(HTMLParser):
    """Collects for each line its visible text and its number of tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self._parts: list[str] = []
        self._n = 0
        self._hidden: list[str] = []
        self._unclosed: set[str] = set()

    def read(self, page: str) -> None:
        """A whole page. No tag can end after the last ">", so the rest isn't searched for
        one again and again, and an end that a comment or section lacks is looked for once."""
        cut = page.rfind(">") + 1
        self.feed(page[:cut])
        super().close()
        self.handle_data(unescape(page[cut:]))
        self._end_line()

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._once("comment", super().parse_comment, i, report)

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        return self._once(self.rawdata[i : i + 5], super().parse_marked_section, i, report)

    def _once(self, kind: str, parse, i: int, report: bool) -> int:
        if kind in self._unclosed:
            return -1
        end = parse(i, report)
        if end < 0:
            self._unclosed.add(kind)
        return end

    def _end_line(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text or self._n:
            self.texts.append(text)
            self.tags.append(self._n)
            self._parts, self._n = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._n += 1
        if tag == "body":
            self._hidden.clear()
        elif tag in HIDDEN:
            self._hidden.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._n += 1

    def handle_endtag(self, tag: str) -> None:
        self._n += 1
        if tag in self._hidden:
            while self._hidden.pop() != tag:
                pass
        if tag in BLOCKS:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if self._hidden:
            return
        if "\n" not in data:
            self._parts.append(data)
            return
        first, *rest = data.split("\n")
        self._parts.append(first)
        for line in rest:
            self._end_line()
            self._parts.append(line)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the ends over those that exist."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(ratio, kernel)[radius : radius + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[radius : radius + len(ratio)]


def two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of numbers, from the extremes on."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def extract(page: str | None) -> tuple[str | None, int, int]:
    """(content, lines, lines of content) of one page."""
    if page is None:
        return None, 0, 0
    events = LineEvents()
    events.read(page)
    if not any(events.texts):
        return "", len(events.texts), 0
    chars = np.array([len(t) for t in events.texts], float)
    ratio = smoothed(np.log1p(chars / np.maximum(1, np.array(events.tags))))
    keep = ratio > two_means(ratio) if ratio.max() > ratio.min() else np.ones(len(ratio), bool)
    lines = [t for t, k in zip(events.texts, keep) if k and t]
    return "\n".join(lines), len(events.texts), len(lines)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [extract(p) for p in part.column(2).to_pylist()]
            cols = [part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "content", "n_lines", "n_content_lines"])


def contents(pages: DataFrame) -> DataFrame:
    """page_id, url, content, n_lines, n_content_lines."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_run, "page_id long, url string, content string, n_lines long, n_content_lines long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(table(spark, sf_dir, "pages"))
