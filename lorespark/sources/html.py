"""HTML pages to blocks of text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style"}
BLOCKS = {"p", "div", "li", "br", "section", "article", "header", "footer", "nav", "main", "aside", "ul", "ol", "tr", "table", "blockquote", "pre", "title", "h1", "h2", "h3", "h4", "h5", "h6"}


class Blocks(HTMLParser):
    """Collects (kind, level, text) of a page: headings with their level, table rows as cells between bars, all else as text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, str]] = []
        self.held: list[str] = []
        self.cells: list[str] | None = None
        self.kind, self.level, self.skipping = "text", 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.found.append((self.kind, self.level, text))
        self.held = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipping += tag in SKIPPED
        if tag in ("td", "th") and self.cells is not None:
            self.held = []
        elif tag in BLOCKS:
            self.flush()
            self.cells = [] if tag == "tr" else self.cells
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            self.kind, self.level = ("heading", int(tag[1])) if heading else ("list" if tag == "li" else "text", 0)

    def handle_endtag(self, tag: str) -> None:
        self.skipping = max(0, self.skipping - (tag in SKIPPED))
        if tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join("".join(self.held).split()))
            self.held = []
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.found.append(("table", 0, "| " + " | ".join(c.replace("|", "\\|") for c in self.cells) + " |"))
            self.cells, self.held = None, []
        elif tag in BLOCKS:
            self.flush()
            self.kind, self.level = "text", 0

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.held.append(data)


def html_blocks(html: str | None) -> list[tuple[str, int, str]]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.found


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, kind, level, text) for pages of (page_id, html)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *b) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, b in enumerate(html_blocks(x))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "block", "kind", "level", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(parse, "page_id long, block int, kind string, level int, text string")
