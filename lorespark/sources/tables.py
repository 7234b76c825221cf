"""Tables of HTML pages as grids: cells over several rows and columns fill all their places."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .html import SKIPPED

#: The most rows or columns of one cell, columns of a table, rows, and places.
SPAN, COLUMNS, ROWS, PLACES = 256, 256, 10_000, 100_000
#: Pages whose tables make a batch.
PAGES = 1024
GRID = "table_no int, error string, header_rows int, marked boolean, header array<string>, rows array<array<string>>, cells array<struct<row:int,col:int,rowspan:int,colspan:int,header:boolean,text:string>>"

# Pages of nothing but closed tables with closed rows and cells, spans as their only attributes, and text
# without tags or references. What the parser finds in these, a scan finds too.
_TEXT, _SPANS = "[^<&]*+", r"(?: +(?:row|col)span=(?:'[0-9]+'|\"[0-9]+\"|[0-9]+))*+"
_ROW = f"<tr>{_TEXT}(?:<(?:td{_SPANS}>{_TEXT}</td|th{_SPANS}>{_TEXT}</th)>{_TEXT})*+</tr>{_TEXT}"
_TABLE = f"<table>{_TEXT}(?:<thead>{_TEXT}((?:{_ROW})*+)</thead>{_TEXT})?+(?:<tbody>{_TEXT})?+((?:{_ROW})*+)(?:</tbody>{_TEXT})?+</table>"
PLAIN_PAGE = re.compile(f"{_TEXT}(?:{_TABLE}{_TEXT})*+")
PLAIN_TABLE = re.compile(_TABLE)
PLAIN_CELL = re.compile("<t([hd])([^>]*)>([^<]*)</")


class BadTable(ValueError):
    """A table that has no one grid."""


@dataclass(slots=True)
class Cell:
    rowspan: int
    colspan: int
    header: bool
    text: str = ""


class Tables(HTMLParser):
    """The outermost tables of a page, each a list of rows of cells, or why it has none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[list[Cell]] | str] = []
        self.rows: list[list[Cell]] = []
        self.row: list[Cell] | None = None
        self.cell: Cell | None = None
        self.depth, self.skipping, self.in_head, self.error = 0, 0, False, ""

    def fail(self, why: str) -> None:
        self.error = self.error or why

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skipping += 1
        if self.skipping or not (self.depth or tag == "table"):
            return
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows, self.row, self.cell, self.in_head, self.error = [], None, None, False, ""
            else:
                self.fail("nested_table")
        elif self.depth == 1 and tag == "thead":
            self.in_head = True
        elif self.depth == 1 and tag == "tr":
            if self.row is not None:
                self.fail("open_row")
            self.row = []
        elif self.depth == 1 and tag in ("td", "th") and self.row is not None:
            if self.cell is not None:
                self.fail("open_cell")
            spans = []
            for name in ("rowspan", "colspan"):
                value = (dict(attrs).get(name) or "1").strip()
                spans.append(int(value) if value.isascii() and value.isdigit() else 0)
            if not all(1 <= s <= SPAN for s in spans):
                self.fail("bad_span")
            self.cell = Cell(*spans, tag == "th" or self.in_head)
        elif tag == "br" and self.cell is not None:
            self.cell.text += "\n"

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.skipping:
            self.cell.text += data

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif self.skipping or not self.depth:
            return
        elif tag == "table":
            self.depth -= 1
            if not self.depth:
                if self.row is not None or self.cell is not None:
                    self.fail("open_row")
                self.found.append(self.error or self.rows)
        elif self.depth == 1 and tag == "thead":
            self.in_head = False
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            self.row.append(self.cell)
            self.cell = None
        elif self.depth == 1 and tag == "tr" and self.row is not None:
            if self.cell is not None:
                self.fail("open_cell")
            self.rows.append(self.row)
            self.row = None
            if len(self.rows) > ROWS:
                self.fail("too_many_rows")

    def finish(self) -> None:
        self.close()
        if self.depth:
            self.found.append("open_table")


@lru_cache(4096)
def _spans(attributes: str) -> tuple[int, int]:
    given = dict(re.findall(r"(row|col)span=['\"]?([0-9]+)", attributes))
    return int(given.get("row", 1)), int(given.get("col", 1))


def plain_tables(html: str) -> list[list[list[Cell]]] | None:
    """What Tables finds in a plain page; null for all others, and for tables that may fail by a span or their rows."""
    if not PLAIN_PAGE.fullmatch(html):
        return None
    found = []
    for head, body in PLAIN_TABLE.findall(html):
        rows = []
        for part, in_head in ((head, True), (body, False)):
            for row in part.split("</tr>")[:-1]:
                rows.append([Cell(*(_spans(spans) if spans else (1, 1)), kind == "h" or in_head, text) for kind, spans, text in PLAIN_CELL.findall(row)])
        if len(rows) > ROWS or not all(1 <= c.rowspan <= SPAN and 1 <= c.colspan <= SPAN for row in rows for c in row):
            return None
        found.append(rows)
    return found


def parsed_tables(html: str) -> list[list[list[Cell]] | str]:
    found = plain_tables(html)
    if found is None:
        parser = Tables()
        parser.feed(html)
        parser.finish()
        found = parser.found
    return found


def laid_out(rows: list[list[Cell]]) -> tuple[list[list[str]], list[tuple[int, int, Cell]]]:
    """(grid, placed): each cell goes to the first free column of its row and fills its rows and columns from there.

    Fails if a cell reaches beyond the last row, meets one that is there, or the grid gets too large.
    """
    taken: list[dict[int, str]] = [{} for _ in rows]
    placed, places = [], 0
    for r, row in enumerate(rows):
        column = 0
        for cell in row:
            while column in taken[r]:
                column += 1
            if r + cell.rowspan > len(rows):
                raise BadTable("rowspan_beyond_table")
            places += cell.rowspan * cell.colspan
            if column + cell.colspan > COLUMNS or places > PLACES:
                raise BadTable("grid_too_large")
            text = " ".join(cell.text.split())
            for below in taken[r : r + cell.rowspan]:
                for c in range(column, column + cell.colspan):
                    if c in below:
                        raise BadTable("overlapping_cells")
                    below[c] = text
            placed.append((r, column, cell))
            column += cell.colspan
    width = max((max(t, default=-1) for t in taken), default=-1) + 1
    if not width:
        raise BadTable("no_cells")
    if width * len(rows) > PLACES:
        raise BadTable("grid_too_large")
    return [[t.get(c, "") for c in range(width)] for t in taken], placed


def html_tables(html: str | None, with_cells: bool = True) -> list[dict]:
    """The outermost tables of a page in order, as rows of GRID; cells null unless asked for.

    The rows on top whose cells are all headers are the header, each column with its labels from above, every one once;
    without any the first row stands for it, and marked is false.
    """
    out = []
    for no, found in enumerate(parsed_tables(html or "")):
        made = {"table_no": no, "error": None, "header_rows": None, "marked": None, "header": None, "rows": None, "cells": None}
        try:
            if isinstance(found, str):
                raise BadTable(found)
            grid, placed = laid_out(found)
            heads = 0
            while heads < len(found) and found[heads] and all(c.header for c in found[heads]):
                heads += 1
            header = [" > ".join(dict.fromkeys(row[c] for row in grid[: heads or 1] if row[c])) for c in range(len(grid[0]))]
            cells = [{"row": r, "col": c, "rowspan": x.rowspan, "colspan": x.colspan, "header": x.header, "text": " ".join(x.text.split())} for r, c, x in placed] if with_cells else None
            made |= {"header_rows": heads or 1, "marked": heads > 0, "header": header, "rows": grid, "cells": cells}
        except BadTable as error:
            made["error"] = str(error)
        out.append(made)
    return out


def page_tables(pages: DataFrame, with_cells: bool = True) -> DataFrame:
    """(page_id, table_no, error, header_rows, marked, header, rows, cells) for the outermost tables of pages of (page_id, html).

    rows is the whole grid, the header's rows among them; a place that no cell fills is ''. Of a table without one grid
    (nested, not closed, spans that are no numbers from 1 to 256, cells that overlap or reach beyond the last row, no
    cells, too large) error says why and the rest is null. Null pages have no tables. with_cells: whether cells are wanted, else
    they are null.
    """
    schema = StructType.fromDDL(f"page_id {pages.schema['page_id'].dataType.simpleString()}, {GRID}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                rows = [(i, t) for i, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for t in html_tables(html, with_cells)]
                ids = pa.array([i for i, _ in rows], into.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([t[f.name] for _, t in rows], f.type) for f in list(into)[1:])], schema=into)

    return pages.select("page_id", "html").mapInArrow(parse, schema)


def table_rows(tables: DataFrame) -> DataFrame:
    """(page_id, table_no, row, values): the rows below each table's header, by the labels of its columns; of labels that repeat or
    are empty, the number of the column is the label."""
    sound = tables.filter("error is null")
    repeated = lambda x: F.size(F.filter("header", lambda y: y == x)) > 1
    labels = F.transform("header", lambda x, i: F.when((x == "") | repeated(x), i.cast("string")).otherwise(x))
    rows = sound.select("page_id", "table_no", "header_rows", labels.alias("labels"), F.posexplode("rows").alias("row", "cells")).filter("row >= header_rows")
    return rows.select("page_id", "table_no", (F.col("row") - F.col("header_rows")).alias("row"), F.map_from_arrays("labels", "cells").alias("values"))
