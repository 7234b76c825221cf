"""What of expected texts is found in pages that an engine has read: anchors, pairs in one row of a table, times."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_where
from ..functions.text import substring_distance, unspaced
from ..sources.html import html_blocks
from .documents import DASHES, table_cells


def table_rows(markdown: str) -> list[list[str]]:
    """The cells of all rows of tables, in HTML or in Markdown, as unspaced text."""
    rows = [table_cells(line) for line in markdown.splitlines() if line.strip().startswith("|") and not re.fullmatch(DASHES, line)]
    if "<t" in markdown.lower():
        rows += [table_cells(text) for kind, _, text in html_blocks(markdown) if kind == "table"]
    return [[unspaced(c) for c in row] for row in rows]


def measured(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """(page_id, engine, errors, pairs) for outputs of (page_id, engine, markdown) of pages that expected has: the error of
    each anchor, its least edit distance to any part of the page by its length, and whether some row of a table has
    both labels of each pair.

    expected: (page_id, anchors, pairs), arrays of texts and of pairs of texts. Texts count unspaced and folded; anchors
    without characters have no error, and a null page has none of them.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, pairs = [], []
            for markdown, anchors, wanted in zip(*(batch.column(c).to_pylist() for c in ("markdown", "anchors", "pairs")), strict=True):
                text = unspaced(markdown)
                rows = table_rows(markdown or "") if wanted else []
                told = [a for a in map(unspaced, anchors or []) if a]
                errors.append([substring_distance(a, text) / len(a) for a in told])
                pairs.append([any(all(any(unspaced(label) in cell for cell in row) for label in pair) for row in rows) for pair in wanted or []])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.list_(pa.float64())), pa.array(pairs, pa.list_(pa.bool_()))], ["page_id", "engine", "errors", "pairs"])

    rows = outputs.select("page_id", "engine", "markdown").join(expected.select("page_id", "anchors", "pairs"), "page_id")
    return rows.mapInArrow(measure, f"page_id {rows.schema['page_id'].dataType.simpleString()}, engine string, errors array<double>, pairs array<boolean>")


def anchor_report(outputs: DataFrame, expected: DataFrame, near: float = 0.1) -> DataFrame:
    """Per engine: pages, those that were read, anchors in those, found exactly or nearly, pairs and those kept, characters, seconds in all,
    and the median of seconds after the engine's first page.

    outputs: (page_id, engine, place, status, seconds, markdown). A page that was not read counts as a page alone. Times are
    counted by milliseconds, so that an engine with very many pages is no list in one task.
    """
    read = F.col("status") == "ok"
    found = measured(outputs.filter(read), expected)
    sums = found.groupBy("engine").agg(
        F.sum(F.size("errors")).alias("anchors"),
        F.sum(F.size(F.filter("errors", lambda e: e == 0))).alias("exact"),
        F.sum(F.size(F.filter("errors", lambda e: e <= near))).alias("near"),
        F.sum(F.size("pairs")).alias("pairs"),
        F.sum(F.size(F.filter("pairs", lambda p: p))).alias("pairs_kept"),
    )
    first = outputs.groupBy("engine").agg(F.min("place").alias("first"))
    pages = outputs.groupBy("engine").agg(F.count("*").alias("pages"), count_where(read).alias("read"), F.sum(F.when(read, F.length("markdown"))).alias("chars"), F.round(F.sum(F.when(read, F.col("seconds"))), 3).alias("seconds"))
    warm = outputs.join(first, "engine").filter(read & (F.col("place") > F.col("first"))).groupBy("engine", F.round("seconds", 3).alias("at")).agg(F.count("*").alias("k"))
    every = Window.partitionBy("engine")
    warm = warm.withColumn("upto", F.sum("k").over(every.orderBy("at"))).withColumn("n", F.sum("k").over(every))
    middle = lambda place: F.min(F.when(F.col("upto") >= place, F.col("at")))
    median = warm.groupBy("engine").agg(F.round((middle(F.floor((F.col("n") + 1) / 2)) + middle(F.floor(F.col("n") / 2) + 1)) / 2, 3).alias("median_seconds"))
    return pages.join(sums, "engine", "left").join(median, "engine", "left").na.fill(0, ["anchors", "exact", "near", "pairs", "pairs_kept"])
