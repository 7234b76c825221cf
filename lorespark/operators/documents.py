"""Documents to blocks, chunks and their lineage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import mapped

#: Between blocks in a document's joined text.
SEPARATOR = 2
# Places where a chunk may end, best first.
BOUNDARIES = [re.compile(p) for p in (r"\n\n+", r"\n", r"[.!?。！？]\s*", r"[,;，；]\s*", r"\s")]


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, text, start, end): a block per line with content.

    Offsets are code points in the text of all blocks joined by an empty line.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^[\s]+|[\s]+$", "")))
    blocks = docs.select("doc_id", F.posexplode(F.filter(lines, lambda x: x != "")).alias("block", "text"))
    order = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + SEPARATOR).over(order), F.lit(0))
    kind = F.when(F.col("text").rlike(r"^#{1,6}\s"), "heading").when(F.col("text").rlike(r"^(?:[-*+]|\d+[.)])\s"), "list").when(F.col("text").rlike(r"^\|.*\|$"), "table").otherwise("paragraph")
    return blocks.select("doc_id", "block", kind.alias("kind"), "text", start.alias("start")).withColumn("end", F.col("start") + F.length("text"))


# What opens each kind of block at a line, in order; a table is a line with a bar above a line of dashes.
DASHES = r"[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*"
OPENERS = {
    "heading": r" {0,3}#{1,6}[ \t]+\S.*",
    "table": rf".*\|.*\n{DASHES}(?:\n(?=.*\S).*\|.*)*",
    "code": r"[ \t]*(?P<fence>`{3,}|~{3,}|\$\$)[^\n]*(?:\n(?![ \t]*(?P=fence)).*)*(?:\n.*)?",
    "list": r"[ \t]*(?:[-*+]|\d+[.)]) \S.*",
}
_OPEN = "|".join(rf"(?P<{kind}>{pattern})" for kind, pattern in OPENERS.items())
_STOP = r"(?! {0,3}#{1,6}[ \t])(?![ \t]*(?:`{3,}|~{3,}|\$\$))"
TABLE_HEAD = re.compile(rf"[^\n]*\|[^\n]*\n{DASHES}(?:\n|$)")
TEXT_BLOCK = re.compile(rf"^(?:(?:{_OPEN})|(?P<paragraph>.*\S.*))$", re.M)
_MORE = re.compile(rf"\n{_STOP}(?=.*\S)(?!.*\|.*\n{DASHES}$).*", re.M)
_BAR = re.compile(r"(?<!\\)(?:\\\\)*\|")


def table_cells(line: str) -> list[str]:
    """The cells of a table's line: bars part them unless an odd number of backslashes stands before; outer bars are none."""
    cells, begin, line = [], 0, line.strip()
    for bar in _BAR.finditer(line):
        cells.append(line[begin : bar.end() - 1].strip())
        begin = bar.end()
    cells.append(line[begin:].strip())
    return cells[bool(line[:1] == "|") : len(cells) - (len(cells) > 1 and begin == len(line))]


def parsed_blocks(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, first line, last line, text) of a Markdown text: headings, tables whose lines have one width, fenced code and
    formulas, lists, and paragraphs of all lines up to an empty one or the next block."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found, at, line, done = [], 0, 1, 0
    while block := TEXT_BLOCK.search(text, at):
        kind, begin, end = block.lastgroup if block.lastgroup != "fence" else "code", block.start(), block.end()
        if kind == "table":
            lines = block[0].split("\n")
            widths = [len(table_cells(x)) for x in lines]
            same = next((i for i, w in enumerate(widths) if w != widths[0]), len(lines))
            kind, end = ("table", begin + len("\n".join(lines[:same]))) if same > 1 else ("paragraph", begin + len(lines[0]))
        if kind in ("list", "paragraph"):
            while more := _MORE.match(text, end):
                end = more.end()
        line += text.count("\n", done, begin)
        last = line + text.count("\n", begin, end)
        found.append((kind, line, last, text[begin:end]))
        line, done, at = last, end, end
    return found


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, first_line, last_line, text) of each text by parsed_blocks()."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *b) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, b in enumerate(parsed_blocks(x or ""))]
            kinds = (batch.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], ["doc_id", "block", "kind", "first_line", "last_line", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), parse, f"doc_id {kind}, block int, kind string, first_line int, last_line int, text string")


def table_chunks(header: list[str], rows: list[list[str]], size: int) -> list[tuple[int, int, str]]:
    """(first row, past last row, text) of a table cut into pieces of at most size characters, each with the header; a row
    that is longer alone is a piece of its own."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    head = line(header) + "\n" + line(["---"] * len(header))
    pieces, begin, held = [], 0, len(head)
    for i, row in enumerate(rows):
        if i > begin and held + 1 + len(line(row)) > size:
            pieces.append((begin, i))
            begin, held = i, len(head)
        held += 1 + len(line(row))
    pieces += [(begin, len(rows))] if begin < len(rows) else []
    return [(a, b, "\n".join([head, *map(line, rows[a:b])])) for a, b in pieces]


def tiered_chunks(text: str, size: int) -> list[tuple[str, int, int, str]]:
    """(tier, first line, last line, content) of a Markdown text in chunks of at most size characters, tables aside whose
    header and one line take more.

    A section, from a heading to the next, that fits is a chunk. Of others blocks are taken together as long as they
    fit; tables and code are not cut in the middle of a line, tables keep their header in each piece, and what is
    still too long is cut at the best boundary. If the chunks miss anything of the text but white space, all of it is cut so.
    """
    sections: list[list[tuple[str, int, int, str]]] = []
    for block in parsed_blocks(text):
        if block[0] == "heading" or not sections:
            sections.append([])
        sections[-1].append(block)
    out = []
    for blocks in sections:
        if sum(len(b[3]) + SEPARATOR for b in blocks) - SEPARATOR <= size:
            out.append(("heading", blocks[0][1], blocks[-1][2], "\n\n".join(b[3] for b in blocks)))
            continue
        held: list[tuple[str, int, int, str]] = []
        for block in [*blocks, None]:
            if held and (block is None or sum(len(b[3]) + SEPARATOR for b in held) + len(block[3]) > size):
                out.append(("blocks", held[0][1], held[-1][2], "\n\n".join(b[3] for b in held)))
                held = []
            if block is None or len(block[3]) <= size:
                held += [block] if block else []
            elif block[0] == "table":
                rows = [table_cells(x) for x in block[3].split("\n")]
                out += [("table", block[1] + 2 + a, block[1] + 1 + b, content) for a, b, content in table_chunks(rows[0], rows[2:], size)]
            else:
                out += [("cut", block[1] + block[3].count("\n", 0, a), block[1] + block[3].count("\n", 0, b - 1), block[3][a:b]) for a, b in cut_points(block[3], size, 0)]
    said = lambda parts: "".join("".join(parts).split())
    plain = [c for tier, _, _, c in out if tier != "table"]
    if len(plain) == len(out) and said(plain) != said([text]):
        return [("fallback", 1 + text.count("\n", 0, a), 1 + text.count("\n", 0, b - 1), text[a:b]) for a, b in cut_points(text, size, 0)]
    return out


def tier_chunks(docs: DataFrame, size: int = 800) -> DataFrame:
    """(doc_id, chunk, tier, first_line, last_line, content) of each text by tiered_chunks()."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *c) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, c in enumerate(tiered_chunks(x or "", size))]
            kinds = (batch.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], ["doc_id", "chunk", "tier", "first_line", "last_line", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), cut, f"doc_id {kind}, chunk int, tier string, first_line int, last_line int, content string")


def section_paths(blocks: DataFrame) -> DataFrame:
    """blocks with section, the headings above each: a heading closes all open ones of its level or deeper."""
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", r"^#+", 0)))
    rows = blocks.withColumn("level", level).withColumn("title", F.regexp_replace("text", r"^#+\s*", ""))
    so_far = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The open heading of a level is the last one of it, unless a shallower one came later.
    last = {n: F.last(F.when(F.col("level") == n, F.struct("block", "title")), ignorenulls=True).over(so_far) for n in range(1, 7)}
    for n, value in last.items():
        rows = rows.withColumn(f"h{n}", value)
    for n in range(2, 7):
        later = F.greatest(*[F.coalesce(F.col(f"h{m}.block"), F.lit(-1)) for m in range(1, n)], F.lit(-1))
        rows = rows.withColumn(f"o{n}", F.when(F.col(f"h{n}.block") > later, F.col(f"h{n}.title")))
    path = F.array_compact(F.array(F.col("h1.title"), *[F.col(f"o{n}") for n in range(2, 7)]))
    return rows.select(*blocks.columns, path.alias("section"))


def cut_points(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most size characters that cover text; each ends at the best boundary in its last half, and the next
    starts overlap characters before that at most, after a space."""
    spans, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for boundary in BOUNDARIES:
                found = [m.end() for m in boundary.finditer(text, start + size // 2, end)]
                if found:
                    end = found[-1]
                    break
        spans.append((start, end))
        if end == len(text):
            break
        back = max(start + 1, end - min(overlap, (end - start) // 2))
        space = text.find(" ", back, end)
        start = space + 1 if space >= 0 else end
    return spans


def chunks(docs: DataFrame, size: int = 800, overlap: int = 80) -> DataFrame:
    """(doc_id, chunk, start, end, content): overlapping chunks of each text; texts without content have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, a, b, x[a:b]) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x and x.strip() for n, (a, b) in enumerate(cut_points(x, size, overlap))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "chunk", "start", "end", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), cut, f"doc_id {kind}, chunk int, start int, end int, content string")


def chunk_audit(docs: DataFrame, cut: DataFrame, size: int) -> DataFrame:
    """Per document with chunks: whether they are exact slices in order, within size, without a gap, to the end."""
    rows = cut.join(docs.select("doc_id", "text"), "doc_id")
    before = Window.partitionBy("doc_id").orderBy("chunk")
    rows = rows.withColumn("gap", F.col("start") > F.coalesce(F.lag("end").over(before), F.lit(0)))
    exact = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("content")
    return rows.groupBy("doc_id").agg(F.bool_and(exact).alias("exact"), F.bool_and(F.length("content") <= size).alias("within"), (~F.bool_or("gap")).alias("gapless"), (F.max("end") == F.max(F.length("text"))).alias("complete"))


def lineage(cut: DataFrame) -> DataFrame:
    """Chunks with the chunks before and after, and the overlap with the one before."""
    order = Window.partitionBy("doc_id").orderBy("chunk")
    overlap = F.greatest(F.lit(0), F.lag("end").over(order) - F.col("start"))
    return cut.withColumn("prev_chunk", F.lag("chunk").over(order)).withColumn("next_chunk", F.lead("chunk").over(order)).withColumn("overlap", overlap)


def parents(cut: DataFrame, size: int = 2400) -> DataFrame:
    """Chunks with parent: consecutive chunks of a document as long as they span at most size characters.

    Each parent starts where the one before could take no more, so the fold runs over each document's list of spans.
    """
    spans = cut.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "start", "end"))).alias("spans"))
    start = F.struct(F.lit(-1).alias("parent"), F.lit(0).alias("begin"), F.array().cast("array<int>").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        opens = (acc["parent"] < 0) | (x["end"] - acc["begin"] > size)
        parent = F.when(opens, acc["parent"] + 1).otherwise(acc["parent"])
        return F.struct(parent.alias("parent"), F.when(opens, x["start"]).otherwise(acc["begin"]).alias("begin"), F.concat(acc["out"], F.array(parent)).alias("out"))

    folded = spans.withColumn("parents", F.aggregate("spans", start, place)["out"])
    return folded.select("doc_id", F.explode(F.arrays_zip("spans", "parents")).alias("x")).select("doc_id", "x.spans.chunk", F.col("x.parents").alias("parent"))


def chunk_rows(docs: DataFrame, size: int = 800, overlap: int = 80, parent_size: int = 2400, parent_from: int = 1024) -> DataFrame:
    """(document_id, chunk_id, kind, parent_id, prev_id, next_id, start, end, content) of each text of (doc_id, text): its
    overlapping chunks as leaves and, in texts of at least parent_from characters, parents of consecutive leaves as long as
    they span at most parent_size. Null texts and those without content have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = cut_points(text, size, overlap) if text and text.strip() else []
                groups: list[list[int]] = []
                for n, (_, end) in enumerate(spans):
                    if not groups or end - spans[groups[-1][0]][0] > parent_size:
                        groups.append([])
                    groups[-1].append(n)
                grown = bool(spans) and len(text) >= parent_from
                parent = {n: f"{ident}:p{g}" for g, held in enumerate(groups) for n in held} if grown else {}
                name = lambda n: f"{ident}:{n}" if 0 <= n < len(spans) else None  # noqa: B023, E731
                rows += [(ident, name(n), "leaf", parent.get(n), name(n - 1), name(n + 1), a, b, text[a:b]) for n, (a, b) in enumerate(spans)]
                if grown:
                    bounds = [(spans[held[0]][0], spans[held[-1]][1]) for held in groups]
                    rows += [(ident, f"{ident}:p{g}", "parent", None, None, None, a, b, text[a:b]) for g, (a, b) in enumerate(bounds)]
            kinds = (batch.column(0).type, *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["document_id", "chunk_id", "kind", "parent_id", "prev_id", "next_id", "start", "end", "content"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), cut, f"document_id {kind}, chunk_id string, kind string, parent_id string, prev_id string, next_id string, start long, end long, content string")


def overlapping(left: DataFrame, right: DataFrame, step: int = 2048) -> DataFrame:
    """Pairs of spans of one document that overlap, with the common part.

    Both sides are (doc_id, id, start, end). Spans meet in stretches of step characters, so that long documents do
    not pair all with all; a pair is taken in the stretch where its common part starts.
    """
    parted = lambda df, p: df.select("doc_id", *[F.col(c).alias(p + c) for c in ("id", "start", "end")], F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / step))).alias("stretch"))
    both = parted(left, "l_").join(parted(right, "r_"), ["doc_id", "stretch"])
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    return both.filter((lo < hi) & (F.floor(lo / step) == F.col("stretch"))).select("doc_id", "l_id", "r_id", lo.alias("lo"), hi.alias("hi"))
