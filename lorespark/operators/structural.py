"""Chunks along the structure of documents: what belongs together is cut together, with a map back to its sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .context import folded
from .documents import SEPARATOR, TABLE_HEAD, cut_points
from .structure import _identity

PROTECTED = ("table", "table_row", "code")
SEGMENT = "struct<place:bigint,page:int,role:string,source_start:bigint,source_end:bigint,content_start:bigint,content_end:bigint>"


@dataclass(frozen=True)
class Sizes:
    """Characters of a chunk with the headings above it, of the overlap of two, and of a parent with its headings."""

    chunk: int = 800
    overlap: int = 80
    parent: int = 2400


def _segments(places: list[tuple[int, int]], blocks: list[dict]) -> tuple[str, list[dict]]:
    """The text of some stretches of a group's text, an empty line between blocks, and where each part of it comes from.

    Stretches are in order and lie in the text that the blocks make up with an empty line between each two.
    """
    parts, segments, at, cursor = [], [], 0, 0
    spans = []
    for b in blocks:
        spans.append((at, at + len(b["text"]), b))
        at += len(b["text"]) + SEPARATOR
    for lo, hi in places:
        for a, e, b in spans:
            x, y = max(a, lo), min(e, hi)
            if x < y:
                body = b["text"][x - a : y - a]
                gap = SEPARATOR if parts and segments[-1]["place"] != b["place"] else 1 if parts else 0
                cursor += gap
                parts.append("\n" * gap + body)
                segments.append({"place": b["place"], "page": b["page"], "role": b["role"], "source_start": b["start"] + x - a, "source_end": b["start"] + y - a, "content_start": cursor, "content_end": cursor + len(body)})
                cursor += len(body)
    return "".join(parts), segments


def _stretches(blocks: list[dict], room: int, overlap: int) -> list[list[tuple[int, int]]]:
    """How a group's text is cut: a table with a header between its lines, each piece with the header; all else by boundaries."""
    text = ("\n" * SEPARATOR).join(b["text"] for b in blocks)
    head = TABLE_HEAD.match(text) if blocks[0]["kind"] == "table" else None
    if not head or len(text) <= room:
        return [[span] for span in cut_points(text, room, 0 if blocks[0]["kind"] in PROTECTED else overlap)]
    out, begin, end = [], head.end(), head.end()
    for line in text[head.end() :].splitlines(keepends=True):
        if end > begin and head.end() + end - begin + len(line.rstrip("\n")) > room:
            out.append((begin, end))
            begin = end
        end += len(line)
    top = (0, len(text[: head.end()].rstrip("\n")))
    cut = [(a, a + len(text[a:b].rstrip("\n"))) for a, b in [*out, (begin, end)] if b > a]
    return [[top, span] for span in cut] or [[top]]


def _parents(chunks: list[dict], blocks: list[dict], header: str, sizes: Sizes) -> list[tuple[dict, list[int]]]:
    """Parents of consecutive chunks of a group: stretches of each block merged where they overlap, if all fit."""
    groups: list[list[int]] = []
    for i, chunk in enumerate(chunks):
        held = sum(len(chunks[k]["content"]) + SEPARATOR for k in groups[-1]) if groups else 0
        if not groups or held + len(chunk["content"]) + SEPARATOR + len(header) > sizes.parent:
            groups.append([])
        groups[-1].append(i)
    out, texts = [], {b["place"]: b for b in blocks}
    for members in groups:
        merged: list[list[int]] = []
        for s in sorted((s for i in members for s in chunks[i]["segments"]), key=lambda s: s["source_start"]):
            if merged and merged[-1][0] == s["place"] and s["source_start"] <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], s["source_end"])
            else:
                merged.append([s["place"], s["source_start"], s["source_end"]])
        parts, segments, cursor = [], [], 0
        for place, a, b in merged:
            block = texts[place]
            parts.append(block["text"][a - block["start"] : b - block["start"]])
            segments.append({"place": place, "page": block["page"], "role": block["role"], "source_start": a, "source_end": b, "content_start": cursor, "content_end": cursor + b - a})
            cursor += b - a + SEPARATOR
        content = ("\n" * SEPARATOR).join(parts)
        if len(members) > 1 and len(content) + len(header) + SEPARATOR <= sizes.parent:
            out.append(({"content": content, "segments": segments}, members))
    return out


def structural_chunks(built: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """(doc_id, chunk_id, kind, parent_id, unit_id, header, content, start, end, page, segments): leaves, then parents of two or more of them.

    built: blocks as structured() gives them, with start, their place in the document's text. Blocks that accepted edges
    join are a group; tables and code are groups of their own; layout and empty blocks are in none, and a group of headings
    alone is navigation. A group's text, blocks with an empty line between, is cut to sizes.chunk with its header, the
    headings above; each leaf knows from which stretches of the source it is, so text that lies apart stays apart.
    Documents stream by block after block; what is held is the group that is open.
    """
    sizes = sizes or Sizes()
    ids = built.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {ids}, chunk_id string, kind string, parent_id string, unit_id string, header string, content string, start long, end long, page int, segments array<{SEGMENT}>")

    def flushed(group: list[dict]) -> list[dict]:
        if not group or all(b["role"] == "heading" for b in group):
            return []
        doc, unit = group[0]["doc_id"], _identity(group[0]["doc_id"], "group", *[b["place"] for b in group])
        body = next((b for b in group if b["role"] != "heading"), group[0])
        header = " > ".join(body["path"])
        room = max(1, sizes.chunk - (len(header) + SEPARATOR if header else 0))
        chunks = []
        for spans in _stretches(group, room, min(sizes.overlap, room // 2)):
            content, segments = _segments(spans, group)
            if segments:
                chunks.append({"content": content, "segments": segments})
        kept = [(c, f"{doc}:{unit[:12]}:{i}", "leaf", None) for i, c in enumerate(chunks)]
        for n, (parent, members) in enumerate(_parents(chunks, group, header, sizes)):
            name = f"{doc}:{unit[:12]}:p{n}"
            for i in members:
                kept[i] = (*kept[i][:3], name)
            kept.append((parent, name, "parent", None))
        out = []
        for chunk, name, kind, parent in kept:
            pages = {s["page"] for s in chunk["segments"]}
            out.append({"doc_id": doc, "chunk_id": name, "kind": kind, "parent_id": parent, "unit_id": unit, "header": header, "start": chunk["segments"][0]["source_start"], "end": chunk["segments"][-1]["source_end"], "page": pages.pop() if len(pages) == 1 else None, **chunk})
        return out

    def step(state: dict, row: dict) -> list[dict]:
        group = state.setdefault("group", [])
        if row["role"] == "furniture" or not (row["text"] or "").strip() or row["unit_id"] is None:
            return []
        if group and row["state"] == "accepted" and row["edge_from"] == group[-1]["place"] and not {row["kind"], group[-1]["kind"]} & set(PROTECTED):
            group.append(row)
            return []
        state["group"] = [row]
        return flushed(group)

    columns = ["doc_id", "place", "kind", "role", "text", "start", "page", "path", "unit_id", "state", "edge_from"]
    return folded(built.select(*columns), ["doc_id"], ["place"], step, schema, lambda state: flushed(state.get("group", [])))


def structural_audit(chunks: DataFrame, built: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """(doc_id, chunks, exact, within, covered) per document with chunks: whether every segment is an exact slice of its block, leaves
    keep to the size, tables' lines aside, and leaves cover each block that they begin, character by character."""
    sizes = sizes or Sizes()
    leaves = chunks.withColumn("s", F.explode("segments"))
    blocks = built.select(F.col("doc_id").alias("of_doc"), F.col("place").alias("at"), "text", F.col("start").alias("from"), F.col("kind").alias("of"))
    rows = leaves.join(blocks, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("s.place") == F.col("at")))
    size = F.col("s.source_end") - F.col("s.source_start")
    exact = F.substring(F.col("text"), (F.col("s.source_start") - F.col("from") + 1).cast("int"), size.cast("int")) == F.substring(F.col("content"), (F.col("s.content_start") + 1).cast("int"), size.cast("int"))
    within = (F.col("kind") == "parent") | (F.col("of") == "table") | (F.length("content") + F.when(F.col("header") != "", F.length("header") + SEPARATOR).otherwise(0) <= F.greatest(F.lit(sizes.chunk), F.length("header") + SEPARATOR + 1))
    checked = rows.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.bool_and(exact).alias("exact"), F.bool_and(within).alias("within"))
    spans = rows.filter("kind = 'leaf'").select("doc_id", "at", F.col("s.source_start").alias("a"), F.col("s.source_end").alias("b"), F.col("from"), (F.col("from") + F.length("text")).alias("to"), "text")
    before = F.max("b").over(Window.partitionBy("doc_id", "at").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    # White space between two stretches is what a line's end left out.
    gaps = spans.withColumn("before", F.coalesce(before, F.col("from"))).withColumn("gap", F.substring(F.col("text"), (F.col("before") - F.col("from") + 1).cast("int"), F.greatest(F.lit(0), F.col("a") - F.col("before")).cast("int")))
    by_block = gaps.groupBy("doc_id", "at").agg((F.bool_and(F.trim(F.regexp_replace("gap", r"\s+", " ")) == "") & F.bool_or(F.trim(F.regexp_replace(F.substring(F.col("text"), (F.col("b") - F.col("from") + 1).cast("int"), (F.col("to") - F.col("b")).cast("int")), r"\s+", " ")) == "")).alias("covered"))
    return checked.join(by_block.groupBy("doc_id").agg(F.bool_and("covered").alias("covered")), "doc_id")
