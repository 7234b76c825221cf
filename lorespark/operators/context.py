"""Context of queries: what recalled chunks expand to, and what of it is delivered under budgets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.arrow import mapped


@dataclass(frozen=True)
class Limits:
    """Passages of a query, their characters and bytes together, chunks that candidates expand to, neighbours to each
    side, and the shortest start of a passage that is worth delivering."""

    top: int = 5
    chars: int | None = 32_768
    octets: int | None = None
    chunks: int = 24
    window: int = 1
    least: int = 16


@dataclass
class Delivered:
    """Which stretches of a document are delivered: sorted, apart from each other."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def left(self, start: int, end: int) -> list[tuple[int, int]]:
        """The pieces of a span that are not delivered yet, in order."""
        out, at = [], start
        for i in range(bisect_right(self.ends, start), len(self.starts)):
            if self.starts[i] >= end:
                break
            if self.starts[i] > at:
                out.append((at, self.starts[i]))
            at = self.ends[i]
        return out + ([(at, end)] if at < end else [])

    def largest_left(self, start: int, end: int) -> tuple[int, int] | None:
        """The largest of these pieces, the first of equals; null if nothing is left."""
        return max(self.left(start, end), key=lambda piece: piece[1] - piece[0], default=None)

    def add(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


def folded(rows: DataFrame, keys: list[str], order: list[str], step, schema: StructType | str, done=None) -> DataFrame:
    """rows in order of keys and order through step(state, row), which gives output rows; state is new for each value of keys.
    done(state) gives more of them at the end of each.

    Groups are sorted by Spark and stream by, so that a task holds the state of one group and a small part of a batch.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, into = None, None, to_arrow_schema(kind)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if state is None or now != key:
                    if done and state is not None:
                        out += done(state)
                    key, state = now, {}
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, into)
        if done and state is not None:
            yield pa.RecordBatch.from_pylist(done(state), into)

    return mapped(rows.repartition(*keys).sortWithinPartitions(*keys, *order), fold, kind)


def undelivered(spans: DataFrame) -> DataFrame:
    """(query_id, document_id, place, start, end): of each span, in order of place, the largest piece that the pieces before
    it have left of its document, the first of equals. Spans of which nothing is left fall away, null or empty ones too.

    What counts is what was delivered: a span that lost a part hides no more than the piece that it gave.
    """

    def step(state: dict, row: dict) -> list[dict]:
        if row["start"] is None or row["end"] is None:
            return []
        seen = state.setdefault("seen", Delivered())
        piece = seen.largest_left(row["start"], row["end"])
        if piece is None:
            return []
        seen.add(*piece)
        return [row | {"start": piece[0], "end": piece[1]}]

    rows = spans.select("query_id", "document_id", "place", F.col("start").cast("long"), F.col("end").cast("long"))
    return folded(rows, ["query_id", "document_id"], ["place", "start", "end"], step, rows.schema)


def _alike(a: str, b: str, columns: list[str]) -> Column:
    out = F.col(f"{a}.document_id") == F.col(f"{b}.document_id")
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def neighbourhoods(candidates: DataFrame, chunks: DataFrame, window: int, alike: list[str]) -> DataFrame:
    """candidates of (query_id, rank, chunk_id) with what each may expand to: parent, if one of kind `parent` is alike, else
    before and after, up to window chunks to each side as long as they are no parents and alike.

    chunks: (chunk_id, document_id, kind, parent_id, prev_id, next_id) and the columns of alike, equal null-safe within a
    passage. Each step to a side is one join by id.
    """
    narrow = chunks.select("chunk_id", "document_id", "kind", "parent_id", "prev_id", "next_id", *alike)
    rows = candidates.select("query_id", "rank", "chunk_id").join(narrow, "chunk_id").alias("c")
    up = narrow.filter("kind = 'parent'").alias("p")
    rows = rows.join(up, (F.col("c.parent_id") == F.col("p.chunk_id")) & _alike("c", "p", alike), "left").select("c.*", F.when(F.col("p.chunk_id").isNotNull(), F.struct(F.col("p.chunk_id").alias("id"), F.col("p.parent_id").alias("parent_id"))).alias("parent"))
    other = narrow.filter("kind is null or kind <> 'parent'")
    for side, pointer in (("before", "prev_id"), ("after", "next_id")):
        rows = rows.withColumn("at", F.when(F.col("parent").isNull(), F.col(pointer))).withColumn(side, F.array().cast(f"array<struct<id:{narrow.schema['chunk_id'].dataType.simpleString()},parent_id:{narrow.schema['parent_id'].dataType.simpleString()}>>"))
        for _ in range(window):
            step = rows.alias("c").join(other.alias("n"), (F.col("c.at") == F.col("n.chunk_id")) & _alike("c", "n", alike), "left")
            found = F.col("n.chunk_id").isNotNull()
            more = F.concat(f"c.{side}", F.array(F.struct(F.col("n.chunk_id").alias("id"), F.col("n.parent_id").alias("parent_id"))))
            kept = [F.col(f"c.{x}") for x in rows.columns if x not in (side, "at")]
            rows = step.select(*kept, F.when(found, more).otherwise(F.col(f"c.{side}")).alias(side), F.when(found, F.col(f"n.{pointer}")).alias("at"))
        rows = rows.drop("at")
    return rows.select("query_id", "rank", "chunk_id", "kind", "parent_id", "parent", "before", "after")


def expanded(candidates: DataFrame, chunks: DataFrame, limits: Limits | None = None, alike: list[str] | None = None) -> DataFrame:
    """(query_id, place, chunk_id, match_id, role, matched): the chunks whose text a query's context is made of, in order.

    First what stands for each candidate by rank, its parent or itself, then neighbours; limits.chunks of them together,
    counted as they are found. Chunks whose parent is among them fall away. match_id is the candidate that led to a
    chunk, matched all candidates that it is or is the parent of. A query has so many candidates as its pool allows;
    they are folded in order, queries spread over tasks.
    """
    limits = limits or Limits()
    near = neighbourhoods(candidates, chunks, limits.window, alike or [])
    item = F.struct("rank", "chunk_id", "kind", "parent_id", "parent", "before", "after")
    lists = near.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("found"))
    ids = candidates.schema["chunk_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"query_id {candidates.schema['query_id'].dataType.simpleString()}, place int, chunk_id {ids}, match_id {ids}, role string, matched array<{ids}>")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                chosen = _chosen(row["found"], limits.chunks)
                out += [{"query_id": row["query_id"], "place": i, **one} for i, one in enumerate(chosen, 1)]
            yield pa.RecordBatch.from_pylist(out, into)

    return mapped(lists, choose, schema)


def _chosen(found: list[dict], most: int) -> list[dict]:
    """The chunks that a query's candidates expand to, as expanded() says."""
    main: dict[object, dict] = {}
    side: dict[object, dict] = {}
    for c in found:
        up = c["parent"]
        one = {"chunk_id": up["id"], "up": up["parent_id"], "role": "parent"} if up else {"chunk_id": c["chunk_id"], "up": c["parent_id"], "role": "matched"}
        one["covers"] = up is not None or c["kind"] == "parent"
        main.setdefault(one["chunk_id"], one | {"match_id": c["chunk_id"]})
        for direction in (c["before"], c["after"]):
            for n in direction:
                if len(main) + len(side) >= most:
                    break
                side.setdefault(n["id"], {"chunk_id": n["id"], "up": n["parent_id"], "role": "neighbor", "covers": False, "match_id": c["chunk_id"]})
        if len(main) >= most:
            break
    kept = list((main | {k: v for k, v in side.items() if k not in main}).values())[:most]
    covering = {x["chunk_id"] for x in kept if x["covers"]}
    out = []
    for x in kept:
        if x["up"] is None or x["up"] not in covering:
            matched = [c["chunk_id"] for c in found if x["chunk_id"] in (c["chunk_id"], c["parent_id"])]
            out.append({"chunk_id": x["chunk_id"], "match_id": x["match_id"], "role": x["role"], "matched": list(dict.fromkeys(matched or [x["match_id"]]))})
    return out


def labelled(chunk_id: Column, source_name: Column, text: Column) -> Column:
    """A passage under its source's line. The line is a fixed value."""
    return F.concat(F.lit("[来源 "), chunk_id.cast("string"), F.lit(": "), source_name, F.lit("]\n"), text)


def delivered(passages: DataFrame, limits: Limits | None = None) -> DataFrame:
    """passages with what a query's context gets of them, in order of place: start, end and content as delivered, text, that
    under the passage's header, and whether it was trimmed to what was new or cut to what fits (truncated).

    passages: (query_id, place, chunk_id, document_id, start, end, content, header, source_name) and more. Of a span the largest
    piece counts that no delivered piece of its document has; a span of which nothing is left, that is empty, or of which a
    part was delivered under the same bounds, is left out. A passage without a span is taken whole, one of a document. Its line of source, its header, an empty line between passages and
    its text count towards limits; what does not fit is cut to the longest start that does, and left out if that
    has fewer than limits.least characters. Later, shorter passages may still follow, up to limits.top.
    """
    limits = limits or Limits()
    schema = StructType([*passages.schema.fields, *StructType.fromDDL("text string, trimmed boolean, truncated boolean").fields])

    def step(state: dict, row: dict) -> list[dict]:
        span = (row["document_id"], row["start"], row["end"])
        known = row["document_id"] is not None
        if state.get("n", 0) >= limits.top or known and span in state.setdefault("spans", set()):
            return []
        body, start, end = row["content"] or "", row["start"], row["end"]
        spanned, trimmed = known and start is not None and end is not None, False
        seen = state.setdefault("seen", {}).setdefault(row["document_id"], Delivered()) if spanned else None
        if spanned:
            piece = seen.largest_left(start, end)
            if piece is None:
                return []
            trimmed = piece != (start, end)
            body, (start, end) = body[piece[0] - start : piece[1] - start], piece
        head = f"{row['header']}\n\n" if row["header"] else ""
        frame = f"[来源 {row['chunk_id']}: {row['source_name']}]\n{head}" + ("\n\n" if state.get("n") else "")
        fits = longest_start(body, *(None if most is None else most - state.get(used, 0) - size for most, used, size in ((limits.chars, "chars", len(frame)), (limits.octets, "octets", len(frame.encode())))))
        if fits is None or fits < len(body) and fits < limits.least:
            return []
        truncated, body = fits < len(body), body[:fits]
        if truncated and start is not None:
            end = start + fits
        if spanned and start < end:
            seen.add(start, end)
        if known:
            state["spans"].add(span)
        state["n"] = state.get("n", 0) + 1
        state["chars"] = state.get("chars", 0) + len(frame) + len(body)
        state["octets"] = state.get("octets", 0) + len(frame.encode()) + len(body.encode())
        return [row | {"start": start, "end": end, "content": body, "text": head + body, "trimmed": trimmed, "truncated": truncated}]

    return folded(passages, ["query_id"], ["place"], step, schema)


def longest_start(text: str, chars: int | None, octets: int | None) -> int | None:
    """The length of the longest start of text within both; null if not even an empty one is."""
    if min(chars or 0, octets or 0) < 0:
        return None
    n = len(text) if chars is None else min(len(text), chars)
    if octets is not None and len(text[:n].encode()) > octets:
        n = len(text[:n].encode()[:octets].decode(errors="ignore"))
    return n


def context_passages(candidates: DataFrame, chunks: DataFrame, limits: Limits | None = None, alike: list[str] | None = None) -> DataFrame:
    """What a batch of queries gets from its ranked candidates of (query_id, rank, chunk_id): expanded() and then delivered().

    Text moves for chosen chunks alone, at most limits.chunks of a query.
    """
    chosen = expanded(candidates, chunks, limits, alike)
    return delivered(chosen.join(chunks.select("chunk_id", "document_id", "start", "end", "content", "header", "source_name"), "chunk_id"), limits)


def contexts(queries: DataFrame, passages: DataFrame, required: bool = False) -> DataFrame:
    """(query_id, status, passages, chars, context, refused) for queries of (query_id, failed_lanes): delivered passages in order
    under their sources' lines, an empty line between.

    Any passage makes a hit; without one a query of which a lane failed is degraded, others are no_match. Where a
    context is required, those without one are refused.
    """
    text = labelled(F.col("chunk_id"), F.col("source_name"), F.col("text"))
    joined = passages.select("query_id", "place", text.alias("text")).groupBy("query_id").agg(F.count("*").alias("passages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    rows = queries.select("query_id", "failed_lanes").join(joined, "query_id", "left")
    hit = F.col("passages").isNotNull()
    status = F.when(hit, "hit").when(F.col("failed_lanes") > 0, "degraded").otherwise("no_match")
    return rows.select("query_id", status.alias("status"), F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce(F.length("context"), F.lit(0)).alias("chars"), F.coalesce("context", F.lit("")).alias("context"), (F.lit(required) & ~hit).alias("refused"))
