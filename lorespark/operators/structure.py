"""Structure of documents: roles, barriers, sections, units and typed edges between blocks, as rows."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import chapter_number
from .context import folded

# The policy. What belongs to a page's layout, what native types stand for, how numbered headings begin, and
# which lines open what; the first role that matches counts.
FURNITURE = ("header", "footer", "page_number")
NATIVE = {"table_caption": "caption", "table_footnote": "footnote"}
CHAPTER = r"^第[一二三四五六七八九十百千零〇0-9]+章"
SECTION = r"^第[一二三四五六七八九十百千零〇0-9]+节"
SUBSECTION = r"^(?:[（(][一二三四五六七八九十0-9]+[）)]|[一二三四五六七八九十]+[、.])"
ROLES = [
    ("exercise", r"^(?:链接中考|中考链接|课堂练习|练习题|随堂练习|Exercises?|Practice|Quiz)[:：\s]*$"),
    ("answer", r"^(?:【(?:答案|解析)】|答案[:：]|解析[:：]|Answers?[:：]|\d+[.、)]\s*[A-D](?:\s|(?=[㐀-鿿])))"),
    ("note", r"^(?:温馨提示|知识拓展|注意事项|注意|例外|例外说明|特殊情况|Note|Notes|Tip|Tips|Exceptions)[:：\s]*$"),
    ("question", r"^(?:\d+[.、)]\s*\(|Question\s+\d+)"),
    ("example", r"^(?:例句|例如|如[:：]|Examples?[:：]|[•·])"),
]
_ROLES = [(name, re.compile(pattern, re.IGNORECASE)) for name, pattern in ROLES]
BREAKS = ("exercise", "answer", "question", "code")
TABLE_REFERENCE = r"(?:如下表|下表|表中|表格|following table|table below)[:：.。\s]*$"
REFERENCE = r"(?i)(?:参见|参照|见|see)\s*(第[一二三四五六七八九十百千零〇0-9]+[章节]|Chapter\s+\d+|Section\s+\d+)"

BLOCKS = "page int, sheet string, native string, table_id string, related_table_id string, running boolean, reset boolean"
_OUT = (
    "role string, section_id string, parent_section string, level int, title string, chapter string, path array<string>, unit_id string, barriers array<string>, "
    "edge_id string, edge_from long, relation string, state string, evidence array<string>, chain string"
)


def with_defaults(blocks: DataFrame) -> DataFrame:
    """blocks with the columns of BLOCKS that they lack, as null."""
    missing = [f for f in StructType.fromDDL(BLOCKS).fields if f.name not in blocks.columns]
    return blocks.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def _identity(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:32]


def _chapter(title: str) -> str | None:
    found = re.match(CHAPTER, title)
    number = chapter_number(found[0][1:-1]) if found else None
    return None if not found else found[0] if number is None else str(number)


def _title(row: dict) -> str:
    return re.sub(r"^#+\s*", "", row["text"] or "").strip()


def role_of(row: dict) -> str:
    """What a block is in its document, by its native type, its kind and its text."""
    if row["native"] in FURNITURE or row["running"]:
        return "furniture"
    role = NATIVE.get(row["native"]) or ("table" if row["kind"] in ("table", "table_row") else "code" if row["kind"] == "code" else "body")
    text = _title(row) if row["kind"] == "heading" else (row["text"] or "").strip()
    return next((name for name, pattern in _ROLES if pattern.search(text)), role)


def _step(state: dict, row: dict) -> list[dict]:
    """The next block of a document: state holds the open headings, the unit that is open, and the block before."""
    barriers: list[str] = []
    text, stripped = row["text"] or "", (row["text"] or "").strip()

    def barrier(reason: str, forget: bool = False) -> None:
        barriers.append(reason)
        state["before"] = state["unit"] = None
        if forget:
            state["headings"], state["chapter"] = [], None

    if not state:
        state |= {"headings": [], "chapter": None, "unit": None, "before": None, "page": None, "sheet": None, "place": None, "hash": hashlib.sha256()}
    if row["sheet"] is not None:
        if state["sheet"] not in (None, row["sheet"]):
            barrier("different_sheet", True)
        state["sheet"] = row["sheet"]
    if state["place"] is not None and row["place"] != state["place"] + 1:
        barrier("excluded_or_missing_block")
    state["place"] = row["place"]
    if row["reset"] or (row["page"] is not None and state["page"] is not None and row["page"] - state["page"] not in (0, 1)):
        barrier("non_contiguous_pages", True)
    state["page"] = row["page"] if row["page"] is not None else state["page"]
    role = role_of(row)
    out = row | dict.fromkeys(("section_id", "parent_section", "level", "title", "chapter", "unit_id", "edge_id", "edge_from", "relation", "state", "evidence"))

    def done() -> list[dict]:
        headings = state["headings"]
        out.update(role=out.get("role") or role, path=[h[1] for h in headings], section_id=headings[-1][2] if headings else None, barriers=barriers)
        shown = (row["place"], out["role"], out["section_id"], out["unit_id"], out["edge_id"], out["state"], barriers, text)
        state["hash"].update(repr(shown).encode("utf-8", "surrogatepass"))
        return [out | {"chain": state["hash"].hexdigest()}]

    if role == "furniture":
        said = _chapter(stripped)
        if None not in (said, state["chapter"]) and said != state["chapter"]:
            barrier("header_indicates_different_chapter", True)
        return done()
    if row["kind"] == "page_break":
        if not row["reset"]:
            barrier("empty_or_unparsed_page", True)
        return done()
    if not stripped:
        barrier("empty_source")
        return done()
    if row["kind"] != "heading" and role == "body" and "\n" not in stripped and len(stripped) <= 128 and re.match(CHAPTER, stripped):
        barrier("unverified_chapter_boundary", True)
    if row["kind"] == "heading" and role == "body":
        title = _title(row)
        level = next((n for n, pattern in enumerate((CHAPTER, SECTION, SUBSECTION), 1) if re.match(pattern, title)), row["depth"] or 2)
        if re.match(CHAPTER, title):
            state["chapter"] = _chapter(title)
        barrier("new_chapter" if level == 1 else "new_structural_section")
        while state["headings"] and state["headings"][-1][0] >= level:
            state["headings"].pop()
        parent = state["headings"][-1][2] if state["headings"] else None
        state["headings"].append((level, title, _identity(row["doc_id"], "section", row["place"])))
        out.update(role="heading", level=level, title=title, chapter=state["chapter"], parent_section=parent)
    role = out.get("role") or role
    if role in BREAKS:
        barrier("independent_question_or_answer")
    section, before = (state["headings"][-1][2] if state["headings"] else None), state["before"]
    tied = before and "table" in (role, before["role"]) and (
        (row["related_table_id"] and row["related_table_id"] == before["table_id"])
        or (row["table_id"] and row["table_id"] == before["related_table_id"])
        or (role == "table" and re.search(TABLE_REFERENCE, before["text"], re.IGNORECASE))
    )
    meets = bool(before) and before["section"] == section and not {role, before["role"]} & set(BREAKS)
    joins = meets and section is not None and bool(tied or "table" not in (role, before["role"]))
    if not joins or state["unit"] is None or state["unit"][1] != section:
        state["unit"] = (_identity(row["doc_id"], "unit", row["place"]), section)
    out["unit_id"] = state["unit"][0]
    if meets:
        relation = "same_knowledge_unit" if joins else "adjacent_context"
        if tied:
            relation = "table_annotation" if {role, before["role"]} & {"caption", "footnote"} else "definition_to_table"
        evidence = ["shared_structural_section" if joins else "physical_adjacency_only"]
        if tied:
            evidence.append("native_table_relationship" if row["related_table_id"] or before["related_table_id"] else "explicit_table_reference")
        if row["page"] != before["page"]:
            evidence.append("continuous_physical_pages")
        out.update(edge_id=_identity(row["doc_id"], before["place"], row["place"], relation), edge_from=before["place"], relation=relation, state="accepted" if joins else "proposed", evidence=evidence)
    state["before"] = {"place": row["place"], "role": role, "section": section, "text": text, "page": row["page"], "table_id": row["table_id"], "related_table_id": row["related_table_id"]}
    return done()


def structured(blocks: DataFrame) -> DataFrame:
    """blocks of (doc_id, place, kind, depth, text) with what they are in their document: role, section and the headings above, unit,
    barriers that lie before them, the edge from the block before, and chain, a digest of all up to them.

    Blocks come in order of place, each document as one ordered stream; what is held of it is its open headings and one block, so
    a document may have any number. depth is a heading's level. Columns of BLOCKS may be given too: page, sheet, the parser's
    native type, ids of tables, whether a line is a running chapter header, and whether sections start anew. Blocks of
    equal place come one after another with a barrier between.

    A unit is a run of blocks of one section; tables belong to what is tied to them by number or by words; exercises,
    answers, questions and code stand alone. Blocks that meet without a section or a tie are only proposed. Other columns
    of blocks stay, but for those that have a name of what is found.
    """
    known = ["doc_id", "place", "kind", "depth", "text", *StructType.fromDDL(BLOCKS).names]
    more = [c for c in blocks.columns if c.lower() not in [*known, *StructType.fromDDL(_OUT).names]]
    rows = with_defaults(blocks).select("doc_id", F.col("place").cast("long"), "kind", F.col("depth").cast("int"), "text", *known[5:], *more)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(_OUT).fields])
    return folded(rows, ["doc_id"], ["place", "kind", "text"], _step, schema)


def sections(built: DataFrame) -> DataFrame:
    """(doc_id, place, section_id, parent_section, level, title, chapter) of each heading that opens a section."""
    return built.filter("title is not null").select("doc_id", "place", "section_id", "parent_section", "level", "title", "chapter", "path")


def units(built: DataFrame) -> DataFrame:
    """(doc_id, unit_id, section_id, first, last, members): the blocks that belong together."""
    return built.filter("unit_id is not null").groupBy("doc_id", "unit_id", "section_id").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("members"))


def edges(built: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(doc_id, edge_id, source, target, relation, state, evidence) between blocks that meet, and from blocks to sections that they
    name. decisions of (doc_id, edge_id, accepted) overrule states; nothing crosses a barrier, so no decision can either."""
    found = built.filter("edge_id is not null").select("doc_id", "edge_id", F.col("edge_from").alias("source"), F.col("place").alias("target"), "relation", "state", "evidence")
    found = found.unionByName(references(built).filter("target is not null").select(*found.columns))
    if decisions is None:
        return found
    rows = found.join(decisions.select("doc_id", "edge_id", "accepted"), ["doc_id", "edge_id"], "left")
    state = F.when(F.col("accepted"), "accepted").when(~F.col("accepted"), "rejected").otherwise(F.col("state"))
    note = F.when(F.col("accepted"), F.array(F.lit("reviewer_confirmed"))).when(~F.col("accepted"), F.array(F.lit("reviewer_rejected"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "edge_id", "source", "target", "relation", state.alias("state"), F.concat("evidence", note).alias("evidence"))


def references(built: DataFrame) -> DataFrame:
    """(doc_id, source, named, edge_id, target, relation, state, evidence) for each place where a block names a chapter or section: the
    first block of the only section whose title begins so, else its heading; target null if none or several do."""
    texts = built.filter("role not in ('furniture', 'heading', 'code')").select("doc_id", F.col("place").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))).alias("named"))
    texts = texts.distinct()
    named = texts.join(sections(built).select("doc_id", "section_id", "title", "path", F.col("place").alias("heading")), "doc_id").filter(F.startswith(F.lower("title"), F.lower("named")))
    one = named.groupBy("doc_id", "source", "named").agg(F.count("*").alias("n"), F.min(F.struct("heading", "path")).alias("of")).filter("n = 1")
    # What is below a section has its headings first among its own.
    body = built.filter("role not in ('furniture', 'heading') and size(path) > 0").select("doc_id", "place", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("under"))
    body = body.groupBy("doc_id", "under").agg(F.min("place").alias("first"))
    found = one.join(body, (one["doc_id"] == body["doc_id"]) & (F.col("of.path") == F.col("under")), "left").select(one["doc_id"], "source", "named", F.coalesce("first", "of.heading").alias("target"))
    rows = texts.join(found.filter("target <> source"), ["doc_id", "source", "named"], "left")
    known = F.col("target").isNotNull()
    ident = F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("target").cast("string"), F.lit("references_section")), 256), 1, 32)
    return rows.select("doc_id", "source", "named", F.when(known, ident).alias("edge_id"), "target", F.lit("references_section").alias("relation"), F.when(known, "accepted").otherwise("unresolved").alias("state"), F.when(known, F.array(F.lit("explicit_source_reference"), F.lit("unique_existing_section"))).otherwise(F.array(F.lit("missing_or_ambiguous_target"))).alias("evidence"))


def signatures(built: DataFrame) -> DataFrame:
    """(doc_id, blocks, signature): equal for documents of equal blocks that were understood alike."""
    return built.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max_by("chain", "place").alias("signature"))
