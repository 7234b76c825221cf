"""Structure of documents against definitions that look back at all blocks before."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorespark.operators import structure as op

SCHEMA = f"doc_id long, place long, kind string, depth int, text string, {op.BLOCKS}"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TEXTS = ["第一章 总则", "第二章 其他", "第三节 名词", "（一）概念", "Free heading", "plain body text", "Exercises:", "Note:", "Answer: B", "see Section 2 for more", "Section 2 of it", "as in the following table:", "| a | b |", "参见第二章", "  ", "Question 3 what", "第九章"]


def block(doc, place, rng):
    kind = rng.choice(["heading", "paragraph", "paragraph", "paragraph", "table", "code", "page_break", "list"])
    native = rng.choice([None] * 8 + ["header", "page_number", "table_caption", "table_footnote"])
    return {
        "doc_id": doc, "place": place, "kind": kind, "depth": rng.choice([None, 1, 2, 3]), "text": rng.choice(TEXTS), "page": None, "sheet": None, "native": native,
        "table_id": rng.choice([None, "t1", "t2"]), "related_table_id": rng.choice([None, None, "t1"]), "running": rng.random() < 0.03, "reset": rng.random() < 0.03,
    }


def documents(seed, n):
    rng, out = random.Random(seed), []
    for doc in range(n):
        place, page, sheet, rows = 0, 1, "s1", []
        for _ in range(rng.choice([1, 5, 30, 60])):
            place += rng.choice([1] * 20 + [2])
            page += rng.choice([0] * 8 + [1, 2])
            sheet = rng.choice([sheet] * 15 + ["s2", None])
            rows.append(block(doc, place, rng) | ({"page": page} if doc % 3 else {}) | ({"sheet": sheet} if doc % 2 else {}))
        out.append(rows)
    return out


def defined(rows):
    """(barriers, role, path, unit's first place, edge) of each block, each found anew from all blocks before it."""
    roles, barriers, resets, out = [op.role_of(r) for r in rows], [], [], []
    chapter_of = lambda r: re.match(op.CHAPTER, re.sub(r"^#+\s*", "", r["text"]).strip())
    number = {"一": "1", "二": "2", "九": "9"}

    def known_chapter(i):
        for j in range(i - 1, -1, -1):
            if heads[j] and chapter_of(rows[j]):
                return number[chapter_of(rows[j])[0][1]]
            if resets[j]:
                return None
        return None

    def skipped(i):
        return roles[i] == "furniture" or rows[i]["kind"] == "page_break" or not rows[i]["text"].strip()

    heads = [r["kind"] == "heading" and roles[i] == "body" and not skipped(i) for i, r in enumerate(rows)]
    for i, r in enumerate(rows):
        why, reset = [], False
        sheets = [x["sheet"] for x in rows[:i] if x["sheet"] is not None]
        pages = [x["page"] for x in rows[:i] if x["page"] is not None]
        if r["sheet"] is not None and sheets and sheets[-1] != r["sheet"]:
            why.append("different_sheet")
            reset = True
        if i and r["place"] != rows[i - 1]["place"] + 1:
            why.append("excluded_or_missing_block")
        if r["reset"] or r["page"] is not None and pages and r["page"] not in (pages[-1], pages[-1] + 1):
            why.append("non_contiguous_pages")
            reset = True
        text, chapter = r["text"].strip(), chapter_of(r)
        if roles[i] == "furniture":
            if not reset and known_chapter(i) and re.match(op.CHAPTER, text) and number[text[1]] != known_chapter(i):
                why.append("header_indicates_different_chapter")
                reset = True
        elif r["kind"] == "page_break":
            if not r["reset"]:
                why.append("empty_or_unparsed_page")
                reset = True
        elif not text:
            why.append("empty_source")
        else:
            if r["kind"] != "heading" and roles[i] == "body" and re.match(op.CHAPTER, text):
                why.append("unverified_chapter_boundary")
                reset = True
            if heads[i]:
                why.append("new_chapter" if chapter or not re.match(op.SECTION, text) and not re.match(op.SUBSECTION, text) and r["depth"] == 1 else "new_structural_section")
            if roles[i] in op.BREAKS:
                why.append("independent_question_or_answer")
        barriers.append(why)
        resets.append(reset)

    def level(j):
        text = rows[j]["text"].strip()
        return next((n for n, p in enumerate((op.CHAPTER, op.SECTION, op.SUBSECTION), 1) if re.match(p, text)), rows[j]["depth"] or 2)

    def stack(i):
        since = max([j for j in range(i + 1) if resets[j]], default=0)
        seen = [j for j in range(since, i + 1) if heads[j]]
        return [j for j in seen if all(level(k) > level(j) for k in seen if k > j)]

    units = {}
    for i, r in enumerate(rows):
        path = stack(i)
        role = "heading" if heads[i] else roles[i]
        if skipped(i):
            out.append((barriers[i], role, path, None, None))
            continue
        before = next((j for j in range(i - 1, -1, -1) if not skipped(j)), None)
        if before is not None and any(barriers[k] for k in range(before + 1, i + 1)):
            before = None
        joins, edge = False, None
        if before is not None and stack(before)[-1:] == path[-1:] and not {roles[i], roles[before]} & set(op.BREAKS):
            b = rows[before]
            table = "table" in (roles[i], roles[before])
            tied = table and bool(r["related_table_id"] and r["related_table_id"] == b["table_id"] or r["table_id"] and r["table_id"] == b["related_table_id"] or roles[i] == "table" and b["text"].endswith("table:"))
            joins = bool(path) and (tied or not table)
            relation = ("table_annotation" if {roles[i], roles[before]} & {"caption", "footnote"} else "definition_to_table") if tied else "same_knowledge_unit" if joins else "adjacent_context"
            edge = (b["place"], relation, "accepted" if joins else "proposed", r["page"] != b["page"], tied)
        units[i] = units[before] if joins else r["place"]
        out.append((barriers[i], role, path, units[i], edge))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_structure_against_definitions(spark, seed):
    docs = documents(seed, 60)
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for rows in docs for r in rows], SCHEMA).repartition(5)
    got = {}
    for r in op.structured(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc, rows in enumerate(docs):
        found = sorted(got[doc], key=lambda r: r["place"])
        for r, row, (why, role, path, unit, edge) in zip(found, rows, defined(rows), strict=True):
            assert (r["barriers"], r["role"]) == (why, role), (doc, row)
            assert r["path"] == [re.sub(r"^#+\s*", "", rows[j]["text"]).strip() for j in path]
            assert r["section_id"] == (op._identity(doc, "section", rows[path[-1]]["place"]) if path else None)
            assert r["unit_id"] == (None if unit is None else op._identity(doc, "unit", unit))
            assert (r["edge_from"], r["relation"], r["state"]) == (edge[:3] if edge else (None, None, None))
            assert edge is None or ("continuous_physical_pages" in r["evidence"], any("table" in e for e in r["evidence"])) == (edge[3], edge[4])


def test_references_units_and_decisions(spark):
    texts = [("heading", "Chapter 1 Verbs"), ("paragraph", "see Section 2, see Section 9, See chapter 1"), ("heading", "Section 2 Nouns"), ("paragraph", "body"), ("paragraph", "see Section 2 here"), ("heading", "Chapter 3"), ("paragraph", "x")]
    blocks = spark.createDataFrame([(1, i, k, 1 if t.startswith("Ch") else 2, t) for i, (k, t) in enumerate(texts)], "doc_id long, place long, kind string, depth int, text string")
    built = op.structured(blocks)
    named = {(r["source"], r["named"]): r["target"] for r in op.references(built).collect()}
    assert named == {(1, "Section 2"): 3, (1, "Section 9"): None, (1, "chapter 1"): None, (4, "Section 2"): 3}
    found = {(r["source"], r["target"], r["relation"]): r for r in op.edges(built).collect()}
    assert {k: r["state"] for k, r in found.items()} == {(0, 1, "same_knowledge_unit"): "accepted", (2, 3, "same_knowledge_unit"): "accepted", (3, 4, "same_knowledge_unit"): "accepted", (5, 6, "same_knowledge_unit"): "accepted", (1, 3, "references_section"): "accepted", (4, 3, "references_section"): "accepted"}
    no = spark.createDataFrame([(1, found[3, 4, "same_knowledge_unit"]["edge_id"], False)], "doc_id long, edge_id string, accepted boolean")
    after = {(r["source"], r["target"]): (r["state"], r["evidence"][-1]) for r in op.edges(built, no).collect()}
    assert after[3, 4] == ("rejected", "reviewer_rejected") and after[2, 3] == ("accepted", "shared_structural_section")
    assert [(r["first"], r["last"], r["members"]) for r in op.units(built).orderBy("first").collect()] == [(0, 1, 2), (2, 4, 3), (5, 6, 2)]
    assert [(r["title"], r["level"]) for r in op.sections(built).orderBy("place").collect()] == [("Chapter 1 Verbs", 1), ("Section 2 Nouns", 2), ("Chapter 3", 1)]
    same = op.signatures(op.structured(blocks.withColumn("doc_id", F.lit(1)))).collect()
    other = op.signatures(op.structured(blocks.withColumn("text", F.concat("text", F.lit("."))))).collect()
    assert op.signatures(built).collect() == same != other


def test_a_document_of_many_blocks_streams_by(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("place"), F.when(F.col("id") % 50 == 0, "heading").otherwise("paragraph").alias("kind"), (F.col("id") % 3 + 1).alias("depth"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    built = op.structured(rows)
    assert [(r["n"], r["m"]) for r in op.units(built).agg(F.count("*").alias("n"), F.sum("members").alias("m")).collect()] == [(2000, 100_000)]
