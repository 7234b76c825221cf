"""Chunks along structure: exact slices, whole coverage, parents as unions of their leaves' stretches."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators.structural import Sizes, structural_audit, structural_chunks
from lorespark.operators.structure import structured

SCHEMA = "doc_id long, place long, kind string, depth int, text string, start long, page int, native string"


def documents(seed, n):
    """Blocks whose places in their document lie apart, some of them layout or empty, with long ones, tables and code."""
    rng, rows = random.Random(seed), []
    words = "one two three four five, six. seven 漢字。 eight".split(" ")
    for doc in range(n):
        at = rng.randrange(5)
        for place in range(rng.choice([1, 6, 25])):
            kind = rng.choice(["heading", "paragraph", "paragraph", "paragraph", "list", "table", "code"])
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 60])))
            if kind == "heading":
                text = text[:20].strip()
            if kind == "table" and rng.random() < 0.7:
                text = "\n".join(["| a | b |", "|---|---|", *(f"| {rng.choice(words)} | {k} |" for k in range(rng.choice([0, 2, 20])))])
            rows.append((doc, place, kind, rng.choice([1, 2, 3]), rng.choice([text] * 20 + [" "]), at, 1 + place // 4, rng.choice([None] * 12 + ["footer"])))
            at += len(text) + rng.choice([2, 2, 9])
    return rows


@pytest.mark.parametrize("sizes", [Sizes(120, 20, 400), Sizes(40, 0, 90), Sizes(800, 80, 2400)])
def test_chunks_hold_what_they_say(spark, sizes):
    rows = documents(3, 40)
    blocks = {(r[0], r[1]): r for r in rows}
    built = structured(spark.createDataFrame(rows, SCHEMA).repartition(4))
    chunks = structural_chunks(built, sizes)
    found = chunks.collect()
    audit = structural_audit(chunks, built, sizes).collect()
    assert {r["doc_id"] for r in audit} == {r["doc_id"] for r in found} and all(r["exact"] and r["within"] and r["covered"] for r in audit)
    leaves = [r for r in found if r["kind"] == "leaf"]
    assert len({r["chunk_id"] for r in found}) == len(found)
    for r in found:
        pieces = []
        for s in r["segments"]:
            block = blocks[r["doc_id"], s["place"]]
            body = block[4][s["source_start"] - block[5] : s["source_end"] - block[5]]
            assert body and r["content"][s["content_start"] : s["content_end"]] == body and s["page"] == block[6]
            pieces.append(body)
        rest, at = [], 0
        for s in r["segments"]:
            rest.append(r["content"][at : s["content_start"]])
            at = s["content_end"]
        assert "".join(rest).strip() == "" and at == len(r["content"])
        assert (r["start"], r["end"]) == (r["segments"][0]["source_start"], r["segments"][-1]["source_end"])
    # What is in no leaf is layout, empty, or a group of headings alone.
    covered = {(r["doc_id"], s["place"]) for r in leaves for s in r["segments"]}
    for b in built.collect():
        if (b["doc_id"], b["place"]) not in covered:
            assert b["role"] in ("furniture", "heading") or not b["text"].strip()
    parents = [r for r in found if r["kind"] == "parent"]
    assert parents or sizes.parent < 100
    for p in parents:
        own = [r for r in leaves if r["parent_id"] == p["chunk_id"]]
        assert len(own) > 1 and len({r["unit_id"] for r in own} | {p["unit_id"]}) == 1
        places = lambda chunks: {(s["place"], x) for r in chunks for s in r["segments"] for x in range(s["source_start"], s["source_end"])}
        assert places([p]) == places(own)
        assert len(p["content"]) + len(p["header"]) + 2 <= sizes.parent


def test_tables_keep_their_head_and_groups_their_kind(spark):
    table = "\n".join(["| a | b |", "|---|---|", *(f"| {k} | {k} |" for k in range(9))])
    rows = [(1, 0, "heading", 1, "Top", 0, 1, None), (1, 1, "paragraph", None, "before the following table:", 10, 1, None), (1, 2, "table", None, table, 50, 1, None), (1, 3, "paragraph", None, "after", 300, 2, None), (2, 0, "heading", 1, "Only a heading", 0, 1, None), (2, 1, "heading", 1, "and one more", 20, 1, None)]
    got = structural_chunks(structured(spark.createDataFrame(rows, SCHEMA)), Sizes(60, 0, 10)).orderBy("start", "end").collect()
    assert {r["doc_id"] for r in got} == {1} and all(r["header"] == "Top" for r in got)
    assert got[0]["content"] == "Top\n\nbefore the following table:" and got[-1]["content"] == "after"
    tables = [r["content"].split("\n") for r in got[1:-1]]
    assert all(t[:2] == ["| a | b |", "|---|---|"] and len("\n".join(t)) <= 55 for t in tables)
    assert [line for t in tables for line in t[2:]] == table.split("\n")[2:]


def test_audit_notices(spark):
    built = structured(spark.createDataFrame(documents(5, 6), SCHEMA))
    chunks = structural_chunks(built, Sizes(60, 0, 10))
    first = chunks.filter("kind = 'leaf' and length(content) > 5").groupBy("doc_id").agg(F.min("chunk_id").alias("chunk_id"))
    wrong = chunks.join(first.withColumn("bad", F.lit(True)), ["doc_id", "chunk_id"], "left").withColumn("content", F.when(F.col("bad"), F.concat(F.lit("#"), "content")).otherwise(F.col("content")))
    assert not any(r["exact"] for r in structural_audit(wrong.join(first.select("doc_id"), "doc_id", "left_semi"), built, Sizes(60, 0, 10)).collect())
    less = chunks.join(first, ["doc_id", "chunk_id"], "left_anti")
    assert any(not r["covered"] for r in structural_audit(less, built, Sizes(60, 0, 10)).collect())
