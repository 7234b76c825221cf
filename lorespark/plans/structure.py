"""Queries of documents' structure, over the lines of all documents as blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, relations, retrieval, semantic, structural
from ..operators import structure as op
from ..operators.tables import written
from .context import CUTS
from .documents import LINE_BLOCKS
from .projections import table


def _built(spark, sf_dir):
    """Short lines stand for headings, as the documents have none, and some lengths for tables and code."""
    blocks = documents.line_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.length("text")
    kind = F.when(size < 40, "heading").when(size % 7 == 0, "table").when(size % 11 == 0, "code").otherwise(F.col("kind"))
    return op.structured(blocks.select("doc_id", F.col("block").alias("place"), kind.alias("kind"), (1 + size % 3).alias("depth"), "text", "start"))


def structure_edges(spark, sf_dir):
    return op.edges(written(_built(spark, sf_dir), "built")).withColumn("evidence", F.array_join("evidence", ","))


def structural_chunks(spark, sf_dir):
    """The leaves of all documents."""
    leaves = structural.structural_chunks(_built(spark, sf_dir)).filter("kind = 'leaf'")
    number = F.element_at(F.split("chunk_id", ":"), -1).cast("int")
    return leaves.select("doc_id", F.col("segments")[0]["place"].alias("first"), number.alias("number"), "header", "start", "end", F.md5("content").alias("content"))


def relation_context(spark, sf_dir):
    """Bundles for benchmark items, from the leaves that their terms recall; every third item is a question of three parts."""
    built = written(_built(spark, sf_dir), "built")
    chunks = written(structural.structural_chunks(built), "chunks")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    leaves = chunks.filter("kind = 'leaf'").select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
    found = retrieval.keyword_recall(items, leaves, 8).select("query_id", "rank", F.col("candidate_id").alias("chunk_id"), F.when(F.col("query_id") % 3 == 0, 3).otherwise(1).alias("question_parts"))
    sources = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source_name"))
    given = relations.relation_context(found, chunks, built, sources, relations.BundleLimits(chars=4000))
    return given.select("query_id", "bundle", "chunk_id", "doc_id", F.size("segments").alias("segments"), F.md5("text").alias("text"), "complete", F.array_join("reasons", ",").alias("reasons"))


def semantic_groups(spark, sf_dir):
    """Lines of all documents, cut where neighbouring sentences have few words in common."""
    blocks = documents.line_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = semantic.sentences(blocks.select(F.concat_ws("-", "doc_id", "block").alias("block_id"), "text"))
    return semantic.semantic_groups(semantic.text_likeness(found), 0.2, 400)


def late_pooling(spark, sf_dir):
    """Words of conversations' turns as tokens, their hash as vectors, halves of the turn as chunks."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = turns.select("doc_id", F.length("text").alias("n"), F.posexplode(F.split("text", " ", -1)).alias("id", "word"), F.split("text", " ", -1).alias("all"))
    start = F.aggregate(F.slice("all", F.lit(1), F.col("id")), F.lit(0).cast("long"), lambda n, w: n + F.length(w) + 1)
    tokens = words.select("doc_id", "id", "word", start.alias("start")).withColumn("end", F.col("start") + F.length("word"))
    at = F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("long") % 32
    states = tokens.select("doc_id", "id", at.cast("int").alias("dim"), F.lit(1.0).alias("value"))
    half = F.floor(F.length("text") / 2)
    spans = turns.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("id"), F.lit(0).cast("long").alias("start"), half.alias("end")), F.struct(F.lit(1).alias("id"), half.alias("start"), F.length("text").cast("long").alias("end")))).alias("s")).select("doc_id", "s.*").filter("start < end")
    return semantic.pooled(tokens.drop("word"), states, spans).withColumn("value", F.round("value", 6))


QUERIES = {
    "semantic_groups": semantic_groups,
    "late_pooling": late_pooling,
    "relation_context": relation_context,
    "structural_chunks": structural_chunks,
    "structure_sections": lambda s, d: op.sections(_built(s, d)).select("doc_id", "place", "section_id", "parent_section", "level", "title"),
    "structure_units": lambda s, d: op.units(_built(s, d)),
    "structure_edges": structure_edges,
    "structure_roles": lambda s, d: _built(s, d).groupBy("doc_id", "role").agg(F.count("*").alias("blocks"), F.sum(F.size("barriers")).alias("barriers")),
}

#: Roles by the policy's patterns, of which SQL needs no look-ahead to find a match; the documents have no chapters in Chinese,
#: no pages and no references to sections.
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(shown, '(?i){p.replace('(?=[㐀-鿿])', '[㐀-鿿]')}') THEN '{n}'" for n, p in op.ROLES) + " WHEN kind IN ('table', 'code') THEN kind ELSE 'body' END"
_ID = lambda kind, place: f"substr(sha256(doc_id || '|{kind}|' || {place}), 1, 32)"
_STRUCTURE = LINE_BLOCKS + rf""", k AS (SELECT b.doc_id, b.block AS place, CASE WHEN b.n < 40 THEN 'heading' WHEN b.n % 7 = 0 THEN 'table' WHEN b.n % 11 = 0 THEN 'code' ELSE b.kind END AS kind, n.text, 1 + b.n % 3 AS depth FROM b JOIN n USING (doc_id, block)),
r0 AS (SELECT *, CASE WHEN kind = 'heading' THEN trim(regexp_replace(text, '^#+\s*', '')) ELSE text END AS shown FROM k),
r1 AS (SELECT *, {_ROLE} AS role FROM r0),
r2 AS (SELECT *, kind = 'heading' AND role = 'body' AS head, CASE WHEN regexp_matches(shown, '{op.SUBSECTION}') THEN 3 ELSE depth END AS level, role IN {op.BREAKS} AS breaks FROM r1),
r3 AS (SELECT *, max(CASE WHEN head THEN place END) OVER w AS section, lag(breaks) OVER w AS breaks_before, lag(role) OVER w AS role_before, lag(text) OVER w AS text_before FROM r2 WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
r4 AS (SELECT *, NOT head AND NOT breaks AND breaks_before = FALSE AS meets, coalesce(role = 'table' AND regexp_matches(text_before, '(?i){op.TABLE_REFERENCE}'), FALSE) AS tied FROM r3),
r5 AS (SELECT *, coalesce(meets AND section IS NOT NULL AND (tied OR role <> 'table' AND role_before <> 'table'), FALSE) AS joins FROM r4),
r AS (SELECT *, max(CASE WHEN NOT joins THEN place END) OVER (PARTITION BY doc_id ORDER BY place) AS unit FROM r5)
"""
SQL = {
    "semantic_groups": LINE_BLOCKS.replace("WITH ", "WITH RECURSIVE ", 1) + r""", q AS (SELECT doc_id || '-' || block AS block_id, regexp_extract_all(text, '(?s).+?(?:[。！？]|[.!?](?:\s|$)|$)') AS ps FROM n),
u AS (SELECT block_id, unnest(ps) AS text, unnest(range(len(ps))) AS i, unnest(list_transform(range(len(ps)), lambda k: coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0))) AS start FROM q),
s AS (SELECT block_id, text, start, start + length(text) AS stop, row_number() OVER (PARTITION BY block_id ORDER BY i) AS no FROM u WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
e AS (SELECT block_id, no, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{3400}-\x{9fff}]')) AS w FROM s),
c AS (SELECT block_id, no, CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 63 + 1 AS dim, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY 1, 2, 3 UNION ALL SELECT block_id, no, 0, 0.01 FROM s),
v AS (SELECT block_id, no, dim, value / sqrt(sum(value * value) OVER (PARTITION BY block_id, no)) AS value FROM c),
d AS (SELECT a.block_id, a.no, round(sum(a.value * z.value), 9) AS sim FROM v a JOIN v z ON z.block_id = a.block_id AND z.no = a.no - 1 AND z.dim = a.dim GROUP BY 1, 2),
g AS (SELECT s.*, sim, count(*) OVER (PARTITION BY block_id) AS k, max(stop - start) OVER (PARTITION BY block_id) AS most FROM s LEFT JOIN d USING (block_id, no)),
f AS (
  SELECT block_id, no, start, stop, 0 AS part, start AS begins FROM g WHERE no = 1 AND k > 1 AND most <= 400
  UNION ALL
  SELECT g.block_id, g.no, g.start, g.stop, part + (sim < 0.2 OR g.stop - begins > 400)::INT, CASE WHEN sim < 0.2 OR g.stop - begins > 400 THEN g.start ELSE begins END FROM f JOIN g ON g.block_id = f.block_id AND g.no = f.no + 1)
SELECT block_id, part, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end", count(*) AS sentences FROM f GROUP BY 1, 2""",
    "late_pooling": """WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
w AS (SELECT doc_id, n, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM t),
p AS (SELECT doc_id, n, i, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
k AS (SELECT doc_id, unnest([0, 1]) AS id, n, n // 2 AS half FROM t),
m AS (SELECT k.doc_id, k.id, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % 32 AS dim FROM k JOIN p ON p.doc_id = k.doc_id AND word <> '' AND start < CASE id WHEN 0 THEN half ELSE k.n END AND start + length(word) > CASE id WHEN 0 THEN 0 ELSE half END),
s AS (SELECT doc_id, id, dim, count(*)::DOUBLE AS total FROM m GROUP BY 1, 2, 3)
SELECT doc_id, id, CAST(dim AS INTEGER) AS dim, round(total / sqrt(sum(total * total) OVER (PARTITION BY doc_id, id)), 6) AS value FROM s""",
    # Lines of a group lie next to each other in a document's text, so places in it are places in the source.
    "structural_chunks": _STRUCTURE.replace("WITH ", "WITH RECURSIVE ", 1) + rf""", h AS (SELECT doc_id, place, shown, (SELECT max(p.place) FROM r p WHERE p.doc_id = r.doc_id AND p.head AND p.place < r.place AND p.level < r.level) AS above FROM r WHERE head),
hp AS (SELECT doc_id, place, shown AS path FROM h WHERE above IS NULL UNION ALL SELECT h.doc_id, h.place, hp.path || ' > ' || h.shown FROM hp JOIN h ON h.doc_id = hp.doc_id AND h.above = hp.place),
g0 AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY place) AS kind_before FROM r),
g1 AS (SELECT *, max(CASE WHEN NOT joins OR kind IN ('table', 'code') OR kind_before IN ('table', 'code') THEN place END) OVER (PARTITION BY doc_id ORDER BY place) AS first FROM g0),
g AS (SELECT g1.doc_id, first, string_agg(g1.text, chr(10) || chr(10) ORDER BY g1.place) AS text, coalesce(any_value(hp.path), '') AS header, any_value(g1.kind) FILTER (g1.place = first) AS kind, min(b.start) AS start
  FROM g1 JOIN b ON b.doc_id = g1.doc_id AND b.block = g1.place LEFT JOIN hp ON hp.doc_id = g1.doc_id AND hp.place = g1.section GROUP BY g1.doc_id, first HAVING NOT bool_and(head)),
o AS (SELECT *, greatest(1, 800 - CASE WHEN header <> '' THEN length(header) + 2 ELSE 0 END) AS size FROM g),
src AS (SELECT {{'doc': doc_id, 'first': first}} AS doc_id, text, length(text) AS n, size, CASE WHEN kind IN ('table', 'code') THEN 0 ELSE least(80, size // 2) END AS back, header, start FROM o),
{CUTS},
x AS (SELECT c.doc_id.doc AS doc_id, c.doc_id.first AS g, chunk AS number, header, src.start + s AS start, regexp_replace(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '\n+$', '') AS content FROM c JOIN src USING (doc_id) WHERE chunk >= 0)
SELECT x.doc_id, max(b.block) AS first, number, header, any_value(x.start) AS start, any_value(x.start + length(content)) AS "end", any_value(md5(content)) AS content FROM x JOIN b ON b.doc_id = x.doc_id AND b.start <= x.start GROUP BY x.doc_id, g, number, header""",
    "structure_sections": _STRUCTURE + f"""SELECT doc_id, place, {_ID('section', 'place')} AS section_id, {_ID('section', '(SELECT max(p.place) FROM r p WHERE p.doc_id = r.doc_id AND p.head AND p.place < r.place AND p.level < r.level)')} AS parent_section, level, shown AS title FROM r WHERE head""",
    "structure_units": _STRUCTURE + f"SELECT doc_id, {_ID('unit', 'unit')} AS unit_id, {_ID('section', 'max(section)')} AS section_id, min(place) AS first, max(place) AS last, count(*) AS members FROM r GROUP BY doc_id, unit",
    "structure_edges": _STRUCTURE + """, e AS (SELECT *, CASE WHEN tied THEN 'definition_to_table' WHEN joins THEN 'same_knowledge_unit' ELSE 'adjacent_context' END AS relation FROM r WHERE meets)
SELECT doc_id, substr(sha256(doc_id || '|' || (place - 1) || '|' || place || '|' || relation), 1, 32) AS edge_id, place - 1 AS source, place AS target, relation, CASE WHEN joins THEN 'accepted' ELSE 'proposed' END AS state,
  CASE WHEN joins THEN 'shared_structural_section' ELSE 'physical_adjacency_only' END || CASE WHEN tied THEN ',explicit_table_reference' ELSE '' END AS evidence FROM e""",
    "structure_roles": _STRUCTURE + "SELECT doc_id, CASE WHEN head THEN 'heading' ELSE role END AS role, count(*) AS blocks, sum(head::INT + breaks::INT) AS barriers FROM r GROUP BY 1, 2",
}
