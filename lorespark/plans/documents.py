"""Queries of parsing, chunking, lineage and hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import lower_plain
from ..operators import documents as op
from ..operators import anchors, graphs, hygiene
from ..sources.html import page_blocks
from ..sources.tables import page_tables, table_rows
from .context import CHUNKS, OVERLAP, SIZE
from .projections import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def chunk_audit(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return op.chunk_audit(docs, op.chunks(docs, SIZE, OVERLAP), SIZE)


def tier_audit(spark, sf_dir):
    """Per document whether its tiered chunks fit and hold all of the text but white space."""
    docs = _docs(spark, sf_dir).filter(r"text rlike '\\S'")
    parts = op.tier_chunks(docs, SIZE).groupBy("doc_id").agg(F.max(F.length("content")).alias("most"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "content"))), lambda x: x["content"]), "").alias("all"))
    squeezed = lambda c: F.md5(F.regexp_replace(c, r"\s+", ""))
    return parts.select("doc_id", (F.col("most") <= SIZE).alias("fits"), squeezed(F.col("all")).alias("digest"))


def chunk_lineage(spark, sf_dir):
    return op.lineage(op.chunks(_docs(spark, sf_dir), SIZE, OVERLAP)).select("doc_id", "chunk", "start", "end", "prev_chunk", "next_chunk", "overlap")


def chunk_parents(spark, sf_dir):
    return op.parents(op.chunks(_docs(spark, sf_dir), SIZE, OVERLAP))


def block_windows(spark, sf_dir):
    """Blocks against windows of 500 characters of the joined text."""
    blocks = op.line_blocks(_docs(spark, sf_dir))
    lengths = blocks.groupBy("doc_id").agg(F.max("end").alias("n"))
    windows = lengths.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 500))).alias("id"))
    windows = windows.select("doc_id", "id", (F.col("id") * 500).alias("start"), (F.col("id") * 500 + 500).alias("end"))
    return op.overlapping(blocks.select("doc_id", F.col("block").alias("id"), "start", "end"), windows)


def page_block_counts(spark, sf_dir):
    blocks = page_blocks(table(spark, sf_dir, "pages"))
    return blocks.groupBy("page_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def request_dedup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("hash", hygiene.request_hash(F.col("role"), F.col("text")))
    return hygiene.first_requests(turns, "hash", "conv_id", "turn")


def _taxonomy(spark, sf_dir):
    node = lambda name, key, parent: table(spark, sf_dir, name).select(F.concat(F.lit(name[0]), F.col(key).cast("string")).alias("node"), parent.alias("parent"))
    edges = node("region", "r_regionkey", F.lit(None).cast("string"))
    edges = edges.unionByName(node("nation", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    return edges.unionByName(node("customer", "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))


def descendants(spark, sf_dir):
    """Per node how many are below it, and how deep."""
    return graphs.closure(_taxonomy(spark, sf_dir)).filter("hops > 0").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("below"), F.max("hops").alias("depth"))


def resolved_names(spark, sf_dir):
    """Names of suppliers' nations in another form, and parts' types, which are no nodes, by the names of regions and nations."""
    names = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("name"))
    names = names.union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name"))
    labels = table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), F.lower("n_name")).alias("label")).union(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label")).distinct())
    return graphs.resolved(labels, names, lower_plain)


def bounded_reach(spark, sf_dir):
    """From each supplier over the parts of its lines to their other suppliers, at most 120 nodes and two hops."""
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))
    pairs = pairs.groupBy("s", "p").agg(F.min("place").alias("place"))
    edges = pairs.select(F.col("s").alias("source"), F.col("p").alias("target"), "place").unionByName(pairs.select("p", "s", "place").toDF("source", "target", "place"))
    return graphs.bounded_reach(pairs.select(F.col("s").alias("seed"), F.col("s").alias("node"), F.lit(0).alias("place")).distinct(), edges, 120, 2)


def pool_candidates(spark, sf_dir):
    """Labelled good documents that no benchmark item of the same number stands for."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return hygiene.not_pooled(good, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


def review_sample(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return hygiene.seeded_sample(labels, "doc_id", 6, "review", (F.col("quality") == 1) & (F.col("toxic") == 1))


def fewshot_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return hygiene.budgeted(turns, "conv_id", ["turn"], "chars", 600, 3)


def example_reasons(spark, sf_dir):
    """Why each labelled document may not serve as an example; the first reason counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.coalesce(F.sha2("text", 256), F.lit("")).alias("content"))
    docs = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    firsts = docs.groupBy("content").agg(F.min("doc_id").alias("first_id"))
    used = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("used_id"))
    rows = docs.join(firsts, "content").join(used, F.col("doc_id") == F.col("used_id"), "left")
    reasons = [("toxic", F.col("toxic") == 1), ("low_quality", F.col("quality") == 0), ("in_evaluation", F.col("used_id").isNotNull()), ("duplicate", F.col("first_id") < F.col("doc_id")), ("too_long", F.col("n_chars") > 4000)]
    return hygiene.first_reason(rows, reasons).select("doc_id", "reason")


def anchor_report(spark, sf_dir):
    """Documents as pages that sources have read; anchors are a stretch of each, and one that lost its letters e."""
    docs = table(spark, sf_dir, "documents")
    seconds = (F.col("n_chars") % 1000 / 250).cast("double")
    outputs = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("engine"), F.col("doc_id").alias("place"), F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("ok").alias("status"), seconds.alias("seconds"), F.col("text").alias("markdown"))
    stretch = F.substring("text", 20, 60)
    pair = F.array(F.array(F.col("lang"), F.col("source")))
    return anchors.anchor_report(outputs, docs.select(F.col("doc_id").alias("page_id"), F.array(stretch, F.translate(stretch, "e", "")).alias("anchors"), pair.alias("pairs")))


def _order_tables(spark, sf_dir):
    """Each order as a page with a table of its lines: two rows of headers, and one cell for all lines of a flag."""
    # One shuffle by page serves the three groupings.
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey").repartition("page_id")
    lines = lines.groupBy("page_id", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    cells = F.concat(F.lit("<td>"), F.col("part").cast("string"), F.lit("</td><td>"), F.col("supp").cast("string"), F.lit("</td></tr>"))
    rows = lines.groupBy("page_id", "flag").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", cells.alias("cells")))).alias("lines"))
    body = F.concat(F.lit("<tr><td rowspan='"), F.size("lines").cast("string"), F.lit("'>"), F.col("flag"), F.lit("</td>"), F.array_join("lines.cells", "<tr>"))
    pages = rows.select("page_id", F.struct("flag", body.alias("html")).alias("part")).groupBy("page_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    head = "<table><thead><tr><th rowspan=2>flag</th><th colspan=2>of</th></tr><tr><th>part</th><th>supplier</th></tr></thead>"
    return pages.select("page_id", F.concat(F.lit(head), F.array_join("parts.html", ""), F.lit("</table>")).alias("html"))


def grid_rows(spark, sf_dir):
    rows = table_rows(page_tables(_order_tables(spark, sf_dir), with_cells=False))
    value = lambda name: F.element_at("values", F.lit(name))
    return rows.select("page_id", "row", value("flag").alias("flag"), value("of > part").alias("part"), value("of > supplier").alias("supplier"))


QUERIES = {
    "grid_rows": grid_rows,
    "anchor_report": anchor_report,
    "example_reasons": example_reasons,
    "event_islands": lambda s, d: hygiene.islands(table(s, d, "events"), "user_id", "ts", "event_id", "6 hours"),
    "line_blocks": lambda s, d: op.line_blocks(_docs(s, d)).select("doc_id", "block", "kind", "start", "end"),
    "chunk_audit": chunk_audit,
    "chunk_lineage": chunk_lineage,
    "chunk_parents": chunk_parents,
    "block_windows": block_windows,
    "page_block_counts": page_block_counts,
    "tier_audit": tier_audit,
    "text_blocks": lambda s, d: op.text_blocks(_docs(s, d)).select("doc_id", "block", "kind", "first_line", "last_line"),
    "request_dedup": request_dedup,
    "taxonomy_closure": lambda s, d: graphs.closure(_taxonomy(s, d)),
    "descendants": descendants,
    "resolved_names": resolved_names,
    "bounded_reach": bounded_reach,
    "pool_candidates": pool_candidates,
    "review_sample": review_sample,
    "fewshot_budget": fewshot_budget,
    "exported_samples": lambda s, d: hygiene.exported(table(s, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn").select(F.md5("line").alias("line")),
}

LINE_BLOCKS = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM l),
n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM t WHERE text <> ''),
b AS (SELECT doc_id, block, CASE WHEN regexp_matches(text, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(text, '^(?:[-*+]|\\d+[.)])\\s') THEN 'list' WHEN regexp_matches(text, '^\\|.*\\|$') THEN 'table' ELSE 'paragraph' END AS kind,
        length(text) AS n, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n)
"""
SQL = {
    "grid_rows": "WITH l AS (SELECT l_orderkey AS page_id, l_linenumber AS n, min(l_returnflag) AS flag, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY flag, n) - 1 AS row, flag, CAST(part AS VARCHAR) AS part, CAST(supp AS VARCHAR) AS supplier FROM l",
    "example_reasons": """WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'in_evaluation'
  WHEN first_id < doc_id THEN 'duplicate' WHEN n_chars > 4000 THEN 'too_long' ELSE 'eligible' END AS reason FROM d""",
    "event_islands": """WITH o AS (SELECT user_id, event_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM i GROUP BY user_id, island""",
    "line_blocks": LINE_BLOCKS + 'SELECT doc_id, block, kind, start, start + n AS "end" FROM b',
    "chunk_audit": "SELECT doc_id, TRUE AS exact, TRUE AS within, TRUE AS gapless, TRUE AS complete FROM documents WHERE regexp_matches(text, '\\S')",
    "chunk_lineage": f'WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk, s AS start, e AS "end", lag(chunk) OVER w AS prev_chunk, lead(chunk) OVER w AS next_chunk, greatest(0, coalesce(lag(e) OVER w - s, 0)) AS overlap FROM c WHERE chunk >= 0 WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)',
    "chunk_parents": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk, parent FROM p",
    "tier_audit": r"SELECT doc_id, TRUE AS fits, md5(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents WHERE regexp_matches(text, '\S')",
    "block_windows": LINE_BLOCKS + """, x AS (SELECT doc_id, max(start + n) AS n FROM b GROUP BY doc_id),
w AS (SELECT doc_id, unnest(range(0, (n - 1) // 500 + 1)) AS id FROM x)
SELECT b.doc_id, b.block AS l_id, w.id AS r_id, greatest(b.start, w.id * 500) AS lo, least(b.start + b.n, w.id * 500 + 500) AS hi
FROM b JOIN w ON b.doc_id = w.doc_id AND b.start < w.id * 500 + 500 AND b.start + b.n > w.id * 500""",
    "request_dedup": "SELECT sha256(role || '|' || text) AS hash, min(struct_pack(conv_id := conv_id, turn := turn)).conv_id AS conv_id, min(struct_pack(conv_id := conv_id, turn := turn)).turn AS turn, count(*) AS requests FROM conversations GROUP BY 1",
    "resolved_names": """WITH n AS (SELECT 'r' || r_regionkey AS node, lower(r_name) AS name FROM region UNION ALL SELECT 'n' || n_nationkey, lower(n_name) FROM nation),
l AS (SELECT '  ' || lower(n_name) AS label FROM nation UNION ALL SELECT DISTINCT c_mktsegment FROM customer)
SELECT label, node FROM l LEFT JOIN n ON name = lower(trim(label))""",
    "bounded_reach": """WITH p AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, min(l_orderkey * 8 + l_linenumber) AS place FROM lineitem GROUP BY 1, 2),
a AS (SELECT s AS seed, p AS node, row_number() OVER (PARTITION BY s ORDER BY place, p) + 1 AS nth FROM p QUALIFY nth <= 120),
m AS (SELECT seed, max(nth) AS had FROM a GROUP BY seed),
t AS (SELECT a.seed, p.s AS node, min(row(a.nth, p.place)) AS way FROM a JOIN p ON p.p = a.node WHERE p.s <> a.seed GROUP BY 1, 2),
b AS (SELECT t.seed, t.node, had + row_number() OVER (PARTITION BY t.seed ORDER BY way, t.node) AS place FROM t JOIN m USING (seed))
SELECT DISTINCT s AS seed, s AS node, CAST(1 AS BIGINT) AS place, 0 AS hops FROM p UNION ALL SELECT seed, node, nth, 1 FROM a UNION ALL SELECT seed, node, place, 2 FROM b WHERE place <= 120""",
    "descendants": """SELECT 'r' || n_regionkey AS node, count(DISTINCT n_nationkey) + count(c_custkey) AS below, CASE WHEN count(c_custkey) > 0 THEN 2 ELSE 1 END AS depth FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey
UNION ALL SELECT 'n' || c_nationkey, count(*), 1 FROM customer GROUP BY c_nationkey""",
    "taxonomy_closure": """WITH RECURSIVE edges AS (
  SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
up(ancestor, node, hops) AS (SELECT node, node, 0 FROM edges UNION ALL SELECT e.parent, u.node, u.hops + 1 FROM up u JOIN edges e ON e.node = u.ancestor WHERE e.parent IS NOT NULL)
SELECT ancestor, node, hops FROM up""",
    "pool_candidates": "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id NOT IN (SELECT item_id FROM benchmark)",
    "review_sample": """WITH r AS (SELECT doc_id, 'sample' AS reason FROM (SELECT doc_id FROM labels ORDER BY sha256('review|' || doc_id) LIMIT 6) UNION SELECT doc_id, 'disagreement' FROM labels WHERE quality = 1 AND toxic = 1)
SELECT doc_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY doc_id""",
    "fewshot_budget": """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST(600 AS BIGINT) AS room, 0 AS k, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS chars, FALSE AS kept FROM t
  UNION ALL SELECT t.conv_id, t.n, CASE WHEN k < 3 AND t.chars <= room THEN room - t.chars ELSE room END, CASE WHEN k < 3 AND t.chars <= room THEN k + 1 ELSE k END, t.turn, t.chars, coalesce(k < 3 AND t.chars <= room, FALSE) FROM f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1)
SELECT conv_id, turn, chars FROM f WHERE kept""",
    "exported_samples": "SELECT md5(CAST(to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text}) AS VARCHAR)) AS line FROM conversations",
}
