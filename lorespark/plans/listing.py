"""Queries of listings, scopes, roles, jobs and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as op
from .projections import table, with_

MATRIX = [("admin", "read"), ("admin", "write"), ("admin", "delete"), ("editor", "read"), ("editor", "write"), ("viewer", "read")]
_MATRIX = "matrix(role, permission) AS (VALUES " + ", ".join(f"('{r}', '{p}')" for r, p in MATRIX) + ")"


def permissions(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "admin").when(F.col("c_custkey") % 3 == 1, "editor").otherwise("viewer").alias("role"))
    granted = op.permitted(users, spark.createDataFrame(MATRIX, "role string, permission string"))
    return granted.groupBy("permission").agg(F.count("*").alias("users"), F.sum("user_id").alias("ids"))


def _chunks(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunk")
    return chunks.withColumn("section_path", F.array("section", F.col("page_no").cast("string"))).withColumn("point_ids", F.array("knowledge_point", F.concat(F.lit("P"), (F.col("id") % 4).cast("string")))).withColumn("labels", F.array(F.concat(F.lit("L"), (F.col("id") % 6).cast("string"))))


def visible_content(spark, sf_dir):
    items, out = table(spark, sf_dir, "content_item"), None
    for role in ("viewer", "editor"):
        rows = op.visible(items, role).groupBy("template_id").agg(F.count("*").alias("items")).select(F.lit(role).alias("role"), "template_id", "items")
        out = rows if out is None else out.unionByName(rows)
    return out


def content_calls(spark, sf_dir):
    calls = op.calls_with_content(table(spark, sf_dir, "trace_log"), table(spark, sf_dir, "content_item"), "cloze")
    return calls.groupBy("item_status", "template_id").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def leaf_removal(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunk")
    return op.without_leaf(chunks, chunks.filter("chunk_index = 3 and document_id % 2 = 0"))


QUERIES = {
    "content_page": lambda s, d: op.page_of(table(s, d, "content_item"), {"status": "published"}, [F.desc("id")], 20, 2).select("id", "template_id", "source"),
    "content_counts": lambda s, d: op.counts_by(table(s, d, "content_item"), "status", "template_id", "tenant_id"),
    "content_by_id": lambda s, d: op.by_id(table(s, d, "content_item"), table(s, d, "orders").select(F.col("o_custkey").alias("id"))).select("id", "found", "status", "template_id"),
    "foreign_rows": lambda s, d: op.foreign_rows(table(s, d, "trace_log"), "tenant2", "template_id"),
    "permissions": permissions,
    "visible_content": visible_content,
    "scoped_chunks": lambda s, d: op.retrieval_scope(_chunks(s, d), section=("en", "1"), points=("KP3", "P3"), labels=("kp5", "l2")).select("id", "document_id"),
    "content_calls": content_calls,
    "document_summary": lambda s, d: op.document_summary(table(s, d, "chunk")),
    "job_summary": lambda s, d: op.job_summary(table(s, d, "page_task")),
    "page_gaps": lambda s, d: op.page_gaps(table(s, d, "page_task")),
    "chunk_families": lambda s, d: op.chunk_families(table(s, d, "chunk"), "section", "embedding_model"),
    "leaf_removal": leaf_removal,
    "gold_candidates": lambda s, d: op.gold_candidates(table(s, d, "content_item"), table(s, d, "quality_record"), table(s, d, "trace_log")),
}

SQL = {
    "content_page": with_("content_item") + "SELECT id, template_id, source FROM content_item WHERE status = 'published' ORDER BY id DESC LIMIT 20 OFFSET 20",
    "content_counts": with_("content_item") + "SELECT 'total' AS facet, NULL AS name, count(*) AS n FROM content_item" + "".join(f" UNION ALL SELECT '{k}', {k}, count(*) FROM content_item GROUP BY {k}" for k in ("status", "template_id", "tenant_id")),
    "content_by_id": with_("content_item") + "SELECT o.id, c.id IS NOT NULL AS found, status, template_id FROM (SELECT DISTINCT o_custkey AS id FROM orders) o LEFT JOIN content_item c USING (id)",
    "foreign_rows": with_("trace_log") + "SELECT template_id, count(*) AS rows, count(*) FILTER (WHERE tenant_id IS DISTINCT FROM 'tenant2') AS \"foreign\", count(*) FILTER (WHERE tenant_id IS DISTINCT FROM 'tenant2') = 0 AS readable FROM trace_log GROUP BY template_id",
    "permissions": f"WITH {_MATRIX} SELECT permission, count(*) AS users, sum(c_custkey) AS ids FROM customer JOIN matrix ON role = CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'viewer' END GROUP BY permission",
    "visible_content": with_("content_item") + "SELECT 'viewer' AS role, template_id, count(*) AS items FROM content_item WHERE status = 'published' GROUP BY template_id UNION ALL SELECT 'editor', template_id, count(*) FROM content_item GROUP BY template_id",
    "scoped_chunks": with_("chunk") + """SELECT id, document_id FROM chunk WHERE (chunk_type IS NULL OR chunk_type <> 'parent') AND section = 'en' AND page_no = 1
AND (lower(knowledge_point) IN ('kp5', 'l2') OR (knowledge_point = 'KP3' AND id % 4 = 3) OR id % 6 = 2)""",
    "content_calls": with_("trace_log", "content_item") + "SELECT c.status AS item_status, t.template_id, count(*) AS calls, round(sum(cost), 6) AS cost FROM trace_log t LEFT JOIN content_item c ON c.id = t.item_id WHERE c.template_id = 'cloze' OR t.template_id = 'cloze' GROUP BY 1, 2",
    "document_summary": with_("chunk") + "SELECT document_id, count(*) FILTER (WHERE chunk_type IS DISTINCT FROM 'parent') AS leaves, count(*) FILTER (WHERE chunk_type = 'parent') AS parents, coalesce(string_agg(DISTINCT embedding_model, ',' ORDER BY embedding_model) FILTER (WHERE chunk_type IS DISTINCT FROM 'parent'), '') AS models FROM chunk GROUP BY document_id",
    "job_summary": with_("page_task") + "SELECT job_id, count(*) AS pages, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in op.PAGE_STATES) + ", count(*) FILTER (WHERE cached) AS cached, round(count(*) FILTER (WHERE status IN ('succeeded', 'failed', 'blank'))::DOUBLE / count(*), 4) AS progress FROM page_task GROUP BY job_id",
    "page_gaps": with_("page_task") + "SELECT * FROM (SELECT job_id, page_no, page_no - coalesce(lag(page_no) OVER (PARTITION BY job_id ORDER BY page_no), 0) - 1 AS missing FROM page_task) WHERE missing > 0",
    "chunk_families": with_("chunk") + """, l AS (SELECT * FROM chunk WHERE chunk_type IS DISTINCT FROM 'parent'),
n AS (SELECT l.*, lag(id) OVER w AS p, lag(section) OVER w AS ps, lag(embedding_model) OVER w AS pm, lead(id) OVER w AS n, lead(section) OVER w AS ns, lead(embedding_model) OVER w AS nm FROM l WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index))
SELECT n.id, n.document_id, CASE WHEN c.section IS NOT DISTINCT FROM n.section AND c.embedding_model IS NOT DISTINCT FROM n.embedding_model THEN c.id END AS parent_id,
  CASE WHEN ps IS NOT DISTINCT FROM n.section AND pm IS NOT DISTINCT FROM n.embedding_model THEN p END AS previous_id,
  CASE WHEN ns IS NOT DISTINCT FROM n.section AND nm IS NOT DISTINCT FROM n.embedding_model THEN n END AS next_id
FROM n LEFT JOIN chunk c ON c.document_id = n.document_id AND c.chunk_type = 'parent'""",
    "leaf_removal": with_("chunk") + """, g AS (SELECT id FROM chunk WHERE chunk_index = 3 AND document_id % 2 = 0),
t AS (SELECT DISTINCT document_id FROM chunk SEMI JOIN g USING (id)),
r AS (SELECT *, document_id IN (SELECT document_id FROM t) AS partial FROM chunk WHERE id NOT IN (SELECT id FROM g))
SELECT id, document_id, partial, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM r WHERE NOT (partial AND chunk_type IS NOT DISTINCT FROM 'parent')
WINDOW w AS (PARTITION BY document_id, chunk_type IS DISTINCT FROM 'parent' ORDER BY chunk_index)""",
    "gold_candidates": with_("content_item", "quality_record", "trace_log") + """, q AS (SELECT item_id, arg_max(score, struct_pack(a := created_at, b := record_id)) AS score FROM quality_record WHERE source = 'auto' GROUP BY item_id),
c AS (SELECT item_id, arg_max(trace_id, struct_pack(a := created_at, b := id)) AS trace_id FROM trace_log WHERE success AND item_id IS NOT NULL GROUP BY item_id)
SELECT i.id AS item_id, i.template_id, q.score, c.trace_id FROM content_item i JOIN q ON q.item_id = i.id LEFT JOIN c ON c.item_id = i.id""",
}
