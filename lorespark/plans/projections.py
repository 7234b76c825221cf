"""The driver's tables as the tables that the operators work on, in SQL for Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TRACE_LOG = """
SELECT 'e' || CAST(event_id AS VARCHAR(20)) AS id,
  't' || CAST(CAST(FLOOR(event_id / 3) AS BIGINT) AS VARCHAR(20)) AS trace_id,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'task' || CAST(event_id % 97 AS VARCHAR(20)) END AS task_id,
  CASE event_id % 4 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'cloze' WHEN 2 THEN 'reading' END AS template_id,
  'm' || CAST(k % 5 AS VARCHAR(20)) AS model,
  CASE event_type WHEN 'purchase' THEN 'qc' WHEN 'signup' THEN 'embedding'
       ELSE CASE WHEN k % 10 = 3 THEN '' WHEN k % 10 = 4 THEN NULL ELSE 'generate' END END AS stage,
  CASE WHEN k % 20 = 0 THEN NULL ELSE CAST(event_id % 3 + 1 AS INT) END AS attempt,
  event_type <> 'error' AS success,
  CASE WHEN k % 10 = 0 THEN NULL ELSE k * 10 END AS prompt_tokens,
  CASE WHEN k % 15 = 0 THEN NULL ELSE k * 3 END AS completion_tokens,
  CASE WHEN k % 25 = 0 THEN NULL ELSE value / 1000 END AS cost,
  CASE WHEN k % 25 < 2 THEN NULL ELSE value / 1500 END AS prompt_cost,
  CASE WHEN k % 7 = 0 THEN NULL ELSE k % 7 < 5 END AS usage_reported,
  value * 10 AS latency_ms,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'tenant' || CAST(user_id % 5 AS VARCHAR(20)) END AS tenant_id,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS item_id,
  ts AS created_at
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) e
"""

QUALITY_EVALUATION = """
SELECT 'c' || CAST(o_custkey AS VARCHAR(20)) AS thread_id,
  CASE o_custkey % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'cloze' ELSE 'reading' END AS template_id,
  rn - 1 + CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS revise_count,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderkey * 37 % 101 AS DOUBLE) END AS score,
  CAST(50 + o_custkey % 30 AS DOUBLE) AS threshold,
  rn = cnt AND o_orderstatus <> 'O' AS is_final, o_orderdate AS created_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
             COUNT(*) OVER (PARTITION BY o_custkey) AS cnt FROM orders) o
"""

#: Every fourth item was judged twice, every seventh review is of another tenant than its item.
QUALITY_RECORD = """
SELECT d.doc_id * 4 AS record_id, d.doc_id AS item_id, 'auto' AS source, LEAST(100.0, CAST(d.n_chars % 101 AS DOUBLE)) AS score,
  CASE d.doc_id % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'cloze' ELSE 'reading' END AS template_id,
  d.doc_id % 5 AS tenant_id, d.doc_id % 5 AS item_tenant, CAST(1000 + d.n_chars % 50 AS BIGINT) AS created_at,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE 'v' || CAST(d.doc_id % 2 AS VARCHAR(20)) END AS version, CAST(NULL AS VARCHAR(20)) AS reviewer,
  CASE WHEN d.doc_id % 4 = 1 THEN NULL ELSE '{"threshold": ' || CAST(50 + d.doc_id % 4 * 10 AS VARCHAR(20)) || '}' END AS config FROM documents d
UNION ALL
SELECT d.doc_id * 4 + 1, d.doc_id, 'auto', CAST(d.n_chars * 7 % 101 AS DOUBLE),
  CASE d.doc_id % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'cloze' ELSE 'reading' END,
  d.doc_id % 5, d.doc_id % 5, CAST(1000 + d.n_chars % 40 AS BIGINT), 'v0', NULL, NULL FROM documents d WHERE d.doc_id % 4 = 0
UNION ALL
SELECT l.doc_id * 4 + 2, l.doc_id, 'manual_review', CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 100.0 ELSE 0.0 END,
  CASE l.doc_id % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'cloze' ELSE 'reading' END,
  CASE WHEN l.doc_id % 7 = 0 THEN NULL ELSE l.doc_id % 5 END, l.doc_id % 5, CAST(2000 AS BIGINT), 'v1', 'r' || CAST(l.doc_id % 3 AS VARCHAR(20)), NULL FROM labels l
"""

TASK_ITEM = """
SELECT l_orderkey AS task_id, l_linenumber AS item_index,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'cancelled'
       WHEN l_quantity < 3 THEN 'awaiting_review' ELSE 'succeeded' END AS status FROM lineitem
"""

TASK = "SELECT o_orderkey AS task_id, CAST(o_orderkey % 8 AS INT) AS expected FROM orders"

#: Returned lines are billed as estimates of a number of their own, so either side lacks some of the other's.
ESTIMATE = "SELECT CASE WHEN l_returnflag = 'R' THEN -l_orderkey ELSE l_orderkey END AS trace_id, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount FROM lineitem"
BILL = "SELECT o_orderkey AS trace_id, CAST(o_totalprice AS DECIMAL(18,4)) AS amount FROM orders"

CONTENT_ITEM = """
SELECT d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'cloze' ELSE 'reading' END AS template_id,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.lang END AS tenant_id,
  CASE d.doc_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'awaiting_review' WHEN 2 THEN 'published' ELSE 'rejected' END AS status,
  d.source AS source, d.n_chars AS n_chars FROM documents d
"""

#: Eight documents in a row stand for the chunks of one, the first for the parent of the others.
CHUNK = """
SELECT d.doc_id AS id, CAST(FLOOR(d.doc_id / 8) AS BIGINT) AS document_id, CAST(d.doc_id % 8 AS INT) AS chunk_index,
  CASE WHEN d.doc_id % 8 = 0 THEN 'parent' WHEN d.doc_id % 8 = 1 THEN NULL ELSE 'leaf' END AS chunk_type,
  d.source AS source_name, d.lang AS section, 'KP' || CAST(d.doc_id % 11 AS VARCHAR(20)) AS knowledge_point,
  CASE WHEN d.doc_id % 3 = 0 THEN 'small' ELSE 'large' END AS embedding_model, CAST(FLOOR(d.doc_id % 8 / 3) AS INT) AS page_no FROM documents d
"""

PAGE_TASK = """
SELECT CAST(FLOOR(p.page_id / 6) AS BIGINT) AS job_id, CAST(p.page_id % 6 + 1 + CASE WHEN p.page_id % 6 > 2 AND FLOOR(p.page_id / 6) % 4 = 0 THEN 2 ELSE 0 END AS INT) AS page_no,
  CASE LENGTH(p.html) % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'blank' ELSE 'succeeded' END AS status,
  LENGTH(p.html) % 3 = 0 AS cached FROM pages p
"""

DIMENSION_SCORE = """
SELECT l_orderkey AS item_id, CASE l_linenumber % 4 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'clarity' WHEN 2 THEN 'format' ELSE 'difficulty' END AS dimension,
  CAST(l_partkey % 101 AS DOUBLE) AS score, CAST(l_suppkey % 3 AS INT) AS round,
  CASE WHEN l_orderkey % 5 = 0 THEN 'fp' ELSE 'pass' END AS verdict FROM lineitem
"""

PROJECTIONS = {
    "trace_log": TRACE_LOG,
    "quality_evaluation": QUALITY_EVALUATION,
    "quality_record": QUALITY_RECORD,
    "task_item": TASK_ITEM,
    "task": TASK,
    "estimate": ESTIMATE,
    "bill": BILL,
    "dimension_score": DIMENSION_SCORE,
    "content_item": CONTENT_ITEM,
    "chunk": CHUNK,
    "page_task": PAGE_TASK,
}


#: Rows of a part on average; a task that sorts or groups so many takes some hundred MB.
PART_ROWS = 1 << 18


def parts(rows: DataFrame) -> int:
    """How many parts the number of rows asks for, which is counted: little work for a file, much for the result of long work."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // PART_ROWS + 1)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in parts by their keys, so that what a task sorts or groups does not grow with the table."""
    return rows.repartition(parts(rows), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or a projection of its tables."""
    if name not in PROJECTIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", PROJECTIONS[name])]
    sql = PROJECTIONS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_(*names: str) -> str:
    """The projections as the head of an SQL query."""
    return "WITH " + ",\n".join(f"{n} AS ({PROJECTIONS[n]})" for n in names) + "\n"
