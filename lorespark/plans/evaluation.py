"""Queries of dashboards, ledgers, pools and recovery rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as op
from .projections import table, with_

_LOG = with_("trace_log")


def worker_summary(spark, sf_dir):
    samples = table(spark, sf_dir, "trace_log").select("model", F.when(F.col("success"), "succeeded").when(F.col("attempt").isNull(), "running").otherwise("failed").alias("status"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("seconds_at"), F.col("latency_ms").alias("latency"))
    return op.worker_summary(samples, "model")


def review_pool(spark, sf_dir):
    """Contents are texts; the document's parity judges against its label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = docs.join(labels, "doc_id").select(F.md5("text").alias("content"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"), F.col("source"))
    return op.review_pool(judged)


def stale_items(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 6).alias("attempts"), F.col("o_orderdate").alias("updated_at"))
    return op.stale_items(items, F.lit("1996-01-01 00:00:00"), 86_400, 5).withColumn("wait_seconds", op.backoff_seconds(F.col("attempts"), 30.0))


def active_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("ended"))
    return op.active_requests(requests, "o_custkey", ["o_orderdate", "o_orderkey"], "ended").select("o_custkey", "o_orderkey", "accepted")


QUERIES = {
    "dashboard": lambda s, d: op.dashboard(table(s, d, "trace_log"), table(s, d, "quality_evaluation"), table(s, d, "task_item")),
    "ship_cycles": lambda s, d: op.cycle_seconds(table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), "o_orderpriority", "o_orderdate", "l_shipdate"),
    "worker_summary": worker_summary,
    "stage_states": lambda s, d: op.stage_states(table(s, d, "trace_log")),
    "logical_cost": lambda s, d: op.logical_cost(table(s, d, "trace_log"), "trace_id"),
    "recovery": lambda s, d: op.recovery(table(s, d, "trace_log"), "model"),
    "review_pool": review_pool,
    "duplicate_threads": lambda s, d: op.duplicates(table(s, d, "quality_evaluation"), "thread_id", "status"),
    "turn_neighbours": lambda s, d: op.neighbours(table(s, d, "conversations"), "conv_id", ["turn"], "turn", 2),
    "alternating_arms": lambda s, d: op.alternating_arms(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", ["l_linenumber"]),
    "stale_items": stale_items,
    "active_requests": active_requests,
    "position_bias": lambda s, d: op.position_bias(table(s, d, "lineitem").select(F.col("l_returnflag").alias("option"))),
}

SQL = {
    "dashboard": with_("trace_log", "quality_evaluation", "task_item") + """, t AS (SELECT thread_id, max(revise_count) AS most FROM quality_evaluation GROUP BY 1),
c AS (SELECT count(*) AS calls, round(sum(cost), 6) AS cost, CAST(count(*) FILTER (WHERE success) AS DOUBLE) / count(*) AS success_rate FROM trace_log),
h AS (SELECT count(*) AS threads, CAST(count(*) FILTER (WHERE most > 0) AS DOUBLE) / count(*) AS revise_rate FROM t),
i AS (SELECT count(*) AS items, CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*) AS failed_rate FROM task_item)
SELECT c.*, h.*, i.*, round(cost / threads, 6) AS cost_per_thread FROM c, h, i""",
    "ship_cycles": "SELECT o_orderpriority, round(avg(epoch(l_shipdate::TIMESTAMP) - epoch(o_orderdate::TIMESTAMP)), 4) AS avg_seconds, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1",
    "worker_summary": _LOG + """, s AS (SELECT model, CASE WHEN success THEN 'succeeded' WHEN attempt IS NULL THEN 'running' ELSE 'failed' END AS status, CAST(floor(epoch(created_at)) AS BIGINT) AS sec, latency_ms FROM trace_log)
SELECT model, count(*) AS total, count(*) FILTER (WHERE status <> 'running') AS ended, round(CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*) FILTER (WHERE status <> 'running'), 6) AS failure_rate,
  round(CAST(count(*) FILTER (WHERE status = 'running') AS DOUBLE) / count(*), 6) AS unresolved_rate, round(CAST(count(*) FILTER (WHERE status <> 'running') AS DOUBLE) / ((max(sec) - min(sec)) / 3600.0), 4) AS per_hour, quantile_disc(latency_ms, 0.95) AS latency_p95
FROM s GROUP BY model""",
    "stage_states": _LOG + "SELECT stage, count(*) AS planned, count(*) FILTER (WHERE success) AS completed, count(*) FILTER (WHERE NOT success) AS failed, count(cost) AS priced, count(*) FILTER (WHERE usage_reported) AS with_usage, count(*) FILTER (WHERE usage_reported AND cost IS NULL) AS unpriced, count(*) FILTER (WHERE usage_reported IS NOT TRUE) AS without_usage, count(*) FILTER (WHERE attempt > 1) AS retried, count(*) FILTER (WHERE attempt IS NULL) AS unknown_attempt FROM trace_log GROUP BY stage",
    "logical_cost": _LOG + "SELECT trace_id, CASE WHEN count(*) = count(cost) THEN round(sum(cost), 6) END AS cost, count(*) AS calls FROM trace_log GROUP BY trace_id",
    "recovery": _LOG + """, p AS (SELECT model, trace_id, arg_min(success, struct_pack(a := coalesce(attempt, 1), i := id)) AS first, bool_or(success) AS ever, count(*) AS n FROM trace_log GROUP BY 1, 2)
SELECT model, count(*) AS paths, count(*) FILTER (WHERE NOT first) AS first_failed, count(*) FILTER (WHERE NOT first AND ever) AS recovered,
  round(CAST(count(*) FILTER (WHERE NOT first AND ever) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT first), 0), 6) AS recovery_rate, CAST(sum(n - 1) AS BIGINT) AS extra_calls FROM p GROUP BY model""",
    "review_pool": "WITH j AS (SELECT md5(text) AS content, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict, source FROM documents JOIN labels USING (doc_id)) SELECT content, count(*) AS paths, min(verdict) <> max(verdict) AS disagreement, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM j GROUP BY content",
    "duplicate_threads": with_("quality_evaluation") + "SELECT thread_id, status, count(*) AS n FROM quality_evaluation GROUP BY 1, 2 HAVING count(*) > 1",
    "turn_neighbours": "SELECT conv_id, turn, concat_ws(',', lag(turn, 2) OVER w, lag(turn) OVER w, lead(turn) OVER w, lead(turn, 2) OVER w) AS around FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "alternating_arms": "SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) % 2 = 1 THEN 'A' ELSE 'B' END AS arm FROM lineitem",
    "stale_items": """SELECT o_orderkey AS item_id, o_custkey % 6 AS attempts, CASE WHEN o_custkey % 6 >= 5 THEN 'fail' WHEN epoch(TIMESTAMP '1996-01-01') - epoch(o_orderdate::TIMESTAMP) > 86400 THEN 'retry' ELSE 'wait' END AS action,
  30.0::DOUBLE * pow(2::DOUBLE, least(o_custkey % 6 - 1, 8)) AS wait_seconds FROM orders""",
    "active_requests": "SELECT o_custkey, o_orderkey, coalesce(lag(o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TRUE) AS accepted FROM orders",
    "position_bias": 'SELECT l_returnflag AS "option", count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, count(*)::DOUBLE / sum(count(*)) OVER () > 0.5 AS biased FROM lineitem GROUP BY 1',
}
