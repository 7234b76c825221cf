"""Queries over the log of model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import in_scope, redacted, usage_reported
from ..operators import traces as op
from .projections import table, with_

_LOG = with_("trace_log")
_SUMS = "round(coalesce(sum(cost), 0), 8) AS cost, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, count(*) AS calls"
START, END = "2024-01-05", "2024-01-20"
PRICES = [("m0", 0.5, 1.5), ("m1", 0.25, None), ("m2", None, 2.0)]


def _log(spark, sf_dir):
    return table(spark, sf_dir, "trace_log")


def cost_priced(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "model string, prompt_rate double, completion_rate double")
    return op.priced(_log(spark, sf_dir), prices, 0.1)


def usage_flags(spark, sf_dir):
    traces = _log(spark, sf_dir)
    flag = usage_reported(F.coalesce("stage", F.lit("")), F.col("prompt_tokens"), F.col("completion_tokens"))
    return traces.groupBy("stage", flag.alias("reported")).agg(F.count("*").alias("calls"))


def tenant_costs(spark, sf_dir):
    traces = _log(spark, sf_dir)
    views = {"tenant1": in_scope(F.col("tenant_id"), "tenant1"), "none": in_scope(F.col("tenant_id"), None), "tenant1_shared": in_scope(F.col("tenant_id"), "tenant1", shared=True), "admin": in_scope(F.col("tenant_id"), None, everything=True)}
    return traces.agg(*[F.count_if(c).alias(f"{n}_calls") for n, c in views.items()], *[F.round(F.sum(F.when(c, F.col("cost"))), 8).alias(f"{n}_cost") for n, c in views.items()])


def redacted_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redacted(F.coalesce("text", F.lit("")), 100_000)).alias("digest"))


def run_prefix(spark, sf_dir):
    traces = _log(spark, sf_dir).filter(F.col("trace_id").startswith("t1"))
    return op.cost_by(traces, "template_id", "model")


QUERIES = {
    "cost_by_task": lambda s, d: op.cost_by(_log(s, d), "task_id"),
    "cost_by_stage_and_task": lambda s, d: op.cost_by(_log(s, d), "task_id", "stage"),
    "cost_by_template_window": lambda s, d: op.cost_between(_log(s, d), START, END, "template_id"),
    "cost_since": lambda s, d: op.cost_between(_log(s, d), START, None),
    "cost_labelled_by_template": lambda s, d: op.labelled_cost(_log(s, d), "template_id"),
    "cost_labelled_by_model": lambda s, d: op.labelled_cost(_log(s, d), "model"),
    "cost_labelled_by_task": lambda s, d: op.labelled_cost(_log(s, d), "task_id"),
    "model_usage": lambda s, d: op.model_usage(_log(s, d)),
    "daily_cost": lambda s, d: op.daily_cost(_log(s, d)),
    "success_rates": lambda s, d: op.success_rates(_log(s, d)),
    "generation_stats": lambda s, d: op.generation_stats(_log(s, d)),
    "deep_cost_report": lambda s, d: op.deep_cost_report(_log(s, d)),
    "latest_calls": lambda s, d: op.latest_calls(_log(s, d), 20, 2).select("id", "trace_id", "model", "created_at"),
    "cost_drilldown": lambda s, d: op.drilldown(_log(s, d)),
    "trace_list": lambda s, d: op.trace_list(_log(s, d)),
    "structured_stats": lambda s, d: op.structured_stats(_log(s, d), "template_id"),
    "latency_percentiles": lambda s, d: op.latency_percentiles(_log(s, d), "model"),
    "call_accounting": lambda s, d: op.call_accounting(_log(s, d), "template_id", "model"),
    "running_cost": lambda s, d: op.running_cost(_log(s, d), 1.0),
    "health_states": lambda s, d: op.health_states(_log(s, d)),
    "cost_priced": cost_priced,
    "usage_flags": usage_flags,
    "tenant_costs": tenant_costs,
    "redacted_texts": redacted_texts,
    "run_prefix": run_prefix,
    "reconciled_bills": lambda s, d: op.reconciled(table(s, d, "estimate"), table(s, d, "bill")),
}


def _facet(name: str, key: str | None) -> str:
    shown = f"CASE WHEN {key} IS NULL OR {key} = '' THEN 'unknown' ELSE {key} END" if key else "'total'"
    return f"""SELECT '{name}' AS facet, {shown} AS name, {_SUMS}, round(coalesce(sum(prompt_cost), 0), 8) AS prompt_cost,
  count(*) FILTER (WHERE stage IN ('generate', 'qc', 'embedding') AND usage_reported IS NOT TRUE) AS unknown_usage,
  count(*) FILTER (WHERE stage IN ('generate', 'qc', 'embedding') AND usage_reported AND cost IS NULL) AS unknown_pricing
FROM trace_log{f" GROUP BY {key}" if key else ""}"""


def _labelled(key: str) -> str:
    return _LOG + f"SELECT coalesce({key}, 'unknown') AS name, round(sum(cost), 8) AS cost, CAST(coalesce(sum(prompt_tokens), 0) + coalesce(sum(completion_tokens), 0) AS BIGINT) AS tokens, count(*) AS calls FROM trace_log GROUP BY {key}"


_WORDS = "api[_-]?key|authorization|password|secret|access[_-]?token|refresh[_-]?token|token"
SQL = {
    "cost_by_task": _LOG + f"SELECT task_id, {_SUMS} FROM trace_log GROUP BY task_id",
    "cost_by_stage_and_task": _LOG + f"SELECT task_id, stage, {_SUMS} FROM trace_log GROUP BY task_id, stage",
    "cost_by_template_window": _LOG + f"SELECT template_id, {_SUMS} FROM trace_log WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' GROUP BY template_id",
    "cost_since": _LOG + f"SELECT {_SUMS} FROM trace_log WHERE created_at >= TIMESTAMP '{START}'",
    "cost_labelled_by_template": _labelled("template_id"),
    "cost_labelled_by_model": _labelled("model"),
    "cost_labelled_by_task": _labelled("task_id"),
    "model_usage": _LOG + "SELECT model, round(coalesce(sum(cost), 0), 8) AS cost, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM trace_log GROUP BY model",
    "daily_cost": _LOG + f"SELECT CAST(created_at AS DATE) AS day, {_SUMS} FROM trace_log GROUP BY 1",
    "success_rates": _LOG + "SELECT template_id, CAST(count(*) FILTER (WHERE success) AS DOUBLE) / count(*) AS success_rate, count(*) AS calls FROM trace_log GROUP BY template_id",
    "generation_stats": _LOG + """, g AS (SELECT * FROM trace_log WHERE stage = 'generate')
SELECT count(*) AS calls, coalesce(CAST(count(*) FILTER (WHERE success) AS DOUBLE) / nullif(count(*), 0), 0) AS success_rate,
       coalesce(CAST(count(*) FILTER (WHERE NOT success) AS DOUBLE) / nullif(count(*), 0), 0) AS retry_rate,
       (SELECT string_agg(model || ':' || n, ',' ORDER BY model) FROM (SELECT model, count(*) AS n FROM g GROUP BY model)) AS by_model
FROM g""",
    "deep_cost_report": _LOG + "\nUNION ALL ".join([_facet("total", None), _facet("stage", "stage"), _facet("template", "template_id"), _facet("model", "model"), _facet("task", "task_id")]),
    "latest_calls": _LOG + "SELECT id, trace_id, model, created_at FROM trace_log ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20",
    "cost_drilldown": _LOG + "SELECT id, trace_id, template_id, stage, model, cost, prompt_cost, round(cost - prompt_cost, 6) AS completion_cost FROM trace_log ORDER BY created_at DESC, id DESC LIMIT 50",
    "trace_list": _LOG + "SELECT trace_id, max(task_id) AS task_id, max(template_id) AS template_id, count(*) AS calls, round(coalesce(sum(cost), 0), 8) AS cost, round(coalesce(sum(latency_ms), 0), 2) AS latency_ms, min(created_at) AS first_at, max(created_at) AS last_at FROM trace_log GROUP BY trace_id",
    "structured_stats": _LOG + """, t AS (SELECT template_id, trace_id, min(CASE WHEN success THEN CASE WHEN coalesce(attempt, 0) = 0 THEN 1 ELSE attempt END END) AS won FROM trace_log GROUP BY template_id, trace_id)
SELECT template_id, count(*) AS total, count(won) AS succeeded, round(CAST(count(*) FILTER (WHERE won = 1) AS DOUBLE) / nullif(count(won), 0), 4) AS first_pass_rate,
       round(avg(won), 4) AS avg_attempts, round(CAST(count(*) - count(won) AS DOUBLE) / count(*), 4) AS failure_rate
FROM t GROUP BY template_id""",
    "latency_percentiles": _LOG + "SELECT model, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS most FROM trace_log GROUP BY model",
    "call_accounting": _LOG + """SELECT template_id, model, count(*) AS calls, count(DISTINCT coalesce(trace_id, id)) AS requests,
  round(CASE WHEN count(cost) = count(*) THEN sum(cost) END, 8) AS total_cost, round(coalesce(sum(cost), 0), 8) AS known_cost, count(cost) = count(*) AS cost_complete,
  CAST(CASE WHEN count(prompt_tokens) = count(*) THEN sum(prompt_tokens) END AS BIGINT) AS prompt_tokens,
  CAST(CASE WHEN count(completion_tokens) = count(*) THEN sum(completion_tokens) END AS BIGINT) AS completion_tokens
FROM trace_log GROUP BY template_id, model""",
    "running_cost": _LOG + ", r AS (SELECT task_id, id, round(sum(coalesce(cost, 0)) OVER (PARTITION BY task_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 8) AS so_far FROM trace_log WHERE task_id IS NOT NULL) SELECT *, so_far <= 1.0 AS within FROM r",
    "health_states": _LOG + """, m AS (SELECT model, id, created_at, success, sum(CAST(success AS INT)) OVER (PARTITION BY model ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM trace_log),
s AS (SELECT model, id, created_at, sum(CAST(NOT success AS INT)) OVER (PARTITION BY model, run ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS streak FROM m)
SELECT model, id, CAST(streak AS BIGINT) AS streak, streak >= 3 AS opens, CASE WHEN streak >= 3 THEN created_at + INTERVAL 10 MINUTE END AS cooldown_until FROM s""",
    "cost_priced": _LOG + """, p(model, prompt_rate, completion_rate) AS (VALUES ('m0', 0.5, 1.5), ('m1', 0.25, NULL), ('m2', NULL, 2.0)),
c AS (SELECT id, round(coalesce(prompt_tokens, 0) / CAST(1000 AS DOUBLE) * CAST(coalesce(prompt_rate, 0.1) AS DOUBLE), 6) AS prompt_cost, round(coalesce(completion_tokens, 0) / CAST(1000 AS DOUBLE) * CAST(coalesce(completion_rate, 0.1) AS DOUBLE), 6) AS completion_cost FROM trace_log LEFT JOIN p USING (model))
SELECT *, round(prompt_cost + completion_cost, 6) AS cost FROM c""",
    "usage_flags": _LOG + "SELECT stage, coalesce(prompt_tokens >= 0, FALSE) AND (coalesce(stage, '') = 'embedding' OR coalesce(completion_tokens >= 0, FALSE)) AS reported, count(*) AS calls FROM trace_log GROUP BY 1, 2",
    "tenant_costs": _LOG + """SELECT count(*) FILTER (WHERE tenant_id = 'tenant1') AS tenant1_calls, count(*) FILTER (WHERE tenant_id IS NULL) AS none_calls,
  count(*) FILTER (WHERE tenant_id = 'tenant1' OR tenant_id IS NULL) AS tenant1_shared_calls, count(*) AS admin_calls,
  round(sum(cost) FILTER (WHERE tenant_id = 'tenant1'), 8) AS tenant1_cost, round(sum(cost) FILTER (WHERE tenant_id IS NULL), 8) AS none_cost,
  round(sum(cost) FILTER (WHERE tenant_id = 'tenant1' OR tenant_id IS NULL), 8) AS tenant1_shared_cost, round(sum(cost), 8) AS admin_cost
FROM trace_log""",
    "redacted_texts": f"""SELECT doc_id, md5(CASE WHEN length(t) > 100000 THEN substr(t, 1, 100000) || '...[truncated]' ELSE t END) AS digest FROM (
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '("(?:[\\w-]+_)?(?:{_WORDS})"\\s*:\\s*)"(?:\\\\.|[^"\\\\])*"', '\\1"[REDACTED]"', 'gi'),
  '(bearer\\s+)([^\\s,;]+)', '\\1[REDACTED]', 'gi'), '({_WORDS})(\\s*[:=]\\s*)([^\\s,;]+)', '\\1\\2[REDACTED]', 'gi') AS t FROM documents)""",
    "run_prefix": _LOG + f"SELECT template_id, model, {_SUMS} FROM trace_log WHERE starts_with(trace_id, 't1') GROUP BY template_id, model",
    "reconciled_bills": with_("estimate", "bill") + """, e AS (SELECT trace_id, sum(amount) AS estimate FROM estimate GROUP BY trace_id), b AS (SELECT trace_id, sum(amount) AS billed FROM bill GROUP BY trace_id)
SELECT coalesce(e.trace_id, b.trace_id) AS trace_id, estimate, billed, billed - estimate AS difference,
  CASE WHEN estimate IS NULL THEN 'missing_estimate' WHEN billed IS NULL THEN 'missing_bill' WHEN abs(billed - estimate) <= 0.01 THEN 'matched' ELSE 'mismatch' END AS status
FROM e FULL OUTER JOIN b ON e.trace_id = b.trace_id""",
}
