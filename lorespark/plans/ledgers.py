"""Queries of experiments' ledgers and of data set audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledgers as op
from ..operators import quality
from .projections import dealt, table, with_
from .quality import WEIGHTS

PRICES = [("m0", 0.5, 1.5, True), ("m1", 0.25, 0.75, False), ("m2", 1.0, 2.0, True)]
OTHER = [(d, w) for d, w in zip((d for d, _ in WEIGHTS), (0.1, 0.2, 0.3, 0.4), strict=True)]
ARMS = ["plain", "strict", "guided"]
_LOG = with_("trace_log")
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "trace_log").withColumn("currency", F.when(F.col("tenant_id").isNull(), "EUR").otherwise("USD"))


def budget_guard(spark, sf_dir):
    calls = table(spark, sf_dir, "trace_log")
    budgets = calls.filter("task_id is not null").select("task_id").distinct().withColumn("budget", F.expr("cast(substring(task_id, 5) as int) % 5 * 2.0D"))
    return op.budget_guard(calls.filter("success"), calls.filter("not success"), budgets)


def judge_rates(spark, sf_dir):
    calls = table(spark, sf_dir, "trace_log").select("template_id", F.col("usage_reported").alias("valid"), F.col("success").alias("completed"), (F.col("cost") > 0.05).alias("passed"))
    return op.judge_rates(calls, "template_id")


def _cases(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "tune").otherwise("test")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), part.alias("part"), F.md5("text").alias("input"), F.col("source").alias("family"), F.col("quality").alias("label"))


def votes(spark, sf_dir):
    """Lines of orders as votes of three judges, dealt by order."""
    judge = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), judge.alias("judge"), (F.col("l_quantity") > 25).alias("good"))
    return dealt(rows, "item_id")


def shared_scores(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    paths = docs.select(F.col("doc_id").alias("path_id"), F.md5("text").alias("content_id"), (F.col("doc_id") % 7 != 0).alias("eligible"))
    scores = docs.join(labels, "doc_id").groupBy(F.md5("text").alias("content_id")).agg(F.max("quality").alias("score"))
    return op.shared_scores(paths, scores)


def gold_integrity(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return op.gold_integrity(lines.select(F.col("l_orderkey").alias("item_id"), (F.col("l_suppkey") % 5).alias("annotator"), F.when(F.col("l_linenumber") == 3, "adjudicator").otherwise("annotator").alias("role"), (F.col("l_quantity") > 25).alias("label")))


def arm_summary(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"))
    plan = op.frozen_plan(cases, ARMS, "plan")
    outcomes = plan.join(table(spark, sf_dir, "labels"), F.col("case_id") == F.col("doc_id")).filter("turn < 3").select("path_id", (F.col("quality") == 1).alias("good"))
    return op.arm_summary(plan, outcomes)


def example_leaks(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.concat_ws("-", "source", (F.col("doc_id") % 9).cast("string")).alias("family"), F.md5(F.lower(F.regexp_replace("text", r"\s+", " "))).alias("content"))
    rows = rows.join(labels, "doc_id", "left").withColumn("reviewed", F.coalesce(F.col("quality") == 1, F.col("doc_id") % 2 == 0))
    cases = rows.filter("doc_id % 50 = 0")
    return op.example_leaks(rows.filter("doc_id % 50 <> 0").withColumnRenamed("doc_id", "candidate_id"), cases)


def near_examples(spark, sf_dir):
    """Documents against benchmark items as cases, by ratio of matching blocks."""
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    candidates = docs.select(F.col("doc_id").alias("candidate_id"), "text", F.col("doc_id").alias("item_id"), F.col("source").alias("family"), (F.coalesce("quality", F.lit(1)) == 1).alias("reviewed"))
    cases = items.select(F.col("item_id").alias("case_id"), "text", (-F.col("item_id") - 1).alias("item_id"), F.lit(None).cast("string").alias("family"))
    return op.example_leaks(candidates, cases, 0.85)


def near_sets(spark, sf_dir):
    """Benchmark items as the cases of three sets, in order of their ids."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.col("item_id").alias("place"), F.md5("text").alias("input"), F.floor(F.col("item_id") / 10).alias("family"), (F.col("item_id") % 2).alias("label"))
    return op.set_geometry(items.withColumn("part", F.when(F.col("id") % 21 < 10, "exploration").when(F.col("id") % 21 < 20, "confirmation").otherwise("smoke")), 0.85)


def paired_effect(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return op.paired_effect(labels.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 5 > 0, F.col("quality") == 1).alias("without_example"), F.when(F.col("doc_id") % 7 > 0, F.col("toxic") == 0).alias("with_example")))


QUERIES = {
    "coverage_summary": lambda s, d: op.coverage_summary(table(s, d, "trace_log"), "task_id"),
    "accounting_by_currency": lambda s, d: op.accounting_by_currency(_calls(s, d), "template_id"),
    "model_comparison": lambda s, d: op.model_comparison(table(s, d, "trace_log")),
    "budget_guard": budget_guard,
    "judge_rates": judge_rates,
    "call_costs": lambda s, d: op.call_costs(table(s, d, "trace_log"), s.createDataFrame(PRICES, "model string, prompt_rate double, completion_rate double, verified boolean")),
    "set_geometry": lambda s, d: op.set_geometry(_cases(s, d)),
    "frozen_plan": lambda s, d: op.frozen_plan(table(s, d, "labels").select(F.col("doc_id").alias("case_id")), ARMS, "plan"),
    "rescored": lambda s, d: op.rescored(quality.round_means(table(s, d, "dimension_score")), s.createDataFrame(OTHER, "dimension string, weight double"), 60.0),
    "pairwise_agreement": lambda s, d: op.pairwise_agreement(votes(s, d), ["a", "b", "c"]),
    "shared_scores": shared_scores,
    "gold_integrity": gold_integrity,
    "verdict_rollup": lambda s, d: op.verdict_rollup(table(s, d, "task_item").select("task_id", F.when(F.col("status") == "failed", "fail").when(F.col("status") == "awaiting_review", "unresolved").otherwise("pass").alias("verdict")), "task_id"),
    "arm_summary": arm_summary,
    "example_leaks": example_leaks,
    "near_examples": near_examples,
    "near_sets": near_sets,
    "paired_effect": paired_effect,
}

_CASES = """WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'tune' ELSE 'test' END AS part, md5(text) AS input, source AS family, quality AS label FROM documents JOIN labels USING (doc_id))"""
_PLAN = "WITH p AS (SELECT doc_id AS case_id, unnest(['plain', 'strict', 'guided']) AS arm FROM labels), f AS (SELECT substr(sha256('plan|' || case_id || '|' || arm), 1, 16) AS path_id, case_id, arm, row_number() OVER (PARTITION BY case_id ORDER BY sha256('plan|' || case_id || '|' || arm)) AS turn FROM p)"
_SHARED = lambda name: f"(SELECT count(DISTINCT {name}) FROM c x WHERE x.part = c.part AND x.{name} IN (SELECT {name} FROM c GROUP BY {name} HAVING count(DISTINCT part) > 1)) AS shared_{name}"
SQL = {
    "coverage_summary": _LOG + "SELECT task_id, count(*) AS calls, round(count(cost)::DOUBLE / count(*), 6) AS coverage, round(coalesce(sum(cost), 0), 6) AS known, CASE WHEN count(*) = count(cost) THEN round(sum(cost), 6) END AS total FROM trace_log GROUP BY task_id",
    "accounting_by_currency": _LOG + "SELECT template_id, CASE WHEN tenant_id IS NULL THEN 'EUR' ELSE 'USD' END AS currency, count(*) AS calls, count(DISTINCT coalesce(trace_id, id)) AS requests, round(sum(cost), 6) AS cost, round(count(trace_id)::DOUBLE / count(*), 6) AS traced, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM trace_log GROUP BY 1, 2",
    "model_comparison": _LOG + """SELECT template_id, model, grouping(model) = 1 AS whole, round(sum(cost), 6) AS cost, round(sum(latency_ms), 4) AS latency_ms, CAST(sum(attempt) AS BIGINT) AS attempts,
  CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS tokens, round(sum(cost) FILTER (WHERE stage = 'embedding'), 6) AS shared_cost FROM trace_log GROUP BY GROUPING SETS ((template_id, model), (template_id))""",
    "budget_guard": _LOG + ", s AS (SELECT task_id, CAST(substr(task_id, 5) AS INT) % 5 * 2.0::DOUBLE AS budget, round(coalesce(sum(cost), 0), 6) AS spent FROM trace_log WHERE task_id IS NOT NULL GROUP BY task_id) SELECT *, spent >= budget AS exhausted FROM s",
    "judge_rates": _LOG + """, c AS (SELECT template_id, count(*) AS paths, count(*) FILTER (WHERE usage_reported) AS valid, count(*) FILTER (WHERE success) AS completed, count(*) FILTER (WHERE success AND cost > 0.05) AS passed FROM trace_log GROUP BY template_id)
SELECT *, round(passed::DOUBLE / nullif(paths, 0), 6) AS of_all, round(passed::DOUBLE / nullif(valid, 0), 6) AS of_valid, round(passed::DOUBLE / nullif(completed, 0), 6) AS of_completed FROM c""",
    "call_costs": _LOG + f", p(model, a, b, verified) AS (VALUES {_VALUES(PRICES)}) SELECT id, round(CASE WHEN verified AND usage_reported THEN (prompt_tokens * a::DOUBLE + completion_tokens * b::DOUBLE) / 1000 END, 6) AS cost FROM trace_log LEFT JOIN p USING (model)",
    "set_geometry": _CASES + f" SELECT part, count(*) AS items, round(count(*) FILTER (WHERE label = 1)::DOUBLE / count(*), 6) AS positive, {_SHARED('id')}, {_SHARED('input')}, {_SHARED('family')} FROM c GROUP BY part",
    "frozen_plan": _PLAN + " SELECT * FROM f",
    "rescored": with_("dimension_score") + f", w(dimension, weight) AS (VALUES {_VALUES(OTHER)}), m AS (SELECT item_id, verdict, dimension, avg(score) AS score FROM dimension_score GROUP BY 1, 2, 3), t AS (SELECT item_id, round(sum(score * weight::DOUBLE) / sum(weight::DOUBLE), 6) AS total FROM m JOIN w USING (dimension) GROUP BY item_id) SELECT *, total >= 60 AS passed FROM t",
    "pairwise_agreement": """WITH v AS (SELECT l_orderkey AS item_id, max(CASE WHEN l_linenumber % 3 = 0 THEN (l_quantity > 25)::INT END) AS a, max(CASE WHEN l_linenumber % 3 = 1 THEN (l_quantity > 25)::INT END) AS b, max(CASE WHEN l_linenumber % 3 = 2 THEN (l_quantity > 25)::INT END) AS c FROM lineitem GROUP BY 1),
p AS (SELECT 'a' AS first, 'b' AS second, a AS x, b AS y FROM v UNION ALL SELECT 'a', 'c', a, c FROM v UNION ALL SELECT 'b', 'c', b, c FROM v),
s AS (SELECT first, second, count(*) AS items, avg((x = y)::INT)::DOUBLE AS o, avg(x)::DOUBLE * avg(y) + (1 - avg(x)::DOUBLE) * (1 - avg(y)) AS e FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)
SELECT first, second, items, round(o, 6) AS agreement, round(CASE WHEN e < 1 THEN (o - e) / (1 - e) END, 6) AS kappa FROM s""",
    "shared_scores": """WITH s AS (SELECT md5(text) AS content_id, max(quality) AS score FROM documents JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT doc_id AS path_id, score, CASE WHEN doc_id % 7 = 0 THEN 'cancelled' WHEN score IS NULL THEN 'missing' ELSE 'scored' END AS status FROM documents LEFT JOIN s ON md5(text) = content_id)
SELECT path_id, CASE WHEN status = 'scored' THEN score END AS score, status FROM p""",
    "gold_integrity": """WITH f AS (SELECT l_orderkey AS item_id, count(DISTINCT l_suppkey % 5) AS annotators, count(DISTINCT l_quantity > 25) AS labels, list(DISTINCT l_suppkey % 5) AS who FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1),
t AS (SELECT l_orderkey AS item_id, min(l_suppkey % 5) AS third FROM lineitem WHERE l_linenumber = 3 GROUP BY 1)
SELECT item_id, annotators, labels > 1 AS disputed, third IS NOT NULL AS adjudicated, annotators >= 2 AND (labels = 1 OR coalesce(NOT list_contains(who, third), FALSE)) AS sound FROM f LEFT JOIN t USING (item_id)""",
    "verdict_rollup": with_("task_item") + "SELECT task_id, CASE WHEN bool_or(status = 'failed') THEN 'fail' WHEN bool_or(status = 'awaiting_review') THEN 'unresolved' ELSE 'pass' END AS verdict, count(*) AS votes FROM task_item GROUP BY task_id",
    "arm_summary": _PLAN + """, o AS (SELECT f.*, CASE WHEN turn < 3 THEN quality = 1 END AS good FROM f JOIN labels ON doc_id = case_id)
SELECT arm, count(*) AS planned, count(good) AS assessed, round(count(good)::DOUBLE / count(*), 6) AS coverage, round(count(*) FILTER (WHERE good)::DOUBLE / nullif(count(good), 0), 6) AS pass_rate,
  md5(coalesce(string_agg(DISTINCT case_id::VARCHAR, ',' ORDER BY case_id::VARCHAR) FILTER (WHERE NOT good), '')) AS bad_cases FROM o GROUP BY arm""",
    "paired_effect": """WITH o AS (SELECT CASE WHEN doc_id % 5 > 0 THEN (quality = 1)::INT END AS a, CASE WHEN doc_id % 7 > 0 THEN (toxic = 0)::INT END AS b FROM labels), p AS (SELECT * FROM o WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT (SELECT count(*) FROM o) AS cases, count(*) AS paired, round(avg(a), 6) AS without_rate, round(avg(b), 6) AS with_rate, round(avg(b) - avg(a), 6) AS delta FROM p""",
    "example_leaks": r"""WITH r AS (SELECT doc_id, doc_id % 40 AS item_id, concat_ws('-', source, doc_id % 9) AS family, md5(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS content, coalesce(quality = 1, doc_id % 2 = 0) AS reviewed FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT * FROM r WHERE doc_id % 50 = 0)
SELECT doc_id AS candidate_id, CASE WHEN NOT reviewed THEN 'not_reviewed' WHEN item_id IN (SELECT item_id FROM c) THEN 'same_item' WHEN family IN (SELECT family FROM c) THEN 'same_family'
  WHEN content IN (SELECT content FROM c WHERE content IS NOT NULL) THEN 'same_text' ELSE 'eligible' END AS reason FROM r WHERE doc_id % 50 <> 0""",
}
