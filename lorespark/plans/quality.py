"""Queries over quality events, records and task items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as op
from .projections import dealt, table, with_

WEIGHTS = [("accuracy", 0.4), ("clarity", 0.3), ("format", 0.2), ("difficulty", 0.1)]
_WEIGHTS = "weights(dimension, weight) AS (VALUES " + ", ".join(f"('{d}', CAST({w} AS DOUBLE))" for d, w in WEIGHTS) + ")"


def _weights(spark):
    return spark.createDataFrame(WEIGHTS, "dimension string, weight double")


def outcomes(spark, sf_dir):
    """Lines of orders as outcomes of an old and a new version on inputs, in rounds, dealt by input."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 4).cast("string")).alias("template_id"),
        F.col("l_orderkey").alias("input"),
        F.floor(F.col("l_linenumber") / 2).alias("round"),
        F.when(F.col("l_linenumber") % 2 == 0, "old").otherwise("new").alias("version"),
        (F.col("l_quantity") > 20).alias("good"),
    )
    return dealt(rows, "template_id", "input")


def overrides(spark, sf_dir):
    """Parts as weights of templates' own, some of dimensions that have no default."""
    dimension = F.element_at(F.array(*map(F.lit, ("accuracy", "clarity", "style", "format"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 300).alias("template_id"), dimension.alias("dimension")).agg((F.min("p_partkey") % 7 / 10.0).cast("double").alias("weight"))


QUERIES = {
    "pipeline_stats": lambda s, d: op.pipeline_stats(table(s, d, "quality_evaluation")),
    "pipeline_stats_by_template": lambda s, d: op.pipeline_stats(table(s, d, "quality_evaluation"), "template_id"),
    "quality_buckets": lambda s, d: op.quality_buckets(table(s, d, "quality_record")),
    "buckets_by_config": lambda s, d: op.buckets_by_config(table(s, d, "quality_record")),
    "merged_weights": lambda s, d: op.merged_weights(_weights(s), overrides(s, d)),
    "latest_evaluation": lambda s, d: op.latest_per_key(table(s, d, "quality_evaluation"), ["thread_id"], "created_at", "revise_count").select("thread_id", "revise_count", "status", "score"),
    "judged_pairs": lambda s, d: op.judged_pairs(table(s, d, "quality_record")),
    "labelled_outcomes": lambda s, d: op.labelled_outcomes(table(s, d, "quality_record")),
    "judge_agreement": lambda s, d: op.agreement(table(s, d, "quality_record")),
    "judge_agreement_by_template": lambda s, d: op.agreement(table(s, d, "quality_record"), 70.0, "template_id"),
    "gold_report": lambda s, d: op.gold_report(table(s, d, "quality_record")),
    "weighted_totals": lambda s, d: op.weighted_totals(table(s, d, "dimension_score"), _weights(s)),
    "fitted_weights": lambda s, d: op.fitted_weights(table(s, d, "dimension_score"), _weights(s)),
    "tightened_threshold": lambda s, d: op.tightened_threshold(table(s, d, "quality_record")),
    "round_variance": lambda s, d: op.round_variance(table(s, d, "dimension_score")),
    "status_counts": lambda s, d: op.status_counts(table(s, d, "task_item")),
    "status_pivot": lambda s, d: op.status_pivot(table(s, d, "task_item")),
    "task_rollup": lambda s, d: op.task_rollup(table(s, d, "task_item"), table(s, d, "task")),
    "version_contrast": lambda s, d: op.contrast(outcomes(s, d)),
}

_PAIRS = with_("quality_record") + """, pairs AS (
  SELECT a.item_id, a.template_id, a.score AS auto, m.score AS manual FROM
    (SELECT * FROM quality_record WHERE source = 'auto' QUALIFY row_number() OVER (PARTITION BY item_id, template_id ORDER BY created_at, record_id) = 1) a JOIN
    (SELECT * FROM quality_record WHERE source = 'manual_review' QUALIFY row_number() OVER (PARTITION BY item_id, template_id ORDER BY created_at, record_id) = 1) m USING (item_id, template_id)
  WHERE a.tenant_id IS NOT DISTINCT FROM a.item_tenant AND m.tenant_id IS NOT DISTINCT FROM m.item_tenant)
"""
_MEANS = with_("dimension_score") + f", {_WEIGHTS}, means AS (SELECT item_id, verdict, dimension, avg(score) AS score FROM dimension_score GROUP BY 1, 2, 3)\n"


def _stats(key: str) -> str:
    k, g = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return with_("quality_evaluation") + f""", e AS (
  SELECT *, coalesce(status = 'completed' AND score >= threshold, FALSE) AS passed,
         row_number() OVER (PARTITION BY {k}thread_id ORDER BY revise_count) AS up, row_number() OVER (PARTITION BY {k}thread_id ORDER BY revise_count DESC) AS down FROM quality_evaluation)
SELECT {k}count(DISTINCT thread_id) AS threads, count(*) AS evaluations, count(*) FILTER (WHERE up = 1 AND revise_count = 0) AS first_n,
  CAST(count(*) FILTER (WHERE up = 1 AND revise_count = 0 AND passed) AS DOUBLE) / nullif(count(*) FILTER (WHERE up = 1 AND revise_count = 0), 0) AS first_pass_rate,
  count(*) FILTER (WHERE down = 1 AND is_final) AS final_n,
  CAST(count(*) FILTER (WHERE down = 1 AND is_final AND passed) AS DOUBLE) / nullif(count(*) FILTER (WHERE down = 1 AND is_final), 0) AS final_pass_rate
FROM e{g}"""


def _agreement(key: str) -> str:
    k, g = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return _PAIRS + f""", c AS (
  SELECT {k}count(*) FILTER (WHERE auto >= 70 AND manual > 0) AS tp, count(*) FILTER (WHERE auto < 70 AND manual <= 0) AS tn,
         count(*) FILTER (WHERE auto >= 70 AND manual <= 0) AS fp, count(*) FILTER (WHERE auto < 70 AND manual > 0) AS fn FROM pairs{g}),
r AS (SELECT *, CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0) AS po, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS r,
             ((tp + fp) * CAST(tp + fn AS DOUBLE) + (tn + fn) * CAST(tn + fp AS DOUBLE)) / nullif((tp + tn + fp + fn) * CAST(tp + tn + fp + fn AS DOUBLE), 0) AS pe FROM c)
SELECT {k}tp, tn, fp, fn, round(po, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / nullif(p + r, 0), 4) AS f1,
  round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 4) AS kappa,
  round(CASE WHEN (tp + fp) * (tn + fn) * (tp + fn) * (tn + fp) > 0 THEN (po - pe) / (1 - pe) END, 6) AS kappa_strict,
  round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 4) AS kappa_guarded
FROM r"""


SQL = {
    "buckets_by_config": with_("quality_record") + """, r AS (SELECT *, score >= coalesce(TRY_CAST(nullif(regexp_extract(config, '"threshold":\\s*([0-9.]+)', 1), '') AS DOUBLE), 70) AS good FROM quality_record)
SELECT template_id, version, tenant_id, source, reviewer, sha256(config) AS config_hash, count(*) AS total, count(*) FILTER (WHERE good) AS passed, count(*) - count(*) FILTER (WHERE good) AS rejected, round(avg(score), 4) AS avg_score FROM r GROUP BY ALL""",
    "merged_weights": f"""WITH {_WEIGHTS}, o AS (SELECT p_partkey % 300 AS template_id, CASE p_partkey % 4 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'clarity' WHEN 2 THEN 'style' ELSE 'format' END AS dimension, min(p_partkey) % 7 / 10.0::DOUBLE AS own FROM part GROUP BY 1, 2),
j AS (SELECT template_id, dimension, coalesce(own, weight) AS weight FROM (SELECT DISTINCT template_id FROM o) t CROSS JOIN weights FULL JOIN o USING (template_id, dimension))
SELECT *, bool_and(weight > 0) OVER (PARTITION BY template_id) AS sound FROM j""",
    "pipeline_stats": _stats(""),
    "pipeline_stats_by_template": _stats("template_id"),
    "quality_buckets": with_("quality_record") + "SELECT template_id, source, count(*) AS total, count(*) FILTER (WHERE score >= 70) AS passed, count(*) - count(*) FILTER (WHERE score >= 70) AS rejected, round(avg(score), 4) AS avg_score FROM quality_record GROUP BY 1, 2",
    "latest_evaluation": with_("quality_evaluation") + "SELECT thread_id, revise_count, status, score FROM quality_evaluation QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, revise_count DESC) = 1",
    "judged_pairs": _PAIRS + "SELECT * FROM pairs",
    "labelled_outcomes": _PAIRS + "SELECT count(*) AS labelled, count(*) FILTER (WHERE auto >= 70 AND manual = 0) AS false_pass, count(*) FILTER (WHERE manual <> 0) AS passed, round(CAST(count(*) FILTER (WHERE manual = 0) AS DOUBLE) / nullif(count(*), 0), 4) AS reject_rate FROM pairs",
    "judge_agreement": _agreement(""),
    "judge_agreement_by_template": _agreement("template_id"),
    "gold_report": _PAIRS + "SELECT coalesce(template_id, 'overall') AS stratum, count(*) AS cases, round(avg(CASE WHEN (auto >= 70) = (manual > 0) THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM pairs GROUP BY GROUPING SETS ((), (template_id))",
    "weighted_totals": _MEANS + "SELECT item_id, round(sum(score * weight) / sum(weight), 6) AS total FROM means JOIN weights USING (dimension) GROUP BY item_id",
    "fitted_weights": _MEANS + """, m AS (SELECT dimension, avg(score) FILTER (WHERE verdict = 'fp') AS fp, avg(score) FILTER (WHERE verdict = 'pass') AS ok FROM means GROUP BY dimension),
l AS (SELECT dimension, weight, coalesce(round(fp - ok, 2), 0) AS lenient FROM weights LEFT JOIN m USING (dimension)),
r AS (SELECT *, max(lenient) OVER () AS most FROM l),
w AS (SELECT *, CASE WHEN most > 0 THEN weight * (1 - greatest(lenient, 0) / most) ELSE weight END AS raw FROM r),
k AS (SELECT *, greatest(raw, avg(raw) OVER () * 0.05) AS kept FROM w)
SELECT dimension, lenient, CASE WHEN most > 0 THEN round(kept / sum(kept) OVER (), 4) ELSE weight END AS weight FROM k""",
    "tightened_threshold": _PAIRS + """, f AS (SELECT count(*) AS labelled, count(*) FILTER (WHERE auto >= 70 AND manual = 0) AS false_pass, CAST(count(*) FILTER (WHERE manual = 0) AS DOUBLE) / nullif(count(*), 0) AS rejects, count(*) FILTER (WHERE manual <> 0) AS n FROM pairs),
p AS (SELECT auto AS p10 FROM (SELECT auto, row_number() OVER (ORDER BY auto) - 1 AS rank FROM pairs WHERE manual <> 0), f WHERE rank = n // 10)
SELECT labelled, false_pass, labelled >= 20 AND false_pass >= 5 AS enough, CASE WHEN labelled >= 20 AND false_pass >= 5 AND rejects > 0.05 THEN greatest(70.0, p10) ELSE 70.0 END AS threshold FROM f LEFT JOIN p ON TRUE""",
    "round_variance": _MEANS + "SELECT dimension, round(a.single, 6) AS single, round(b.multi, 6) AS multi FROM (SELECT dimension, var_pop(score) AS single FROM dimension_score GROUP BY 1) a JOIN (SELECT dimension, var_pop(score) AS multi FROM means GROUP BY 1) b USING (dimension)",
    "status_counts": with_("task_item") + ", known(status) AS (VALUES " + ", ".join(f"('{x}')" for x in op.ITEM_STATUSES) + ") SELECT known.status, count(task_item.status) AS n FROM known LEFT JOIN task_item USING (status) GROUP BY 1",
    "status_pivot": with_("task_item") + "SELECT task_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("awaiting_review", "succeeded", "failed", "cancelled")) + " FROM task_item GROUP BY task_id",
    "task_rollup": with_("task_item", "task") + """, i AS (SELECT task_id, count(*) AS have, count(*) FILTER (WHERE status = 'succeeded') AS good, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(*) FILTER (WHERE status = 'awaiting_review') AS waiting FROM task_item GROUP BY task_id),
c AS (SELECT task_id, greatest(coalesce(expected, 0), coalesce(have, 0)) AS n, coalesce(good, 0) AS good, coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled, coalesce(waiting, 0) AS waiting
      FROM i FULL JOIN task USING (task_id) WHERE greatest(coalesce(expected, 0), coalesce(have, 0)) > 0)
SELECT task_id, round(CAST(good + failed + cancelled AS DOUBLE) / n, 4) AS progress,
  CASE WHEN good + failed + cancelled < n THEN CASE WHEN good + failed + cancelled + waiting = n THEN 'awaiting_review' END
       WHEN good = n THEN 'succeeded' WHEN good > 0 THEN 'partially_succeeded' WHEN cancelled = n THEN 'cancelled' ELSE 'failed' END AS status
FROM c""",
    "version_contrast": """WITH o AS (SELECT 't' || (l_suppkey % 4) AS template_id, l_orderkey AS input, l_linenumber // 2 AS round, l_linenumber % 2 = 0 AS old, CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END AS good FROM lineitem),
p AS (SELECT template_id, input, round, max(CASE WHEN old THEN good END) AS old, max(CASE WHEN NOT old THEN good END) AS new FROM o GROUP BY 1, 2, 3),
i AS (SELECT template_id, input, avg(new - old) AS gain FROM p WHERE old IS NOT NULL AND new IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(template_id, 'overall') AS stratum, count(*) AS inputs, round(avg(gain) * 100, 6) AS points FROM i GROUP BY GROUPING SETS ((), (template_id))""",
}
