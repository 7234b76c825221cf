"""Reports over the log of model calls: costs, tokens, success, attempts, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_where, is_not_true, label, ratio, zero_ratio

PAID_STAGES = ("generate", "qc", "embedding")


def totals() -> list[Column]:
    """Null amounts count as 0 in each column by itself."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [F.round(zero("cost"), 8).alias("cost"), zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls")]


def cost_by(traces: DataFrame, *keys: str) -> DataFrame:
    """Sums per group of the raw keys; null keys form a group."""
    return traces.groupBy(*keys).agg(*totals())


def cost_between(traces: DataFrame, start: str | None, end: str | None, *keys: str) -> DataFrame:
    """cost_by() for start <= created_at < end."""
    if start:
        traces = traces.filter(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        traces = traces.filter(F.col("created_at") < F.lit(end).cast("timestamp_ntz"))
    return cost_by(traces, *keys)


def labelled_cost(traces: DataFrame, key: str) -> DataFrame:
    """Cost per raw key, named for display, by falling sum with missing sums first."""
    sums = traces.groupBy(key).agg(F.round(F.sum("cost"), 8).alias("cost"), (F.coalesce(F.sum("prompt_tokens"), F.lit(0)) + F.coalesce(F.sum("completion_tokens"), F.lit(0))).alias("tokens"), F.count("*").alias("calls"))
    return sums.orderBy(F.desc_nulls_first("cost"), F.asc_nulls_first(key)).select(label(F.col(key)).alias("name"), "cost", "tokens", "calls")


def model_usage(traces: DataFrame) -> DataFrame:
    """Per model; a call whose prompt or completion tokens are missing adds no tokens."""
    return traces.groupBy("model").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("cost"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count("*").alias("calls"))


def daily_cost(traces: DataFrame) -> DataFrame:
    return traces.groupBy(F.to_date("created_at").alias("day")).agg(*totals()).orderBy("day")


def success_rates(traces: DataFrame) -> DataFrame:
    """Per template, 0 where there are no calls."""
    return traces.groupBy("template_id").agg(zero_ratio(count_where(F.col("success")), F.count("*")).alias("success_rate"), F.count("*").alias("calls"))


def generation_stats(traces: DataFrame) -> DataFrame:
    """One row: success rate of generation calls, share of failed calls, and calls per model."""
    generate = traces.filter("stage = 'generate'")
    models = generate.groupBy("model").agg(F.count("*").alias("n"))
    by_model = models.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "model", F.col("n").cast("string")))), ",").alias("by_model"))
    good, failed, n = count_where(F.col("success")), count_where(~F.col("success")), F.count("*")
    rates = generate.agg(n.alias("calls"), zero_ratio(good, n).alias("success_rate"), zero_ratio(failed, n).alias("retry_rate"))
    return rates.join(F.broadcast(by_model))


def deep_cost_report(traces: DataFrame) -> DataFrame:
    """Totals and the splits by stage, template, model and task from one scan: (facet, name, sums, unknown counts).

    Raw keys are grouped: a null and an empty stage are two rows of one name. Calls of paid stages that report no
    usage, or have no price though they report it, are counted in each row.
    """
    facets = ("stage", "template_id", "model", "task_id")
    paid = F.col("stage").isin(*PAID_STAGES)
    marked = traces.withColumn("no_usage", paid & is_not_true(F.col("usage_reported"))).withColumn("no_price", paid & F.col("usage_reported") & F.col("cost").isNull())
    sums = marked.groupingSets([[], *[[f] for f in facets]], *facets).agg(
        F.grouping_id().alias("g"),
        *totals(),
        F.round(F.coalesce(F.sum("prompt_cost"), F.lit(0.0)), 8).alias("prompt_cost"),
        count_where(F.col("no_usage")).alias("unknown_usage"),
        count_where(F.col("no_price")).alias("unknown_pricing"),
    )
    # In grouping_id a bit is 0 for the facet grouped by; the first facet has the highest bit.
    code = {15 - (1 << (3 - i)): f for i, f in enumerate(facets)}
    facet, name = F.lit("total"), F.lit("total")
    for g, f in code.items():
        facet = F.when(F.col("g") == g, f.removesuffix("_id")).otherwise(facet)
        name = F.when(F.col("g") == g, label(F.col(f), blank_too=True)).otherwise(name)
    return sums.select(facet.alias("facet"), name.alias("name"), "cost", "prompt_tokens", "completion_tokens", "calls", "prompt_cost", "unknown_usage", "unknown_pricing")


def latest_calls(traces: DataFrame, n: int = 20, page: int = 1) -> DataFrame:
    """A page of the newest calls; equal times are ordered by id."""
    return traces.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * n).limit(n)


def drilldown(traces: DataFrame, n: int = 50) -> DataFrame:
    """The newest calls with both parts of their cost; the part of the completion is what the prompt's leaves, null if one is unknown."""
    return latest_calls(traces, n).select("id", "trace_id", "template_id", "stage", "model", "cost", "prompt_cost", F.round(F.col("cost") - F.col("prompt_cost"), 6).alias("completion_cost"))


def trace_list(traces: DataFrame) -> DataFrame:
    """A row per trace."""
    return traces.groupBy("trace_id").agg(F.max("task_id").alias("task_id"), F.max("template_id").alias("template_id"), F.count("*").alias("calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("cost"), F.round(F.coalesce(F.sum("latency_ms"), F.lit(0.0)), 2).alias("latency_ms"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def structured_stats(traces: DataFrame, *keys: str) -> DataFrame:
    """Per group of keys: traces, successes, first-pass rate and mean attempts of the successful, failure rate of all.

    A missing or zero attempt is the first. Rates without a denominator are null.
    """
    attempt = F.when(F.coalesce("attempt", F.lit(0)) == 0, 1).otherwise(F.col("attempt"))
    each = traces.groupBy(*keys, "trace_id").agg(F.min(F.when(F.col("success"), attempt)).alias("won"))
    n, good = F.count("*"), F.count("won")
    return each.groupBy(*keys).agg(n.alias("total"), good.alias("succeeded"), F.round(ratio(count_where(F.col("won") == 1), good), 4).alias("first_pass_rate"), F.round(F.avg("won"), 4).alias("avg_attempts"), F.round(ratio(n - good, n), 4).alias("failure_rate"))


def latency_percentiles(traces: DataFrame, *keys: str) -> DataFrame:
    """Nearest-rank percentiles. Ranks come from counts per value, so that no group's values are held in one buffer."""
    counts = traces.filter("latency_ms is not null").groupBy(*keys, "latency_ms").agg(F.count("*").alias("k"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("k").over(group.orderBy("latency_ms"))).withColumn("n", F.sum("k").over(group))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col("latency_ms")))
    return counts.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("latency_ms").alias("most"))


def call_accounting(traces: DataFrame, *keys: str) -> DataFrame:
    """Calls, distinct requests, and sums that are null unless every call has the amount; what is known is summed apart."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    return traces.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.countDistinct(F.coalesce("trace_id", "id")).alias("requests"),
        F.round(whole("cost"), 8).alias("total_cost"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("known_cost"),
        (F.count("cost") == F.count("*")).alias("cost_complete"),
        whole("prompt_tokens").alias("prompt_tokens"),
        whole("completion_tokens").alias("completion_tokens"),
    )


def running_cost(traces: DataFrame, quota: float) -> DataFrame:
    """Calls of each task in order with the cost so far and whether it is within the quota."""
    order = Window.partitionBy("task_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.sum(F.coalesce("cost", F.lit(0.0))).over(order)
    return traces.filter("task_id is not null").select("task_id", "id", F.round(so_far, 8).alias("so_far"), (F.round(so_far, 8) <= quota).alias("within"))


def health_states(traces: DataFrame, failures: int = 3, cooldown: str = "10 minutes") -> DataFrame:
    """Per model and call, in order: failures in a row so far, and whether they keep the model in a cooldown, which each
    failure from the given number on renews.

    Days are ordered apart, so that no model's calls are one task's work; a day's first failures go on with those at
    the end of the days before.
    """
    order = Window.partitionBy("model", "day").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    calls = traces.select("model", "id", "created_at", "success", F.to_date("created_at").alias("day"))
    # Failures so far in the day, and those at its last success: one order of the day's calls gives both.
    calls = calls.withColumn("failed", F.coalesce(F.sum((~F.col("success")).cast("int")).over(order), F.lit(0)))
    calls = calls.withColumn("before", F.max(F.when(F.col("success"), F.col("failed"))).over(order)).withColumn("here", F.col("failed") - F.coalesce("before", F.lit(0)))
    days = calls.groupBy("model", "day").agg(F.max("failed").alias("failed"), F.max("before").alias("before"))
    days = days.select("model", "day", (F.col("failed") - F.coalesce("before", F.lit(0))).alias("last"), F.col("before").isNotNull().alias("wins"))
    by_day = Window.partitionBy("model").orderBy("day")
    days = days.withColumn("since", F.sum(F.col("wins").cast("int")).over(by_day))
    days = days.withColumn("open", F.sum("last").over(Window.partitionBy("model", "since").orderBy("day")))
    days = days.select("model", "day", F.coalesce(F.lag("open").over(by_day), F.lit(0)).alias("carried"))
    streak = F.col("here") + F.when(F.col("before").isNull(), F.col("carried")).otherwise(0)
    opens = streak >= failures
    return calls.join(days, ["model", "day"]).select("model", "id", streak.alias("streak"), opens.alias("opens"), F.when(opens, F.col("created_at") + F.expr(f"interval {cooldown}")).alias("cooldown_until"))


def priced(traces: DataFrame, prices: DataFrame, flat_rate: float) -> DataFrame:
    """(id, prompt_cost, completion_cost, cost) by the model's rates; a missing rate is the flat one."""
    joined = traces.join(F.broadcast(prices), "model", "left")
    side = lambda tokens, rate: F.round(F.coalesce(tokens, F.lit(0)) / F.lit(1000.0) * F.coalesce(rate, F.lit(flat_rate)), 6)
    return joined.select("id", side("prompt_tokens", "prompt_rate").alias("prompt_cost"), side("completion_tokens", "completion_rate").alias("completion_cost")).withColumn("cost", F.round(F.col("prompt_cost") + F.col("completion_cost"), 6))


def reconciled(estimates: DataFrame, bills: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Estimates and bills per trace, duplicates summed in decimal, with a verdict on each trace of either."""
    e = estimates.groupBy("trace_id").agg(F.sum("amount").alias("estimate"))
    b = bills.groupBy("trace_id").agg(F.sum("amount").alias("billed"))
    gap = F.col("billed") - F.col("estimate")
    verdict = F.when(F.col("estimate").isNull(), "missing_estimate").when(F.col("billed").isNull(), "missing_bill").when(F.abs(gap) <= F.lit(tolerance).cast("decimal(18,4)"), "matched").otherwise("mismatch")
    return e.join(b, "trace_id", "full_outer").select("trace_id", "estimate", "billed", gap.alias("difference"), verdict.alias("status"))
