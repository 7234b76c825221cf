"""Dashboards, benchmark summaries, evaluation ledgers, review pools, recovery rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_where, is_not_true, ratio, zero_ratio


def dashboard(traces: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """One row of key figures: calls, cost, cost per thread, success, revisions, failed items."""
    calls = traces.agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), zero_ratio(count_where(F.col("success")), F.count("*")).alias("success_rate"))
    threads = events.groupBy("thread_id").agg(F.max("revise_count").alias("most")).agg(F.count("*").alias("threads"), ratio(count_where(F.col("most") > 0), F.count("*")).alias("revise_rate"))
    done = items.agg(F.count("*").alias("items"), ratio(count_where(F.col("status") == "failed"), F.count("*")).alias("failed_rate"))
    row = calls.join(F.broadcast(threads)).join(F.broadcast(done))
    return row.withColumn("cost_per_thread", F.round(F.try_divide("cost", "threads"), 6))


def cycle_seconds(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Mean seconds from start to end per key; rows without both do not count."""
    seconds = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return rows.groupBy(key).agg(F.round(F.avg(seconds), 4).alias("avg_seconds"), F.count(seconds).alias("n"))


def worker_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Counts, failure and unresolved rates with their denominators, throughput per hour and p95s per group."""
    p95 = lambda c: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")
    ended, n = count_where(F.col("status").isin("succeeded", "failed")), F.count("*")
    hours = (F.max("seconds_at") - F.min("seconds_at")) / 3600.0
    return samples.groupBy(*keys).agg(
        n.alias("total"),
        ended.alias("ended"),
        F.round(ratio(count_where(F.col("status") == "failed"), ended), 6).alias("failure_rate"),
        F.round(ratio(n - ended, n), 6).alias("unresolved_rate"),
        F.round(F.try_divide(ended.cast("double"), hours), 4).alias("per_hour"),
        p95("latency").alias("latency_p95"),
    )


def stage_states(calls: DataFrame, stages: str = "stage") -> DataFrame:
    """Per stage: calls, successful, failed, priced, unpriced though used, with usage, without, retried, and those of unknown attempt."""
    return calls.groupBy(stages).agg(
        F.count("*").alias("planned"),
        count_where(F.col("success")).alias("completed"),
        count_where(~F.col("success")).alias("failed"),
        F.count("cost").alias("priced"),
        count_where(F.col("usage_reported")).alias("with_usage"),
        count_where(F.col("usage_reported") & F.col("cost").isNull()).alias("unpriced"),
        count_where(is_not_true(F.col("usage_reported"))).alias("without_usage"),
        count_where(F.col("attempt") > 1).alias("retried"),
        count_where(F.col("attempt").isNull()).alias("unknown_attempt"),
    )


def logical_cost(calls: DataFrame, *keys: str) -> DataFrame:
    """Sum of costs per group, null as soon as one call has none."""
    return calls.groupBy(*keys).agg(F.when(F.count("*") == F.count("cost"), F.round(F.sum("cost"), 6)).alias("cost"), F.count("*").alias("calls"))


def recovery(calls: DataFrame, *keys: str) -> DataFrame:
    """Paths whose first call failed, those of them that succeeded later, and further calls, by group."""
    order = F.struct("attempt_no", "id")
    paths = calls.withColumn("attempt_no", F.coalesce("attempt", F.lit(1))).groupBy(*keys, "trace_id").agg(F.min_by("success", order).alias("first"), F.bool_or("success").alias("ever"), F.count("*").alias("n"))
    failed = count_where(~F.col("first"))
    rescued = count_where(~F.col("first") & F.col("ever"))
    return paths.groupBy(*keys).agg(F.count("*").alias("paths"), failed.alias("first_failed"), rescued.alias("recovered"), F.round(ratio(rescued, failed), 6).alias("recovery_rate"), F.sum(F.col("n") - 1).alias("extra_calls"))


def review_pool(judgements: DataFrame) -> DataFrame:
    """One row per content: how many paths share it and whether its judges disagree."""
    return judgements.groupBy("content").agg(F.count("*").alias("paths"), (F.min("verdict") != F.max("verdict")).alias("disagreement"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def neighbours(rows: DataFrame, key: str, order: list[str], id_col: str, hops: int = 1) -> DataFrame:
    """Each row with the ids of up to so many rows before and after it."""
    w = Window.partitionBy(key).orderBy(*order)
    around = [F.lag(id_col, h).over(w) for h in range(hops, 0, -1)] + [F.lead(id_col, h).over(w) for h in range(1, hops + 1)]
    return rows.select(key, id_col, F.array_join(F.array_compact(F.array(*[a.cast("string") for a in around])), ",").alias("around"))


def alternating_arms(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The arm of each row, A and B in turn within a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("arm", F.when(n % 2 == 1, "A").otherwise("B"))


def stale_items(items: DataFrame, now: Column, limit_seconds: int, most_attempts: int) -> DataFrame:
    """What to do with each unresolved item: nothing while its lease runs, else another attempt or failure."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))
    action = F.when(F.col("attempts") >= most_attempts, "fail").when(age > limit_seconds, "retry").otherwise("wait")
    return items.select("item_id", "attempts", action.alias("action"))


def backoff_seconds(attempt: Column, base: float) -> Column:
    """base doubled with each attempt after the first, eight times at most."""
    return F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(8)))


def active_requests(requests: DataFrame, key: str, order: list[str], ends: str) -> DataFrame:
    """Whether each request of a key is accepted: the one before it in order has ended, or there is none."""
    before = F.lag(ends).over(Window.partitionBy(key).orderBy(*order))
    return requests.withColumn("accepted", F.coalesce(before, F.lit(True)))


def position_bias(answers: DataFrame, most: float = 0.5) -> DataFrame:
    """Answers per option, their share, and whether one option holds more than its share allows."""
    counts = answers.groupBy("option").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select("option", "n", F.round(share, 6).alias("share"), (share > most).alias("biased"))
