"""Ledgers of experiments: coverage of costs, budgets, denominators, plans, audits of data sets and of annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_where, kappa, ratio
from .likeness import near_texts


def coverage_summary(calls: DataFrame, *keys: str) -> DataFrame:
    """Per group: calls, share with a cost, the known costs, and their total, which is null unless every call has one."""
    n, known = F.count("*"), F.count("cost")
    return calls.groupBy(*keys).agg(n.alias("calls"), F.round(ratio(known, n), 6).alias("coverage"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("known"), F.when(n == known, F.round(F.sum("cost"), 6)).alias("total"))


def accounting_by_currency(calls: DataFrame, *keys: str) -> DataFrame:
    """Per group and currency: calls, requests, costs, share of calls with a trace, and nearest-rank p50 and p95 of latency."""
    group = [*keys, "currency"]
    sums = calls.groupBy(*group).agg(F.count("*").alias("calls"), F.countDistinct(F.coalesce("trace_id", "id")).alias("requests"), F.round(F.sum("cost"), 6).alias("cost"), F.round(ratio(F.count("trace_id"), F.count("*")), 6).alias("traced"))
    counts = calls.filter("latency_ms is not null").groupBy(*group, "latency_ms").agg(F.count("*").alias("k"))
    every = Window.partitionBy(*group)
    counts = counts.withColumn("upto", F.sum("k").over(every.orderBy("latency_ms"))).withColumn("n", F.sum("k").over(every))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col("latency_ms")))
    ranks = counts.groupBy(*group).agg(at(0.5).alias("p50"), at(0.95).alias("p95")).select(*[F.col(c).alias(f"r_{c}") for c in group], "p50", "p95")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return sums.join(ranks, same, "left").drop(*[f"r_{c}" for c in group])


def model_comparison(calls: DataFrame) -> DataFrame:
    """Per case and profile the sums of cost, latency, attempts and tokens; per case, as profile null, those of all, with what shared sources cost."""
    shared = F.sum(F.when(F.col("stage") == "embedding", F.col("cost")))
    sums = calls.groupingSets([["template_id", "model"], ["template_id"]], "template_id", "model").agg(
        F.grouping("model").alias("whole"),
        F.round(F.sum("cost"), 6).alias("cost"),
        F.round(F.sum("latency_ms"), 4).alias("latency_ms"),
        F.sum("attempt").alias("attempts"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"),
        F.round(shared, 6).alias("shared_cost"),
    )
    return sums.select("template_id", "model", (F.col("whole") == 1).alias("whole"), "cost", "latency_ms", "attempts", "tokens", "shared_cost")


def budget_guard(booked: DataFrame, pending: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per task of a budget: what is booked and pending together, and whether the next call must wait."""
    spent = booked.select("task_id", "cost").unionByName(pending.select("task_id", "cost")).groupBy("task_id").agg(F.sum("cost").alias("spent"))
    rows = budgets.join(spent, "task_id", "left").withColumn("spent", F.round(F.coalesce("spent", F.lit(0.0)), 6))
    return rows.select("task_id", "budget", "spent", (F.col("spent") >= F.col("budget")).alias("exhausted"))


def judge_rates(paths: DataFrame, *keys: str) -> DataFrame:
    """Pass rates over all paths, over those with a valid schema, and over those that were completed."""
    passed = count_where(F.col("completed") & F.col("passed"))
    valid, done = count_where(F.col("valid")), count_where(F.col("completed"))
    rate = lambda whole: F.round(ratio(passed, whole), 6)
    return paths.groupBy(*keys).agg(F.count("*").alias("paths"), valid.alias("valid"), done.alias("completed"), passed.alias("passed"), rate(F.count("*")).alias("of_all"), rate(valid).alias("of_valid"), rate(done).alias("of_completed"))


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, cost): null unless the call reports its usage and the model has a verified price."""
    joined = calls.join(F.broadcast(prices), "model", "left")
    cost = (F.col("prompt_tokens") * F.col("prompt_rate") + F.col("completion_tokens") * F.col("completion_rate")) / 1000.0
    return joined.select("id", F.round(F.when(F.col("verified") & F.col("usage_reported"), cost), 6).alias("cost"))


def set_geometry(items: DataFrame, near: float | None = None) -> DataFrame:
    """Per set of a data set: its size and balance, and how many of its ids, inputs and families another set has too.

    near: also how many of its items (id, text) have a text like that of an item before it, in order of place, in another set.
    """
    sizes = items.groupBy("part").agg(F.count("*").alias("items"), F.round(ratio(count_where(F.col("label") == 1), F.count("*")), 6).alias("positive"))
    for name in ("id", "input", "family"):
        shared = items.groupBy(name).agg(F.countDistinct("part").alias("parts")).filter("parts > 1")
        both = items.join(shared.select(name), name, "left_semi").groupBy("part").agg(F.countDistinct(name).alias(f"shared_{name}"))
        sizes = sizes.join(both, "part", "left").withColumn(f"shared_{name}", F.coalesce(f"shared_{name}", F.lit(0)))
    if near is None:
        return sizes
    # Texts meet once each; of the items that have one, the first of each set stands for all.
    firsts = items.groupBy("text", "part").agg(F.min("place").alias("before"))
    texts = firsts.select(F.md5("text").alias("id"), "text").distinct()
    pairs = near_texts(texts, texts, near).select("first_id", "second_id").join(firsts.select(F.md5("text").alias("second_id"), F.col("part").alias("other"), "before"), "second_id")
    earlier = pairs.groupBy("first_id", "other").agg(F.min("before").alias("before"))
    found = items.select(F.md5("text").alias("first_id"), "id", "part", "place").join(earlier, "first_id").filter("part <> other and before < place")
    return sizes.join(found.groupBy("part").agg(F.countDistinct("id").alias("near_items")), "part", "left").withColumn("near_items", F.coalesce("near_items", F.lit(0)))


def frozen_plan(cases: DataFrame, arms: list[str], seed: str) -> DataFrame:
    """(path_id, case_id, arm, turn): every case in every arm; the arms of a case in an order drawn by seed, path ids by hash."""
    paths = cases.select("case_id", F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    drawn = F.sha2(F.concat_ws("|", F.lit(seed), F.col("case_id").cast("string"), "arm"), 256)
    turn = F.row_number().over(Window.partitionBy("case_id").orderBy(drawn))
    return paths.select(F.substring(drawn, 1, 16).alias("path_id"), "case_id", "arm", turn.alias("turn"))


def rescored(scores: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(item_id, total, passed) from stored dimension scores under other weights and another threshold."""
    joined = scores.join(F.broadcast(weights), "dimension")
    total = F.round(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), 6)
    return joined.groupBy("item_id").agg(total.alias("total")).withColumn("passed", F.col("total") >= threshold)


def pairwise_agreement(votes: DataFrame, judges: list[str]) -> DataFrame:
    """For each two of some judges: items that both judged, share on which they agree, and kappa, null if chance agreement is certain."""
    items = votes.groupBy("item_id").agg(*[F.max(F.when(F.col("judge") == j, F.col("good").cast("int"))).alias(j) for j in judges])
    out = None
    for i, a in enumerate(judges):
        for b in judges[i + 1 :]:
            both = items.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
            sums = both.agg(F.count("*").alias("items"), F.sum(F.col(a) * F.col(b)).alias("yes"), F.sum(a).alias("left"), F.sum(b).alias("right"))
            observed, expected = kappa(F.col("yes"), F.col("left"), F.col("right"), F.col("items"))
            row = sums.select(F.lit(a).alias("first"), F.lit(b).alias("second"), "items", F.round(observed, 6).alias("agreement"), F.round(F.when(expected < 1, F.try_divide(observed - expected, 1 - expected)), 6).alias("kappa"))
            out = row if out is None else out.unionByName(row)
    return out


def shared_scores(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """(path_id, score, status): each content is scored once, and its score goes to all paths that have it; ineligible
    paths are cancelled, and those whose content has no score are missing."""
    joined = paths.join(scores, "content_id", "left")
    status = F.when(~F.col("eligible"), "cancelled").when(F.col("score").isNull(), "missing").otherwise("scored")
    return joined.select("path_id", F.when(status == "scored", F.col("score")).alias("score"), status.alias("status"))


def gold_integrity(labels: DataFrame) -> DataFrame:
    """Per item: whether two annotators labelled it, whether they agree, and whether a third settled a dispute."""
    first = labels.filter("role = 'annotator'").groupBy("item_id").agg(F.countDistinct("annotator").alias("annotators"), F.countDistinct("label").alias("labels"), F.collect_set("annotator").alias("who"))
    third = labels.filter("role = 'adjudicator'").groupBy("item_id").agg(F.min("annotator").alias("adjudicator"))
    rows = first.join(third, "item_id", "left")
    outsider = F.col("adjudicator").isNotNull() & ~F.array_contains("who", F.col("adjudicator"))
    sound = (F.col("annotators") >= 2) & ((F.col("labels") == 1) | F.coalesce(outsider, F.lit(False)))
    return rows.select("item_id", "annotators", (F.col("labels") > 1).alias("disputed"), F.col("adjudicator").isNotNull().alias("adjudicated"), sound.alias("sound"))


def verdict_rollup(verdicts: DataFrame, *keys: str) -> DataFrame:
    """One verdict per key: fail if any is, else unresolved if any is, else pass."""
    has = lambda v: F.bool_or(F.col("verdict") == v)
    return verdicts.groupBy(*keys).agg(F.when(has("fail"), "fail").when(has("unresolved"), "unresolved").otherwise("pass").alias("verdict"), F.count("*").alias("votes"))


def unit_support(results: DataFrame, units: DataFrame, parts: int | None = None) -> DataFrame:
    """Per query: needed units, those that some result holds, whether all are there, and where the first loss was.

    units: (query_id, unit, candidate_id); results: (query_id, candidate_id, stage) with stage 1 for recall and 2 for
    what was delivered. A query fails at recall if a unit is in no recalled candidate, else at delivery. Queries are
    grouped in so many parts, or as many as the session has.
    """
    joined = units.join(results, ["query_id", "candidate_id"], "left")
    joined = joined.repartition(parts, "query_id") if parts else joined
    held = joined.groupBy("query_id", "unit").agg(F.bool_or(F.coalesce(F.col("stage") >= 1, F.lit(False))).alias("recalled"), F.bool_or(F.coalesce(F.col("stage") >= 2, F.lit(False))).alias("delivered"))
    lost = F.when(~F.bool_and("recalled"), "recall").when(~F.bool_and("delivered"), "delivery").otherwise("none")
    return held.groupBy("query_id").agg(F.count("*").alias("units"), count_where(F.col("recalled")).alias("recalled"), count_where(F.col("delivered")).alias("delivered"), F.bool_and("delivered").alias("complete"), lost.alias("lost_at"))


def macro_averages(metrics: DataFrame, names: list[str], condition: Column) -> DataFrame:
    """Means of the metrics over all queries and over those that satisfy a condition."""
    means = lambda prefix, use: [F.round(F.avg(F.when(use, F.col(n).cast("double"))), 6).alias(f"{prefix}{n}") for n in names]
    return metrics.agg(F.count("*").alias("queries"), *means("", F.lit(True)), *means("hit_", condition))


def arm_summary(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per arm: planned paths, assessed ones, their share, passes among them, and the bad cases in order."""
    joined = plan.join(outcomes, "path_id", "left")
    bad = F.array_join(F.sort_array(F.collect_set(F.when(~F.col("good"), F.col("case_id").cast("string")))), ",")
    return joined.groupBy("arm").agg(F.count("*").alias("planned"), F.count("good").alias("assessed"), F.round(ratio(F.count("good"), F.count("*")), 6).alias("coverage"), F.round(ratio(count_where(F.col("good")), F.count("good")), 6).alias("pass_rate"), F.md5(bad).alias("bad_cases"))


def example_leaks(candidates: DataFrame, cases: DataFrame, near: float | None = None) -> DataFrame:
    """(candidate_id, reason): why a candidate may not serve as an example for any of the cases; the first reason counts.

    Not reviewed, then the same item, then the same family, then the same normal text as a case, or, with near, a text whose
    matching blocks with a case's make up that share. Candidates and cases then have text; a null item or family is like none.
    """
    side = lambda name: cases.select(name).distinct().withColumn(f"has_{name}", F.lit(True))
    rows = candidates
    for name in ("item_id", "family", *(["content"] if near is None else [])):
        rows = rows.join(side(name), name, "left")
    if near is not None:
        texts = [df.select(F.md5("text").alias("id"), "text").distinct() for df in (candidates, cases)]
        known = near_texts(*texts, near, autojunk=True).select("first_id").distinct().withColumn("has_content", F.lit(True))
        rows = rows.withColumn("first_id", F.md5("text")).join(known, "first_id", "left")
    reason = F.when(~F.coalesce("reviewed", F.lit(False)), "not_reviewed").when(F.col("has_item_id"), "same_item").when(F.col("has_family"), "same_family").when(F.col("has_content"), "same_text" if near is None else "near_duplicate").otherwise("eligible")
    return rows.select("candidate_id", reason.alias("reason"))


def paired_effect(outcomes: DataFrame) -> DataFrame:
    """(cases, paired, without_rate, with_rate, delta) of outcomes (case_id, without_example, with_example): rates over cases that
    have both, null without any."""
    both = F.col("without_example").isNotNull() & F.col("with_example").isNotNull()
    paired = count_where(both)
    rates = [ratio(count_where(both & F.col(c)), paired) for c in ("without_example", "with_example")]
    return outcomes.agg(F.count("*").alias("cases"), paired.alias("paired"), F.round(rates[0], 6).alias("without_rate"), F.round(rates[1], 6).alias("with_rate"), F.round(rates[1] - rates[0], 6).alias("delta"))
