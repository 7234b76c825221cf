"""Quality measurement: pass rates, weights, calibration, agreement, status rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_where, kappa, ratio


def pipeline_stats(events: DataFrame, *keys: str) -> DataFrame:
    """Per group of threads: first-draft and final pass rates.

    A thread's first event counts if it is revision 0, its last if it is final; an event passes if it completed
    with at least its own threshold. Rates without a denominator are null.
    """
    passed = (F.col("status") == "completed") & (F.col("score") >= F.col("threshold"))
    event = F.struct("revise_count", F.coalesce(passed, F.lit(False)).alias("passed"), "is_final")
    threads = events.groupBy(*keys, "thread_id").agg(F.min_by(event, "revise_count").alias("first"), F.max_by(event, "revise_count").alias("last"), F.count("*").alias("n"))
    first, final = F.col("first.revise_count") == 0, F.col("last.is_final")
    return threads.groupBy(*keys).agg(
        F.count("*").alias("threads"),
        F.sum("n").alias("evaluations"),
        count_where(first).alias("first_n"),
        ratio(count_where(first & F.col("first.passed")), count_where(first)).alias("first_pass_rate"),
        count_where(final).alias("final_n"),
        ratio(count_where(final & F.col("last.passed")), count_where(final)).alias("final_pass_rate"),
    )


def quality_buckets(records: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Per template and source: records, passed, rejected, mean score; null keys form groups."""
    good = count_where(F.col("score") >= threshold)
    return records.groupBy("template_id", "source").agg(F.count("*").alias("total"), good.alias("passed"), (F.count("*") - good).alias("rejected"), F.round(F.avg("score"), 4).alias("avg_score"))


def buckets_by_config(records: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Per template, version, tenant, source, reviewer and hash of the configuration that was in force: records, passed,
    rejected, mean score. The threshold is the configuration's own if it states one; null keys form groups."""
    stated = F.regexp_extract("config", r'"threshold":\s*([0-9.]+)', 1)
    own = F.coalesce(F.expr("try_cast(stated as double)"), F.lit(threshold))
    rows = records.withColumn("stated", stated).withColumn("passed", F.col("score") >= own).withColumn("config_hash", F.sha2("config", 256))
    keys = ["template_id", "version", "tenant_id", "source", "reviewer", "config_hash"]
    good = count_where(F.col("passed"))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), good.alias("passed"), (F.count("*") - good).alias("rejected"), F.round(F.avg("score"), 4).alias("avg_score"))


def merged_weights(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(template_id, dimension, weight, sound): the default weights with a template's own in their place; sound tells
    whether all of a template's are positive and at least one default dimension has one."""
    own = overrides.select("template_id", "dimension", F.col("weight").alias("own"))
    rows = own.select("template_id").distinct().join(F.broadcast(defaults)).join(own, ["template_id", "dimension"], "full_outer")
    rows = rows.withColumn("weight", F.coalesce("own", "weight"))
    sound = F.bool_and(F.col("weight") > 0).over(Window.partitionBy("template_id"))
    return rows.select("template_id", "dimension", "weight", sound.alias("sound"))


def latest_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in the given order, whose columns must settle ties."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__n", at).filter("__n = 1").drop("__n")


def judged_pairs(records: DataFrame) -> DataFrame:
    """(item_id, template_id, auto, manual): the scores of the first record of either source, by created_at and record_id,
    of items that have both and whose tenant both records share."""

    def side(source: str, name: str) -> DataFrame:
        first = F.min_by(F.struct("score", F.col("tenant_id").eqNullSafe(F.col("item_tenant")).alias("own")), F.struct("created_at", "record_id"))
        rows = records.filter(F.col("source") == source).groupBy("item_id", "template_id").agg(first.alias("first"))
        return rows.filter("first.own").select("item_id", "template_id", F.col("first.score").alias(name))

    return side("auto", "auto").join(side("manual_review", "manual"), ["item_id", "template_id"])


def labelled_outcomes(records: DataFrame, threshold: float = 70.0) -> DataFrame:
    """One row: items labelled, false passes (judged good, reviewed as 0), passes, and the manual reject rate."""
    pairs = judged_pairs(records)
    false_pass = (F.col("auto") >= threshold) & (F.col("manual") == 0)
    return pairs.agg(F.count("*").alias("labelled"), count_where(false_pass).alias("false_pass"), count_where(F.col("manual") != 0).alias("passed"), F.round(ratio(count_where(F.col("manual") == 0), F.count("*")), 4).alias("reject_rate"))


def agreement(records: DataFrame, threshold: float = 70.0, *keys: str) -> DataFrame:
    """Confusion counts of judge against reviewer with accuracy, precision, recall, F1 and three forms of kappa.

    kappa is 1 where chance agreement is certain; kappa_strict is null if either side has one class only;
    kappa_guarded is null if chance agreement is certain. Ratios without a denominator are null.
    """
    pairs = judged_pairs(records).select(*keys, (F.col("auto") >= threshold).alias("a"), (F.col("manual") > 0).alias("m"))
    counts = pairs.groupBy(*keys).agg(count_where(F.col("a") & F.col("m")).alias("tp"), count_where(~F.col("a") & ~F.col("m")).alias("tn"), count_where(F.col("a") & ~F.col("m")).alias("fp"), count_where(~F.col("a") & F.col("m")).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    observed, expected = kappa(tp, tp + fp, tp + fn, n)
    value = F.try_divide(observed - expected, 1 - expected)
    one_class = (tp + fp == 0) | (tn + fn == 0) | (tp + fn == 0) | (tn + fp == 0)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        *keys, "tp", "tn", "fp", "fn",
        F.round(ratio(tp + tn, n), 4).alias("accuracy"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(F.try_divide(2 * precision * recall, precision + recall), 4).alias("f1"),
        F.round(F.when(expected >= 1, 1.0).otherwise(value), 4).alias("kappa"),
        F.round(F.when(~one_class, value), 6).alias("kappa_strict"),
        F.round(F.when(expected < 1, value), 4).alias("kappa_guarded"),
    )


def gold_report(records: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Accuracy overall and per template from one pass over the pairs."""
    pairs = judged_pairs(records).withColumn("same", (F.col("auto") >= threshold) == (F.col("manual") > 0))
    sums = pairs.groupingSets([[], ["template_id"]], "template_id").agg(F.grouping("template_id").alias("g"), F.count("*").alias("cases"), F.round(F.avg(F.col("same").cast("double")), 4).alias("accuracy"))
    return sums.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("template_id")).alias("stratum"), "cases", "accuracy")


def round_means(scores: DataFrame) -> DataFrame:
    """Mean over rounds of each item's score in each dimension."""
    return scores.groupBy("item_id", "verdict", "dimension").agg(F.avg("score").alias("score"))


def weighted_totals(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(item_id, total): the mean of an item's dimension scores by weight; dimensions without a weight do not count."""
    joined = round_means(scores).join(F.broadcast(weights), "dimension")
    return joined.groupBy("item_id").agg(F.round(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), 6).alias("total"))


def fitted_weights(scores: DataFrame, weights: DataFrame, alpha: float = 1.0, floor_ratio: float = 0.05) -> DataFrame:
    """(dimension, lenient, weight): weights lowered where false passes score as high as passes.

    lenient is the difference of the two means. A positive one, relative to the largest, lowers the weight; no
    weight falls below a share of the mean, and all add up to 1. If none is positive weights stay as they are.
    """
    means = round_means(scores).groupBy("dimension").agg(F.avg(F.when(F.col("verdict") == "fp", F.col("score"))).alias("fp"), F.avg(F.when(F.col("verdict") == "pass", F.col("score"))).alias("ok"))
    every = Window.partitionBy()
    rows = weights.join(means, "dimension", "left").withColumn("lenient", F.coalesce(F.round(F.col("fp") - F.col("ok"), 2), F.lit(0.0)))
    rows = rows.withColumn("most", F.max("lenient").over(every))
    rows = rows.withColumn("raw", F.when(F.col("most") > 0, F.col("weight") * (1 - alpha * F.greatest(F.col("lenient"), F.lit(0.0)) / F.col("most"))).otherwise(F.col("weight")))
    rows = rows.withColumn("kept", F.greatest(F.col("raw"), F.avg("raw").over(every) * floor_ratio))
    fitted = F.when(F.col("most") > 0, F.round(F.col("kept") / F.sum("kept").over(every), 4)).otherwise(F.col("weight"))
    return rows.select("dimension", "lenient", fitted.alias("weight"))


def tightened_threshold(records: DataFrame, threshold: float = 70.0, most_rejects: float = 0.05, least_labelled: int = 20, least_false: int = 5) -> DataFrame:
    """One row: whether there is enough to recalibrate, and the threshold then: the tenth percentile (rank n // 10
    from 0) of the judge's scores of passed items if reviewers reject too many, never below the old one."""
    pairs = judged_pairs(records)
    false_pass = count_where((F.col("auto") >= threshold) & (F.col("manual") == 0))
    found = pairs.agg(F.count("*").alias("labelled"), false_pass.alias("false_pass"), ratio(count_where(F.col("manual") == 0), F.count("*")).alias("rejects"), F.count(F.when(F.col("manual") != 0, F.col("auto"))).alias("n"))
    ranked = pairs.filter("manual <> 0").groupBy("auto").agg(F.count("*").alias("k"))
    # The value of a rank comes from counts per score, of which there are few, and not from a list of all scores.
    ranked = ranked.withColumn("upto", F.sum("k").over(Window.orderBy("auto")))
    tenth = ranked.crossJoin(F.broadcast(found.select(F.floor(F.col("n") / 10).alias("rank")))).filter("upto > rank").agg(F.min("auto").alias("p10"))
    enough = (F.col("labelled") >= least_labelled) & (F.col("false_pass") >= least_false)
    tight = F.when(enough & (F.col("rejects") > most_rejects), F.greatest(F.lit(threshold), F.col("p10"))).otherwise(F.lit(threshold))
    return found.crossJoin(tenth).select("labelled", "false_pass", enough.alias("enough"), tight.alias("threshold"))


def round_variance(scores: DataFrame) -> DataFrame:
    """Population variance of the scores of each dimension per round and of their means over rounds."""
    single = scores.groupBy("dimension").agg(F.var_pop("score").alias("single"))
    multi = round_means(scores).groupBy("dimension").agg(F.var_pop("score").alias("multi"))
    return single.join(multi, "dimension").select("dimension", F.round("single", 6).alias("single"), F.round("multi", 6).alias("multi"))


ITEM_STATUSES = ("pending", "queued", "running", "awaiting_review", "succeeded", "partially_succeeded", "failed", "cancelled")


def status_counts(items: DataFrame) -> DataFrame:
    """Count of every status, 0 for those that do not occur."""
    spark = items.sparkSession
    known = spark.createDataFrame([(s,) for s in ITEM_STATUSES], "status string")
    return F.broadcast(known).join(items.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def status_pivot(items: DataFrame) -> DataFrame:
    return items.groupBy("task_id").agg(*[count_where(F.col("status") == s).alias(s) for s in ("awaiting_review", "succeeded", "failed", "cancelled")])


def task_rollup(items: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """(task_id, progress, status) of each task that has items, or at least one expected: a task has as many items as it
    expects, or more if there are more; the status is null while some are missing or unresolved."""
    of = lambda *s: count_where(F.col("status").isin(*s))
    counts = items.groupBy("task_id").agg(F.count("*").alias("have"), of("succeeded").alias("good"), of("failed").alias("failed"), of("cancelled").alias("cancelled"), of("awaiting_review").alias("waiting"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("expected", "have", "good", "failed", "cancelled", "waiting")}
    counts = counts.join(tasks, "task_id", "full_outer") if tasks is not None else counts.withColumn("expected", F.lit(0))
    counts = counts.withColumns(zero).withColumn("n", F.greatest("expected", "have")).filter("n > 0")
    ended = F.col("good") + F.col("failed") + F.col("cancelled")
    status = (
        F.when((ended < F.col("n")) & (ended + F.col("waiting") == F.col("n")), "awaiting_review")
        .when(ended < F.col("n"), F.lit(None).cast("string"))
        .when(F.col("good") == F.col("n"), "succeeded")
        .when(F.col("good") > 0, "partially_succeeded")
        .when(F.col("cancelled") == F.col("n"), "cancelled")
        .otherwise("failed")
    )
    return counts.select("task_id", F.round(ratio(ended, F.col("n")), 4).alias("progress"), status.alias("status"))


def contrast(outcomes: DataFrame) -> DataFrame:
    """Mean over inputs of the mean difference new - old of each input, in points, overall and per template."""
    of = lambda version: F.max(F.when(F.col("version") == version, F.col("good").cast("double"))).alias(version)
    pairs = outcomes.groupBy("template_id", "input", "round").agg(of("old"), of("new"))
    inputs = pairs.filter("old is not null and new is not null").groupBy("template_id", "input").agg(F.avg(F.col("new") - F.col("old")).alias("gain"))
    sums = inputs.groupingSets([[], ["template_id"]], "template_id").agg(F.grouping("template_id").alias("g"), F.count("*").alias("inputs"), F.round(F.avg("gain") * 100, 6).alias("points"))
    return sums.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("template_id")).alias("stratum"), "inputs", "points")
