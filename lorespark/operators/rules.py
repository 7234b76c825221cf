"""Rules over rows: transitions, failures, routing, replay, expiry, policies as data, keys and byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_where


def checked_transitions(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """moves of (id, before, after) with whether the rules of (before, after) allow them; to stay is a move like others."""
    rules = allowed.select("before", "after").distinct().withColumn("known", F.lit(True))
    joined = moves.join(rules, ["before", "after"], "left")
    return joined.select("id", "before", "after", F.coalesce("known", F.lit(False)).alias("allowed"))


#: Failures that pass, and codes that may.
TRANSIENT, RETRIED = ("connection", "timeout", "database", "trace_store"), (408, 429)


def failure_class(causes: Column) -> Column:
    """`retry`, `permanent` or `unknown` for a failure and its causes, an array of (kind, code) from the outermost inwards.

    The first of them that says something decides: a connection or store that failed is tried again; an answer with a
    code is tried again for 408, 429 and from 500 on and given up otherwise; the platform's own errors are given up.
    Others say nothing, nor does a routing failure; without any that does, nothing is known.
    """

    def said(x: Column) -> Column:
        passes = x["code"].isin(*RETRIED) | (x["code"] >= 500)
        return (
            F.when(x["kind"].isin(*TRANSIENT), "retry")
            .when((x["kind"] == "http") & x["code"].isNotNull(), F.when(passes, "retry").otherwise("permanent"))
            .when(x["kind"] == "platform", "permanent")
        )

    return F.coalesce(F.get(F.filter(F.transform(causes, said), lambda x: x.isNotNull()), F.lit(0)), F.lit("unknown"))


def routed(events: DataFrame, threshold: float, margin: float, most_revisions: int) -> DataFrame:
    """(id, route): store what is clearly good, review what is near the threshold, revise what is not good while it may
    still be revised, reject the rest; without a score it is reviewed."""
    route = (
        F.when(F.col("score").isNull(), "review")
        .when(F.col("score") >= threshold + margin, "store")
        .when(F.col("score") >= threshold - margin, "review")
        .when(F.col("revisions") < most_revisions, "revise")
        .otherwise("reject")
    )
    return events.select("id", route.alias("route"))


def replayable(letters: DataFrame, active: DataFrame, most: int) -> DataFrame:
    """(id, verdict) of dead letters: replay one that no active event of its key stands in the way of, as long as it was
    replayed less than most times; of one key only the oldest, by created_at and id."""
    held = active.select("key").distinct().withColumn("held", F.lit(True))
    place = F.row_number().over(Window.partitionBy("key").orderBy("created_at", "id"))
    rows = letters.withColumn("place", place).join(held, "key", "left")
    verdict = F.when(F.col("held"), "active").when(F.col("replays") >= most, "exhausted").when(F.col("place") > 1, "later").otherwise("replay")
    return rows.select("id", verdict.alias("verdict"))


def expired(rows: DataFrame, now: Column, batch: int, *order: str) -> DataFrame:
    """(id, batch_no): rows whose time is up, in batches of a size, oldest first. Ranges of time are numbered apart and
    their counts summed, so that no task orders all rows."""
    due = rows.filter(F.col("expires_at") <= now).withColumn("day", F.to_date("expires_at"))
    days = due.groupBy("day").agg(F.count("*").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("expires_at", *order))
    return due.withColumn("place", place).join(before, "day").select("id", F.floor((F.col("before") + F.col("place") - 1) / batch).alias("batch_no"))


def durability(calls: DataFrame, *keys: str) -> DataFrame:
    """Per group: calls that were stored at once, those that were spooled, those lost, and the group's health."""
    stored, spooled, lost = (count_where(F.col("kept") == k) for k in ("stored", "spooled", "lost"))
    health = F.when(lost > 0, "failing").when(spooled > 0, "degraded").otherwise("healthy")
    return calls.groupBy(*keys).agg(stored.alias("stored"), spooled.alias("spooled"), lost.alias("lost"), health.alias("health"))


def first_match(rows: DataFrame, text: str, policy: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """rows with role: the name of the first pattern of a policy, which is data, that the text matches."""
    role = F.lit(otherwise)
    for name, pattern in reversed(policy):
        role = F.when(F.col(text).rlike(pattern), name).otherwise(role)
    return rows.withColumn("role", role)


def violations(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule of (type, field, least, most) how many rows of its type there are and how many break it: content types are data.

    A field that is null, no number, or that rows do not have is broken. Any number of fields and rules takes part.
    """
    fields = [c for c in rows.columns if c != "type"]
    values = F.create_map(*[x for c in fields for x in (F.lit(c), F.expr(f"try_cast(`{c}` as double)"))]) if fields else F.expr("cast(map() as map<string,double>)")
    joined = rows.select("type", values.alias("values")).join(rules, "type")
    value = F.element_at("values", F.col("field"))
    broken = (value < F.col("least")) | (value > F.col("most")) | value.isNull()
    return joined.groupBy("type", "field").agg(F.count("*").alias("rows"), count_where(broken).alias("broken"))


def tier(tiers: Column, difficulty: Column) -> Column:
    """The model of a difficulty by a map, else of the default, else the first one."""
    return F.coalesce(F.element_at(tiers, difficulty), F.element_at(tiers, F.lit("default")), F.get(F.map_values(tiers), F.lit(0)))


def scoped_key(*parts: Column, tenant: Column, version: str) -> Column:
    """A cache key that no two tenants and no two versions share; a null part differs from an empty one."""
    shown = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in (tenant, *parts)]
    return F.sha2(F.concat_ws("|", F.lit(version), *shown), 256)


def byte_cut(text: Column, most: int) -> Column:
    """The longest start of a text that takes at most so many bytes; no character is cut apart."""
    begin = F.expr("0")
    chars = F.split(F.substring(text, 1, most), "")
    step = lambda acc, c: F.struct((acc["bytes"] + F.octet_length(c)).alias("bytes"), (acc["n"] + (acc["bytes"] + F.octet_length(c) <= most).cast("int")).alias("n"))
    n = F.aggregate(chars, F.struct(begin.alias("bytes"), begin.alias("n")), step)["n"]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), n))


def without_copies(rows: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """rows with copied: whether their content is exactly that of an example."""
    known = examples.select(key).distinct().withColumn("copied", F.lit(True))
    return rows.join(known, key, "left").withColumn("copied", F.coalesce("copied", F.lit(False)))


def upserted(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, version, content, change): stored rows with the incoming ones merged in. New content raises the version, equal
    content leaves the row as it is."""
    new = incoming.select(key, F.col("content").alias("new"))
    joined = stored.join(new, key, "full_outer")
    change = F.when(F.col("version").isNull(), "added").when(F.col("new").isNull() | F.col("new").eqNullSafe(F.col("content")), "kept").otherwise("changed")
    version = F.when(change == "added", 1).when(change == "changed", F.col("version") + 1).otherwise(F.col("version"))
    return joined.select(key, version.alias("version"), F.coalesce("new", "content").alias("content"), change.alias("change"))


def sound_weights(weights: DataFrame, *keys: str) -> DataFrame:
    """Per template: its rules, the sum of their weights, and whether it may be loaded: the weights are positive and add up to 1."""
    total = F.sum("weight")
    return weights.groupBy(*keys).agg(F.count("*").alias("rules"), F.round(total, 6).alias("total"), ((F.abs(total - 1) <= 1e-6) & F.bool_and(F.col("weight") > 0)).alias("sound"))


def read_bills(lines: DataFrame) -> DataFrame:
    """(trace_id, amount, lines) of text lines "trace,amount": duplicates are summed in decimal; lines without both, or
    whose amount is no finite number of at least 0, are rejected."""
    parts = F.split("value", ",")
    amount = F.expr("try_cast(trim(split(value, ',')[1]) as decimal(18,4))")
    rows = lines.select(F.trim(F.get(parts, F.lit(0))).alias("trace_id"), F.when(F.size(parts) == 2, amount).alias("amount"))
    return rows.filter("trace_id <> '' and amount >= 0").groupBy("trace_id").agg(F.sum("amount").alias("amount"), F.count("*").alias("lines"))
