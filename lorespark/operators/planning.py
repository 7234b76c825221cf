"""The read path for batches of queries: parts, expansion, order, spans, context and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What parts a question of several, and what stands at the ends of its parts.
SEPARATORS = r"(?:以及|同时(?:还)?|另外|此外|[；;]|\band also\b)"
ENDS = r"^[ ,，。；;？?]+|[ ,，。；;？?]+$"
#: Words, runs of Chinese and suffixes that are terms by themselves.
FRAGMENTS = r"[a-z0-9]+(?:[-'][a-z0-9]+)*|[\x{3400}-\x{9fff}]+|[-+][a-z]+"
HAN = r"[\x{3400}-\x{9fff}]+"


def evenly(values: Column, n: Column) -> Column:
    """n elements of an array at even distances, the first and last among them; all if there are no more."""
    last = F.size(values) - 1
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(n == 1, (last + 1) / 2).otherwise(k * last / F.greatest(n - 1, F.lit(1))))
    picked = F.transform(at, lambda x: F.get(values, F.floor(x).cast("int")))
    return F.when(F.size(values) <= n, values).when(n <= 0, F.array().cast("array<string>")).otherwise(picked)


def with_terms(queries: DataFrame, plain: str, most: int = 16) -> DataFrame:
    """queries with terms: the whole of a normal text, its fragments, then pairs of neighbours in Chinese runs; of more than
    most, some at even distances."""
    whole = F.col(plain)
    rows = queries.withColumn("__base", F.array_distinct(F.concat(F.array(whole), F.regexp_extract_all(whole, F.lit(FRAGMENTS), F.lit(0)))))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: F.substring(run, i, F.lit(2)))
    runs = F.filter(F.regexp_extract_all(whole, F.lit(HAN), F.lit(0)), lambda r: F.length(r) > 1)
    rows = rows.withColumn("__pairs", F.array_except(F.array_distinct(F.flatten(F.transform(runs, pairs))), F.col("__base")))
    room = F.lit(most) - F.size("__base")
    terms = F.when(room <= 0, evenly(F.col("__base"), F.lit(most))).otherwise(F.concat("__base", evenly(F.col("__pairs"), room)))
    return rows.withColumn("terms", F.when(whole == "", F.array().cast("array<string>")).otherwise(terms)).drop("__base", "__pairs")


def question_parts(queries: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, part_no, part): the parts of a question that has several, in order; parts of one character or over 256,
    and those that repeat another or the question, are left out."""
    normal = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    raw = F.filter(F.transform(F.split("text", SEPARATORS, -1), lambda x: F.regexp_replace(x, ENDS, "")), lambda x: x != "")
    rows = queries.select("query_id", normal(F.col("text")).alias("whole"), raw.alias("raw")).filter(F.size("raw") > 1)
    fits = F.filter("raw", lambda x: (F.length(x) >= 2) & (F.length(x) <= 256) & (normal(x) != F.col("whole")))
    first = F.filter(F.transform(fits, lambda x, i: F.struct(x.alias("part"), i.alias("i"))), lambda x: F.array_position(F.transform(fits, normal), normal(x["part"])) == x["i"] + 1)
    return rows.select("query_id", F.posexplode(F.slice(first, 1, most)).alias("part_no", "x")).select("query_id", "part_no", "x.part")


def expanded_queries(queries: DataFrame, aliases: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, variant, text): the question itself, then the name of the point that it is a name of, and its other
    names, each normal form once. aliases: (point, label, place), place 0 for the name itself."""
    normal = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = aliases.withColumn("key", normal(F.col("label")))
    of = queries.join(known.groupBy("key").agg(F.min("point").alias("point")), normal(F.col("text")) == F.col("key"), "left")
    own = of.select("query_id", F.lit(-1).alias("place"), F.trim("text").alias("text"))
    more = of.join(aliases, "point").select("query_id", "place", F.col("label").alias("text"))
    rows = own.unionByName(more).filter("length(text) between 1 and 512").withColumn("key", normal(F.col("text")))
    firsts = rows.groupBy("query_id", "key").agg(F.min(F.struct("place", "text")).alias("x")).select("query_id", "x.place", "x.text")
    variant = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "text"))
    return firsts.withColumn("variant", variant).filter(F.col("variant") <= most).select("query_id", "variant", "text")


def reranked(candidates: DataFrame, scores: DataFrame, least: float, top: int, required: bool = False, parts: int | None = None) -> DataFrame:
    """(query_id, candidate_id, score, place): the candidates of (query_id, candidate_id, rank) of at least a score by a
    reranker, best first, equal ones by id.

    A query that lacks a finite score of any candidate failed: it keeps its candidates in the order of their
    ranks, scores null, or nothing if reranking is required. Queries are sorted in so many parts, or as many as the session has.
    """
    joined = candidates.join(scores, ["query_id", "candidate_id"], "left")
    joined = joined.repartition(parts, "query_id") if parts else joined
    sound = F.coalesce(F.abs("score") < float("inf"), F.lit(False)) & ~F.isnan("score")
    rows = joined.withColumn("whole", F.bool_and(sound).over(Window.partitionBy("query_id"))).withColumn("score", F.when(F.col("whole"), F.col("score")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.when(~F.col("whole"), F.col("rank")), "candidate_id"))
    good = rows.filter(F.when(F.col("whole"), F.col("score") >= least).otherwise(F.lit(not required)))
    return good.withColumn("place", place).filter(F.col("place") <= top).select("query_id", "candidate_id", "score", "place")


def coverage_order(candidates: DataFrame, parts: list[int]) -> DataFrame:
    """(query_id, candidate_id, place): for each part of a question in turn its best candidate that no earlier part took,
    then all others by their rank.

    candidates: (query_id, candidate_id, rank, gains), gains a map of part to what its lanes give.
    """
    # Each sort carries a number for a part, not the map.
    gains = [F.coalesce(F.element_at("gains", F.lit(part)), F.lit(0.0)).alias(f"gain{i}") for i, part in enumerate(parts)]
    rows = candidates.select("query_id", "candidate_id", "rank", *gains, F.lit(None).cast("int").alias("seed"))
    for i in range(len(parts)):
        gain = F.col(f"gain{i}")
        open_ = (gain > 0) & F.col("seed").isNull()
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(open_, 0).otherwise(1), F.desc(gain), "rank", "candidate_id"))
        rows = rows.withColumn("best", best).withColumn("seed", F.when(open_ & (F.col("best") == 1), F.lit(i)).otherwise(F.col("seed"))).drop("best")
    order = Window.partitionBy("query_id").orderBy(F.col("seed").asc_nulls_last(), "rank", "candidate_id")
    return rows.select("query_id", "candidate_id", F.row_number().over(order).alias("place"))


def citations(passages: DataFrame) -> DataFrame:
    """(query_id, number, document_id, start, end, label): a row for each segment of the passages, numbered in order."""
    rows = passages.select("query_id", "place", F.posexplode("segments").alias("i", "x"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "i"))
    return rows.select("query_id", number.alias("number"), "x.document_id", "x.start", "x.end").withColumn("label", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("document_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
