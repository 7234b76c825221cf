"""Mixing sources to target weights: hash-random keys, ranges of keys, prefix sums of sizes, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, attach, fresh, table, written

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Per source its size and target, from rows of (source, size).

    Sources in code point order, null last, get the weights in turn and share the total size. A target
    stops at cap times its source's size; what is over goes to the others by weight. In order of cap per
    weight, the sources that stop are a prefix, so that sums over that order give the fixed point at once.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    totals = totals.withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    totals = totals.withColumn("stops", F.col("most") * F.sum("weight").over(onward) <= left * F.col("weight"))
    kept_back = F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    shared = (F.sum("source_size").over(everything) - kept_back) * F.col("weight") / open_weight
    return totals.withColumn("target", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(shared.cast("double"))).select("source", "source_size", "n_docs", "target")


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for documents of (doc_id, source, text).

    taken: the words that the mix takes of the document, whole epochs and the cut one together. The order
    within a source is that of md5(seed:doc_id), so reruns agree. The first three hex digits of that key are
    4,096 ranges of nearly equal size in any source; sums per range give each range's start, and a running sum
    within the range gives the document's place. The document at the cut counts with the words up to the cut,
    so that a source's sum is its target, rounded.

    Null text has size 0; a null source is a source, and the last; a null doc_id takes part with its own key;
    repeated rows each count. No documents give no rows.
    """
    sized = written(docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("key")), "sized")
    return _mixed(sized, ["key", "doc_id", "size"], weights, cap).drop("key")


def _mixed(sized: DataFrame, order: list[str], weights: tuple[int, ...], cap: int) -> DataFrame:
    """sized, a table of (source, size, key) and more, with source_size, target and taken; a source's rows are taken in the given order."""
    rows = attach(sized, source_targets(sized, weights, cap), ["source"], "n_docs", sized.count()).withColumn("range", F.substring("key", 1, 3))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start"))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["s"]) & (rows["range"] == starts["r"]))
    here = Window.partitionBy("s", "r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("begins", F.col("start") + F.sum("size").over(here) - F.col("size")).withColumn("epochs", epochs)
    last = budget - F.col("epochs") * F.col("source_size") - F.col("begins")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last))
    return rows.select(*sized.columns, "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """The documents as the mix takes them, in docs' columns: once for each whole epoch, and at the cut its first words, single-spaced.

    Rows are numbered in a table, so that rows that repeat are told apart and a source's words add up to its target. Per
    source only the number of epochs and its last row beyond them go back to the rows, which hold their own keys
    against it; no text moves for a source with more than 1/4096 of the rows. Long texts are cut like others.
    """
    key, size, row, cut, epochs, weight, words = fresh(docs, "__key", "__size", "__row", "__cut", "__epochs", "__rows", "__words")
    tagged = written(docs.withColumn(size, _size()).withColumn(key, _key(seed)).withColumn(row, F.monotonically_increasing_id()), "tagged")
    order = ["key", "doc_id", "size", "row"]
    narrow = tagged.select("source", "doc_id", F.col(size).alias("size"), F.col(key).alias("key"), F.col(row).alias("row"))
    mixed = _mixed(narrow, order, weights, cap)
    turns = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    extra = F.col("taken") - turns * F.col("size")
    cuts = mixed.groupBy("source").agg(F.max(F.when(extra > 0, F.struct(F.struct(*order).alias("at"), extra.alias("words")))).alias(cut), F.max(turns).alias(epochs), F.count("*").alias(weight))
    rows = attach(tagged, cuts, ["source"], weight, tagged.count())
    here = F.struct(F.col(key).alias("key"), "doc_id", F.col(size).alias("size"), F.col(row).alias("row"))
    more = F.when(F.col(cut).isNull() | (here > F.col(f"{cut}.at")), 0).when(here < F.col(f"{cut}.at"), F.col(size)).otherwise(F.col(f"{cut}.words"))
    whole = F.col(epochs) + (more == F.col(size)).cast("long")
    parts = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when((more > 0) & (more < F.col(size)), F.array(more)).otherwise(F.array().cast("array<long>")))
    rows = rows.filter(F.col(size) > 0).withColumn(words, F.explode(parts))
    start = F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE), 1, F.greatest(F.lit(1), F.col(words)).cast("int")), " ")
    return rows.select(*[F.when(F.col(words) < 0, F.col(c)).otherwise(start).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s),
c AS (SELECT *, most * open_weight <= (total - done) * weight AS stops FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN stops THEN CAST(most AS DOUBLE)
              ELSE CAST((total - coalesce(sum(CASE WHEN stops THEN most END) OVER (), 0)) * weight AS DOUBLE) / CAST(sum(CASE WHEN NOT stops THEN weight END) OVER () AS DOUBLE) END AS target
  FROM c),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - begins)) AS BIGINT) AS taken
FROM e
"""
