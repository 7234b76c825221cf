"""Request deduplication, sample pools, seeded samples, export."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def first_requests(requests: DataFrame, key: str, *order: str) -> DataFrame:
    """The first request of each hash, and how many repeat it."""
    first = requests.groupBy(key).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("requests"))
    return first.select(key, *[F.col(f"first.{c}").alias(c) for c in order], "requests")


def not_pooled(items: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Items that the pool does not have."""
    return items.join(pool.select(key), key, "left_anti")


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: str, also: Column) -> DataFrame:
    """(id, reasons): n rows in the order of a keyed hash, and all rows that satisfy also."""
    drawn = rows.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)).limit(n).select(id_col, F.lit("sample").alias("reason"))
    wanted = rows.filter(also).select(id_col, F.lit("disagreement").alias("reason"))
    return drawn.unionByName(wanted).groupBy(id_col).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def budgeted(candidates: DataFrame, group: str, order: list[str], cost: str, budget: int, most: int) -> DataFrame:
    """The candidates of each group that fit: in order, one whose cost no longer fits is skipped and later ones may follow.

    Groups come sorted and are folded as they stream by, so that no group is held whole.
    """
    at, price = candidates.columns.index(group), candidates.columns.index(cost)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left, kept = None, budget, 0
        for batch in batches:
            chosen = []
            for i, (key, c) in enumerate(zip(batch.column(at).to_pylist(), batch.column(price).to_pylist(), strict=True)):
                if i == 0 and current is None or key != current[0]:
                    current, left, kept = (key,), budget, 0
                if kept < most and c is not None and c <= left:
                    chosen.append(i)
                    left, kept = left - c, kept + 1
            yield batch.take(pa.array(chosen, pa.int64()))

    return candidates.repartition(group).sortWithinPartitions(group, *order).mapInArrow(take, candidates.schema)


def exported(rows: DataFrame, *order: str) -> DataFrame:
    """One JSON line per row, newest first."""
    return rows.orderBy(*[F.desc(c) for c in order]).select(F.to_json(F.struct(*rows.columns)).alias("line"))


def first_reason(rows: DataFrame, reasons: list[tuple[str, Column]], otherwise: str = "eligible") -> DataFrame:
    """rows with reason, the name of the first condition that holds; a condition that is null does not."""
    found = F.lit(otherwise)
    for name, condition in reversed(reasons):
        found = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(found)
    return rows.withColumn("reason", found)


def islands(rows: DataFrame, key: str, at: str, tie: str, gap: str) -> DataFrame:
    """Runs of a key's rows in order of at with no gap longer than the given one: (key, island, rows, first, last)."""
    order = Window.partitionBy(key).orderBy(at, tie)
    opens = F.coalesce(F.col(at) > F.lag(at).over(order) + F.expr(f"interval {gap}"), F.lit(True))
    numbered = rows.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "island").agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))
