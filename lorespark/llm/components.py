"""Connected components of links that do not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written, written_and_seen


def _least(pairs: DataFrame) -> DataFrame:
    """Rows (u, v, m): v is a neighbour of u, m the least of u and its neighbours. Adaptive execution splits a u of many neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (x, y): root is the least node that it reaches.

    Alternates two steps until nothing changes: each node links its larger neighbours to its least one, then
    its smaller neighbours and itself. Links turn into stars, in a number of rounds that grows with the
    logarithm of the longest path. Each round is a table in the shared folder.
    """
    edges = links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    measures = F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")
    edges, before = written_and_seen(edges, "edges", *measures)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        small = _least(large)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after, now = written_and_seen(small.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges", *measures)
        dropped(large, edges)
        edges = after
        if before == now:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
