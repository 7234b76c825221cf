"""What is reached over edges: breadth first under limits, and all ancestors in trees. Rounds of joins, each a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, written


def bounded_reach(starts: DataFrame, edges: DataFrame, most: int, hops: int, active: DataFrame | None = None) -> DataFrame:
    """(seed, node, place, hops): the first `most` nodes that a queue would give of each seed, at most so many hops away.

    starts: (seed, node, place), a seed's own nodes in order of place. edges: (source, target, place), a node's targets
    in order of place, as long as they go one way; for both ways each edge stands twice. active: (node) that may be
    members; others are neither members nor passed through. Nodes come by hops, then as those before them did, then
    by place; of equal places by node. Every node is a seed's member once.

    A round takes the new targets of the last round's members, those alone that fit the limit: what is held of a seed
    never exceeds it, and no other seed's nodes matter to it.
    """
    first = starts.select("seed", "node", F.struct(F.lit(0).cast("long").alias("a"), F.col("place").cast("long").alias("b")).alias("by"))
    way = edges.select(F.col("source").alias("node"), F.col("target"), F.col("place").cast("long").alias("b"))
    reached, rounds, front = None, [], first
    for hop in range(hops + 1):
        new = front.groupBy("seed", "node").agg(F.min("by").alias("by"))
        new = new if active is None else new.join(active.select("node").distinct(), "node", "left_semi")
        if reached is not None:
            new = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
            new = new.join(reached.groupBy("seed").agg(F.max("place").alias("had")), "seed")
        had = F.col("had") if reached is not None else F.lit(0)
        place = had + F.row_number().over(Window.partitionBy("seed").orderBy("by", "node"))
        new = written(new.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("seed", "node", "place", F.lit(hop).alias("hops")), "reach")
        rounds.append(new)
        if new.isEmpty():
            break
        reached = reduce(DataFrame.unionByName, rounds)
        open_ = new.join(reached.groupBy("seed").agg(F.max("place").alias("n")).filter(F.col("n") < most).select("seed"), "seed", "left_semi")
        front = open_.join(way, "node").select("seed", F.col("target").alias("node"), F.struct(F.col("place").alias("a"), "b").alias("by"))
    return reduce(DataFrame.unionByName, rounds)


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, hops) of trees of (node, parent): each node with itself and all above it. A parent that is null or no
    node ends a path; where paths go in circles, it fails.

    Each round doubles how far up is known, by joining the ancestors so far to the node as far up, so a tree of any size takes as
    many rounds as the logarithm of its depth.
    """
    nodes = edges.select("node", "parent").distinct()
    known = written(nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).cast("long").alias("hops")).distinct(), "closure")
    jumps = written(nodes.join(nodes.select(F.col("node").alias("parent")).distinct(), "parent").select("node", F.col("parent").alias("to")), "jumps")
    step, most = 1, known.count()
    while not jumps.isEmpty():
        if step > most:
            raise ValueError("parents lead in a circle")
        above = known.select("ancestor", F.col("node").alias("to"), "hops")
        more = jumps.join(above, "to").select("ancestor", "node", (F.col("hops") + step).alias("hops"))
        after = written(known.unionByName(more), "closure")
        further = written(jumps.select("node", F.col("to").alias("by")).join(jumps.toDF("by", "to"), "by").select("node", "to"), "jumps")
        dropped(known, jumps)
        known, jumps, step = after, further, 2 * step
    return known


def resolved(labels: DataFrame, names: DataFrame, normal) -> DataFrame:
    """(label, node) for labels of (label): the node that is known under its normal form, if names of (node, name) give one only."""
    known = names.select(normal(F.col("name")).alias("key"), "node").groupBy("key").agg(F.min("node").alias("node"), F.countDistinct("node").alias("n")).filter("n = 1")
    return labels.select("label", normal(F.col("label")).alias("key")).join(known, "key", "left").select("label", "node")
