"""Bounded breadth-first search and closure against plain loops."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lorespark.operators import graphs


def queue(starts, edges, most, hops, active):
    """The members of one seed, one after another."""
    todo, seen, out = deque((n, 0) for n in starts), set(starts), []
    while todo and len(out) < most:
        node, at = todo.popleft()
        if node not in active:
            continue
        out.append((node, at))
        for target in edges.get(node, []):
            if target not in seen and at < hops:
                seen.add(target)
                todo.append((target, at + 1))
    return out


@pytest.mark.parametrize(("seed", "most", "hops"), [(1, 5, 3), (2, 12, 9), (3, 1, 2), (4, 100, 4), (5, 7, 0)])
def test_bounded_reach_against_a_queue(spark, seed, most, hops):
    rng = random.Random(seed)
    edges = {n: rng.sample(range(40), rng.choice([0, 1, 3, 12])) for n in range(40)}
    edges[0] = list(range(1, 40))  # a hub
    starts = {s: rng.sample(range(40), rng.choice([1, 2, 4])) for s in range(15)}
    active = set(rng.sample(range(40), 33)) | {0}
    got = graphs.bounded_reach(
        spark.createDataFrame([(s, n, i) for s, ns in starts.items() for i, n in enumerate(ns)], "seed long, node long, place long"),
        spark.createDataFrame([(n, t, i) for n, ts in edges.items() for i, t in enumerate(ts)], "source long, target long, place long"),
        most,
        hops,
        spark.createDataFrame([(n,) for n in active], "node long"),
    ).collect()
    found = {s: [(r["node"], r["hops"]) for r in sorted(got, key=lambda r: r["place"]) if r["seed"] == s] for s in starts}
    for s in starts:
        assert found[s] == queue(starts[s], edges, most, hops, active), s


def test_closure_of_chains_and_stars(spark):
    rng = random.Random(2)
    parent = {0: None, **{i: i - 1 for i in range(1, 70)}, **{100 + i: rng.randrange(70) for i in range(60)}, 900: 901}
    got = graphs.closure(spark.createDataFrame(list(parent.items()), "node long, parent long")).collect()
    want = set()
    for n in parent:
        at, hops = n, 0
        while at is not None and at in parent:
            want.add((at, n, hops))
            at, hops = parent[at], hops + 1
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    with pytest.raises(ValueError, match="circle"):
        graphs.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"))


def test_closure_beyond_a_million_rows(spark):
    """A tree of 400,000 nodes three deep: recursion of SQL stops at a million rows."""
    nodes = spark.range(400_000).select(F.col("id").alias("node"), F.when(F.col("id") >= 1000, F.col("id") % 999 + 1).when(F.col("id") > 0, F.lit(0)).alias("parent"))
    assert graphs.closure(nodes).count() == 1 + 999 * 2 + 399_000 * 3


def test_names_that_two_nodes_have_resolve_to_none(spark):
    names = spark.createDataFrame([("a", "One"), ("b", "two"), ("c", " TWO ")], "node string, name string")
    got = graphs.resolved(spark.createDataFrame([("ONE ",), ("two",), (None,)], "label string"), names, lambda c: F.lower(F.trim(c))).collect()
    assert {(r["label"], r["node"]) for r in got} == {("ONE ", "a"), ("two", None), (None, None)}
