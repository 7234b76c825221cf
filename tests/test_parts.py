"""What a task sorts or groups stays as it is while the tables grow: more rows make more parts."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lorespark.operators import quality as op
from lorespark.plans import projections, quality


def most_rows(rows):
    return rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("name", ["coverage_order", "citations", "reranked", "unit_support"])
def test_orders_come_in_parts_of_bounded_size(spark, sf, monkeypatch, name):
    rows = queries()[name](spark, sf)
    whole = sorted(map(tuple, rows.collect()))
    monkeypatch.setattr(projections, "PART_ROWS", 256, raising=False)
    parted = queries()[name](spark, sf)
    assert most_rows(parted) < 1024 < len(whole)
    assert sorted(map(tuple, parted.collect())) == whole


def test_outcomes_are_paired_where_they_are_dealt(spark, sf, monkeypatch):
    monkeypatch.setattr(projections, "PART_ROWS", 256, raising=False)
    assert most_rows(quality.outcomes(spark, sf)) < 1024
    rows = spark.createDataFrame([("a", 1, 1, "old", False), ("a", 1, 1, "new", True), ("a", 1, 1, "new", False), ("a", 1, 2, "old", True), ("a", 2, 1, "new", None), ("a", 2, 1, "old", True), (None, 3, 1, "old", True), (None, 3, 1, "new", False), ("a", 4, 1, "other", True)], "template_id string, input long, round long, version string, good boolean")
    dealt = op.contrast(rows.repartition(8, "template_id", "input"))
    assert sorted(map(tuple, dealt.collect()), key=str) == [("a", 1, 100.0), ("overall", 2, 0.0), (None, 1, -100.0)]
    # One exchange deals the inputs, one brings the sums together.
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2
