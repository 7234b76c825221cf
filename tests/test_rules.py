"""Rules that are easily taken too wide: staying, codes, causes, fields beyond any number, rerankers that fail."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators import planning, retrieval, rules, traces
from lorespark.plans.rules import ALLOWED


def test_states_do_not_stay(spark):
    moves = [(1, "published", "published"), (2, "pending_qc", "passed"), (3, "passed", "published"), (4, "rejected", "passed"), (5, None, "passed"), (6, "passed", None)]
    got = rules.checked_transitions(spark.createDataFrame(moves, "id long, before string, after string"), spark.createDataFrame(ALLOWED * 2, "before string, after string")).collect()
    assert {r["id"]: r["allowed"] for r in got} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}


@pytest.mark.parametrize(
    ("causes", "want"),
    [
        ([("http", 408)], "retry"), ([("http", 429)], "retry"), ([("http", 500)], "retry"), ([("http", 409)], "permanent"), ([("http", 425)], "permanent"), ([("http", 404)], "permanent"),
        ([("odd", 500)], "unknown"), ([("odd", None), ("timeout", None)], "retry"), ([("routing", None), ("http", 400), ("timeout", None)], "permanent"), ([("platform", None), ("timeout", None)], "permanent"),
        ([("http", None), ("database", None)], "retry"), ([], "unknown"), ([("routing", None)], "unknown"),
    ],
)
def test_failures_by_their_causes(spark, causes, want):
    df = spark.createDataFrame([(causes,)], "causes array<struct<kind:string,code:int>>")
    assert df.select(rules.failure_class(F.col("causes"))).first()[0] == want


def test_rules_of_any_number_of_fields(spark):
    names = [f"f{i}" for i in range(90)]
    rows = spark.createDataFrame([("t", *range(90)), ("t", *[None] * 90)], "type string, " + ", ".join(f"{n} long" for n in names))
    limits = spark.createDataFrame([("t", n, 0.0, 80.0) for n in names] + [("t", "absent", 0.0, 1.0)], "type string, field string, least double, most double")
    got = {r["field"]: (r["rows"], r["broken"]) for r in rules.violations(rows, limits).collect()}
    assert len(got) == 91 and got["f80"] == (2, 1) and got["f89"] == (2, 2) and got["absent"] == (2, 2)


def test_a_reranker_that_fails_keeps_the_order(spark):
    candidates = spark.createDataFrame([(q, c, r) for q in (1, 2, 3) for c, r in ((10, 2), (11, 1), (12, 3))], "query_id long, candidate_id long, rank long")
    scores = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.9), (1, 12, 0.9), (2, 10, 0.9), (2, 11, 0.8), (3, 10, 1.0), (3, 11, float("nan")), (3, 12, 1.0)], "query_id long, candidate_id long, score double")
    of = lambda got: {q: [r["candidate_id"] for r in sorted(got, key=lambda r: r["place"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert of(planning.reranked(candidates, scores, 0.5, 2).collect()) == {1: [11, 12], 2: [11, 10], 3: [11, 10]}
    assert of(planning.reranked(candidates, scores, 0.5, 2, required=True).collect()) == {1: [11, 12], 2: [], 3: []}


def test_queries_in_blocks_find_the_same(spark, monkeypatch):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple tree", "blue sky", "apple", "", "nothing known"])], "query_id long, text string")
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(["A red Apple", "the sky", "apple tree, red apple tree", None, "blue blue sky"])], "doc_id string, text string").repartition(3)
    whole = sorted(map(tuple, retrieval.keyword_recall(queries, docs, 2).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 150)
    assert whole == sorted(map(tuple, retrieval.keyword_recall(queries, docs, 2).collect()))
    # The whole of a question is a term, too.
    assert [(r[0], r[1], r[2]) for r in whole] == [(0, "d0", 2), (0, "d2", 4), (1, "d1", 1), (1, "d4", 3), (2, "d0", 1), (2, "d2", 1)]


def test_failures_in_a_row_over_days(spark):
    days = ["2024-01-01 10:00", "2024-01-01 23:00", "2024-01-03 01:00", "2024-01-03 02:00", "2024-01-03 03:00", "2024-01-04 01:00"]
    rows = spark.createDataFrame([("m", str(i), d, ok) for i, (d, ok) in enumerate(zip(days, [True, False, False, False, None, False], strict=True))], "model string, id string, at string, success boolean")
    got = traces.health_states(rows.withColumn("created_at", F.col("at").cast("timestamp"))).orderBy("id").collect()
    assert [(r["streak"], r["opens"]) for r in got] == [(0, False), (1, False), (2, False), (3, True), (3, True), (4, True)]
