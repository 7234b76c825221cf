"""Small cases with known results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lorespark.functions.common import cosine, in_scope, redacted
from lorespark.operators import documents, hygiene, planning, quality, retrieval, traces
from lorespark.sources.html import html_blocks
from lorespark.streaming import operators as streams
from lorespark.streaming.runs import finished

CALLS = "trace_id string, attempt int, success boolean"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", 1, True), ("b", 1, False), ("b", 2, False), ("b", 3, True), ("c", 1, False), ("c", 2, False)], (3, 2, 0.5, 2.0, 0.3333)),
        ([("a", 2, True), ("a", 1, True)], (1, 1, 1.0, 1.0, 0.0)),
        ([], (0, 0, None, None, None)),
        ([("a", 1, False)], (1, 0, None, None, 1.0)),
        ([("a", None, True), ("b", 0, True)], (2, 2, 1.0, 1.0, 0.0)),
    ],
)
def test_structured_stats(spark, rows, want):
    assert tuple(traces.structured_stats(spark.createDataFrame(rows, CALLS)).first()) == want


EVENTS = "thread_id string, revise_count int, score double, threshold double, status string, is_final boolean"


def test_pipeline_stats(spark):
    rows = [("a", 0, 75.0, 80.0), ("a", 1, 85.0, 80.0), ("b", 0, 65.0, 60.0), ("c", 0, 60.0, 70.0)]
    got = quality.pipeline_stats(spark.createDataFrame([(*r, "completed", True) for r in rows], EVENTS)).first()
    assert (got["threads"], got["evaluations"]) == (3, 4)
    assert got["first_pass_rate"] == pytest.approx(1 / 3) and got["final_pass_rate"] == pytest.approx(2 / 3)
    rows = [("a", 0, 60.0, 70.0, "completed", False), ("b", 2, 90.0, 70.0, "completed", True)]
    got = quality.pipeline_stats(spark.createDataFrame(rows, EVENTS)).first()
    assert (got["first_n"], got["first_pass_rate"], got["final_n"], got["final_pass_rate"]) == (1, 0.0, 1, 1.0)


RECORDS = "item_id long, source string, score double, template_id string, record_id long, created_at long, tenant_id long, item_tenant long"


def test_first_records_of_one_tenant_are_paired(spark):
    rows = [(1, "auto", 50.0, "t", 2, 10, 1, 1), (1, "auto", 90.0, "t", 1, 10, 1, 1), (1, "auto", 10.0, "t", 0, 11, 1, 1), (1, "manual_review", 1.0, "t", 3, 20, 1, 1), (2, "auto", 1.0, "t", 4, 1, 1, 1), (2, "manual_review", 1.0, "t", 5, 1, None, 1)]
    assert [tuple(r) for r in quality.judged_pairs(spark.createDataFrame(rows, RECORDS)).collect()] == [(1, "t", 90.0, 1.0)]


def test_tasks_wait_for_expected_items(spark):
    items = spark.createDataFrame([(1, "succeeded"), (2, "succeeded"), (2, "failed"), (3, "awaiting_review")], "task_id long, status string")
    tasks = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (5, 0)], "task_id long, expected int")
    got = {r["task_id"]: (r["progress"], r["status"]) for r in quality.task_rollup(items, tasks).collect()}
    assert got == {1: (0.5, None), 2: (1.0, "partially_succeeded"), 3: (0.0, "awaiting_review"), 4: (0.0, None)}


def test_every_failure_from_the_third_on_renews_the_cooldown(spark):
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [("m", str(i), day(d, i), ok) for i, (d, ok) in enumerate([(1, True), (1, False), (1, False), (2, False), (3, False), (3, True), (3, False)])]
    got = traces.health_states(spark.createDataFrame(rows, "model string, id string, created_at timestamp_ntz, success boolean")).orderBy("id").collect()
    assert [(r["streak"], r["opens"]) for r in got] == [(0, False), (1, False), (2, False), (3, True), (4, True), (0, False), (1, False)]


def test_text_blocks():
    text = "# T\npara one\ngoes on\n\n- a\n- b\n| x | y |\n|---|:---:|\n| 1 | 2 |\n| 3 |\ntail\n```py\ncode | x\n# no\n```\n$$\na=b\n$$\nafter\r\n## H2 #\nx|y\n\n~~~\nopen"
    kinds = [(k, a, b) for k, a, b, _ in documents.parsed_blocks(text)]
    assert kinds == [("heading", 1, 1), ("paragraph", 2, 3), ("list", 5, 6), ("table", 7, 9), ("paragraph", 10, 11), ("code", 12, 15), ("code", 16, 18), ("paragraph", 19, 19), ("heading", 20, 20), ("paragraph", 21, 21), ("code", 23, 24)]
    assert documents.parsed_blocks("") == [] and documents.parsed_blocks(" \n\n") == []
    assert documents.table_cells(r"| a \| b | c | ") == [r"a \| b", "c"] and documents.table_cells("a|b") == ["a", "b"]
    pieces = documents.table_chunks(["h", "i"], [["1", "2"], ["3", "4"], ["5", "6" * 30]], 43)
    assert [(a, b) for a, b, _ in pieces] == [(0, 2), (2, 3)] and all(x.startswith("| h | i |\n| --- | --- |\n") for *_, x in pieces)


def test_cuts_end_at_the_best_boundary():
    """Against a search of each window from its end for the best boundary."""
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["word", "a", " ", ". ", ", ", "\n", "\n\n", "漢。", "x" * 30]) for _ in range(rng.randrange(1, 80)))
        size, overlap = rng.choice([(20, 5), (50, 0), (40, 20)])
        spans = documents.cut_points(text, size, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), (c, _) in zip(spans, spans[1:], strict=False):
            assert 0 < b - a <= size and a < c <= b
            half = a + size // 2
            ends = [[half + m.end() for m in boundary.finditer(text[half : a + size])] for boundary in documents.BOUNDARIES]
            want = next((found[-1] for found in ends if found), min(len(text), a + size))
            assert b == want


def test_terms_of_long_and_chinese_queries(spark):
    rows = [(1, ""), (2, "a 漢字漢 b-c"), (3, " ".join(f"w{i}" for i in range(40)))]
    got = {r["query_id"]: r["terms"] for r in planning.with_terms(spark.createDataFrame(rows, "query_id long, plain string"), "plain").collect()}
    assert got[1] == [] and got[2] == ["a 漢字漢 b-c", "a", "漢字漢", "b-c", "漢字", "字漢"]
    assert len(got[3]) == 16 and got[3][0] == rows[2][1] and got[3][-1] == "w39"


def test_agreement(spark):
    def of(*pairs):
        rows = [(i, s, v, "t", k, 1, 1, 1) for i, (a, m) in enumerate(pairs) for k, (s, v) in enumerate((("auto", float(a)), ("manual_review", float(m))))]
        return quality.agreement(spark.createDataFrame(rows, RECORDS)).first()

    got = of((80, 1), (60, 0), (80, 0), (60, 1))
    assert [got[c] for c in ("tp", "tn", "fp", "fn")] == [1, 1, 1, 1]
    assert [got[c] for c in ("accuracy", "precision", "recall", "f1", "kappa")] == [0.5, 0.5, 0.5, 0.5, 0.0]
    got = of((50, 0), (60, 0))
    assert (got["accuracy"], got["precision"], got["kappa"], got["kappa_strict"], got["kappa_guarded"]) == (1.0, None, 1.0, None, None)
    assert of((80, 1), (80, 1), (60, 0), (80, 0))["kappa"] == 0.5


def test_fusion_keeps_places_of_repeats(spark):
    rows = [(1, "vector", 1, 10), (1, "vector", 2, 10), (1, "vector", 3, 20), (1, "keyword", 1, 20), (1, "keyword", 2, 10)]
    got = {r["candidate_id"]: r for r in retrieval.fused(spark.createDataFrame(rows, "query_id long, lane string, position long, candidate_id long")).collect()}
    assert got[10]["rrf"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and got[10]["ranks"] == {"vector": 1, "keyword": 2}
    assert got[20]["rrf"] == pytest.approx(1 / 63 + 1 / 61, abs=1e-8)


def test_vectors_without_a_direction_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [-1.0, 0.0]), (6, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.vector_recall(vectors, vectors, 10, 0.3).filter("query_id = 1").orderBy("rank").collect()
    assert [(r["candidate_id"], round(r["similarity"], 4)) for r in got] == [(1, 1.0), (4, 0.7071)]
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [x and round(x, 4) for (x,) in pairs.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, None, None, None]


def test_query_terms(spark):
    texts = ["Past  Simple", "一般现在时", "", "x " * 3 + " ".join(map(str, range(99)))]
    found = retrieval.terms_of(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")).collect()
    of = lambda i: [r["term"] for r in found if r["query_id"] == i]
    assert of(0) == ["past simple", "past", "simple"]
    assert of(1) == ["一般现在时", "一般", "般现", "现在", "在时"]
    assert of(2) == [] and len(of(3)) == 16


@pytest.mark.parametrize(("statuses", "want"), [(["succeeded", "failed"], (1.0, "partially_succeeded")), (["succeeded", "awaiting_review"], (0.5, "awaiting_review")), (["running", "failed"], (0.5, None)), (["failed", "cancelled"], (1.0, "failed")), (["cancelled"], (1.0, "cancelled"))])
def test_rollup(spark, statuses, want):
    got = quality.task_rollup(spark.createDataFrame([(1, s) for s in statuses], "task_id long, status string")).first()
    assert (got["progress"], got["status"]) == want


def test_tenants_and_redaction(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "tenant string")
    count = lambda **how: rows.filter(in_scope(F.col("tenant"), **how)).count()
    assert [count(own="a"), count(own=None), count(own="a", shared=True), count(own="a", everything=True)] == [1, 1, 2, 3]
    texts = ['{"llm_api_key": "abc"}', "Authorization: Bearer xyz rest", "password=hunter2, more", "x" * 30]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redacted(F.col("t"), 25)).collect()]
    assert "abc" not in got[0] and "xyz" not in got[1] and "hunter2" not in got[2] and got[3] == "x" * 25 + "...[truncated]"


def test_headings_lists_and_sections(spark):
    text = "# A\npara\n\n## B\n- item\n# C\n| a | b |\nend"
    blocks = documents.line_blocks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    got = documents.section_paths(blocks).orderBy("block").collect()
    assert [r["kind"] for r in got] == ["heading", "paragraph", "heading", "list", "heading", "table", "paragraph"]
    assert [r["section"] for r in got] == [["A"], ["A"], ["A", "B"], ["A", "B"], ["C"], ["C"], ["C"]]
    assert [(r["start"], r["end"]) for r in got][:2] == [(0, 3), (5, 9)]


@pytest.mark.parametrize("text", ["", "short", "a" * 5000, "Some sentence here. " * 300, "line\n" * 900, "漢字。" * 700])
def test_chunks_cover_the_text(text):
    spans = documents.cut_points(text, 400, 40)
    assert all(0 < b - a <= 400 for a, b in spans)
    assert all(nxt[0] <= cur[1] and nxt[0] > cur[0] for cur, nxt in zip(spans, spans[1:]))
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))


def test_pages():
    html = "<title>T</title><script>x()</script><h2>Head &amp; co</h2><p>one<br>two</p><table><tr><th>a</th><td>b|c</td></tr></table><li>item"
    assert html_blocks(html) == [("text", 0, "T"), ("heading", 2, "Head & co"), ("text", 0, "one"), ("text", 0, "two"), ("table", 0, "| a | b\\|c |"), ("list", 0, "item")]
    assert html_blocks(None) == []


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 80), (1, 3, 40), (1, 4, 10)], "g long, n long, chars long")
    assert sorted(r["n"] for r in hygiene.budgeted(rows, "g", ["n"], "chars", 100, 3).collect()) == [1, 3, 4]


def test_deliveries_over_batches(spark, tmp_path):
    schema = "key long, number long, ok boolean"
    for i, rows in enumerate([[(1, 1, False), (1, 2, False), (2, 3, True)], [(1, 4, False), (2, 5, False)], [(1, 6, True), (2, 7, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {r["key"]: (r["status"], r["sent"]) for r in streams.latest(finished(streams.deliveries(stream), "test", "update"), "key").collect()}
    assert got == {1: ("dead", 0), 2: ("sent", 2)}


def test_reconciliation(spark):
    d = lambda rows: spark.createDataFrame(rows, "trace_id string, amount string").selectExpr("trace_id", "cast(amount as decimal(18,4)) amount")
    got = {r["trace_id"]: r["status"] for r in traces.reconciled(d([("a", "1"), ("b", "1"), ("c", "1")]), d([("a", "0.5"), ("a", "0.5"), ("b", "2"), ("d", "1")])).collect()}
    assert got == {"a": "matched", "b": "mismatch", "c": "missing_bill", "d": "missing_estimate"}


def test_windows_by_day(spark):
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5), "x", 1.0), (datetime.datetime(2024, 1, 1, 23), "x", 2.0)], "ts timestamp, event_type string, value double")
    assert [(r["events"], r["value"]) for r in streams.windowed_costs(events).collect()] == [(2, 3.0)]


def test_leases_run_out_and_overtaken_owners_change_nothing(spark, tmp_path):
    rows = [
        (1, 1, 0, 7, False), (1, 2, 10, 8, False), (1, 3, 50, 8, True), (1, 4, 60, 7, True),  # 7 has the lease and reports
        (2, 1, 0, 7, False), (2, 2, 150, 8, False), (2, 3, 160, 7, True),  # 8 overtakes 7, whose report is void
        (3, 1, 0, 1, False), (3, 2, 100, 1, False), (3, 3, 200, 1, False), (3, 4, 300, 1, False),  # three claims ran out
        (4, 1, 0, 1, True),
    ]
    rows = [(key, number, 1 + at, owner, done) for key, number, at, owner, done in rows]  # after the first second of 1970
    spark.createDataFrame(rows, "key long, number long, at long, owner long, done boolean").write.parquet(f"{tmp_path}/requests.parquet")
    stream = spark.readStream.schema("key long, number long, at long, owner long, done boolean").parquet(f"{tmp_path}/requests.parquet")
    got = {r["key"]: (r["status"], r["token"], r["owner"]) for r in streams.latest(finished(streams.leases(stream, 100, 3), "leases", "update"), "key").collect()}
    assert got == {1: ("done", 1, 7), 2: ("leased", 2, 8), 3: ("dead", 3, -1), 4: ("pending", 0, -1)}


def _over_files(spark, path, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def test_leases_end_by_a_timer(spark, tmp_path):
    """Key 1 gets no further request after its claim; requests of key 2 move time on, and key 1's lease ends by itself."""
    batches = [[(1, 1, 10, 7, False)], [(2, 3, 500, 8, False)], [(2, 4, 1000, 8, True), (3, 5, 950, 4, False)]]
    stream = _over_files(spark, tmp_path, "key long, number long, at long, owner long, done boolean", batches)
    states = finished(streams.leases(stream, 100, 3, "0 seconds"), "leases", "update").collect()
    assert [r["status"] for r in sorted((r for r in states if r["key"] == 1), key=lambda r: r["batch"])] == ["leased", "pending"]
    last = {r["key"]: (r["status"], r["token"]) for r in sorted(states, key=lambda r: r["batch"])}
    assert last[3] == ("leased", 1) and last[1] == ("pending", 1)


def test_pages_are_claimed_in_order(spark, tmp_path):
    schema = "job long, number long, at long, kind string, page long, owner long"
    one = [(1, i, 1, "add", p, 0) for i, p in enumerate([5, 3, 4])]
    one += [(1, 10, 1, "claim", 0, 7), (1, 11, 2, "claim", 0, 8), (1, 12, 3, "done", 3, 8), (1, 13, 4, "done", 3, 7), (1, 14, 5, "fail", 4, 8), (1, 15, 6, "claim", 0, 9)]
    two = [(1, 20, 200, "claim", 0, 7), (1, 21, 201, "done", 4, 9), (2, 22, 202, "add", 1, 0), (2, 23, 203, "claim", 0, 5)]
    three = [(3, 30, 900, "add", 1, 0)]
    stream = _over_files(spark, tmp_path, schema, [one, two, three])
    got = {(r["job"], r["page"]): (r["status"], r["token"], r["owner"]) for r in streams.latest(finished(streams.page_claims(stream, 100, 3, "0 seconds"), "pages", "update"), "job", "page").collect()}
    # Page 3: done by 7. Page 4: 8 failed, 9's lease ran out, 7 took it last; nobody asked again, so its third token was its last.
    assert got == {(1, 3): ("done", 1, 7), (1, 4): ("dead", 3, -1), (1, 5): ("waiting", 0, -1), (2, 1): ("waiting", 1, -1), (3, 1): ("waiting", 0, -1)}


def test_tiered_chunks_fit_and_keep_all():
    rng = random.Random(7)
    lines = ["# Head", "## Sub part", "", "a word or two here.", "more of the same, and then some", "- item one", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "```\ncode line\n```", "x" * 90, "漢字。" * 20]
    squeezed = lambda x: "".join(x.split())
    for _ in range(300):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 30)))
        found = documents.tiered_chunks(text, 60)
        assert all(len(c) <= 60 for _, _, _, c in found)
        last = text.count("\n") + 1
        assert all(1 <= a <= b <= last for _, a, b, _ in found)
        if all(tier != "table" for tier, *_ in found):
            assert squeezed("".join(c for *_, c in found)) == squeezed(text)
    assert [t for t, *_ in documents.tiered_chunks("# A\nshort\n# B\nshort too", 60)] == ["heading", "heading"]
