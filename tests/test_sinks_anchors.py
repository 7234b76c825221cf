"""Sinks that fail, a spool that is replayed, batches that run again; anchors against the plain table of distances."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.functions.text import substring_distance
from lorespark.operators.anchors import anchor_report, measured
from lorespark.streaming import sinks

SCHEMA = "id long, v string"


def stream(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/in/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def ids(spark, path):
    return sorted(r["id"] for r in sinks.read_table(spark, path, SCHEMA).collect())


class Flaky:
    """A table that fails in the given calls, before or after it wrote."""

    def __init__(self, path, fails, after=False):
        self.inner, self.fails, self.after, self.calls = sinks.table_sink(path), fails, after, 0

    def __call__(self, rows, batch):
        self.calls += 1
        if self.calls in self.fails and not self.after:
            raise ConnectionError
        self.inner(rows, batch)
        if self.calls in self.fails:
            raise ConnectionError


def test_no_row_is_lost_or_doubled(spark, tmp_path):
    at = str(tmp_path)
    rows = stream(spark, at, [[(1, "a"), (2, "b")], [(3, "c")], [(4, "d")]])
    main = Flaky(f"{at}/main", {2, 4})
    sinks.run(rows, f"{at}/ck", sinks.fan_out({"main": main, "copy": sinks.table_sink(f"{at}/copy"), "down": Flaky(f"{at}/x", {1, 2, 3})}, ["main"], f"{at}/spool", f"{at}/log"))
    assert ids(spark, f"{at}/copy") == [1, 2, 3, 4] and ids(spark, f"{at}/main") == [1, 2, 4] and ids(spark, f"{at}/spool") == [3]
    again = sinks.fan_out({"main": main}, ["main"], None, f"{at}/log", "replay")
    with pytest.raises(Exception, match="Lost|replay-0"):
        sinks.replay(spark, f"{at}/spool", rows.schema, f"{at}/ck2", again)
    sinks.replay(spark, f"{at}/spool", rows.schema, f"{at}/ck2", again)
    sinks.replay(spark, f"{at}/spool", rows.schema, f"{at}/ck2", again)
    assert ids(spark, f"{at}/main") == [1, 2, 3, 4]
    health = {r["sink"]: (r["kept"], r["failed"]) for r in sinks.durability(spark, f"{at}/log").collect()}
    assert health == {"main": (3, 1), "copy": (3, 0), "down": (0, 3), "spool": (1, 0)}


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    at = str(tmp_path)
    rows = stream(spark, at, [[(1, "a"), (2, "b")]])
    late = Flaky(f"{at}/late", {1}, after=True)
    write = sinks.fan_out({"first": sinks.table_sink(f"{at}/first"), "late": late}, ["late"], None, f"{at}/log")
    with pytest.raises(Exception, match="Lost|stream-0"):
        sinks.run(rows, f"{at}/ck", write)
    sinks.run(rows, f"{at}/ck", write)
    assert ids(spark, f"{at}/first") == ids(spark, f"{at}/late") == [1, 2]
    assert sinks.replay(spark, f"{at}/nothing", rows.schema, f"{at}/ck3", write) is None


@given(st.text("abc", min_size=1, max_size=9), st.text("abcd", max_size=16))
@settings(max_examples=500, deadline=None)
def test_substring_distance(expected, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(expected, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    assert substring_distance(expected, text) == min(row)


def test_anchor_report(spark):
    table = "| Past | went |\n|---|---|\n| a \\| b | x |\n<table><tr><th>One</th><td>Two</td></tr></table>"
    outputs = [(1, "e", 1, "ok", 9.0, "The  CAT sat here"), (2, "e", 2, "ok", 1.0, table), (3, "e", 3, "ok", 2.0, None), (4, "e", 4, "ok", 3.0, "x"), (5, "e", 5, "failed", 50.0, "lost"), (6, "f", 1, "failed", 1.0, None)]
    expected = [(1, ["the cat", "sad hera", "", "long words that are not there"], []), (2, ["went"], [["past", "WENT"], ["one", "two"], ["past", "x"], ["a | b", "x"]]), (3, ["gone"], [["a", "b"]]), (5, ["lost"], [])]
    pages = spark.createDataFrame(outputs, "page_id long, engine string, place long, status string, seconds double, markdown string")
    known = spark.createDataFrame(expected, "page_id long, anchors array<string>, pairs array<array<string>>")
    errors = {r["page_id"]: (r["errors"], r["pairs"]) for r in measured(pages, known).collect()}
    assert errors[1][0][:2] == [0.0, 2 / 7] and len(errors[1][0]) == 3 and errors[3] == ([1.0], [False])
    assert errors[2] == ([0.0], [True, True, False, False])
    got = {r["engine"]: r for r in anchor_report(pages, known, 0.3).collect()}
    assert (got["e"]["pages"], got["e"]["read"], got["e"]["anchors"], got["e"]["exact"], got["e"]["near"], got["e"]["seconds"], got["e"]["median_seconds"]) == (5, 4, 5, 2, 3, 15.0, 2.0)
    assert (got["f"]["pages"], got["f"]["read"], got["f"]["anchors"], got["f"]["median_seconds"]) == (1, 0, 0, None)
