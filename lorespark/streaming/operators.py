"""Stateful operators: windowed sums, idempotent events, delivery with retries, requests that are active once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_costs(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window and type: events and their value; rows later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    sums = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return sums.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")


def once(events: DataFrame, *keys: str, late: str = "30 days") -> DataFrame:
    """The keys of events, each once however often it comes within the time that the watermark waits; state older than that goes."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def deliveries(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(key, status, sent, failures) after each batch, from attempts of (key, number, ok) taken in order of number.

    A success is one message sent and ends a row of failures; `most` failures in a row make the key dead, and
    nothing counts for it after that.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, sent, failures = state.get if state.exists else ("pending", 0, 0)
        for ok in pd.concat(list(batches)).sort_values("number")["ok"]:
            if status == "dead":
                break
            status, sent, failures = ("sent", sent + 1, 0) if ok else ("dead" if failures + 1 >= most else "retry", sent, failures + 1)
        state.update((status, int(sent), int(failures)))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "sent": [sent], "failures": [failures]})

    return attempts.groupBy("key").applyInPandasWithState(step, "key long, status string, sent long, failures long", "status string, sent long, failures long", "update", GroupStateTimeout.NoTimeout)


def leases(requests: DataFrame, seconds: int = 3600, most: int = 3, late: str = "1 day") -> DataFrame:
    """(key, status, token, owner) after each change, from requests of (key, number, at, owner, done) in order of number.

    A claim gets the lease of its key, with the next token, if nobody has it or it has run out; most claims make
    the key dead. A report that the work is done counts only with the token of the current owner, before the lease
    runs out: owners that were overtaken change nothing. A lease also ends without any further request of its
    key, by a timer, once the watermark, which stays `late` behind the latest request, has passed its end. Requests from before the
    watermark are dropped; it begins with 1970.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, token, owner, until = state.get if state.exists else ("pending", 0, -1, -1)
        if state.hasTimedOut:
            status, owner = ("dead" if token >= most else "pending"), -1
        else:
            for row in pd.concat(list(batches)).sort_values("number").itertuples():
                if status in ("done", "dead"):
                    break
                if status == "leased" and row.at >= until:
                    status, owner = ("dead" if token >= most else "pending"), -1
                if row.done and status == "leased" and row.owner == owner:
                    status = "done"
                elif not row.done and status == "pending":
                    status, token, owner, until = "leased", token + 1, row.owner, row.at + seconds
        state.update((status, int(token), int(owner), int(until)))
        if status == "leased":
            state.setTimeoutTimestamp(max(int(until) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "token": [token], "owner": [owner]})

    timed = requests.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)
    return timed.groupBy("key").applyInPandasWithState(step, "key long, status string, token long, owner long", "status string, token long, owner long, until long", "update", GroupStateTimeout.EventTimeTimeout)


def page_claims(requests: DataFrame, seconds: int = 3600, most: int = 3, late: str = "1 day") -> DataFrame:
    """(job, page, status, token, owner) of each page that changed, from requests of (job, number, at, kind, page, owner) in order.

    `add` puts a page into its job's queue; `claim` gives its owner the first page of the job, by number, that waits or
    whose lease has run out, with the page's next token; `done` and `fail` count only from the owner whose lease still
    holds. A page that failed or ran out waits again, after `most` tokens it is dead. Leases that nobody asks for end by a timer
    as in leases(). A job's state is a row for each of its pages.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages = {p: list(rest) for p, *rest in json.loads(state.get[0])} if state.exists else {}
        touched: set[int] = set()

        def run_out(now: float, strictly: bool) -> None:
            for page, entry in pages.items():
                if entry[0] == "running" and (entry[3] < now if strictly else entry[3] <= now):
                    entry[0], entry[2] = ("dead" if entry[1] >= most else "waiting"), -1
                    touched.add(page)

        if state.hasTimedOut:
            run_out(state.getCurrentWatermarkMs() / 1000, True)
        else:
            for row in pd.concat(list(batches)).sort_values("number").itertuples():
                run_out(row.at, False)
                entry = pages.get(row.page)
                if row.kind == "add" and entry is None:
                    pages[int(row.page)] = ["waiting", 0, -1, -1]
                    touched.add(int(row.page))
                elif row.kind == "claim":
                    waiting = min((p for p, e in pages.items() if e[0] == "waiting"), default=None)
                    if waiting is not None:
                        pages[waiting] = ["running", pages[waiting][1] + 1, int(row.owner), int(row.at) + seconds]
                        touched.add(waiting)
                elif row.kind in ("done", "fail") and entry and entry[0] == "running" and entry[2] == row.owner:
                    entry[0] = "done" if row.kind == "done" else "dead" if entry[1] >= most else "waiting"
                    entry[2] = entry[2] if row.kind == "done" else -1
                    touched.add(int(row.page))
        state.update((json.dumps([[p, *e] for p, e in sorted(pages.items())]),))
        ends = [e[3] for e in pages.values() if e[0] == "running"]
        if ends:
            state.setTimeoutTimestamp(max(min(ends) * 1000, state.getCurrentWatermarkMs() + 1))
        rows = [(key[0], p, *pages[p][:3]) for p in sorted(touched)]
        yield pd.DataFrame(rows, columns=["job", "page", "status", "token", "owner"]).astype({"job": "int64", "page": "int64", "token": "int64", "owner": "int64"})

    timed = requests.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)
    return timed.groupBy("job").applyInPandasWithState(step, "job long, page long, status string, token long, owner long", "pages string", "update", GroupStateTimeout.EventTimeTimeout)


def latest(states: DataFrame, *keys: str) -> DataFrame:
    """The last state of each key."""
    others = [c for c in states.columns if c not in (*keys, "batch")]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, *[f"last.{c}" for c in others])
