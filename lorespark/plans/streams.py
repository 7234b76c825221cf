"""Queries that run streams over the events to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import operators as op
from ..streaming import sinks
from ..streaming.runs import file_stream, finished, shared_path


def daily_values(spark, sf_dir):
    sums = finished(op.windowed_costs(file_stream(spark, sf_dir, "events")), "windows", "update")
    return op.latest(sums, "start", "event_type")


def notified_once(spark, sf_dir):
    return finished(op.once(file_stream(spark, sf_dir, "events"), "user_id", "event_type"), "once").drop("batch")


def delivery_states(spark, sf_dir):
    attempts = file_stream(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("number"), (F.col("event_type") != "error").alias("ok"))
    return op.latest(finished(op.deliveries(attempts), "deliveries", "update"), "key")


def lease_states(spark, sf_dir):
    """Events as claims of users' work by five workers, and purchases as reports that it is done."""
    events = file_stream(spark, sf_dir, "events")
    requests = events.select((F.col("user_id") % 200).cast("long").alias("key"), F.col("event_id").alias("number"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 5).alias("owner"), (F.col("event_type") == "purchase").alias("done"))
    return op.latest(finished(op.leases(requests), "leases", "update"), "key")


def page_states(spark, sf_dir):
    """Sign-ups put pages into the queue of their user's job; other events claim a page, report one as done, or as failed."""
    events = file_stream(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("claim")
    requests = events.select((F.col("user_id") % 50).cast("long").alias("job"), F.col("event_id").alias("number"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"), (F.col("event_id") % 7).cast("long").alias("page"), (F.col("event_id") % 3).cast("long").alias("owner"))
    return op.latest(finished(op.page_claims(requests), "pages", "update"), "job", "page")


def fanned_out(spark, sf_dir):
    """Events to two tables, of which the durable one fails at first: what the spool kept for it is replayed."""
    events, at = file_stream(spark, sf_dir, "events"), shared_path(spark, "fan")
    calls: list[str] = []

    def at_first_down(rows, batch):
        calls.append(batch)
        if len(calls) == 1:
            raise ConnectionError(batch)
        sinks.table_sink(f"{at}/durable")(rows, batch)

    sinks.run(events, f"{at}/first", sinks.fan_out({"durable": at_first_down, "other": sinks.table_sink(f"{at}/other")}, ["durable"], f"{at}/spool", f"{at}/log"))
    sinks.replay(spark, f"{at}/spool", events.schema, f"{at}/again", sinks.fan_out({"durable": at_first_down}, ["durable"], None, f"{at}/log", "replay"))
    tables = [sinks.read_table(spark, f"{at}/{name}", events.schema).withColumn("sink", F.lit(name)) for name in ("durable", "other")]
    return tables[0].unionByName(tables[1]).groupBy("sink", "event_type").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


QUERIES = {"stream_fanned_out": fanned_out, "stream_page_states": page_states, "stream_lease_states": lease_states, "stream_daily_values": daily_values, "stream_notified_once": notified_once, "stream_delivery_states": delivery_states}

SQL = {
    "stream_fanned_out": "SELECT unnest(['durable', 'other']) AS sink, event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
    "stream_lease_states": """WITH RECURSIVE r AS (SELECT user_id % 200 AS key, CAST(epoch(ts) // 1 AS BIGINT) AS moment, event_id % 5 AS who, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id % 200 ORDER BY event_id) AS step FROM events),
f AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS step, 'pending' AS status, CAST(0 AS BIGINT) AS token, CAST(-1 AS BIGINT) AS owner, CAST(-1 AS BIGINT) AS until FROM r
  UNION ALL
  SELECT key, step, CASE WHEN ends THEN 'done' WHEN takes THEN 'leased' ELSE status END, token + takes::INT, CASE WHEN takes THEN who ELSE owner END, CASE WHEN takes THEN moment + 3600 ELSE until END
  FROM (SELECT *, done AND status = 'leased' AND who = owner AS ends, NOT done AND status = 'pending' AS takes
        FROM (SELECT r.key, r.step, r.moment, r.who, r.done, f.token, f.until, f.status = 'leased' AND r.moment >= f.until AS over,
                     CASE WHEN f.status = 'leased' AND r.moment >= f.until THEN CASE WHEN f.token >= 3 THEN 'dead' ELSE 'pending' END ELSE f.status END AS status, CASE WHEN f.status = 'leased' AND r.moment >= f.until THEN -1 ELSE f.owner END AS owner
              FROM f JOIN r ON r.key = f.key AND r.step = f.step + 1))),
l AS (SELECT *, status = 'leased' AND until < (SELECT max(moment) - 86400 FROM r) AS over FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1)
SELECT key, CASE WHEN over THEN CASE WHEN token >= 3 THEN 'dead' ELSE 'pending' END ELSE status END AS status, token, CASE WHEN over THEN -1 ELSE owner END AS owner FROM l""",
    "stream_daily_values": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_notified_once": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_delivery_states": """WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r),
d AS (SELECT user_id, min(event_id) AS died FROM s WHERE streak >= 3 GROUP BY user_id),
k AS (SELECT s.*, died FROM s LEFT JOIN d USING (user_id) WHERE died IS NULL OR event_id <= died)
SELECT user_id AS key, CASE WHEN any_value(died) IS NOT NULL THEN 'dead' WHEN arg_max(streak, event_id) > 0 THEN 'retry' ELSE 'sent' END AS status,
  count(*) FILTER (WHERE ok) AS sent, CAST(arg_max(streak, event_id) AS BIGINT) AS failures
FROM k GROUP BY user_id""",
}
