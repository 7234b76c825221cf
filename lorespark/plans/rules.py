"""Queries of rules, keys, budgets and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import cosine
from ..operators import rules as op
from .projections import table, with_

# The states of content and where each may go.
STATES = {
    "pending_qc": ["passed", "rejected", "awaiting_review"],
    "awaiting_review": ["passed", "rejected"],
    "passed": ["published"],
    "published": [],
    "rejected": [],
}
ALLOWED = [(before, after) for before, targets in STATES.items() for after in targets]
# A policy of line roles, first match first.
POLICY = [("heading", r"^#{1,6}\s"), ("item", r"^(?:[-*+]|[0-9]+[.)])\s"), ("copyright", r"(?i)copyright|license"), ("address", r"[\w.]+@[\w.]+"), ("sentence", r"[.!?]\s*$")]
TYPE_RULES = [("de", "n_chars", 50.0, 5000.0), ("en", "n_chars", 100.0, 4000.0), ("en", "doc_id", 0.0, 500.0)]
FAILURES = ["http", "routing", "timeout", "platform", "odd", "http", "database"]
TIERS = [("easy", "small"), ("hard", "large"), ("default", "medium")]
_LOG = with_("trace_log")


def transitions(spark, sf_dir):
    """Documents as content that moves from one state to another."""
    state = lambda at: F.get(F.array(*map(F.lit, STATES)), (at % len(STATES)).cast("int"))
    moves = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), state(F.col("doc_id")).alias("before"), state(F.col("n_chars")).alias("after"))
    return op.checked_transitions(moves, spark.createDataFrame(ALLOWED, "before string, after string"))


def failures(spark, sf_dir):
    """Events as failures: one kind around another, some with a code."""
    kinds = F.array(*[F.lit(k) for k in FAILURES])
    code = F.when(F.col("event_id") % 5 < 3, (F.col("event_id") % 5 + 3) * 100 + F.col("event_id") % 30).cast("int")
    link = lambda at: F.struct(F.get(kinds, (at % len(FAILURES)).cast("int")).alias("kind"), code.alias("code"))
    return table(spark, sf_dir, "events").select("event_id", op.failure_class(F.array(link(F.col("user_id")), link(F.floor(F.col("user_id") / 7)))).alias("class"))


def routes(spark, sf_dir):
    events = table(spark, sf_dir, "quality_evaluation").select(F.concat_ws("#", "thread_id", "revise_count").alias("id"), "score", F.col("revise_count").alias("revisions"))
    return op.routed(events, 70.0, 5.0, 3)


def replays(spark, sf_dir):
    letters = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 4).alias("replays"))
    active = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return op.replayable(letters, active, 3)


def expiry(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))
    return op.expired(rows, F.lit("2024-01-20").cast("timestamp_ntz"), 200, "id")


def durability(spark, sf_dir):
    kept = F.when(F.col("cost").isNull() & ~F.col("success"), "lost").when(F.col("cost").isNull(), "spooled").otherwise("stored")
    return op.durability(table(spark, sf_dir, "trace_log").withColumn("kept", kept), "task_id")


def line_roles(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return op.first_match(lines.filter("trim(line) <> ''"), "line", POLICY, "other").groupBy("doc_id", "role").agg(F.count("*").alias("lines"))


def type_violations(spark, sf_dir):
    rules = spark.createDataFrame(TYPE_RULES, "type string, field string, least double, most double")
    return op.violations(table(spark, sf_dir, "documents").select(F.col("lang").alias("type"), "n_chars", "doc_id"), rules)


def model_tiers(spark, sf_dir):
    tiers = F.create_map(*[F.lit(x) for pair in TIERS for x in pair])
    difficulty = F.when(F.col("doc_id") % 3 == 0, "easy").when(F.col("doc_id") % 3 == 1, "hard").otherwise("odd")
    rows = table(spark, sf_dir, "documents").select(op.tier(tiers, difficulty).alias("model"), op.tier(F.create_map(F.lit("hard"), F.lit("large")), difficulty).alias("only"))
    return rows.groupBy("model", "only").agg(F.count("*").alias("items"))


def copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("content"))
    return op.without_copies(docs, docs.filter("lang = 'en'"), "content").select("doc_id", "copied")


def upserts(spark, sf_dir):
    stored = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("type_id"), (F.col("p_partkey") % 3 + 1).alias("version"), F.sha2(F.col("p_name"), 256).alias("content"))
    changed = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("+"))).otherwise(F.col("p_name"))
    incoming = table(spark, sf_dir, "part").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 10 == 0, 1_000_000).otherwise(0)).alias("type_id"), F.sha2(changed, 256).alias("content"))
    return op.upserted(stored, incoming, "type_id")


def template_weights(spark, sf_dir):
    rules = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("type_id"), F.when(F.col("l_orderkey") % 3 == 0, F.lit(0.25)).otherwise(F.col("l_linenumber") / 10.0).cast("double").alias("weight"))
    return op.sound_weights(rules, "type_id")


def bill_lines(spark, sf_dir):
    amount = F.when(F.col("o_orderkey") % 11 == 0, "NaN").when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("-"), F.col("o_totalprice").cast("string"))).when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return op.read_bills(table(spark, sf_dir, "orders").select(F.concat_ws(",", F.col("o_custkey").cast("string"), amount).alias("value")))


def neighbour_cosines(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


QUERIES = {
    "transitions": transitions,
    "failure_classes": failures,
    "routes": routes,
    "replays": replays,
    "expiry_batches": expiry,
    "durability": durability,
    "line_roles": line_roles,
    "type_violations": type_violations,
    "model_tiers": model_tiers,
    "cache_keys": lambda s, d: table(s, d, "pages").select("page_id", op.scoped_key(F.sha2("html", 256), F.col("url"), tenant=F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 3), version="v1").alias("key")),
    "byte_cuts": lambda s, d: table(s, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.md5(op.byte_cut(F.coalesce("text", F.lit("")), 200)).alias("cut")),
    "squeezed_texts": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))).alias("digest")),
    "search_texts": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.lower(F.concat_ws(" ", "source", "lang", "text"))).alias("digest")),
    "props_hashes": lambda s, d: table(s, d, "events").select("event_id", F.sha2(F.to_json(F.from_json("props", "map<string,string>")), 256).alias("hash")).groupBy("hash").agg(F.count("*").alias("events")),
    "copies": copies,
    "upserts": upserts,
    "template_weights": template_weights,
    "bill_lines": bill_lines,
    "neighbour_cosines": neighbour_cosines,
}

_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in POLICY) + " ELSE 'other' END"
_PAIRS = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
SQL = {
    "transitions": f"WITH s AS (SELECT {list(STATES)} AS x), m AS (SELECT doc_id AS id, x[doc_id % 5 + 1] AS before, x[n_chars % 5 + 1] AS after FROM documents, s) SELECT *, (before, after) IN (VALUES {_PAIRS(ALLOWED)}) AS allowed FROM m",
    "failure_classes": f"""WITH e AS (SELECT event_id, {FAILURES}[user_id % 7 + 1] AS outer_kind, {FAILURES}[user_id // 7 % 7 + 1] AS inner_kind, CASE WHEN event_id % 5 < 3 THEN (event_id % 5 + 3) * 100 + event_id % 30 END AS code FROM events),
l AS (SELECT event_id, 0 AS depth, outer_kind AS kind, code FROM e UNION ALL SELECT event_id, 1, inner_kind, code FROM e),
s AS (SELECT event_id, depth, CASE WHEN kind IN ('timeout', 'database') THEN 'retry' WHEN kind = 'http' AND (code IN (408, 429) OR code > 499) THEN 'retry' WHEN kind = 'platform' OR kind = 'http' AND code IS NOT NULL THEN 'permanent' END AS class FROM l)
SELECT event_id, coalesce(arg_min(class, depth) FILTER (WHERE class IS NOT NULL), 'unknown') AS class FROM s GROUP BY event_id""",
    "routes": with_("quality_evaluation") + "SELECT thread_id || '#' || revise_count AS id, CASE WHEN score IS NULL THEN 'review' WHEN score >= 75 THEN 'store' WHEN score >= 65 THEN 'review' WHEN revise_count < 3 THEN 'revise' ELSE 'reject' END AS route FROM quality_evaluation",
    "replays": """WITH l AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderkey % 4 AS replays, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'O')
SELECT id, CASE WHEN key IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') THEN 'active' WHEN replays >= 3 THEN 'exhausted' WHEN place > 1 THEN 'later' ELSE 'replay' END AS verdict FROM l""",
    "expiry_batches": "SELECT event_id AS id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 200 AS batch_no FROM events WHERE ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20'",
    "durability": _LOG + """, k AS (SELECT task_id, count(cost) AS stored, count(*) FILTER (WHERE cost IS NULL AND success) AS spooled, count(*) FILTER (WHERE cost IS NULL AND NOT success) AS lost FROM trace_log GROUP BY task_id)
SELECT *, CASE WHEN lost > 0 THEN 'failing' WHEN spooled > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM k""",
    "line_roles": f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, {_ROLE} AS role, count(*) AS lines FROM l WHERE trim(line) <> '' GROUP BY 1, 2",
    "type_violations": "WITH r(type, field, least, most) AS (VALUES " + ", ".join(f"('{t}', '{f}', {a}, {b})" for t, f, a, b in TYPE_RULES) + "), v AS (SELECT lang AS type, 'n_chars' AS field, n_chars AS value FROM documents UNION ALL SELECT lang, 'doc_id', doc_id FROM documents) SELECT type, field, count(*) AS rows, count(*) FILTER (WHERE value < least OR value > most OR value IS NULL) AS broken FROM v JOIN r USING (type, field) GROUP BY 1, 2",
    "model_tiers": "SELECT CASE doc_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'medium' END AS model, 'large' AS only, count(*) AS items FROM documents GROUP BY 1, 2",
    "cache_keys": "SELECT page_id, sha256('v1|' || coalesce('=' || nullif(page_id % 3, 0), '-') || '|' || coalesce('=' || sha256(html), '-') || '|' || coalesce('=' || url, '-')) AS key FROM pages",
    "byte_cuts": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT *, octet_length(encode(t)) AS bytes, len(list_filter(range(1, least(length(t), 200) + 1), lambda i: octet_length(encode(substr(t, 1, i))) <= 200)) AS n FROM d) SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, md5(substr(t, 1, n)) AS cut FROM p",
    "squeezed_texts": r"SELECT doc_id, md5(lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))) AS digest FROM documents",
    "search_texts": "SELECT doc_id, md5(lower(concat_ws(' ', source, lang, text))) AS digest FROM documents",
    "props_hashes": "SELECT sha256('{\"k\":\"' || regexp_extract(props, '[0-9]+') || '\"}') AS hash, count(*) AS events FROM events GROUP BY 1",
    "copies": "SELECT doc_id, coalesce(md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL), FALSE) AS copied FROM documents",
    "upserts": """WITH s AS (SELECT p_partkey AS type_id, p_partkey % 3 + 1 AS version, sha256(p_name) AS content FROM part),
i AS (SELECT p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 1000000 ELSE 0 END AS type_id, sha256(CASE WHEN p_partkey % 4 = 0 THEN p_name || '+' ELSE p_name END) AS new FROM part),
j AS (SELECT type_id, version, content, new, CASE WHEN version IS NULL THEN 'added' WHEN new IS NULL OR new = content THEN 'kept' ELSE 'changed' END AS change FROM s FULL JOIN i USING (type_id))
SELECT type_id, CASE change WHEN 'added' THEN 1 WHEN 'changed' THEN version + 1 ELSE version END AS version, coalesce(new, content) AS content, change FROM j""",
    "template_weights": "WITH w AS (SELECT l_orderkey AS type_id, CASE WHEN l_orderkey % 3 = 0 THEN 0.25::DOUBLE ELSE l_linenumber / 10.0::DOUBLE END AS weight FROM lineitem) SELECT type_id, count(*) AS rules, round(sum(weight), 6) AS total, abs(sum(weight) - 1) <= 1e-6 AND bool_and(weight > 0) AS sound FROM w GROUP BY 1",
    "bill_lines": "SELECT CAST(o_custkey AS VARCHAR) AS trace_id, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS amount, count(*) AS lines FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 GROUP BY 1",
    "neighbour_cosines": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
