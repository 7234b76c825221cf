"""Queries of the read path: terms, parts, expansion, order, spans, context, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import lower_plain
from ..operators import ledgers
from ..operators import planning as op
from . import retrieval
from .projections import dealt, parts, table


def query_terms(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), lower_plain(F.col("text")).alias("plain"))
    return op.with_terms(items, "plain").select("query_id", F.array_join("terms", "|").alias("terms"))


def _questions(spark, sf_dir):
    """Turns of users; sentences stand for parts, as the table has none of the words that part questions."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.regexp_replace("text", r"\.", ";").alias("text"))


def _aliases(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("point"), F.col("n_name").alias("label"), F.lit(0).alias("place"))
    other = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("point"), F.concat(F.lit("the land of "), F.lower("n_name")).alias("label"), F.lit(1).alias("place"))
    return names.unionByName(other)


def expanded_queries(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("text"))
    other = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("query_id"), F.col("r_name").alias("text"))
    return op.expanded_queries(asked.unionByName(other), _aliases(spark, sf_dir))


def _lines(spark, sf_dir, *columns, by=("query_id",)):
    """Lines by order and number with the least of each column, dealt by order or by both."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("candidate_id"), *columns)
    return dealt(lines, *by).groupBy("query_id", "candidate_id").agg(*[F.min(c).alias(c) for c in columns])


def _candidates(spark, sf_dir, **dealing):
    """Lines of an order, which may share a number, as the candidates of a query."""
    return _lines(spark, sf_dir, "l_quantity", "l_suppkey", "l_partkey", **dealing)


def reranked(spark, sf_dir):
    """Lines of an order by quantity; the reranker scores none of up to 4, so that their orders fail."""
    rows = _candidates(spark, sf_dir, by=("query_id", "candidate_id"))
    scores = rows.filter("l_quantity > 4").select("query_id", "candidate_id", (F.col("l_quantity") / 50).cast("double").alias("score"))
    return op.reranked(rows.select("query_id", "candidate_id", F.col("candidate_id").alias("rank")), scores, 0.3, 3, parts=parts(table(spark, sf_dir, "lineitem")))


def coverage_order(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    gains = F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.when(F.col("l_partkey") % 3 == 0, 1.0 / (60 + F.col("candidate_id"))).otherwise(0.0), F.when(F.col("l_suppkey") % 2 == 0, 1.0 / (60 + F.col("candidate_id") % 4)).otherwise(0.0)))
    return op.coverage_order(rows.select("query_id", "candidate_id", F.col("candidate_id").alias("rank"), gains.alias("gains")), [1, 2])


def citations(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    segment = lambda shift: F.struct(F.col("l_partkey").alias("document_id"), (F.col("l_suppkey") + shift).alias("start"), (F.col("l_suppkey") + shift + 10).alias("end"))
    segments = F.when(F.col("candidate_id") % 2 == 0, F.array(segment(0), segment(50))).otherwise(F.array(segment(0)))
    return op.citations(rows.select("query_id", F.col("candidate_id").alias("place"), segments.alias("segments")))


def unit_support(spark, sf_dir):
    """Lines that were not returned are the results; those that are no longer open were delivered."""
    lines = _lines(spark, sf_dir, "l_partkey", "l_returnflag", "l_linestatus", by=("query_id", "candidate_id")).withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
    results = lines.filter("flag <> 'R'").select("query_id", "candidate_id", F.when(F.col("status") == "O", 1).otherwise(2).alias("stage"))
    return ledgers.unit_support(results, lines.select("query_id", (F.col("l_partkey") % 3).alias("unit"), "candidate_id"), parts=parts(table(spark, sf_dir, "lineitem")))


def macro_averages(spark, sf_dir):
    return ledgers.macro_averages(retrieval.metrics(spark, sf_dir), ["reciprocal_rank", "recall", "ndcg"], F.col("hit"))


QUERIES = {
    "query_terms": query_terms,
    "question_parts": lambda s, d: op.question_parts(_questions(s, d)),
    "expanded_queries": expanded_queries,
    "reranked": reranked,
    "coverage_order": coverage_order,
    "citations": citations,
    "unit_support": unit_support,
    "macro_averages": macro_averages,
}

_P = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_LINES = "SELECT l_orderkey AS query_id, CAST(l_linenumber AS BIGINT) AS candidate_id, min(l_quantity) AS l_quantity, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2"
SQL = {
    "query_terms": retrieval.QUERY_TERMS,
    "question_parts": f"""WITH q AS (SELECT conv_id * 100 + turn AS query_id, replace(text, '.', ';') AS text FROM conversations WHERE role = 'user'),
s AS (SELECT query_id, {_P.format('text')} AS whole, list_filter(list_transform(regexp_split_to_array(text, '(?:以及|同时(?:还)?|另外|此外|[；;]|\\band also\\b)'), lambda x: regexp_replace(x, '^[ ,，。；;？?]+|[ ,，。；;？?]+$', '', 'g')), lambda x: x <> '') AS raw FROM q),
f AS (SELECT query_id, list_filter(raw, lambda x: length(x) BETWEEN 2 AND 256 AND {_P.format('x')} <> whole) AS fits FROM s WHERE len(raw) > 1),
n AS (SELECT query_id, fits, list_transform(fits, lambda x: {_P.format('x')}) AS norm FROM f),
k AS (SELECT query_id, list_filter(fits, lambda x, i: list_position(norm, norm[i]) = i)[1:4] AS parts FROM n)
SELECT query_id, unnest(range(len(parts))) AS part_no, unnest(parts) AS part FROM k""",
    "expanded_queries": f"""WITH a AS (SELECT n_nationkey AS point, n_name AS label, 0 AS place FROM nation UNION ALL SELECT n_nationkey, 'the land of ' || lower(n_name), 1 FROM nation),
q AS (SELECT n_nationkey AS query_id, ' ' || lower(n_name) || ' ' AS text FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region),
k AS (SELECT {_P.format('label')} AS key, min(point) AS point FROM a GROUP BY 1),
o AS (SELECT q.*, k.point FROM q LEFT JOIN k ON k.key = {_P.format('text')}),
r AS (SELECT query_id, -1 AS place, trim(text) AS text FROM o UNION ALL SELECT query_id, place, label FROM o JOIN a USING (point)),
f AS (SELECT query_id, {_P.format('text')} AS key, min(struct_pack(p := place, t := text)) AS x FROM r WHERE length(text) BETWEEN 1 AND 512 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY x.p, x.t) AS variant, x.t AS text FROM f QUALIFY variant <= 4""",
    "reranked": f"""WITH l AS ({_LINES}), j AS (SELECT query_id, candidate_id, CASE WHEN l_quantity > 4 THEN CAST(l_quantity / 50 AS DOUBLE) END AS score FROM l),
w AS (SELECT query_id, candidate_id, bool_and(score IS NOT NULL) OVER (PARTITION BY query_id) AS whole, score FROM j),
k AS (SELECT query_id, candidate_id, CASE WHEN whole THEN score END AS score FROM w WHERE NOT whole OR score >= 0.3)
SELECT query_id, candidate_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, candidate_id) AS place FROM k QUALIFY place <= 3""",
    "coverage_order": f"""WITH l AS ({_LINES}), g AS (SELECT query_id, candidate_id, CASE WHEN l_partkey % 3 = 0 THEN 1.0::DOUBLE / (60 + candidate_id) ELSE 0 END AS g1, CASE WHEN l_suppkey % 2 = 0 THEN 1.0::DOUBLE / (60 + candidate_id % 4) ELSE 0 END AS g2 FROM l),
a AS (SELECT query_id, candidate_id, 0 AS seed FROM g WHERE g1 > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY g1 DESC, candidate_id) = 1),
b AS (SELECT query_id, candidate_id, 1 AS seed FROM g ANTI JOIN a USING (query_id, candidate_id) WHERE g2 > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY g2 DESC, candidate_id) = 1),
s AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY seed NULLS LAST, candidate_id) AS place FROM g LEFT JOIN s USING (query_id, candidate_id)""",
    "citations": f"""WITH l AS ({_LINES}), s AS (SELECT query_id, candidate_id, 0 AS i, l_partkey AS document_id, l_suppkey AS start FROM l UNION ALL SELECT query_id, candidate_id, 1, l_partkey, l_suppkey + 50 FROM l WHERE candidate_id % 2 = 0),
n AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY candidate_id, i) AS number, document_id, start, start + 10 AS finish FROM s)
SELECT query_id, number, document_id, start, finish AS "end", '[' || number || '] ' || document_id || ':' || start || '-' || finish AS label FROM n""",
    "unit_support": """WITH l AS (SELECT l_orderkey AS query_id, l_linenumber AS c, min(l_partkey) AS part, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2),
r AS (SELECT query_id, part % 3 AS unit, flag <> 'R' AS rec, flag <> 'R' AND status <> 'O' AS del FROM l),
u AS (SELECT query_id, unit, bool_or(rec) AS rec, bool_or(del) AS del FROM r GROUP BY 1, 2)
SELECT query_id, count(*) AS units, count(*) FILTER (WHERE rec) AS recalled, count(*) FILTER (WHERE del) AS delivered, bool_and(del) AS complete, CASE WHEN NOT bool_and(rec) THEN 'recall' WHEN NOT bool_and(del) THEN 'delivery' ELSE 'none' END AS lost_at FROM u GROUP BY query_id""",
    "macro_averages": "SELECT count(*) AS queries, " + ", ".join(f"round(avg({n}), 6) AS {n}, round(avg({n}) FILTER (WHERE hit), 6) AS hit_{n}" for n in ("reciprocal_rank", "recall", "ndcg")) + f" FROM ({retrieval.SQL['retrieval_metrics']})",
}
