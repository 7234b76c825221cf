"""Queries of recall, fusion and evaluation. Query vectors are those whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import lower_plain
from ..operators import retrieval as op
from .projections import table

TOP = 5


def _recall(spark, sf_dir, least=0.3, pool=30):
    vectors = table(spark, sf_dir, "embeddings")
    return op.vector_recall(vectors.filter("vec_id % 100 = 0"), vectors, pool, least)


def vector_recall(spark, sf_dir):
    return _recall(spark, sf_dir).select("query_id", "candidate_id", F.round("similarity", 6).alias("similarity"), "rank")


def keyword_recall(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return op.keyword_recall(queries, table(spark, sf_dir, "documents"), 10)


def fused_recall(spark, sf_dir):
    """Two lanes: the most similar vectors, and of them those of the query's own label by id."""
    near = _recall(spark, sf_dir, None).select("query_id", F.lit("vector").alias("lane"), F.col("rank").alias("position"), "candidate_id")
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    of = near.join(labels.toDF("candidate_id", "label"), "candidate_id").join(labels.toDF("query_id", "own"), "query_id").filter("label = own")
    lanes = near.unionByName(of.select("query_id", F.lit("label").alias("lane"), F.col("candidate_id").alias("position"), "candidate_id"))
    return op.fused(lanes).select("query_id", "candidate_id", "rrf", "rank")


def metrics(spark, sf_dir):
    """Vectors of the query's label are relevant."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    queries = labels.filter("vec_id % 100 = 0").toDF("query_id", "label")
    relevant = queries.join(labels, "label").select("query_id", F.col("vec_id").alias("candidate_id"), F.lit(1).alias("grade"))
    return op.retrieval_metrics(_recall(spark, sf_dir, None, TOP), relevant, TOP)


def hash_embeddings(spark, sf_dir):
    return op.hash_embeddings(table(spark, sf_dir, "documents")).withColumn("value", F.round("value", 6))


def leaked_documents(spark, sf_dir):
    """Documents that contain the text of a benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    whole = op.terms_of(items, whole=True).withColumnRenamed("query_id", "item_id")
    return op.term_hits(table(spark, sf_dir, "documents"), whole, lower_plain(F.col("text"))).join(whole, "term").select("doc_id", "item_id").distinct()


QUERIES = {
    "vector_recall": vector_recall,
    "keyword_recall": keyword_recall,
    "fused_recall": fused_recall,
    "retrieval_metrics": metrics,
    "hash_embeddings": hash_embeddings,
    "leaked_documents": leaked_documents,
    "corpus_fingerprint": lambda s, d: op.corpus_fingerprint(table(s, d, "documents"), "source"),
}


def _near(pool: int, least: str) -> str:
    return f"""WITH p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS candidate_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS similarity
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM p QUALIFY rank <= {pool}),
near AS (SELECT * FROM n WHERE {least})
"""


_P = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_EVEN = lambda v, n: f"CASE WHEN len({v}) <= {n} THEN {v} WHEN {n} <= 0 THEN [] WHEN {n} = 1 THEN [{v}[len({v}) // 2 + 1]] ELSE list_transform(range({n}), lambda k: {v}[k * (len({v}) - 1) // ({n} - 1) + 1]) END"
_HAN = "[\\x{3400}-\\x{9fff}]"
QUERY_TERMS = f"""WITH q AS (SELECT item_id AS query_id, {_P.format("coalesce(text, '')")} AS p FROM benchmark),
b AS (SELECT query_id, p, list_concat([p], regexp_extract_all(p, '[a-z0-9]+(?:[-\'\'][a-z0-9]+)*|{_HAN}+|[-+][a-z]+')) AS x, regexp_extract_all(p, '{_HAN}+') AS runs FROM q),
u AS (SELECT query_id, p, list_filter(x, lambda v, i: list_position(x, v) = i) AS base, flatten(list_transform(runs, lambda r: list_transform(range(1, len(r)), lambda i: substr(r, i, 2)))) AS y FROM b),
r AS (SELECT *, list_filter(y, lambda v, i: list_position(y, v) = i AND NOT list_contains(base, v)) AS pairs, 16 - len(base) AS room FROM u)
SELECT query_id, CASE WHEN p = '' THEN '' WHEN room <= 0 THEN array_to_string({_EVEN('base', '16')}, '|') ELSE array_to_string(list_concat(base, {_EVEN('pairs', 'room')}), '|') END AS terms FROM r"""
_PLAIN = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
SQL = {
    "vector_recall": _near(30, "similarity >= 0.3") + "SELECT query_id, candidate_id, round(similarity, 6) AS similarity, rank FROM near",
    "fused_recall": _near(30, "TRUE") + """, l AS (SELECT near.query_id, near.candidate_id, row_number() OVER (PARTITION BY near.query_id ORDER BY near.candidate_id) AS place
  FROM near JOIN embeddings c ON c.vec_id = near.candidate_id JOIN embeddings q ON q.vec_id = near.query_id AND q.label = c.label),
a AS (SELECT query_id, candidate_id, rank AS place FROM near UNION ALL SELECT query_id, candidate_id, place FROM l),
s AS (SELECT query_id, candidate_id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS rrf FROM a GROUP BY 1, 2)
SELECT query_id, candidate_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, candidate_id) AS rank FROM s QUALIFY rank <= 30""",
    "retrieval_metrics": _near(TOP, "TRUE") + f""", r AS (SELECT q.vec_id AS query_id, v.vec_id AS candidate_id, count(*) OVER (PARTITION BY q.vec_id) AS units FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0),
i AS (SELECT query_id, any_value(units) AS units, (SELECT sum(1 / log2(x + 1)) FROM range(1, {TOP} + 1) t(x) WHERE x <= any_value(units)) AS ideal FROM r GROUP BY query_id),
g AS (SELECT query_id, count(*) AS found, min(rank) AS best, sum(1 / log2(rank + 1)) AS dcg FROM near JOIN r USING (query_id, candidate_id) GROUP BY query_id)
SELECT query_id, best IS NOT NULL AS hit, round(coalesce(1.0::DOUBLE / best, 0), 6) AS reciprocal_rank, round(coalesce(found::DOUBLE / units, 0), 6) AS recall, round(coalesce(least(1, dcg / ideal), 0), 6) AS ndcg
FROM i LEFT JOIN g USING (query_id)""",
    "hash_embeddings": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\\x{3400}-\\x{9fff}]')) AS w FROM documents),
c AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 63 + 1 AS INTEGER) AS dim, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY 1, 2),
a AS (SELECT * FROM c UNION ALL SELECT doc_id, 0, 0.01 FROM documents)
SELECT doc_id, dim, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM a""",
    "keyword_recall": """WITH t AS (SELECT query_id, unnest(string_split(terms, '|')) AS term FROM (TERMS)),
m AS (SELECT query_id, doc_id AS candidate_id, count(*) AS matched FROM documents JOIN t ON contains(lower(text), term) WHERE term <> '' GROUP BY 1, 2)
SELECT query_id, candidate_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, candidate_id) AS rank, 1.0::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, candidate_id) AS score FROM m QUALIFY rank <= 10""".replace("TERMS", QUERY_TERMS),
    "leaked_documents": "SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b WHERE contains(" + _PLAIN.format("d.text") + ", " + _PLAIN.format("b.text") + ")",
    "corpus_fingerprint": """WITH h AS (SELECT source, md5(CAST(doc_id AS VARCHAR) || '|' || coalesce(text, '')) AS m FROM documents)
SELECT source, count(*) AS rows, sha256(count(*) || '|' || sum(CAST('0x' || substr(m, 1, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substr(m, 17, 15) AS BIGINT))) AS fingerprint FROM h GROUP BY source""",
}
