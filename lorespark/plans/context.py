"""Queries of chunks and of the context that recalled chunks give; SQL cuts and folds by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as op
from ..operators import documents, retrieval
from ..sources.index import ChunkIndex, index_rows
from ..streaming.runs import shared_path
from .projections import dealt, table
from .retrieval import QUERY_TERMS

SIZE, OVERLAP, PARENT, PARENT_FROM = 800, 80, 2400, 2000
LIMITS = op.Limits(top=4, chars=3_000)
POOL = 6


def chunk_table(spark, sf_dir):
    """Leaves and parents of all documents, under the source that they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = documents.chunk_rows(docs, SIZE, OVERLAP, PARENT, PARENT_FROM)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("source", F.lit("")).alias("source_name"), F.col("lang").alias("header"))
    return rows.join(sources, "document_id")


def chunk_rows(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("chunk_id", "document_id", "kind", "parent_id", "prev_id", "next_id", "start", "end", F.md5("content").alias("content"))


def _lines(spark, sf_dir):
    """Spans of the lines of an order, on one of two documents each."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("place"), "l_partkey", "l_suppkey")
    lines = dealt(lines, "query_id").groupBy("query_id", "place").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    start = F.col("part") % 200
    return lines.select("query_id", (F.col("supp") % 2).alias("document_id"), "place", start.alias("start"), (start + F.col("supp") % 60 + 1).alias("end"))


def undelivered(spark, sf_dir):
    return op.undelivered(_lines(spark, sf_dir))


def _turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    nothing = {c: F.lit(None).cast("long") for c in ("document_id", "start", "end")}
    return turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("header"), F.col("role").alias("source_name"), *[v.alias(k) for k, v in nothing.items()])


def assembled(spark, sf_dir):
    """Turns as passages; a query's lanes failed if its last turn says so. What does not fit is cut or left out, later turns follow."""
    turns = table(spark, sf_dir, "conversations")
    queries = turns.groupBy(F.col("conv_id").alias("query_id")).agg((F.max("turn") % 3).alias("failed_lanes"))
    given = op.delivered(_turns(spark, sf_dir).filter("length(content) > 200"), op.Limits(top=3, chars=600))
    return op.contexts(queries, given, required=True).withColumn("context", F.md5("context"))


def context_passages(spark, sf_dir):
    """Chunks that benchmark items' terms recall, what they expand to, and what fits their contexts."""
    chunks = chunk_table(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    leaves = chunks.filter("kind = 'leaf'").select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
    found = retrieval.keyword_recall(items, leaves, POOL).select("query_id", "rank", F.col("candidate_id").alias("chunk_id"))
    given = op.context_passages(found, chunks, LIMITS)
    return given.select("query_id", "place", "chunk_id", "match_id", "role", F.concat_ws(",", "matched").alias("matched"), "start", "end", F.md5("text").alias("text"), "trimmed", "truncated")


def index_replaced(spark, sf_dir):
    """An index of all documents, in which those in German are cut anew into smaller chunks and toxic ones are deleted."""
    index = ChunkIndex(spark, shared_path(spark, "index"))
    index.replace(index_rows(chunk_table(spark, sf_dir).filter("kind = 'leaf'")))
    german = table(spark, sf_dir, "documents").filter("lang = 'de'")
    again = documents.chunk_rows(german.select("doc_id", "text"), SIZE // 2, OVERLAP, PARENT, PARENT_FROM).filter("kind = 'leaf'")
    again = again.join(german.select(F.col("doc_id").alias("document_id"), F.coalesce("source", F.lit("")).alias("source_name"), F.col("lang").alias("header")), "document_id")
    index.replace(index_rows(again), german.select(F.col("doc_id").alias("document_id")))
    index.delete(table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id")))
    index.vacuum()
    return index.read().select("document_id", "chunk_id", "prev_id", "next_id", "start", "end", "content_hash", "embedding_hash", F.md5("search_text").alias("search_text"))


QUERIES = {
    "index_replaced": index_replaced,
    "chunk_rows": chunk_rows,
    "undelivered": undelivered,
    "assembled": assembled,
    "context_passages": context_passages,
}

#: How cut_points() cuts the texts of src(doc_id, text, n, size, back): c(doc_id, chunk, s, e), one step a chunk, from a chunk -1.
#: A chunk ends after the last match of the best boundary in its last half.
_LAST = lambda pattern: f"nullif(length(regexp_extract(w, '(?s)^(?:.*)(?:{pattern})')), 0)"
CUTS = rf"""c AS (
  SELECT doc_id, -1 AS chunk, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS next_s FROM src
  UNION ALL
  SELECT doc_id, chunk + 1, s, e, CASE WHEN e >= n THEN n ELSE e - length(tail) + CASE WHEN strpos(tail, ' ') > 0 THEN strpos(tail, ' ') ELSE length(tail) END END
  FROM (
    SELECT *, substr(text, CAST(greatest(s + 1, e - least(back, (e - s) // 2)) + 1 AS BIGINT), CAST(e - greatest(s + 1, e - least(back, (e - s) // 2)) AS BIGINT)) AS tail
    FROM (
      SELECT *, CASE WHEN s + size >= n THEN n ELSE s + size // 2 + coalesce({_LAST(r'\n\n+')}, {_LAST(r'\n')}, {_LAST(r'[.!?。！？]\s*')}, {_LAST(r'[,;，；]\s*')}, {_LAST(r'\s')}, size - size // 2) END AS e
      FROM (SELECT c.doc_id, chunk, src.text, src.n, src.size, src.back, c.next_s AS s, substr(src.text, CAST(c.next_s + src.size // 2 + 1 AS BIGINT), CAST(src.size - src.size // 2 AS BIGINT)) AS w FROM c JOIN src USING (doc_id) WHERE c.next_s < src.n))))"""
#: Leaves and their parents' numbers p(doc_id, chunk, begin, parent), and both as chunks k.
CHUNKS = rf"""src AS (SELECT doc_id, text, length(text) AS n, {SIZE} AS size, {OVERLAP} AS back FROM documents WHERE regexp_matches(text, '\S')),
{CUTS},
p AS (
  SELECT doc_id, chunk, s, s AS begin, 0 AS parent FROM c WHERE chunk = 0
  UNION ALL
  SELECT c.doc_id, c.chunk, c.s, CASE WHEN c.e - p.begin > {PARENT} THEN c.s ELSE p.begin END, p.parent + CASE WHEN c.e - p.begin > {PARENT} THEN 1 ELSE 0 END
  FROM p JOIN c ON c.doc_id = p.doc_id AND c.chunk = p.chunk + 1),
l AS (
  SELECT c.doc_id, c.chunk, c.s, c.e, substr(src.text, CAST(c.s + 1 AS BIGINT), CAST(c.e - c.s AS BIGINT)) AS content, p.parent, src.n >= {PARENT_FROM} AS grown, c.e >= src.n AS last
  FROM c JOIN src USING (doc_id) JOIN p USING (doc_id, chunk)),
k AS (
  SELECT doc_id || ':' || chunk AS chunk_id, doc_id AS document_id, 'leaf' AS kind, CASE WHEN grown THEN doc_id || ':p' || parent END AS parent_id,
         CASE WHEN chunk > 0 THEN doc_id || ':' || (chunk - 1) END AS prev_id, CASE WHEN NOT last THEN doc_id || ':' || (chunk + 1) END AS next_id, s, e, content FROM l
  UNION ALL
  SELECT g.doc_id || ':p' || parent, g.doc_id, 'parent', NULL, NULL, NULL, g.s, g.e, substr(src.text, CAST(g.s + 1 AS BIGINT), CAST(g.e - g.s AS BIGINT))
  FROM (SELECT doc_id, parent, min(s) AS s, max(e) AS e FROM l WHERE grown GROUP BY 1, 2) g JOIN src USING (doc_id))"""

#: The largest piece of a span s to e that a list of stretches (a, b) leaves, the first of equals; null if none.
_PIECE = """list_max(list_transform(
      list_filter(list_prepend(s, list_transform(seen, lambda i: i.b)), lambda q: q >= s AND q < e AND len(list_filter(seen, lambda i: i.a <= q AND q < i.b)) = 0),
      lambda q: {'n': least(e, coalesce(list_min(list_transform(list_filter(seen, lambda i: i.a > q), lambda i: i.a)), e)) - q, 'a': -q}))"""
SQL = {
    "index_replaced": rf"""WITH RECURSIVE src AS (SELECT doc_id, text, length(text) AS n, CASE WHEN lang = 'de' THEN {SIZE // 2} ELSE {SIZE} END AS size, {OVERLAP} AS back FROM documents WHERE regexp_matches(text, '\S') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
{CUTS},
x AS (SELECT c.*, substr(src.text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS content, CASE WHEN d.lang <> '' THEN d.lang || chr(10) || chr(10) ELSE '' END AS head, e >= n AS last FROM c JOIN src USING (doc_id) JOIN documents d USING (doc_id) WHERE chunk >= 0)
SELECT doc_id AS document_id, doc_id || ':' || chunk AS chunk_id, CASE WHEN chunk > 0 THEN doc_id || ':' || (chunk - 1) END AS prev_id, CASE WHEN NOT last THEN doc_id || ':' || (chunk + 1) END AS next_id, s AS start, e AS "end",
  sha256(content) AS content_hash, sha256(head || content) AS embedding_hash, md5(lower(trim(regexp_replace(head || content, '\s+', ' ', 'g')))) AS search_text FROM x""",
    "chunk_rows": f'WITH RECURSIVE {CHUNKS} SELECT chunk_id, document_id, kind, parent_id, prev_id, next_id, s AS start, e AS "end", md5(content) AS content FROM k',
    "undelivered": f"""WITH RECURSIVE l AS (SELECT l_orderkey AS query_id, l_linenumber AS place, min(l_partkey) % 200 AS s, min(l_partkey) % 200 + min(l_suppkey) % 60 + 1 AS e, min(l_suppkey) % 2 AS document_id FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY place) AS step FROM l),
f AS (
  SELECT DISTINCT query_id, document_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS place, CAST(NULL AS STRUCT(n BIGINT, a BIGINT)) AS piece, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS seen FROM r
  UNION ALL
  SELECT query_id, document_id, step, place, piece, CASE WHEN piece IS NULL THEN seen ELSE list_append(seen, {{'a': -piece.a, 'b': piece.n - piece.a}}) END
  FROM (SELECT r.query_id, r.document_id, r.step, r.place, seen, {_PIECE} AS piece FROM f JOIN r ON r.query_id = f.query_id AND r.document_id = f.document_id AND r.step = f.step + 1))
SELECT query_id, document_id, place, -piece.a AS start, piece.n - piece.a AS "end" FROM f WHERE piece IS NOT NULL""",
    "assembled": """WITH RECURSIVE q AS (SELECT conv_id AS query_id, max(turn) % 3 AS failed FROM conversations GROUP BY 1),
r AS (SELECT conv_id AS query_id, text, '[来源 ' || turn || ': ' || role || ']' || chr(10) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations WHERE length(text) > 200),
f AS (
  SELECT query_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS n, '' AS context FROM q
  UNION ALL
  SELECT query_id, step, n + CASE WHEN takes THEN 1 ELSE 0 END, context || CASE WHEN takes THEN gap || head || substr(text, 1, CAST(room AS BIGINT)) ELSE '' END
  FROM (SELECT *, n < 3 AND (room >= length(text) OR room >= 16) AS takes
        FROM (SELECT r.query_id, r.step, f.n, f.context, r.head, r.text, CASE WHEN n > 0 THEN chr(10) || chr(10) ELSE '' END AS gap, 600 - length(context) - length(head) - CASE WHEN n > 0 THEN 2 ELSE 0 END AS room
              FROM f JOIN r ON r.query_id = f.query_id AND r.step = f.step + 1)))
SELECT query_id, CASE WHEN n > 0 THEN 'hit' WHEN failed > 0 THEN 'degraded' ELSE 'no_match' END AS status, n AS passages, length(context) AS chars, md5(context) AS context, n = 0 AS refused
FROM (SELECT query_id, max_by(n, step) AS n, max_by(context, step) AS context FROM f GROUP BY 1) JOIN q USING (query_id)""",
    # No query has so many candidates that the limit of chunks binds: POOL times three are fewer.
    "context_passages": f"""WITH RECURSIVE {CHUNKS},
terms AS (SELECT query_id, unnest(string_split(terms, '|')) AS term FROM ({QUERY_TERMS})),
m AS (SELECT query_id, chunk_id, count(*) AS matched FROM k JOIN terms ON contains(lower(content), term) WHERE term <> '' AND kind = 'leaf' GROUP BY 1, 2),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, chunk_id) AS rank FROM m QUALIFY rank <= {POOL}),
n AS (SELECT r.*, k.parent_id, k.prev_id, k.next_id FROM r JOIN k USING (chunk_id)),
main AS (SELECT query_id, coalesce(parent_id, chunk_id) AS chunk_id, min(rank) AS rank, arg_min(chunk_id, rank) AS match_id, bool_or(parent_id IS NOT NULL) AS up, string_agg(chunk_id, ',' ORDER BY rank) AS matched FROM n GROUP BY 1, 2),
side AS (
  SELECT query_id, chunk_id, min(rank * 2 + turn) AS rank, arg_min(match_id, rank * 2 + turn) AS match_id
  FROM (SELECT query_id, prev_id AS chunk_id, rank, 0 AS turn, chunk_id AS match_id FROM n WHERE parent_id IS NULL UNION ALL SELECT query_id, next_id, rank, 1, chunk_id FROM n WHERE parent_id IS NULL)
  WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
x AS (
  SELECT query_id, chunk_id, match_id, CASE WHEN up THEN 'parent' ELSE 'matched' END AS role, matched, 0 AS later, rank FROM main
  UNION ALL SELECT query_id, chunk_id, match_id, 'neighbor', match_id, 1, rank FROM side ANTI JOIN main USING (query_id, chunk_id)),
y AS (
  SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY later, x.rank) AS place, k.document_id, k.s, k.e, k.content, coalesce(d.source, '') AS source_name, CASE WHEN d.lang <> '' THEN d.lang || chr(10) || chr(10) ELSE '' END AS header
  FROM x JOIN k USING (chunk_id) JOIN documents d ON d.doc_id = k.document_id),
f AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS STRUCT(d BIGINT, a BIGINT, b BIGINT)[]) AS told, CAST([] AS STRUCT(d BIGINT, a BIGINT, b BIGINT)[]) AS spans, FALSE AS takes, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, CAST(0 AS BIGINT) AS piece_stop FROM y
  UNION ALL
  SELECT query_id, place, n + CASE WHEN takes THEN 1 ELSE 0 END, used + CASE WHEN takes THEN frame + fits ELSE 0 END,
         CASE WHEN takes THEN list_append(told, {{'d': document_id, 'a': start, 'b': start + fits}}) ELSE told END, CASE WHEN takes THEN list_append(spans, {{'d': document_id, 'a': s, 'b': e}}) ELSE spans END, takes, start, start + fits, start + size
  FROM (
    SELECT *, n < {LIMITS.top} AND piece IS NOT NULL AND NOT list_contains(spans, {{'d': document_id, 'a': s, 'b': e}}) AND (fits = size OR fits >= {LIMITS.least}) AND fits >= 0 AS takes
    FROM (
      SELECT *, -piece.a AS start, piece.n AS size, least(piece.n, {LIMITS.chars} - used - frame) AS fits
      FROM (
        SELECT *, {_PIECE} AS piece
        FROM (SELECT y.query_id, y.place, f.n, f.used, f.told, f.spans, y.document_id, y.s, y.e, list_filter(f.told, lambda i: i.d = y.document_id) AS seen,
                     length('[来源 ' || chunk_id || ': ' || source_name || ']') + 1 + length(header) + CASE WHEN f.n > 0 THEN 2 ELSE 0 END AS frame
              FROM f JOIN y ON y.query_id = f.query_id AND y.place = f.place + 1)))))
SELECT y.query_id, y.place, y.chunk_id, y.match_id, y.role, y.matched, f.start, f.stop AS "end", md5(y.header || substr(y.content, CAST(f.start - y.s + 1 AS BIGINT), CAST(f.stop - f.start AS BIGINT))) AS text,
       f.start <> y.s OR f.piece_stop <> y.e AS trimmed, f.stop <> f.piece_stop AS truncated
FROM f JOIN y USING (query_id, place) WHERE takes""",
}
