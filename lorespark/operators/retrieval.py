"""Recall, fusion and evaluation for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import MOST, mapped
from ..functions.common import lower_plain, ratio
from .planning import with_terms


#: Numbers over which blocks of vectors are spread; each block of queries is sent so many times at most.
SPREAD = 256
#: Queries whose products with a block of vectors are held at once.
ROWS = 128


def _packed(vectors: DataFrame, id_col: str, vector_col: str, rows: int) -> DataFrame:
    """(ids, matrix, dims): blocks of at most so many vectors as binary, normal rows only."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                pairs = [(i, v) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if i is not None and v]
                for dims in sorted({len(v) for _, v in pairs}):
                    same = [(i, v) for i, v in pairs if len(v) == dims]
                    ids, matrix = np.array([i for i, _ in same], np.int64), np.array([v for _, v in same], np.float64)
                    norms = np.linalg.norm(matrix, axis=1)
                    good = np.isfinite(norms) & (norms > 0)
                    unit = matrix[good] / norms[good, None]
                    if len(unit):
                        yield pa.RecordBatch.from_pydict({"ids": pa.array([ids[good].tobytes()], pa.binary()), "matrix": pa.array([unit.tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32())})

    return mapped(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")), pack, "ids binary, matrix binary, dims int", MOST)


def vector_recall(queries: DataFrame, vectors: DataFrame, pool: int = 30, least: float | None = 0.3, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, candidate_id, similarity, rank): the pool most similar vectors of each query, then those of at least `least`.

    Exact: blocks of queries meet blocks of vectors, each pair of blocks is one matrix product and passes on the
    pool best of each query only. Vectors that are null, empty, zero or not finite take no part.
    """
    left, right = _packed(queries, id_col, vector_col, block), _packed(vectors, id_col, vector_col, block)
    right = right.select(F.col("ids").alias("r_ids"), F.col("matrix").alias("r"), F.col("dims").alias("r_dims"), (F.monotonically_increasing_id() % SPREAD).alias("at"))
    # Each block of queries goes to every number, a block of vectors to one, so that pairs of blocks are spread over tasks.
    left = left.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    pairs = right.join(left, (F.col("dims") == F.col("r_dims")) & (F.col("at") == F.col("to")))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["r_ids", "r", "ids", "matrix", "dims"]).to_pylist():
                r_ids, ids = np.frombuffer(row["r_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                left, right = np.frombuffer(row["matrix"]).reshape(-1, row["dims"]), np.frombuffer(row["r"]).reshape(-1, row["dims"]).T
                k = min(pool, len(r_ids))
                for at in range(0, len(ids), ROWS):
                    # Rounded, so that the order does not depend on the blocks; equal values go by id.
                    near = np.round(left[at : at + ROWS] @ right, 9)
                    best = np.lexsort((np.broadcast_to(r_ids, near.shape), -near), axis=1)[:, :k]
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids[at : at + ROWS], k), "candidate_id": r_ids[best].ravel(), "similarity": np.take_along_axis(near, best, 1).ravel()})

    found = mapped(pairs, multiply, "query_id long, candidate_id long, similarity double")
    return ranked(found, "similarity", pool).filter(F.col("similarity") >= least) if least is not None else ranked(found, "similarity", pool)


def ranked(candidates: DataFrame, score: str, pool: int) -> DataFrame:
    """The pool best of each query with their rank; equal scores go by id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "candidate_id"))
    return candidates.withColumn("rank", place).filter(F.col("rank") <= pool)


#: Bytes of terms that go to the tasks at once, and matches of texts and queries that a task holds.
BLOCK_BYTES, HELD = 1 << 23, 1 << 18


def terms_of(queries: DataFrame, most: int = 16, whole: bool = False) -> DataFrame:
    """(query_id, term) for queries of (query_id, text), in lower case with single spaces; the whole text as its only term if whole."""
    rows = queries.select(F.col("query_id").cast("long"), lower_plain(F.col("text")).alias("plain"))
    terms = F.array("plain") if whole else F.col("terms")
    rows = rows if whole else with_terms(rows, "plain", most)
    return rows.select("query_id", F.explode(terms).alias("term")).filter("term <> ''")


def term_hits(docs: DataFrame, terms: DataFrame, text: Column) -> DataFrame:
    """(doc_id, term): which of the terms a form of each text contains.

    terms has a column term; its distinct values are parted by hash into blocks of about BLOCK_BYTES, as many as their
    measured size asks for, and each block is searched in one pass. No block of more than that comes to the driver.
    """
    distinct = terms.select("term").filter("term <> ''").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    blocks, out = max(1, -(-size // BLOCK_BYTES)), None
    for number in range(blocks):
        part = distinct.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == number) if blocks > 1 else distinct
        block = docs.sparkSession.sparkContext.broadcast([r[0] for r in part.toLocalIterator()])

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for term in block.value:
                automaton.add_word(term, term)
            automaton.make_automaton()
            for batch in batches:
                rows = [(i, t) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in ({t for _, t in automaton.iter(x)} if block.value else ())]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "term"])

        hits = mapped(docs.select(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")).alias("form")), search, "doc_id long, term string")
        out = hits if out is None else out.unionByName(hits)
    return out


def keyword_recall(queries: DataFrame, docs: DataFrame, pool: int = 30) -> DataFrame:
    """(query_id, candidate_id, matched, rank, score): documents of (doc_id, text) by the number of a query's terms that their text
    in lower case contains; score is 1 / rank.

    Queries are parted by hash into blocks of about BLOCK_BYTES of terms, each searched in one pass. A text's matches are
    counted where it is searched, and of a task's texts only the pool best of a query go on; it holds those and HELD more matches.
    """
    lists = terms_of(queries).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    size = lists.agg(F.sum(F.aggregate("terms", F.lit(64).cast("long"), lambda n, t: n + F.octet_length(t) + 64))).first()[0] or 0
    blocks, out, ids = max(1, -(-size // BLOCK_BYTES)), None, docs.schema["doc_id"].dataType
    for number in range(blocks):
        part = lists.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else lists
        block = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            of: dict[str, list[int]] = {}
            for i, (_, terms) in enumerate(block.value):
                for term in terms:
                    of.setdefault(term, []).append(i)
            automaton = ahocorasick.Automaton()
            for term, having in of.items():
                automaton.add_word(term, (term, np.array(having)))
            automaton.make_automaton()
            numbers = np.array([q for q, _ in block.value], np.int64)
            best, which, counts, met_ids, held = None, [], [], [], 0

            def pruned():
                """The pool best of each query in what is held and what was best before: ids, places in them, queries, counts."""
                told = pa.concat_arrays([*([best[0]] if best else []), *met_ids])
                at = len(best[0]) if best else 0
                row = np.concatenate([*([best[1]] if best else []), *(np.full(len(q), at + i) for i, q in enumerate(which))])
                q = np.concatenate([*([best[2]] if best else []), *which])
                n = np.concatenate([*([best[3]] if best else []), *counts])
                by_id = np.empty(len(told), np.int64)
                by_id[pa.compute.array_sort_indices(told).to_numpy()] = np.arange(len(told))
                order = np.lexsort((by_id[row], -n, q))
                row, q, n = row[order], q[order], n[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                kept = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < pool
                used, row = np.unique(row[kept], return_inverse=True)
                return told.take(pa.array(used)), row, q[kept], n[kept]

            for batch in batches if of else ():
                for row, text in enumerate(batch.column(1)):
                    met = dict(found for _, found in automaton.iter(text.as_py()))
                    if not met:
                        continue
                    q, n = np.unique(np.concatenate(list(met.values())), return_counts=True)
                    met_ids.append(batch.column(0).take(pa.array([row])))
                    which.append(q)
                    counts.append(n)
                    held += len(q)
                    if held > HELD:
                        best, which, counts, met_ids, held = pruned(), [], [], [], 0
            if which:
                best = pruned()
            if best:
                for at in range(0, len(best[1]), HELD):
                    row, q, n = (x[at : at + HELD] for x in best[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), best[0].take(pa.array(row)), pa.array(n)], ["query_id", "candidate_id", "matched"])

        found = mapped(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("form")), search, f"query_id long, candidate_id {ids.simpleString()}, matched long")
        out = found if out is None else out.unionByName(found)
    return ranked(out, "matched", pool).withColumn("score", 1.0 / F.col("rank"))


def fused(lanes: DataFrame, pool: int = 30, k: int = 60) -> DataFrame:
    """(query_id, candidate_id, rrf, ranks, rank) from lanes of (query_id, lane, position, candidate_id).

    A candidate's rank in a lane is the place of its first mention; repeats keep their places. rrf is the sum of
    1 / (k + rank) over lanes.
    """
    places = lanes.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "lane").orderBy("position")))
    best = places.groupBy("query_id", "candidate_id", "lane").agg(F.min("place").alias("place"))
    scored = best.groupBy("query_id", "candidate_id").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("rrf"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lane", "place")))).alias("ranks"))
    return ranked(scored, "rrf", pool)


def retrieval_metrics(results: DataFrame, relevant: DataFrame, top_k: int = 5) -> DataFrame:
    """Per query: hit, reciprocal rank, recall and nDCG at top_k.

    results: (query_id, candidate_id, rank); relevant: (query_id, candidate_id, grade). Gains are 2 ** grade - 1, each
    unit counts once, the ideal order is cut at top_k too.
    """
    first = results.filter(F.col("rank") <= top_k).groupBy("query_id", "candidate_id").agg(F.min("rank").alias("rank"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    discount = lambda rank: F.log2(rank + 1.0)
    got = first.join(relevant, ["query_id", "candidate_id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("best"), F.sum(gain / discount(F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "candidate_id"))
    ideal = relevant.withColumn("place", place).groupBy("query_id").agg(F.count("*").alias("units"), F.sum(F.when(F.col("place") <= top_k, gain / discount(F.col("place")))).alias("ideal"))
    rows = ideal.join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select("query_id", F.col("best").isNotNull().alias("hit"), zero(1.0 / F.col("best")).alias("reciprocal_rank"), zero(ratio(F.col("found"), F.col("units"))).alias("recall"), zero(F.least(F.lit(1.0), F.try_divide("dcg", "ideal"))).alias("ndcg"))


def hash_embeddings(docs: DataFrame, dims: int = 64) -> DataFrame:
    """(doc_id, dim, value): words and single Chinese characters hashed to dims - 1 places, a small constant at place 0, length 1."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z0-9]+|[\x{3400}-\x{9fff}]"), F.lit(0))
    place = (F.conv(F.substring(F.sha2("word", 256), 1, 8), 16, 10).cast("long") % (dims - 1) + 1).cast("int")
    counts = docs.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", place.alias("dim")).agg(F.count("*").cast("double").alias("value"))
    raw = counts.unionByName(docs.select("doc_id", F.lit(0).alias("dim"), F.lit(0.01).alias("value")))
    return raw.withColumn("value", F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id"))))


def corpus_fingerprint(rows: DataFrame, *keys: str) -> DataFrame:
    """Per group of keys the number of rows and a digest of them that does not depend on their order: the sums of both
    halves of the rows' hashes, hashed, so that rows that repeat count as often as they stand."""
    row = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))
    part = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("rows"), part(1).alias("a"), part(17).alias("b"))
    return sums.select(*keys, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("fingerprint"))
