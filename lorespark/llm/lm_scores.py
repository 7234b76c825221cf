"""Stupid-backoff scores by joins: n-gram count tables, exploded n-grams of the documents, sums per document."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, UPPER, returned, table, written
from .words import ORDERS, lowered, mixed, word_hashes

ORDER, BACKOFF = 3, 0.4
#: Words, and rows, of documents that are counted together before anything is shuffled: a chunk.
CHUNK_WORDS, CHUNK_ROWS = 1 << 19, 1 << 16
#: Entries (chunk, n-gram) of a bucket, about; buckets are powers of two.
BUCKET = 1 << 20
#: Stands before the first word of a text.
START = np.uint64(0xA0761D6478BD642F)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, compressed: sorted hashes and small numbers get shorter."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: pa.Scalar, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_buffer()), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, n, ids, sizes, words, places): documents in a row, at least CHUNK_WORDS words of them if there are as many,
    as their ids, numbers of words, the 64-bit hashes of the distinct words, and which of those stands where. A document is never parted."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, chunk = ([], [], []), 0, TaskContext.get().partitionId() << 32

        def chunked() -> pa.RecordBatch:
            ids, sizes, words = held
            words, places = np.unique(np.concatenate(words), return_inverse=True)
            blobs = [pa.array([packed(x)], pa.binary()) for x in (np.asarray(sizes, "<i8"), words.astype("<u8"), places.astype("<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(kind)), *blobs], ["chunk", "n", "ids", "sizes", "words", "places"])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(lowered(text))[1]
                held[0].append(ident)
                held[1].append(len(words))
                held[2].append(words)
                n += len(words)
                if len(held[0]) >= CHUNK_ROWS or n >= CHUNK_WORDS:
                    yield chunked()
                    held, n, chunk = ([], [], []), 0, chunk + 1
        if held[0]:
            yield chunked()

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(returned(gather), f"chunk long, n long, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, sizes binary, words binary, places binary")


class Grams:
    """The n-grams of a chunk, START before each text that has words, up to an order.

    tables has for each n the number of times that the n-gram which ends at a place is known, 0 where that was not
    asked. n-grams shorter than the order also end at the last START, once for each text: they are first contexts.
    """

    def __init__(self, chunk: pa.RecordBatch | pa.Table, at: int, order: int, held_out: bool):
        self.sizes = sizes = unpacked(chunk.column("sizes")[at], "<i8")
        words = unpacked(chunk.column("words")[at], "<u8")[unpacked(chunk.column("places")[at], "<u4")]
        self.order, self.held_out, pads = order, held_out, order - 1
        lengths = sizes + pads * (sizes > 0)
        begins = np.cumsum(lengths) - lengths
        within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.at = np.repeat(begins + pads, sizes) + within
        self.doc_at = np.repeat(np.arange(len(sizes)), lengths)
        self.row = np.full(int(lengths.sum()), START)
        self.row[self.at] = words
        self.starts = (begins + pads - 1)[sizes > 0] if pads else np.zeros(0, np.int64)
        self.tables: dict[int, np.ndarray] = {}

    def ends(self, n: int) -> np.ndarray:
        """Places where the n-grams end that are counted: from n = 3 on where both parts of n - 1 words are known."""
        places = self.at
        if n > 2:
            shorter = self.tables[n - 1]
            places = places[(shorter[places] > 0) & (shorter[places - 1] > 0)]
        return places if n == self.order else np.concatenate([self.starts, places])

    def distinct(self, ends: list[np.ndarray], orders: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted keys of the n-grams of some orders, which of them each place has, and how often each stands here."""
        keys = []
        for n, places in zip(orders, ends, strict=True):
            key = np.full(len(places), n, np.uint64)
            for back in range(n - 1, -1, -1):
                key = mixed(key * np.uint64(0x100000001B3) + self.row[places - back], ORDERS[0])
            keys.append(key)
        return np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)

    def learn(self, orders: list[int], others: np.ndarray) -> None:
        """Fills the tables of some orders, given how often their n-grams, in order of keys, stand in other chunks."""
        ends = [self.ends(n) for n in orders]
        keys, which, counts = self.distinct(ends, orders)
        known = (others + counts)[which]
        if self.held_out:
            docs = self.doc_at[np.concatenate(ends)]
            own, again = np.ones(len(which), np.int64), counts[which] > 1
            _, at, n = np.unique(docs[again] * len(keys) + which[again], return_inverse=True, return_counts=True)
            own[again] = n[at]
            known -= own
        begin = 0
        for n, places in zip(orders, ends, strict=True):
            self.tables[n] = np.zeros(len(self.row), np.int64)
            self.tables[n][places] = known[begin : begin + len(places)]
            begin += len(places)


def rounds(order: int) -> list[list[int]]:
    """Orders that are counted together: the two least, then one after another, as longer n-grams are known only if their parts are."""
    return [list(range(1, min(order, 2) + 1)), *[[n] for n in range(3, order + 1)]]


def _parted(grams: Grams, chunk: int, orders: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, chunk, keys, counts): the distinct n-grams of some orders, parted by the first bits of the key."""
    keys, _, counts = grams.distinct([grams.ends(n) for n in orders], orders)
    cuts = [*np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)]
    full = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
    for begin in range(0, len(full), 64):
        some = [(b, slice(cuts[b], cuts[b + 1])) for b in full[begin : begin + 64]]
        columns = ([b for b, _ in some], [chunk] * len(some), [packed(keys[x].astype("<u8")) for _, x in some], [packed(counts[x].astype("<i8")) for _, x in some])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "keys", "counts"])


def _elsewhere(bucket: pa.Table) -> pa.Table:
    """(chunk, bucket, others): for each chunk's n-grams of a bucket, in order, their count in all other chunks."""
    keys = [unpacked(x, "<u8") for x in bucket.column("keys")]
    counts = np.concatenate([unpacked(x, "<i8") for x in bucket.column("counts")])
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, which, counts)
    others = sums[which] - counts
    cuts = np.cumsum([0, *map(len, keys)])
    parts = [packed(others[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"chunk": bucket.column("chunk").combine_chunks(), "bucket": bucket.column("bucket").combine_chunks(), "others": pa.array(parts, pa.binary())})


def _learned(chunk: pa.Table, found: pa.Table, order: int, upto: int, held_out: bool) -> Grams:
    """The n-grams of a chunk with the tables of the first rounds."""
    grams = Grams(chunk, 0, order, held_out)
    number, buckets = found.column("round").to_numpy(), found.column("bucket").to_numpy()
    for i, orders in enumerate(rounds(order)[:upto]):
        own = np.flatnonzero(number == i)
        parts = [unpacked(found.column("others")[int(k)], "<i8") for k in own[np.argsort(buckets[own])]]
        grams.learn(orders, np.concatenate([np.zeros(0, np.int64), *parts]))
    return grams


def _scored(grams: Grams, total: int) -> list[tuple]:
    """(n_words, n_seen, log_score) of each document of a chunk."""
    sizes, order, at, tables = grams.sizes, grams.order, grams.at, grams.tables
    doc = grams.doc_at[at]
    rest = np.maximum(1, total - (sizes if grams.held_out else np.zeros_like(sizes)))[doc]
    score = math.log(BACKOFF) * order - np.log(rest)
    for n in range(1, order + 1):
        count, context = tables[n][at], rest if n == 1 else tables[n - 1][at - 1]
        score = np.where(count > 0, np.log(np.maximum(1, count) / np.maximum(1, context)) + math.log(BACKOFF) * (order - n), score)
    seen = np.bincount(doc, tables[order][at] > 0, len(sizes))
    return list(zip(sizes.tolist(), seen.astype(np.int64).tolist(), np.bincount(doc, score, len(sizes)).tolist(), strict=True))


def backoff_scores(docs: DataFrame, order: int = ORDER, held_out: bool = True) -> DataFrame:
    """(doc_id, n_words, n_seen, log_score, mean_log_score) for documents of (doc_id, text).

    Words are what stands between white space, A-Z in lower case; every word and every n-gram counts, however rare.
    A word scores by the longest n-gram that ends in it and that the corpus has: count(n-gram) / count(its context),
    times BACKOFF for each word less than order in the n-gram; count(word) / N at last, and BACKOFF ** order / N for
    words that the corpus has not. log_score is the sum of the logarithms, n_seen the number of words whose n-gram of
    full order the corpus has. If held_out, the corpus of a document is all other rows: what only it says is unknown.
    Texts start with marks of their own, which count as context.

    Documents are gathered in chunks of bounded size. A chunk's distinct n-grams with their counts, by 64-bit hashes,
    go to buckets by hash: as they are counted in the chunk first, no n-gram has more rows than there are chunks, and
    none is hot. A bucket adds up its part of the count tables, and tells each chunk how often its n-grams stand
    elsewhere. Longer n-grams follow in rounds of their own, without those of which a part is unknown: they are
    unknown too. Joined to all that, a chunk scores its documents. At 10 ** 13 n-grams about one in two million shares
    its hash with another.

    Null and empty texts have no words, log_score 0 and no mean. Repeated rows count as often as they stand and
    get a row each; null ids stay null. An empty table gives no rows. A text is held whole by the task that scores it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = written(_chunks(docs), "chunks", **{"parquet.block.size": 1 << 24})
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, 2 * total / BUCKET))))
    entry, found = "bucket int, chunk long, keys binary, counts binary", None

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                yield from _parted(Grams(batch, i, order, held_out), chunk, rounds(order)[0], bits)

    def later(i: int, orders: list[int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def count(chunk: pa.Table, known: pa.Table) -> pa.Table:
            parts = _parted(_learned(chunk, known, order, i, held_out), chunk.column("chunk")[0].as_py(), orders, bits)
            names = {"bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
            return pa.Table.from_batches(parts, pa.schema(names.items()))

        return count

    for i, orders in enumerate(rounds(order)):
        entries = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(later(i, orders), entry) if i else chunks.mapInArrow(returned(first), entry)
        counted = entries.groupBy("bucket").applyInArrow(_elsewhere, "chunk long, bucket int, others binary")
        counted = written(counted.withColumn("round", F.lit(i)), "counts")
        found = counted if found is None else found.unionByName(counted)

    def score(chunk: pa.Table, known: pa.Table) -> pa.Table:
        rows = _scored(_learned(chunk, known, order, len(rounds(order)), held_out), total)
        n_words, n_seen, log_score = zip(*rows, strict=True)
        return pa.table({"doc_id": chunk.column("ids")[0].values, "n_words": pa.array(n_words, pa.int64()), "n_seen": pa.array(n_seen, pa.int64()), "log_score": pa.array(log_score, pa.float64())})

    scored = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_words long, n_seen long, log_score double")
    return scored.withColumn("mean_log_score", F.try_divide("log_score", "n_words"))


def op5_lm_scores(spark, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
e AS (SELECT row, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
p AS (SELECT row, i, w, coalesce(lag(w) OVER o, ' ') AS v, coalesce(lag(w, 2) OVER o, ' ') AS u FROM e WINDOW o AS (PARTITION BY row ORDER BY i)),
starts AS (SELECT row FROM d WHERE len(words) > 0),
own1 AS (SELECT row, w, count(*) AS n FROM (SELECT row, w FROM p UNION ALL SELECT row, ' ' FROM starts) GROUP BY row, w),
own2 AS (SELECT row, v, w, count(*) AS n FROM (SELECT row, v, w FROM p UNION ALL SELECT row, ' ', ' ' FROM starts) GROUP BY row, v, w),
own3 AS (SELECT row, u, v, w, count(*) AS n FROM p GROUP BY row, u, v, w),
c1 AS (SELECT row, w, sum(n) OVER (PARTITION BY w) - n AS n FROM own1),
c2 AS (SELECT row, v, w, sum(n) OVER (PARTITION BY v, w) - n AS n FROM own2),
c3 AS (SELECT row, u, v, w, sum(n) OVER (PARTITION BY u, v, w) - n AS n FROM own3),
t AS (SELECT d.row, greatest(1, (SELECT count(*) FROM e) - len(words)) AS rest FROM d),
s AS (
  SELECT p.row, count(*) FILTER (WHERE c3.n > 0) AS n_seen,
         sum(ln(CASE WHEN c3.n > 0 THEN c3.n / CAST(c2uv.n AS DOUBLE) WHEN c2.n > 0 THEN {BACKOFF} * c2.n / CAST(c1v.n AS DOUBLE)
                     WHEN c1.n > 0 THEN {BACKOFF} * {BACKOFF} * c1.n / CAST(rest AS DOUBLE) ELSE {BACKOFF} * {BACKOFF} * {BACKOFF} / CAST(rest AS DOUBLE) END)) AS log_score
  FROM p JOIN c3 ON (c3.row, c3.u, c3.v, c3.w) = (p.row, p.u, p.v, p.w) JOIN c2 ON (c2.row, c2.v, c2.w) = (p.row, p.v, p.w) JOIN c1 ON (c1.row, c1.w) = (p.row, p.w)
         JOIN c2 c2uv ON (c2uv.row, c2uv.v, c2uv.w) = (p.row, p.u, p.v) JOIN c1 c1v ON (c1v.row, c1v.w) = (p.row, p.v) JOIN t ON t.row = p.row
  GROUP BY p.row)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen, coalesce(log_score, 0) AS log_score,
       CASE WHEN len(words) > 0 THEN log_score / len(words) END AS mean_log_score
FROM d LEFT JOIN s USING (row)
"""
