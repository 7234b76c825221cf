"""Importance resampling towards a target distribution: array-scored weights, then a distributed quickselect."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import placed, returned, table, written, written_and_seen
from .words import lowered, pieces, runs_of

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_EDGE = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Pivot keys of one round of the quickselect: each round leaves about one row in so many.
PIVOTS = 15


@dataclass(frozen=True)
class Draw:
    """Features are runs of 1 to order words, hashed into buckets; percent of the texts of least_words words are drawn."""

    buckets: int = 10_000
    order: int = 2
    percent: int = 25
    least_words: int = 20
    seed: int = 7


def feature_buckets(text: str | None, how: Draw) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of the text how many words it has, and the buckets of its features, repeats included."""
    held: list[bytes] = []
    for piece in pieces(lowered(text), _EDGE):
        words = _WORD.findall(piece)
        both = held + words
        crc = [zlib.crc32(w) for w in words]
        for width in range(2, how.order + 1):
            # Runs that end in this piece: those of the held words alone came with the piece before.
            crc += [zlib.crc32(run) for run in runs_of(both[max(0, len(held) - width + 1) :], width)]
        held = both[max(0, len(both) - how.order + 1) :]
        yield len(words), np.array(crc, np.int64) % how.buckets


def bucket_counts(docs: DataFrame, how: Draw, text_col: str = "text") -> DataFrame:
    """(bucket, n): the features of all texts by bucket; a task adds up its own in one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(how.buckets, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), how):
                    held.append(found)
                    size += len(found)
                if size > 1 << 20:
                    sums += np.bincount(np.concatenate(held), minlength=how.buckets)
                    held, size = [], 0
            if held:
                sums += np.bincount(np.concatenate(held), minlength=how.buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(returned(count), "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, how: Draw) -> np.ndarray:
    """The gain of each bucket: what a feature in it says for the target, in thousandths of a nat, smoothed by one a bucket.

    It has how.buckets numbers, whatever the input.
    """
    sides = []
    for texts in (docs, target):
        sums = np.zeros(how.buckets, np.float64)
        for row in bucket_counts(texts, how).collect():
            sums[row["bucket"]] = row["n"]
        sides.append(sums)
    s, t = sides
    return np.floor(1000 * np.log((t + 1) * (s.sum() + how.buckets) / ((s + 1) * (t.sum() + how.buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, how: Draw) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row: the floored mean of the gains of its features, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = n = gain = 0
                for k, found in feature_buckets(text.as_py(), how):
                    words, n, gain = words + k, n + len(found), gain + int(shared.value[found].sum())
                rows.append((words, n, gain // n if n else 0))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])

    shared = docs.sparkSession.sparkContext.broadcast(gains)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(returned(weigh), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def _fixed(row: Row, kind: StructType) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def _nulls_first(row: Row) -> list:
    return [(v is not None, 0 if v is None else v) for v in row]


def kth_key(rows: DataFrame, key: str, k: int, seed: int = 0) -> Row:
    """The k-th least value, from 1, of the struct column key of rows, which has at least k rows.

    Each round draws pivots at random from the keys that are still open, counts exactly the open rows between, at and
    beyond them in one aggregation, and goes on between the two that the k-th lies between, or ends at the one that it
    equals. Up to PIVOTS open keys are all pivots, so the last round ends. Only pivots and counts reach the driver.
    """
    kind, before, low, high, turn = rows.schema[key].dataType, 0, None, None, 0
    while True:
        left = rows.select(key)
        if low is not None:
            left = left.filter(F.col(key) > _fixed(low, kind))
        if high is not None:
            left = left.filter(F.col(key) < _fixed(high, kind))
        drawn = left.orderBy(F.xxhash64(F.lit(seed + turn), key), key).limit(PIVOTS).collect()
        pivots = sorted({r[0] for r in drawn}, key=_nulls_first)
        place = sum((F.col(key) > _fixed(p, kind)).cast("int") for p in pivots)
        same = reduce(or_, [F.col(key) == _fixed(p, kind) for p in pivots])
        counts = {(r["place"], r["same"]): r["n"] for r in left.groupBy(place.alias("place"), same.alias("same")).agg(F.count("*").alias("n")).collect()}
        for i in range(len(pivots) + 1):
            inside, at = counts.get((i, False), 0), counts.get((i, True), 0)
            if before + inside >= k:
                low, high = pivots[i - 1] if i else low, pivots[i] if i < len(pivots) else high
                break
            if before + inside + at >= k:
                return pivots[i]
            before += inside + at
        turn += 1


def resampled(docs: DataFrame, target: DataFrame, how: Draw | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs: how much more likely its features are among the texts
    of target, that with Gumbel noise from its doc_id, and its rank among those that are drawn, else null.

    Of the texts of at least how.least_words words, the highest scores are drawn, so many percent, ties to the smaller
    doc_id. A quickselect finds the last of them; only the winners are sorted, by ranges, and ranked.

    Null and empty texts have no features, weight 0 and are not drawn. A null doc_id has the noise of `null` and comes
    last in a tie. Rows that repeat a doc_id and text tie in all; each is drawn or not by itself, and ranks differ.
    Long texts are read whole, piece by piece; without target texts all buckets count as unseen there; an empty table
    gives no rows; further columns are dropped, whatever their names.
    """
    how = how or Draw()
    gains = bucket_gains(docs, target, how)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    key = F.struct((-F.col("score")).alias("loss"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "n_features", F.monotonically_increasing_id().alias("row"))
    scored = weighted(docs, gains, how).withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= how.least_words).withColumn("key", key)
    scored, (fit,) = written_and_seen(scored, "scored", F.count_if("fit"))
    k = how.percent * (fit or 0) // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(scored.filter("fit"), "key", k, how.seed)
    won = F.col("fit") & (F.col("key") <= _fixed(last, scored.schema["key"].dataType))
    ranked = placed(scored.filter(won).select(*out, "key"), ["key"], "place", k)
    return ranked.select(*out, (F.col("place") + 1).alias("rank")).unionByName(scored.filter(~won).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of each feature's bytes by the usual table, which a rule builds.
OP13_SQL = """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) r(i)),
both_sides AS (
  SELECT 0 AS side, row_number() OVER () AS no, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM both_sides),
f AS (
  SELECT side, no, unnest(list_concat(words, list_transform(range(1, greatest(1, len(words))), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
g AS (SELECT side, no, feature, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT DISTINCT feature FROM g),
b AS (
  SELECT feature, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(feature)) + 1), lambda i: CAST(('0x' || substr(hex(encode(feature)), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))),
    lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM d, tab),
h AS (SELECT g.side, g.no, b.bucket, sum(g.n) AS n FROM g JOIN b USING (feature) GROUP BY ALL),
s AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM h GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000)))) AS BIGINT) AS gain FROM s),
weights AS (SELECT no, sum(n) AS n_features, floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS weight FROM h JOIN gain USING (bucket) WHERE side = 0 GROUP BY no),
noise AS (
  SELECT no, doc_id, len(words) AS n_words, (CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM w WHERE side = 0),
scored AS (
  SELECT no, doc_id, n_words >= 20 AS fit, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(u))) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (no)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, n_features, no) AS place, count(*) FILTER (fit) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""
