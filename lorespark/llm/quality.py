"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fresh, returned, small_batches, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
BULLETS = {f"{mark}{space}" for mark in "-*+•" for space in " \t"}
WINDOW = 5


class Text:
    """One text; each property is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white spaces only

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that stand in a window of five words which the text has twice or more."""
        words = self.words
        if len(words) <= WINDOW:
            return 0
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        if len(ids) == len(words):
            return 0
        n, base = len(words) - WINDOW + 1, len(ids)
        key, top = a[:n], base
        for i in range(1, WINDOW):
            if top > (1 << 62) // base:  # keep the keys exact: number them anew
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                top = int(key.max()) + 1
            key, top = key * base + a[i : n + i], top * base
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        if not same.any():
            return 0
        again = np.zeros(n, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for i in range(WINDOW):
            covered[i : n + i] |= again
        return int(covered.sum())

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before them."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_digits(self) -> int:
        return sum(map(self.text.count, "0123456789"))

    @cached_property
    def n_bullets(self) -> int:
        """Lines that begin with a bullet and white space."""
        return sum(x.lstrip(SPACES)[:2] in BULLETS for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        """Lines that break off."""
        return sum(x.rstrip(SPACES).endswith(("...", "…")) for x in self.lines)

    @cached_property
    def capitals(self) -> int:
        return sum(w.isupper() and len(w) > 1 for w in self.words)


#: Each rule rejects a text for which it holds. The first two are the base; the others leave texts of few words to them.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: len(t.words) < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * len(t.words),
    "symbols": lambda t: 10 * t.n_symbols > 3 * len(t.words),
    "stutter": lambda t: 5 * t.n_stutters > len(t.words),
    "capitals": lambda t: 2 * t.capitals > len(t.words),
    "word_length": lambda t: not 2 * len(t.words) <= t.word_chars <= 100 * len(t.words),
    "repeated_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "digits": lambda t: 2 * t.n_digits > t.word_chars,
    "bullets": lambda t: len(t.lines) > 2 and 10 * t.n_bullets > 9 * len(t.lines),
    "ellipses": lambda t: len(t.lines) > 2 and 10 * t.n_ellipses > 3 * len(t.lines),
}
BASE = ("few_words", "repeated_words")
SAMPLE_ROWS, SAMPLE_PARTS = 512, 64


def sampled_texts(docs: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """At most so many texts, the first ones of some partitions that are spread evenly over all; the other tasks read nothing."""
    parts = docs.rdd.getNumPartitions()
    step = max(1, -(-parts // SAMPLE_PARTS))
    each = max(1, rows // max(1, -(-parts // step)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = each if TaskContext.get().partitionId() % step == 0 else 0
        while left > 0 and (batch := next(batches, None)) is not None:
            yield batch.slice(0, left)
            left -= batch.num_rows

    return [r[0] for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(first, "text string").collect()]


def cascade_order(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[Text], bool]] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names by rejections per second, best first, as measured on a sample of bounded size from all over docs.

    Each place goes to the rule that rejects most per second of what the rules before it leave; what those have
    computed of a text already, such as its words, costs it nothing. The sample serves speed alone, as every order
    gives the same verdicts.
    """
    rules = dict(rules or RULES)
    texts, order = [Text(x) for x in sampled_texts(docs, text_col, sample_rows)], []
    while rules:
        best, best_score, best_left = None, -1.0, texts
        for name, rule in rules.items():
            tried = [copy.copy(t) for t in texts]
            began = time.perf_counter()
            verdicts = [rule(t) for t in tried]
            score = (sum(verdicts) + 0.5) / (time.perf_counter() - began + 1e-6)
            if score > best_score:
                best, best_score, best_left = name, score, [t for t, rejected in zip(tried, verdicts, strict=True) if not rejected]
        order.append(best)
        del rules[best]
        texts = best_left
    return order


def _first_failure(t: Text, order: list[str], rules: dict[str, Callable[[Text], bool]]) -> str | None:
    return next((name for name in order if rules[name](t)), None)


def quality_verdicts(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[Text], bool]] | None = None) -> DataFrame:
    """docs with rejected_by: the rule at which the cascade stopped, null for rows that it keeps.

    Each text meets the rules in the order of cascade_order() and none after the first that rejects it.
    Which of several rejecting rules is named depends on that order; whether one is named does not. Null and
    empty texts have no words and are rejected. An empty table gives no rows.
    """
    rules = rules or RULES
    order = cascade_order(docs, text_col, rules)
    name, at = fresh(docs, "rejected_by")[0], docs.columns.index(text_col)
    schema = extended(docs, name, "string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = pa.array([_first_failure(Text(x), order, rules) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, verdicts], [*batch.schema.names, name])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(returned(judge), schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """The base counts of each text and whether the cascade keeps it; docs has doc_id and text."""
    order = cascade_order(docs)
    small_batches(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                t = Text(text)
                failure = _first_failure(t, order, RULES)
                base = failure in BASE or failure is not None and any(RULES[name](t) for name in BASE)
                rows.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base, failure is None))
            counts = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(counts, kinds, strict=True)]], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return docs.select("doc_id", "text").mapInArrow(returned(report), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def of_good_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the cascade keeps, in docs' columns."""
    judged = quality_verdicts(docs)
    return judged.filter(F.col(judged.columns[-1]).isNull()).drop(judged.columns[-1])


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
g AS (
  SELECT doc_id, i, word, lead(word) OVER p AS next, CASE WHEN lead(i, 4) OVER p IS NOT NULL
         THEN concat_ws(' ', word, lead(word) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) END AS gram
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
s AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(covered) AS n_repeat_words,
         sum(CASE WHEN word = next THEN 1 ELSE 0 END) AS n_stutters,
         sum(CASE WHEN strlen(word) > 1 AND regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]') THEN 1 ELSE 0 END) AS capitals
  FROM c GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(CASE WHEN regexp_matches(line, '^[\\x20\\x09-\\x0D]*[-*+•][\\x20\\x09]') THEN 1 ELSE 0 END) AS n_bullets,
         sum(CASE WHEN regexp_matches(line, '(?:\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END) AS n_ellipses
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, length(text) - length(translate(text, '0123456789', '')) AS n_digits,
         coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(capitals, 0) AS capitals, coalesce(n_stutters, 0) AS n_stutters
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 5 * n_stutters > n_words OR 2 * capitals > n_words OR NOT word_chars BETWEEN 2 * n_words AND 100 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * n_digits > word_chars OR n_lines > 2 AND (10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines)) AS kept
FROM b
"""
