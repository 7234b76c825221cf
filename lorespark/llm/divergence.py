"""Source divergence audit: term shares of sources against each other and their language, priced by a sparse merge per pair."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, dropped, placed, returned, table, written, written_and_seen
from .words import lowered, pieces

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_EDGE = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Terms that a task counts before it hands them on.
HELD = 200_000
#: Term ids of one array: a group's terms are as many arrays as its language has blocks of ids.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Audit:
    """Terms in at least least_docs documents of a language count; a share is smoothed by so many, in units of 1 / scale."""

    least_docs: int = 30
    smooth: int = 5
    scale: int = 1_000_000_000
    top: int = 50


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often each group has the term, in how many documents; term null stands for the
    group itself, with its documents. Null text, lang and source are ''. Tasks hand on partial sums of HELD terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        whole: Counter = Counter()

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, found) in sums.items():
                terms = list(n)
                for i in range(0, len(terms), 16_384):
                    part = terms[i : i + 16_384]
                    sizes = pa.array([n[t] for t in part], pa.int64()), pa.array([found[t] for t in part], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), *sizes], names)
            sums.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                n, found = sums[lang, source]
                whole[lang, source] += 1
                seen: set[bytes] = set()
                for piece in pieces(lowered(text.as_py()), _EDGE):
                    terms = _TERM.findall(piece)
                    n.update(terms)
                    seen.update(terms)
                found.update(seen)
            if sum(len(n) for n, _ in sums.values()) > HELD:
                yield from handed_on()
        yield from handed_on()
        if whole:
            langs, sources = zip(*whole, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.nulls(len(langs), pa.string()), pa.array([0] * len(langs), pa.int64()), pa.array(list(whole.values()), pa.int64())], names)

    names = ["lang", "source", "term", "n", "docs"]
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    partial = rows.mapInArrow(returned(count), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column, how: Audit) -> Column:
    """A term's share, 1 + floor(scale * (n + smooth) / (total + smooth * terms)), exact at any size."""
    above = F.lit(how.scale).cast("decimal(18,0)") * (n + how.smooth).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, (total + how.smooth * terms).cast("decimal(20,0)"))


def shares(counts: np.ndarray, total: int, terms: int, how: Audit) -> np.ndarray:
    """_share() of many counts, in three steps of long division that stay below 2 ** 63 for totals below 9 * 10 ** 15."""
    below, rest, out = total + how.smooth * terms, counts + how.smooth, np.zeros(len(counts), np.int64)
    for step in _steps(how.scale):
        out = out * step + rest * step // below
        rest = rest * step % below
    return out + 1


def _steps(scale: int) -> list[int]:
    """Factors of scale, each at most 1,000, or scale itself where it has none."""
    out = []
    while scale > 1000:
        step = next((f for f in range(1000, 1, -1) if scale % f == 0), scale)
        out.append(step)
        scale //= step
    return [*out, scale]


def galloped(small: np.ndarray, large: np.ndarray, stride: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Where two sorted arrays of distinct ids meet: places in small and in large.

    A stride of small at a time: from where the last one ended, steps in large double until they pass its greatest id, and
    only that window is searched. So few ids against many cost little more than the few.
    """
    mine, theirs, at = [], [], 0
    for i in range(0, len(small), stride):
        part, reach = small[i : i + stride], stride
        while at + reach < len(large) and large[at + reach - 1] < part[-1]:
            reach *= 2
        window = large[at : at + reach]
        if not len(window):
            break
        place = np.searchsorted(window, part)
        met = np.flatnonzero(window[np.minimum(place, len(window) - 1)] == part)
        mine.append(met + i)
        theirs.append(place[met] + at)
        at += int(place[-1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(mine), np.concatenate(theirs)) if mine else (none, none)


def _priced(a: dict, b: dict, terms: int, how: Audit) -> int:
    """What the terms of two groups' arrays add to the price that the pair would have if neither had any of them."""
    pa_, pb = shares(a["counts"], a["total"], terms, how), shares(b["counts"], b["total"], terms, how)
    none = np.zeros(1, np.int64)
    a0, b0 = int(shares(none, a["total"], terms, how)[0]), int(shares(none, b["total"], terms, how)[0])
    swap = len(a["ids"]) > len(b["ids"])
    i, j = galloped(b["ids"], a["ids"])[::-1] if swap else galloped(a["ids"], b["ids"])
    only_a, only_b = np.abs(pa_ - b0), np.abs(pb - a0)
    overlap = int(np.abs(pa_[i] - pb[j]).sum())
    one_sided = int(only_a.sum() - only_a[i].sum() + only_b.sum() - only_b[j].sum())
    return overlap + one_sided - (len(pa_) + len(pb) - len(i)) * abs(a0 - b0)


def pair_prices(arrays: DataFrame, groups: DataFrame, how: Audit) -> DataFrame:
    """(lang, source, item, value): the divergence of each two groups of a language, both ways.

    arrays: (lang, source, block, ids, counts), the terms that a group has, sorted by id. groups: (lang, source, total,
    terms). A task holds two arrays of a block at a time, those of one unordered pair; blocks' prices are added up, on top
    of the price of terms that neither group has.
    """
    x, y = (groups.select("lang", F.col("source").alias(n), F.col("total").alias(f"{n}_total"), "terms") for n in "xy")
    pairs = written(x.join(y.drop("terms"), "lang").filter("x < y"), "pairs")

    def merge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right, sides = left.rename_columns(columns), right.rename_columns(columns), []
        row = (left if left.num_rows else right).select(["terms", "x_total", "y_total"]).slice(0, 1).to_pylist()[0]
        for side, total in ((left, row["x_total"]), (right, row["y_total"])):
            flat = {c: (side[c].combine_chunks().flatten().to_numpy() if side.num_rows else np.zeros(0, np.int64)) for c in ("ids", "counts")}
            sides.append(flat | {"total": total})
        return pa.table([pa.array([v], t) for v, t in zip([*(k.as_py() for k in key[:3]), _priced(*sides, row["terms"], how)], (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "x", "y", "more"])

    columns = ["lang", "x", "y", "block", "terms", "x_total", "y_total", "ids", "counts"]
    sides = [pairs.join(arrays.withColumnRenamed("source", n), ["lang", n]).select(*[F.col(c).alias(f"{n}__{c}") for c in columns]) for n in "xy"]
    sides = [side.groupBy(*side.columns[:4]) for side in sides]
    more = sides[0].cogroup(sides[1]).applyInArrow(merge, "lang string, x string, y string, more long").groupBy("lang", "x", "y").agg(F.sum("more").alias("more"))
    zero = F.lit(0).cast("long")
    absent = F.when(F.col("terms") > 0, F.col("terms") * F.abs(_share(zero, F.col("x_total"), F.col("terms"), how) - _share(zero, F.col("y_total"), F.col("terms"), how))).otherwise(0)
    priced = pairs.join(more, ["lang", "x", "y"], "left").select("lang", "x", "y", (absent + F.coalesce("more", F.lit(0))).cast("long").alias("value"))
    return priced.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("at"), "value").select("lang", "at.source", "at.item", "value")


def source_divergence(docs: DataFrame, how: Audit | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: how far the group's shares of its language's kept terms are from
    those of each other source, summed over all of them. Part `term`: by how much a term's share in the group is above that
    in its language, the largest how.top of them. Ranks count from 1 by value, ties by item in UTF-8 order.

    Kept terms get ids by their order; a group has a sorted array of (id, count) for each block of ids. Terms that a
    group lacks are in no array, and their prices follow from totals.

    Null text, lang and source count as ''. Texts without terms make groups without any; a language without kept terms has
    pairs of value 0. Repeated rows count each; long texts are read whole, piece by piece; an empty table gives no rows;
    further columns are dropped, whatever their names.
    """
    how = how or Audit()
    counts = written(term_counts(docs), "counts")
    found = counts.filter("term is not null")
    kept, (n_kept,) = written_and_seen(found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= how.least_docs).drop("docs"), "kept", F.count(F.lit(1)))
    ids = placed(kept, [F.col("lang"), F.col("term")], "id", n_kept or 0)
    held, (n_held,) = written_and_seen(found.drop("docs").join(ids, ["lang", "term"]), "held", F.count(F.lit(1)))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = written(groups, "groups")
    dropped(counts, kept)

    rows = attach(held, groups, ["lang", "source"], "n_terms", n_held or 0)
    above = _share(F.col("n"), F.col("total"), F.col("terms"), how) - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), how)
    best = rows.select("lang", "source", F.col("term").alias("item"), above.cast("long").alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.top)

    pairs_of = F.sort_array(F.collect_list(F.struct("id", "n")))
    arrays = held.withColumn("block", F.expr(f"id div {BLOCK}")).groupBy("lang", "source", "block").agg(pairs_of.alias("held"))
    arrays = written(arrays.select("lang", "source", "block", F.col("held.id").alias("ids"), F.col("held.n").alias("counts")), "arrays")
    pairs = pair_prices(arrays, groups, how).withColumn("rank", F.row_number().over(order))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(out).unionByName(terms.withColumn("part", F.lit("term")).select(out))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT no, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM e GROUP BY lang, term HAVING count(DISTINCT no) >= 30),
size AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(n.total, 0) + 5 * size.v) AS p,
         1 + (1000000000 * (kept.lang_n + 5)) // (size.lang_total + 5 * size.v) AS q
  FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN n USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
o AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT o.lang, o.source, 'pair' AS part, o.item, coalesce(f.value, 0) AS value FROM o LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
