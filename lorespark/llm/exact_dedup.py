"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, attach, fresh, group_map, map_bits, map_place, table, with_flag, written

PREFIX_CHARS = 256
DECISIONS = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def surviving_groups(signed: DataFrame) -> DataFrame:
    """The pairs (length, prefix) that more than one row has, from a row of (length, prefix) for each text.

    Lengths of a single row fall away first, by a map of the others; the rest is grouped by prefix hash too.
    """
    lengths = written(signed.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length"), "lengths")
    bits = map_bits(lengths.count())
    alive = with_flag(signed, map_place(bits, F.col("length")), group_map(lengths, bits, "length"), "__alive").filter("__alive")
    return alive.groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("length", "prefix")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 for each row.

    The first scan gives each row its normalised length and the hash of its first characters; both are narrow.
    Rows whose length nobody shares are settled there, then those whose prefix hash nobody of that length shares. The
    second scan hashes whole texts of the rows whose group survives (of all rows if digest_all), found in a map of the
    groups; a row let through by a bit that groups share is a group of its own then. Rows with equal hashes form a group. Only rows of surviving groups
    are shuffled, and those of the largest groups not even then.

    Null text counts as empty. Of equal texts the smallest id stays, null after all others; of rows that repeat
    that id and text exactly one stays (docs is read more than once and must come in the same order, as files do). Rows with a text of their own have group_size 1. An empty table gives no
    rows. Columns of docs that have one of the four names are replaced.
    """
    docs = docs.drop(*DECISIONS)
    row, live, full, first, size = fresh(docs, "__row", "__live", "__full", "__first", "__size")
    norm = normalised(F.col(text_col))
    length, prefix = F.length(norm), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS))
    signed = written(docs.select(length.alias("length"), prefix.alias("prefix")), "signed")
    groups = written(surviving_groups(signed), "groups")
    bits = map_bits(groups.count())
    rows = with_flag(docs.withColumn(row, F.monotonically_increasing_id()), map_place(bits, length, prefix), group_map(groups, bits, "length", "prefix"), live)
    digest = F.sha2(norm, 256)
    rows = rows.withColumn(full, digest if digest_all else F.when(F.col(live), digest))

    each = rows.filter(F.col(live)).groupBy(full, F.col(id_col).alias("id")).agg(F.count("*").alias("n"), F.min(row).alias("row"))
    groups = each.groupBy(full).agg(F.min(F.struct(F.col("id").isNull(), "id", "n", "row")).alias(first), F.sum("n").alias(size))
    grouped = attach(rows.filter(F.col(live)), groups, [full], size, signed.count())
    stays = F.col(id_col).eqNullSafe(F.col(f"{first}.id")) & ((F.col(f"{first}.n") == 1) | (F.col(row) == F.col(f"{first}.row")))
    columns = [F.col(c) for c in docs.columns]
    shared = grouped.select(*columns, F.col(f"{first}.id").alias("keep_id"), F.col(size).alias("group_size"), stays.alias("kept"), F.col(full).alias("text_sha256"))
    alone = rows.filter(~F.col(live)).select(*columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col(full).alias("text_sha256"))
    return shared.unionByName(alone)


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, in docs' columns."""
    kept = exact_duplicates(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), *[f"c{docs.columns.index(c)}" for c in ("doc_id", "text")]).filter("kept")
    return kept.drop(*DECISIONS).toDF(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs, digest_all=True).drop("text")


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
