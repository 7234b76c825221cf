"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, dropped, returned, table, written
from .components import component_roots
from .ngram_join import attach_roots
from .words import lowered, pieces, runs_of

_EDGE = re.compile(rb"[\x20\x09-\x0D]")
SEED = 42


@dataclass(frozen=True)
class Near:
    """Fingerprints of width-word shingles link when they differ in at most bits of 64 bits.

    Cut into blocks, two such fingerprints differ in at most bits of them, so they agree in some choice of the others.
    A choice that more than short fingerprints agree in is cut once more: the bits that it leaves open into finer blocks.
    """

    width: int = 3
    bits: int = 2
    blocks: int = 5
    finer: int = 6
    short: int = 256

    def choices(self) -> list[tuple[int, list[int]]]:
        """For each choice of blocks the mask of their bits, and the masks that fix finer blocks of the open bits too."""
        out = []
        for mask, free in _cut(list(range(64)), self.blocks, self.bits):
            out.append((mask, [mask | more for more, _ in _cut(free, self.finer, self.bits)]))
        return out


def _cut(places: list[int], parts: int, left: int) -> Iterator[tuple[int, list[int]]]:
    """Of places cut into parts, each choice that leaves so many parts out: its mask, and the places that are left out."""
    blocks = [b.tolist() for b in np.array_split(places, parts)]
    for out in combinations(range(parts), left):
        yield sum(1 << p for i, b in enumerate(blocks) if i not in out for p in b), [p for i in out for p in blocks[i]]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is set if it is in over half the XXH64 values of the text's shingles, repeats included.

    A text of fewer words is one shingle; one without words, or null, has fingerprint 0. A long text is read piece by piece.
    """
    held, ones, total = [], np.zeros(64, np.int64), 0
    for piece in pieces(lowered(text), _EDGE):
        held += piece.split()
        if len(held) >= width:
            found = [xxhash.xxh64_intdigest(run, SEED) for run in runs_of(held, width)]
            ones += _ones(found)
            total += len(found)
            held = held[len(held) - width + 1 :]
    if held and not total:
        ones, total = _ones([xxhash.xxh64_intdigest(b" ".join(held), SEED)]), 1
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def _ones(values: list[int]) -> np.ndarray:
    """How many of the values have each bit."""
    return np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def with_fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row: the fingerprint's 64 bits as a long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), width) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(returned(sign), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _near(bits: int) -> Column:
    return F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits


def fingerprint_links(classes: DataFrame, how: Near) -> DataFrame:
    """(x, y): all pairs of different fingerprints of classes (fp, one row each) that link.

    Each choice of blocks is a key. Fingerprints with a key in common are compared, if at most how.short have it; else
    they get a key for each choice of finer blocks instead. Such a key leaves so few bits open, 9 by default, that at
    most 2 ** 9 fingerprints can share it: a group of any size is compared in groups of bounded size, and no link is lost.
    """
    choices = how.choices()
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(_signed(mask)).alias("key")) for i, (mask, _) in enumerate(choices)])
    posted = written(classes.select("fp", F.explode(keys).alias("at")).select("fp", "at.k", "at.key"), "posted")
    lists = posted.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(attach(posted, lists, ["k", "key"], "n", posted.count()).filter("n > 1"), "shared")
    dropped(posted)
    long = shared.filter(F.col("n") > how.short)
    finer = [(i, len(choices) + i * len(masks) + j, mask) for i, (_, masks) in enumerate(choices) for j, mask in enumerate(masks)]
    by_choice = F.array(*[F.array(*[F.struct(F.lit(no).alias("k"), _signed(mask).alias("mask")) for i, no, mask in finer if i == k]) for k in range(len(choices))])
    again = long.select("fp", F.explode(F.get(by_choice, F.col("k"))).alias("at")).select("fp", "at.k", F.col("fp").bitwiseAND(F.col("at.mask")).alias("key"))
    found = []
    for rows in (shared.filter(F.col("n") <= how.short).select("fp", "k", "key"), again):
        a, b = rows.alias("a"), rows.alias("b")
        pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _near(how.bits))
        found.append(pairs.select(F.col("a.fp").alias("x"), F.col("b.fp").alias("y")))
    return found[0].unionByName(found[1]).distinct()


def simhash_components(docs: DataFrame, how: Near | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, class_size, component_size) for each row: the fingerprint in 16 hex digits, the
    least id that links lead to, how many rows have the same fingerprint, and how many are in the component.

    Rows with one fingerprint are one node, so copies are never paired; nodes link as fingerprint_links() says.

    Null and empty texts and those of white space have fingerprint 0 and link like any other. Null ids count only
    where a component has no other. Long texts are read whole, piece by piece; repeated rows get equal results; an empty
    table gives no rows; further columns of docs are dropped, whatever their names.
    """
    how = how or Near()
    signed = written(with_fingerprints(docs, how.width, id_col, text_col), "signed")
    classes = written(signed.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("class_size")), "classes")
    links = written(fingerprint_links(classes, how), "links")
    roots = component_roots(links)
    named = written(attach_roots(classes.withColumnRenamed("fp", "node"), roots), "named")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"), F.sum("class_size").alias("component_size"))
    final = attach(named.select("node", "class_size", "root"), groups, ["root"], "nodes", named.count()).withColumnRenamed("node", "fp")
    final = written(final.select("fp", "class_size", "component_id", "component_size"), "final")
    dropped(classes, links, roots, named)
    rows = attach(signed, final, ["fp"], "class_size", signed.count())
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.select(F.col("id").alias(id_col), digits, "component_id", "class_size", "component_size")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
