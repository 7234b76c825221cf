"""Texts that are nearly the same by the share of their matching blocks: exact join under bounds of lengths and counts."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that characters are hashed to. Characters of one place count together, which keeps bounds bounds.
PLACES = 64
#: Texts of one block, and numbers over which blocks of the first side are spread.
BLOCK, SPREAD = 512, 64


def counts_of(text: str) -> np.ndarray:
    """How many of the text's characters each place has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes % PLACES, minlength=PLACES).astype(np.int32)


def least_matched(total: np.ndarray, least: float) -> np.ndarray:
    """The least number of matched characters of two texts of so many together whose ratio can reach least."""
    return np.ceil(least * total / 2 - 1e-9).astype(np.int64)


def may_match(text: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which of some texts may reach the ratio with one, by their sizes and counts: both have the characters that match."""
    need = least_matched(size + sizes, least)
    return (need <= np.minimum(size, sizes)) & (np.minimum(text, others).sum(axis=1) >= need)


def places_of(text: str) -> dict[str, int]:
    """For each character the bits of its places in the text."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(places: dict[str, int], size: int, other: str) -> int:
    """The length of the longest common subsequence of a text and another, all places of the text at once.

    A zero in the row of bits is a place where the length that is common so far grows. Matching blocks are in the same
    order in both texts, so they have no more characters together.
    """
    whole = row = (1 << size) - 1
    for c in other:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & whole
    return size - row.bit_count()


def _stratum(size: int, least: float) -> int:
    """Sizes of one stratum differ by less than texts that match may; those of texts that match are in one or neighbours."""
    return math.floor(math.log(size) / math.log(2 / least - 1)) if size and least < 1 else size


def _blocks(texts: DataFrame, least: float) -> DataFrame:
    """(stratum, ids, texts, counts): blocks of at most BLOCK texts of a stratum, ordered by size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_stratum: dict[int, list[tuple]] = {}
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_stratum.setdefault(_stratum(len(text), least), []).append((len(text), text, ident))
            for stratum, rows in by_stratum.items():
                rows.sort(key=lambda r: r[0])
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    counts = np.stack([counts_of(t) for _, t, _ in part])
                    yield pa.RecordBatch.from_arrays([pa.array([stratum], pa.int64()), pa.array([[i for *_, i in part]], pa.list_(batch.column(0).type)), pa.array([[t for _, t, _ in part]], pa.list_(pa.string())), pa.array([counts.tobytes()], pa.binary())], names)

    names = ["stratum", "ids", "texts", "counts"]
    ids = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(pack, f"stratum long, ids array<{ids}>, texts array<string>, counts binary")


def near_texts(first: DataFrame, second: DataFrame, least: float = 0.85, autojunk: bool = False) -> DataFrame:
    """(first_id, second_id, ratio): all pairs of a text of first and one of second, both (id, text), whose ratio is at least
    `least`: twice the characters in matching blocks by the characters of both. Which text comes first counts.

    Blocks of texts meet by strata of lengths, those of second at the stratum and its neighbours; each pair of texts of
    two blocks is held against bounds, by lengths, by counts of characters and by the longest common subsequence, before its
    blocks are matched. No pair that reaches the ratio is lost, and blocks of first are spread over tasks, so no
    length decides how long one takes. autojunk: long texts' frequent characters begin no block, as the standard
    library has it by default. Null and empty texts match nothing. Texts that repeat are pairs of their own, so callers
    with many copies pass distinct ones.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    sides = [df.select(F.col(df.columns[0]).alias("id"), F.col(df.columns[1]).alias("text")).filter("length(text) > 0") for df in (first, second)]
    left, right = (_blocks(side, least) for side in sides)
    left = left.select("stratum", F.col("ids").alias("l_ids"), F.col("texts").alias("l_texts"), F.col("counts").alias("l_counts"), (F.monotonically_increasing_id() % SPREAD).alias("at"))
    around = F.sequence(F.col("stratum") - 1, F.col("stratum") + 1)
    right = right.select(F.explode(around).alias("stratum"), "ids", "texts", "counts").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                a_ids, a_texts, b_ids, b_texts = (batch.column(c)[row].as_py() for c in ("l_ids", "l_texts", "ids", "texts"))
                a, b = (np.frombuffer(batch.column(c)[row].as_py(), np.int32).reshape(-1, PLACES) for c in ("l_counts", "counts"))
                sizes = np.array([len(t) for t in a_texts])
                for j, text in enumerate(b_texts):
                    found = np.flatnonzero(may_match(b[j], len(text), a, sizes, least))
                    if not len(found):
                        continue
                    places, need, matcher = places_of(text), least_matched(len(text) + sizes[found], least).tolist(), None
                    for i, most in zip(found.tolist(), need, strict=True):
                        if common_length(places, len(text), a_texts[i]) >= most:
                            matcher = matcher or difflib.SequenceMatcher(None, "", text, autojunk)
                            matcher.set_seq1(a_texts[i])
                            ratio = matcher.ratio()
                            if ratio >= least:
                                out.append((a_ids[i], b_ids[j], ratio))
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (batch.schema.field("l_ids").type.value_type, batch.schema.field("ids").type.value_type, pa.float64()), strict=True)], ["first_id", "second_id", "ratio"])

    kinds = [side.schema["id"].dataType.simpleString() for side in sides]
    return left.join(right, ["stratum", "at"]).mapInArrow(match, f"first_id {kinds[0]}, second_id {kinds[1]}, ratio double")
