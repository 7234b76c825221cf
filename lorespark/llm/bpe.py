"""Byte-level BPE by a tree over the text: halves are encoded apart, and neighbours are joined at their boundary."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fresh, returned, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points up to which a text is one leaf.
LEAF = 512
#: Code points that a boundary window first takes from either side; it doubles until both its ends are safe.
WINDOW = 32
#: Letters on either side of a cut that show it to lie within one match, far from any apostrophe, and the tokens that
#: a window within that match first takes from either side.
RUN, TOKENS = 192, 4
#: Rows that are coded and passed on at once.
ROWS = 256

#: Where a match always ends: no alternative of the pattern has white space after anything else, and none has both a
#: letter and a number. The pattern looks ahead only at the end of white space, which never comes before such a place.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_LETTERS = regex.compile(r"\p{L}+")


class Codec:
    """Encodes and decodes with the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf = leaf
        self.whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self._tree(text, 0, len(text)), np.uint32)

    def _tree(self, text: str, begin: int, end: int) -> list[int]:
        """The ids of text[begin:end] as a text of its own."""
        if end - begin <= self.leaf:
            return self.whole.encode_ordinary(text[begin:end])
        half = (begin + end) // 2
        return self._join(text, begin, half, end, self._tree(text, begin, half), self._tree(text, half, end))

    def _join(self, text: str, begin: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[begin:end] from those of both sides of the cut.

        The window around the cut grows until it starts and ends at safe places, where a match ends whatever stands
        before or after, so that what each side has outside of it holds for the joined text too. It is encoded anew;
        how many ids of a side it replaces is how many that side's part of it has as a text of its own.
        """
        take = WINDOW
        while True:
            low, high = max(begin, cut - take), min(end, cut + take)
            # One character more on each side shows whether the window's own ends are safe.
            p = next((m.start() for m in _SAFE.finditer(text, max(begin, low - 1), cut)), None) if low > begin else begin
            q = next((m.start() for m in _SAFE.finditer(text, cut + 1, high) if m.start() < high), None) if high < end else end
            if p is not None and q is not None:
                break
            if take >= RUN and (met := self._within(text, begin, cut, end, left, right)):
                return met
            take *= 2
        encode = self.whole.encode_ordinary
        kept = len(left) - len(encode(text[p:cut]))
        return left[:kept] + encode(text[p:q]) + right[len(encode(text[cut:q])) :]

    def _within(self, text: str, begin: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int] | None:
        """The ids if the cut lies within a long run of letters, so within one match; None if that cannot be told.

        Tokens of a match are its encoding if each two neighbours are the encoding of their bytes. Some tokens on
        either side of the cut are encoded anew; they hold as soon as both ends of the window agree with the
        token outside, as all other neighbours are those of one side.
        """
        if cut - begin < RUN or end - cut < RUN or not _LETTERS.fullmatch(text, cut - RUN, cut + RUN):
            return None
        single, one = self.whole._encode_single_piece, self.whole.decode_single_token_bytes
        room = (len(text[cut - RUN : cut].encode()), len(text[cut : cut + RUN].encode()))
        k = TOKENS
        while k < min(len(left), len(right)):
            tail, head = b"".join(map(one, left[-k - 1 :])), b"".join(map(one, right[: k + 1]))
            if len(tail) > room[0] or len(head) > room[1]:
                return None
            a, b = left[-k - 1], right[k]
            window = single(tail[len(one(a)) :] + head[: len(head) - len(one(b))])
            if single(one(a) + one(window[0])) == [a, window[0]] and single(one(window[-1]) + one(b)) == [window[-1], b]:
                return left[:-k] + window + right[k:]
            k *= 2
        return None

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.whole.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=1)
def codec(vocabulary: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF) -> Codec:
    """One per Python worker; vocabulary is a file of public_tokenizers or a path."""
    return Codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), pattern, leaf)


def _mapped(df: DataFrame, source: str, columns: dict[str, str], make: Callable[[object], tuple]) -> DataFrame:
    """df with further binary columns, made of one column row by row, in slices of ROWS rows."""
    at, names = df.columns.index(source), list(columns)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                made = list(zip(*map(make, part.column(at).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.binary()) for c in made]], [*part.schema.names, *names])

    small_batches(df.sparkSession)
    schema = df
    for name, kind in columns.items():
        schema = extended(schema, name, kind)
    return df.mapInArrow(returned(code), schema)


def with_ids(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """docs with token_ids, binary: the ids of the text as little-endian unsigned 32-bit integers; if decoded, also
    with decoded, binary: the bytes that those ids stand for, made in the same pass.

    Each match of the pattern is encoded apart, without special tokens. Null text counts as empty and has no
    ids; rows are independent, so repeats and ties need no rule; an empty table gives no rows. Columns that docs has
    of these names, in any case, stay; the new ones get an underscore more.
    """

    def both(text: str | None) -> tuple[bytes, ...]:
        c = codec(vocabulary, leaf=leaf)
        ids = c.encode(text or "").astype("<u4").tobytes()
        return (ids, c.decode(np.frombuffer(ids, "<u4"))) if decoded else (ids,)

    return _mapped(docs, text_col, dict.fromkeys(fresh(docs, *["token_ids", "decoded"][: 1 + decoded]), "binary"), both)


def with_text(coded: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "token_ids") -> DataFrame:
    """coded with decoded, binary: the bytes that the ids stand for; null ids count as none."""
    return _mapped(coded, ids_col, {fresh(coded, "decoded")[0]: "binary"}, lambda ids: (codec(vocabulary).decode(np.frombuffer(ids or b"", "<u4")),))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    both = with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return both.select("doc_id", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
