"""Text functions that Spark has no expression for, as plain functions and as Arrow-batched SQL functions."""

from __future__ import annotations

import difflib
import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Chinese digits and units.
DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000}


def plain(text: str | None) -> str:
    """Compatibility form, case folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def letters(text: str | None) -> str:
    """Compatibility form, case folded, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").casefold() if c.isalnum())


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(text: str | None) -> str | None:
    """SHA-256 of a JSON text's canonical form; null if it is no JSON."""
    try:
        return hashlib.sha256(canonical(json.loads(text)).encode()).hexdigest()
    except (TypeError, ValueError):
        return None


def _windows(expected: str, text: str, most: int) -> list[tuple[int, int]]:
    """Apart from each other, the stretches of text that hold all parts with at most so many edits: of most + 1 pieces of expected
    one is in such a part as it is."""
    found, n = set(), len(expected)
    cuts = [n * i // (most + 1) for i in range(most + 2)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        piece, at = expected[lo:hi], -1
        while (at := text.find(piece, at + 1)) >= 0:
            found.add(at - lo)
    out: list[list[int]] = []
    for at in sorted(found):
        begin, end = max(0, at - most), min(len(text), at + n + most)
        if out and begin <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def substring_distance(expected: str, text: str) -> int:
    """Least edit distance of expected to any part of text.

    Parts of few edits are looked for first, where a piece of expected stands; if there are none, in all of the text.
    """
    if expected in text:
        return 0
    for most in (2, 5, 8, 11, 15):
        if len(expected) < 3 * (most + 1):
            break
        places = _windows(expected, text, most)
        if 2 * sum(b - a for a, b in places) > len(text):
            break
        least = min((scanned_distance(expected, text[a:b]) for a, b in places), default=len(expected))
        if least <= most:
            return least
    return scanned_distance(expected, text)


def scanned_distance(expected: str, text: str) -> int:
    """substring_distance() from the whole table of distances; expected has characters.

    Columns of the table of distances are kept as the bits where it rises and falls by one from row to row, all rows at
    once; a part may begin anywhere, so the row of nothing stays 0.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(expected):
        places[c] = places.get(c, 0) | 1 << i
    whole, last = (1 << len(expected)) - 1, 1 << (len(expected) - 1)
    rises, falls, distance = whole, 0, len(expected)
    least = distance
    for c in text:
        met = places.get(c, 0)
        same = (((met & rises) + rises) ^ rises) | met | falls
        up, down = falls | ~(same | rises) & whole, rises & same
        distance += bool(up & last) - bool(down & last)
        least = min(least, distance)
        up, down = up << 1 & whole, down << 1 & whole
        met |= falls
        rises, falls = (down | ~(met | up) & whole) & whole, up & met
    return least


def substring_error(expected: str | None, text: str | None) -> float | None:
    """substring_distance() per character of expected; null if nothing is expected."""
    return substring_distance(expected, text or "") / len(expected) if expected else None


def unspaced(text: str | None) -> str:
    """Compatibility form, case folded, without white space, quotes straight."""
    return "".join(unicodedata.normalize("NFKC", text or "").replace("\u2019", "'").replace("\u2018", "'").split()).casefold()


def likeness(a: str | None, b: str | None) -> float:
    """Share of both texts in matching blocks. It depends on which text comes first."""
    return difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def chapter_number(text: str | None) -> int | None:
    """A number in digits or Chinese numerals below 10,000; null for anything else."""
    text = unicodedata.normalize("NFKC", text or "").strip()
    if text.isascii() and text.isdigit():
        return int(text)
    if not text or any(c not in DIGITS and c not in UNITS for c in text):
        return None
    if not any(c in UNITS for c in text):
        return int("".join(str(DIGITS[c]) for c in text))
    total, digit = 0, None
    for c in text:
        if c in UNITS:
            total += (1 if digit in (None, 0) and total == 0 else digit or 0) * UNITS[c]
            digit = None
        else:
            digit = DIGITS[c]
    return total + (digit or 0)


def register(spark: SparkSession) -> None:
    """The functions under their names in SQL."""

    def each(function, kind: str):
        @F.pandas_udf(kind)
        def run(text: pd.Series) -> pd.Series:
            return text.map(function, na_action=None)

        return run

    def pair(function, kind: str):
        @F.pandas_udf(kind)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([function(x, y) for x, y in zip(a, b, strict=True)])

        return run

    for function, kind in ((plain, "string"), (letters, "string"), (canonical_hash, "string"), (chapter_number, "long")):
        spark.udf.register(function.__name__, each(function, kind))
    for function, kind in ((substring_error, "double"), (likeness, "double")):
        spark.udf.register(function.__name__, pair(function, kind))
