"""Words of whole texts as 64-bit hashes, many at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import LOWER, UPPER

ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AT_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text that are hashed at once.
STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def lowered(text: str | None) -> bytes:
    """The text in UTF-8, A-Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED)


def pieces(data: bytes, edge: re.Pattern) -> Iterator[bytes]:
    """data in parts of about STEP bytes that end where edge, a pattern of one byte between words, matches: no word is cut."""
    begin = 0
    while begin < len(data):
        found = edge.search(data, begin + STEP) if len(data) > begin + STEP else None
        end = found.start() if found else len(data)
        yield data[begin:end]
        begin = end


def runs_of(words: list[bytes], width: int) -> Iterator[bytes]:
    """Each run of width consecutive words, joined by one space."""
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(0, len(words) - width + 1)].tolist()
    return (line[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True))


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data starts, and a 64-bit hash of its bytes: a polynomial in them, mixed with the length."""
    starts, hashes, begin = [], [], 0
    while begin < len(data):
        space = _AT_SPACE.search(data, begin + STEP) if len(data) > begin + STEP else None
        end = space.start() if space else len(data)
        b = np.frombuffer(data, np.uint8, end - begin, begin)
        edge = np.diff((~_SPACE[b]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(1 << max(STEP.bit_length(), len(b).bit_length()))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * up[: len(b)], out=sums[1:])
        hashes.append(mixed((sums[past] - sums[first]) * down[first] + (past - first).astype(np.uint64) * np.uint64(ORDERS[1]), ORDERS[2]))
        starts.append(first + begin)
        begin = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
