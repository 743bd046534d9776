"""Word shingles of whole Arrow batches, computed with numpy.

A word is a maximal run of alphanumeric code points of the lower-cased text. A
shingle is five consecutive words; a text of one to four words has one shingle,
all its words; a text without words has none. Words and shingles are 64-bit
hashes that depend on their characters only, so every executor agrees on them.
"""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
SIMILARITY = 0.8


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, applied to a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@functools.cache
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _characters() -> np.ndarray:
    return constants(0x110000, 11)


def spread(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit value of each run of code points codes[begin : begin + size]: the
    sum of a non-linear mix of every character with its place, so that no swap of
    characters within a run keeps it. Two different runs agree with probability
    2**-64; where that may not decide, texts are compared (see Remembered)."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    start = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(start, size)
    value = _characters()[codes[np.repeat(begin, size) + at]]
    value ^= at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xCA9B0C7EBA1DA115)
    value ^= value >> np.uint64(32)
    return mix(np.add.reduceat(value, start) + size.astype(np.uint64))


#: Runs of up to so many code points below 256 are their own key.
PACKED = 7


def text_keys(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each run codes[begin : begin + size], and which keys are the
    text itself: short runs of small code points are packed into theirs with
    their length; the others get the value of spread(), marked in the top byte."""
    wide = np.concatenate([[0], np.cumsum(codes > 255)])
    exact = (size <= PACKED) & (wide[begin + size] == wide[begin])
    keys = np.zeros(len(begin), np.uint64)
    some, n = begin[exact], size[exact]
    packed = n.astype(np.uint64) << np.uint64(56)
    for k in range(PACKED):
        there = n > k
        packed[there] |= codes[some[there] + k].astype(np.uint64) << np.uint64(8 * k)
    keys[exact] = packed
    if not exact.all():
        keys[~exact] = spread(codes, begin[~exact], size[~exact]) | np.uint64(0xFF << 56)
    return keys, exact


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the index of its
    first word (one entry more than texts)."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n".join(lowered)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _alphanumeric()[codes]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(texts))
    offsets = np.searchsorted(first, np.concatenate([[0], np.cumsum(lengths)]))
    return spread(codes, first, last - first), offsets


def split_words(text: str | None) -> list[str]:
    """The words of a text as strings."""
    return [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(" ") if w]


def shingles(texts: list[str | None], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order with repeats, and offsets as for words(). A
    text of fewer than n words has one shingle of them all, whose hash is the
    same as that of a shingle of so many words."""
    return joined_words(*words(texts), n)


def joined_words(hashes: np.ndarray, offsets: np.ndarray, n: int, *, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, from words(); short: texts of fewer words
    have one of all their words."""
    count = np.diff(offsets)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64) * short)
    out_offsets = np.concatenate([[0], np.cumsum(made)])
    factor = constants(n, 23)
    start = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1] - offsets[:-1], made)
    left = np.repeat(offsets[1:], made) - start
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    for k in range(n):
        total += np.where(left > k, padded[start + k], np.uint64(0)) * factor[k]
    return mix(total), out_offsets


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, with new offsets."""
    which = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, which))
    h, w = hashes[order], which[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return h[keep], np.searchsorted(w[keep], np.arange(len(offsets)))


#: The same words and shingles in DuckDB's SQL, for tables with a text column.
SHINGLE_SQL = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"""
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
