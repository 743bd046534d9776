"""Words of Arrow text columns, found in their UTF-8 bytes with numpy.

A word is a maximal run of ASCII letters and digits and of characters beyond
ASCII, in which A-Z alone are lower-cased. Null texts have none. Bytes that are
not UTF-8 count as characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_INSIDE = np.array([chr(b).isalnum() and b < 128 or b > 127 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of text that are looked at at once; a longer text is cut between words.
WINDOW = 4_000_000


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text begins (one entry more than texts)."""
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; none reaches from one text into the next."""
    inside = _INSIDE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a column: texts, their distinct words as Arrow binaries; code,
    for each word the index of its text; begin and end, its bytes; first, the
    index of each text's first word (one entry more than texts)."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        self.begin, self.end = word_spans(raw, offsets)
        self.first = np.searchsorted(self.begin, offsets)
        where = np.concatenate([[0], np.cumsum(self.end - self.begin)]).astype(np.int64)
        kept = _LOWER[raw[_INSIDE[raw]]]
        all_words = pa.Array.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(where), pa.py_buffer(kept)])
        coded = all_words.dictionary_encode()
        self.texts, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def owner(self) -> np.ndarray:
        """The index of the text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(column: pa.Array, most: int = WINDOW) -> Iterator[tuple[int, int, pa.Array]]:
    """(first text, its number of texts, texts): runs of texts with about `most`
    bytes together. A text of more comes alone, in parts cut between words, each
    under the text's own index."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, begin = np.cumsum(size), 0
    while begin < len(column):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        part = column.slice(begin, end - begin)
        if size[begin] <= most:
            yield begin, end - begin, part
        else:
            raw, _ = text_bytes(part)
            for a, b in cuts(raw, most):
                yield begin, 1, pa.array([raw[a:b].tobytes()], pa.large_binary())
        begin = end


def cuts(raw: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes of a text that no word reaches out of; one
    word of more bytes makes its range longer."""
    a = 0
    while a < len(raw):
        b = min(a + most, len(raw))
        while b < len(raw) and _INSIDE[raw[b]]:
            # on to the next byte that is not in a word, some at a time
            gap = np.flatnonzero(~_INSIDE[raw[b : b + 4096]])
            b = b + int(gap[0]) if len(gap) else min(b + 4096, len(raw))
        yield a, b
        a = b
