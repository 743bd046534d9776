"""Splitting texts into the pieces that byte-pair encoding works on.

Whole batches are split with numpy. Code points whose class Unicode versions
may dispute, and texts with a special token's string, are left to the caller's
exact path: plain() tells them apart.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from sleuthframe.llm.shingles import text_keys

SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
#: Code points below this, and general punctuation, have one class everywhere.
_SETTLED = 0x250


@functools.cache
def _classes() -> np.ndarray:
    """Class of each settled code point; 9 for the others."""
    out = np.full(0x110000, 9, np.uint8)
    for c in [*range(_SETTLED), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if chr(c).isspace() else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[*range(0x1C, 0x20), 0x85]] = 9
    out[0] = 9
    return out


def plain(texts: list[str], specials: tuple[str, ...]) -> np.ndarray:
    """Which texts the numpy path splits exactly."""
    out = np.ones(len(texts), bool)
    for i, t in enumerate(texts):
        if any(s in t for s in specials):
            out[i] = False
        elif not t.isascii() or "\x00" in t or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t:
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[i] = not (_classes()[codes] == 9).any()
    return out


class Split:
    """Pieces of a batch of plain texts. codes[begin:end]: a piece's code points;
    keys and exact: of
    each piece, as text_keys() gives them; first: index of each text's first piece, one more at
    the end; piece(i): its string."""

    def __init__(self, texts: list[str], *, spaces: bool):
        """spaces: one leading space belongs to a piece, and runs of white space
        are pieces; otherwise white space is dropped and each digit stands alone."""
        self.joined = "\x00".join([*texts, ""])
        codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        kind = _classes()[codes]
        kind[codes == 0] = BREAK
        start = np.ones(len(kind), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
        if spaces:
            last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
            start[last] = True
            start[last[codes[last] == 32] + 1] = False
        else:
            start |= kind == NUMBER
        self._contract(codes, kind, start)
        begin = np.flatnonzero(start)
        begin = begin if len(begin) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(kind))
        keep = kind[begin] != BREAK
        if not spaces:
            keep &= kind[begin] != SPACE
        self.codes, self.begin, self.end = codes, begin[keep], end[keep]
        self.keys, self.exact = text_keys(codes, self.begin, self.end - self.begin)
        breaks = np.flatnonzero(kind == BREAK)
        self.first = np.concatenate([[0], np.searchsorted(self.begin, breaks)])

    @staticmethod
    def _contract(codes: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a piece are pieces."""
        at = np.flatnonzero((codes == 39) & start)
        if not len(at):
            return
        after = np.concatenate([codes, np.zeros(3, np.uint32)])
        one, two = after[at + 1], after[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, n in ((short, 1), (long, 2)):
            start[at[which] + 1] = False
            rest = at[which] + 1 + n
            rest = rest[rest < len(kind)]
            start[rest[kind[rest] == LETTER]] = True

    def piece(self, i: int) -> str:
        return self.joined[self.begin[i] : self.end[i]]
