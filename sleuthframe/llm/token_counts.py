"""Token counts by byte-pair merging, without making the tokens.

Each distinct piece of text starts as one symbol per UTF-8 byte, held in a
linked list; a heap yields the adjacent pair of lowest rank until none is left.
The count is the number of symbols minus the number of merges.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows and ids are
counted row by row; an empty table gives an empty result. Only the id and text
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import Remembered, pieces, table
from sleuthframe.llm.pretokens import Split, plain

#: Distinct pieces outside the plain path whose counts a worker remembers, and their greatest length.
REMEMBER, LONGEST = 200_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 bytes for themselves, the rest from U+0100 upwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairMerger:
    """Counts of one word-level BPE vocabulary file: lower case, white space
    dropped, the last symbol of each piece carrying the end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials)))
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left] << 20 | vocab[right]] = rank, vocab[left + right]
        self.counts, self.other = Remembered(np.zeros(0, np.int64)), {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece."""
        raw = piece.encode("utf-8", "replace")
        inner, pairs = self.inner, self.pairs
        symbol = [inner[b] for b in raw]
        n = len(symbol)
        if n < 2:
            return n
        symbol[-1] = self.last[raw[-1]]
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbol[i] << 20 | symbol[i + 1])
            if found:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(made << 20 | symbol[k])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], made, symbol[k]))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbol[h] << 20 | made)
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbol[h], made))
        return left

    def exact(self, text: str) -> int:
        """Tokens of a text in which special strings and any character may occur."""
        total = len(self.special_pattern.findall(text))
        for part in self.special_pattern.split(text):
            lowered = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            total += sum(map(self._remembered, self.pattern.findall(lowered)))
        return total

    def _remembered(self, piece: str) -> int:
        n = self.other.get(piece)
        if n is None:
            n = self.merged(piece)
            if len(piece) <= LONGEST:
                if len(self.other) > REMEMBER:
                    self.other.clear()
                self.other[piece] = n
        return n

    def count(self, texts: list[str | None]) -> np.ndarray:
        whole = [t or "" for t in texts]
        out = np.zeros(len(whole), np.int64)
        lowered = [t.lower() for t in whole]
        # some settled capitals have small letters that are not
        easy = plain(whole, self.specials) & plain(lowered, ())
        for i in np.flatnonzero(~easy):
            out[i] = self.exact(whole[i])
        split = Split([t if ok else "" for t, ok in zip(lowered, easy, strict=True)], spaces=False)
        got = self.counts.values_of(split.keys, split.exact, split.codes, split.begin, split.end, lambda some: np.array([self.merged(split.piece(i)) for i in some.tolist()], np.int64))
        sums = np.concatenate([[0], np.cumsum(got)])
        out[easy] = (sums[split.first[1:]] - sums[split.first[:-1]])[easy]
        return out


@functools.cache
def _merger(name: str) -> PairMerger:
    return PairMerger(public_tokenizers.path(name))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row; see the module for edge cases."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(vocabulary)
        for batch in batches:
            for part in pieces(batch, "text"):
                text = part.column("text")
                size = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
                yield pa.record_batch([part.column("id"), size, pa.array(merger.count(text.to_pylist()))], ["id", "n_bytes", "n_tokens"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
