"""Token ids of documents in seekable files.

A file holds one independent zstandard frame per document, whose content is the
document's ids as little-endian unsigned 32-bit integers. Two skippable frames
follow: the document ids, and a seek table in the public seekable layout
(compressed size, content size and the low half of the content's XXH64 for each
frame; then the number of frames, a descriptor byte and a magic number). A
reader takes the end of the file, then only the frames it wants, and checks each.

Documents are range-sorted by id and equal ids by a hash of the text, so files
follow one another in id order; null ids come first. A caller may give another
order, such as that of a written table. A null text counts as
empty, and an empty document still has its end id. Repeated rows are all
written. An empty table gives no files and an empty result. Only the id and
text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import Remembered, attempt_name, filesystem, kept, pieces, put_file, shared_folder, table, written
from sleuthframe.llm.pretokens import Split, plain

#: Fixed values of the public zstandard seekable layout.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID = 0
#: Ids that a worker holds, those of pieces too long to be remembered among them; then it starts anew.
FLAT = 1 << 22


class Encoder:
    """Ids of whole texts. The library encodes each distinct piece once; texts
    that the splitter leaves aside go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        # where a piece's ids begin in flat, and how many they are
        self.known, self.flat, self.used = Remembered(np.zeros((0, 2), np.int64)), np.zeros(1 << 16, np.uint32), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Number of ids of each piece, and all ids. A space and letters are the
        same piece in a line of such pieces, so those go twenty at a time."""
        joined = np.array([t[0] == " " and t[1:].isalpha() for t in texts], bool)
        size, flat = np.zeros(len(texts), np.int64), [()] * len(texts)
        which = np.flatnonzero(joined)
        groups = [which[i : i + 20] for i in range(0, len(which), 20)]
        lines = self.library.encode_batch(["".join(texts[i] for i in g) for g in groups], add_special_tokens=False)
        for group, line in zip(groups, lines, strict=True):
            size[group] = np.bincount(line.word_ids, minlength=len(group))
            flat[group[0]] = line.ids
        which = np.flatnonzero(~joined)
        for i, e in zip(which, self.library.encode_batch_fast([texts[i] for i in which], add_special_tokens=False), strict=True):
            flat[i] = e.ids
            size[i] = len(e.ids)
        return size, flat

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Append the ids of pieces to flat; (begin, size) of each."""
        order = sorted(range(len(texts)), key=lambda i: not (texts[i][0] == " " and texts[i][1:].isalpha()))
        size, flat = self._library([texts[i] for i in order])
        more = int(size.sum())
        while len(self.flat) < self.used + more:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + more] = np.fromiter(itertools.chain.from_iterable(flat), np.uint32, more)
        out = np.empty((len(texts), 2), np.int64)
        out[order, 0], out[order, 1] = self.used + np.cumsum(size) - size, size
        self.used += more
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        whole = [t or "" for t in texts]
        easy = plain(whole, self.specials)
        split = Split([t if ok else "" for t, ok in zip(whole, easy, strict=True)], spaces=True)
        if len(self.known) > self.known.most or self.used > FLAT:
            self.known.forget()
            self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        found = self.known.values_of(split.keys, split.exact, split.codes, split.begin, split.end, lambda some: self._learn([split.piece(i) for i in some.tolist()]))
        at, size = found[:, 0], found[:, 1]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)]
        bound = np.concatenate([[0], ends])[split.first]
        out = [ids[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        for i in np.flatnonzero(~easy):
            out[i] = np.array(self.library.encode(whole[i], add_special_tokens=False).ids, np.uint32)
        return out


def _encoder(name: str) -> Encoder:
    return kept(("ids", name), lambda: Encoder(public_tokenizers.path(name)))


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FrameWriter:
    """Appends documents to an open stream and ends it with the two tables."""

    def __init__(self, out, level: int = 1):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table, self.ids = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def finish(self) -> None:
        there = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        self.out.write(skippable(SKIPPABLE_INDEX, self.pack.compress(there.tobytes() + ids.tobytes())))
        footer = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(skippable(SKIPPABLE_SEEK, b"".join(self.table) + footer))


class FrameReader:
    """Random access to one file's documents by position or id."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, _, magic = struct.unpack("<IBI", self._range(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        begin = size - 9 - 12 * n
        table = np.frombuffer(self._range(begin, 12 * n), "<u4").reshape(n, 3)
        self.size, self.content, self.checksum = table[:, 0].astype(np.int64), table[:, 1], table[:, 2]
        self.offset = np.cumsum(self.size) - self.size
        index = int(self.size.sum())
        magic, length = struct.unpack("<II", self._range(index, 8))
        raw = zstandard.ZstdDecompressor().decompress(self._range(index + 8, length), max_output_size=9 * n + 9) if n else b""
        there, ids = np.frombuffer(raw[:n], np.uint8), np.frombuffer(raw[n:], "<i8")
        self.ids = [int(i) if t else None for i, t in zip(ids, there, strict=True)]
        self.unpack = zstandard.ZstdDecompressor()

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read."""
        raw = self.unpack.decompress(self._range(int(self.offset[k]), int(self.size[k])))
        if len(raw) != self.content[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksum[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, "<u4")

    def by_id(self, doc_id: int) -> list[np.ndarray]:
        return [self.document(k) for k, i in enumerate(self.ids) if i == doc_id]


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", order: tuple[Column, ...] = ()) -> DataFrame:
    """Write the files and return their table: (part, file, n_docs, n_tokens).
    Documents lie in the order of the columns `order` of df; by id without any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder, counts = _encoder(vocabulary), [0, 0]

        def write(out) -> None:
            frames = FrameWriter(out)
            for batch in (x for some in ([first], batches) for x in some):
                for piece in pieces(batch, "text"):
                    for doc_id, ids in zip(piece.column("id").to_pylist(), encoder.encode(piece.column("text").to_pylist()), strict=True):
                        frames.add(doc_id, np.append(ids, np.uint32(END_ID)))
                        counts[0] += 1
                        counts[1] += len(ids) + 1
            frames.finish()

        file = f"{folder}/part-{attempt_name(context)}.tokens.zst"
        put_file(file, write)
        yield pa.record_batch([[part], [file], [counts[0]], [counts[1]]], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    by = [c.alias(f"by_{k}") for k, c in enumerate(order or (doc_id, F.xxhash64(text)))]
    places = [f"by_{k}" for k in range(len(by))]
    ordered = df.select(doc_id.alias("id"), text.alias("text"), *by).repartitionByRange(*places).sortWithinPartitions(*places)
    files = ordered.select("id", "text").mapInArrow(run, "part int, file string, n_docs bigint, n_tokens bigint")
    return written(files, f"{folder}/manifest")


def row_order(df: DataFrame) -> tuple[Column, ...]:
    """Columns that put the rows of a sorted and written table in the order they
    were written in: Spark deals a table's files to tasks by size, not by name.
    A df that isn't read from files has the order of its partitions."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return (F.monotonically_increasing_id(),)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    return F.when(part != "", part.cast("long")), F.col("_metadata.file_path"), F.col("_metadata.row_index")


def read_token_files(files: DataFrame) -> DataFrame:
    """Read every document back: (doc_id, start, n_tokens, ids_crc32). The table
    of files has one row per file, so its running sum is taken on the driver."""
    spark = files.sparkSession
    listed, at = [], 0
    for r in files.select("part", "file", "n_tokens").orderBy("part").collect():
        listed.append((r["file"], at))
        at += r["n_tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    reader = FrameReader(f)
                    docs = [(len(x), zlib.crc32(x)) for x in map(reader.document, range(len(reader.ids)))]
                sizes = np.array([n for n, _ in docs], np.int64)
                yield pa.record_batch([pa.array(reader.ids, pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([c for _, c in docs], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(listed, "file string, start bigint")
    rows = rows.repartition(max(1, len(listed)), "file") if listed else rows
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), shared_folder(spark)))
