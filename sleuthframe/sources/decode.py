"""Bytes of source files as text that gives the same bytes back.

A byte that isn't part of valid UTF-8 becomes one control character that the file
doesn't hold otherwise (from 1 to 31, but for tab, newline and carriage return), so
that every other character keeps its place. Null bytes stay null; empty ones give
an empty text. A file that holds all those control characters and invalid bytes
as well raises an error, for nothing could stand for them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARKERS = [m for m in range(1, 32) if m not in (9, 10, 13)]


def decoded(raw: bytes) -> tuple[str, str | None, bytes]:
    """The text, the character that stands for invalid bytes, and those bytes in order."""
    try:
        return raw.decode("utf-8"), None, b""
    except UnicodeDecodeError:
        pass
    marker = next((chr(m) for m in MARKERS if m not in raw), None)
    if marker is None:
        raise ValueError("no character is free to stand for invalid bytes")
    out, invalid, at = [], bytearray(), 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode("utf-8"), marker * (e.end - e.start)]
            invalid += raw[at + e.start : at + e.end]
            at += e.end
    return "".join(out), marker, bytes(invalid)


def restored(text: str, marker: str | None, invalid: bytes) -> bytes:
    """The bytes that decoded() was given."""
    if marker is None:
        return text.encode("utf-8")
    parts = text.split(marker)
    if len(parts) - 1 != len(invalid):
        raise ValueError("the text doesn't hold as many marks as there are invalid bytes")
    return b"".join(p.encode("utf-8") + invalid[k : k + 1] for k, p in enumerate(parts))


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(None, None, b"") if raw is None else decoded(raw) for raw in batch.column("raw").to_pylist()]
        yield pa.record_batch([batch.column("path"), pa.array([t for t, _, _ in found], pa.string()), pa.array([m for _, m, _ in found], pa.string()), pa.array([i for _, _, i in found], pa.binary())], ["path", "content", "marker", "invalid"])


def decode(raws: DataFrame) -> DataFrame:
    """files(path, content, marker, invalid) of raws(path, raw)."""
    return raws.select("path", "raw").mapInArrow(_decoded, "path string, content string, marker string, invalid binary")
