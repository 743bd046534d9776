"""Corrections: which of a file's edits are taken, and the text they give.

A correction is the edits of one finding. Corrections are tried by their first
start, the widest first, and taken if no edit overlaps one taken before. One not
taken counts as done all the same if its equal was taken, if all its edits lie
in a run of adjoining edits that was taken, or, for indirect ones, in taken
edits. Invalid corrections (no edits, reversed, out of the text, overlapping
themselves) are neither. The choice depends on all edits of a file in order, so
a file's edits meet in one row; that row is as large as the file's edits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType


class Taken:
    """Ranges that don't overlap, in order; their ends are in order too."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int, int]] = []

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_right(self.ranges, a, key=lambda r: r[1])
        return k < len(self.ranges) and self.ranges[k][0] < b

    def encloses(self, a: int, b: int) -> bool:
        k = bisect_left(self.ranges, b, key=lambda r: r[1])
        while k < len(self.ranges) and self.ranges[k][0] <= a:
            if self.ranges[k][1] >= b:
                return True
            k += 1
        return False

    def add(self, a: int, b: int) -> None:
        insort(self.ranges, (a, b))


def _valid(edits: list[tuple[int, int, str]], size: int) -> bool:
    return bool(edits) and all(0 <= a <= b <= size for a, b, _ in edits) and all(p[1] <= q[0] for p, q in zip(edits, edits[1:], strict=False))


def choose(size: int, corrections: dict[int, tuple[bool, list[tuple[int, int, str]]]]) -> tuple[dict[int, list[tuple[int, int, str]]], set[int]]:
    """{id: (indirect, edits)} to the edits taken, by id, and the ids done by others."""
    tried = {i: (indirect, sorted(edits)) for i, (indirect, edits) in corrections.items()}
    tried = {i: c for i, c in tried.items() if _valid(c[1], size)}
    taken, done, spots, runs, equal = {}, set(), Taken(), Taken(), set()
    for i in sorted(tried, key=lambda i: (tried[i][1][0][0], -tried[i][1][-1][1], i)):
        indirect, edits = tried[i]
        if not any(spots.overlaps(a, b) for a, b, _ in edits):
            taken[i] = edits
            equal.add(tuple(edits))
            for a, b, _ in edits:
                spots.add(a, b)
            if all(p[1] == q[0] for p, q in zip(edits, edits[1:], strict=False)):
                runs.add(edits[0][0], edits[-1][1])
        elif tuple(edits) in equal or all(runs.encloses(a, b) for a, b, _ in edits) or indirect and all(spots.encloses(a, b) for a, b, _ in edits):
            done.add(i)
    return taken, done


def rewrite(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The text after edits that don't overlap; equal edits count once."""
    out, at = [], 0
    for a, b, new in sorted(set(edits)):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _corrected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        carries = "found" in batch.schema.names
        listed = batch.column("edits")
        offsets, flat = listed.offsets.to_pylist(), listed.values
        ids, indirect, *edits = (flat.field(n).to_pylist() for n in ("correction_id", "indirect", "start", "end", "replacement"))
        edits = list(zip(*edits, strict=True))
        texts, accepted, subsumed, done_of = [], [], [], []
        for k, content in enumerate(batch.column("content").to_pylist()):
            asked: dict[int, tuple[bool, list]] = {}
            for e in range(offsets[k], offsets[k + 1]):
                asked.setdefault(ids[e], (indirect[e], []))[1].append(edits[e])
            # a path that no file has
            taken, done = choose(len(content), asked) if asked and content is not None else ({}, set())
            texts.append(rewrite(content, (e for c in taken.values() for e in c)) if taken else content)
            accepted.append(sorted(taken))
            subsumed.append(sorted(done))
            if carries:
                flags = [False] * max((*taken, *done), default=0)
                for i in (*taken, *done):
                    flags[i - 1] = True
                done_of.append(flags)
        numbers = pa.list_(pa.int64())
        made = {"path": batch.column("path"), "content": pa.array(texts, pa.string()), "accepted": pa.array(accepted, numbers), "subsumed": pa.array(subsumed, numbers)}
        if carries:
            made |= {"found": batch.column("found"), "done": pa.array(done_of, pa.list_(pa.bool_()))}
        yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


CORRECTED = "path string, content string, accepted array<bigint>, subsumed array<bigint>"
NO_EDITS = "cast(array() AS array<struct<correction_id:bigint,start:bigint,end:bigint,replacement:string,indirect:boolean>>)"


def applied(rows: DataFrame) -> DataFrame:
    """(path, content, accepted, subsumed) of rows(path, content, edits), edits an array
    for each file; of rows with an array `found`, too, that and `done`, which tells of
    correction 1 and so on whether it was done."""
    rows = rows.withColumn("edits", F.expr(f"coalesce(edits, {NO_EDITS})"))
    if "found" not in rows.columns:
        return rows.mapInArrow(_corrected, CORRECTED)
    schema = StructType([*rows.select("path", "content").schema, *(StructField(n, ArrayType(LongType())) for n in ("accepted", "subsumed")), rows.schema["found"], StructField("done", ArrayType(BooleanType()))])
    return rows.mapInArrow(_corrected, schema)


def corrected(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, accepted, subsumed) of each file after the edits(path,
    correction_id, start, end, replacement, indirect), offsets in code points."""
    listed = edits.groupBy("path").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("correction_id", "start", "end")], F.coalesce("replacement", F.lit("")).alias("replacement"), F.coalesce("indirect", F.lit(False)).alias("indirect"))).alias("edits"))
    return applied(files.select("path", "content").join(listed, "path", "left"))
