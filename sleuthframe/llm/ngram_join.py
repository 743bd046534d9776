"""Similarity join of texts on the Jaccard similarity of their word shingles.

Texts with equal shingle sets are one class. MinHash values of a class, banded,
propose pairs of classes; the full shingle sets decide. A bucket of a band is
dealt to blocks, and a task sees two blocks of one bucket, so no group is ever
gathered whole. A pair counts in the first band that its classes share, and a
task returns a row per class, not per pair: how many documents it is linked to
and one class that it hangs together with.

Shingles are compared as 64-bit values; classes by 128 bits of all of a text's.

A text without words (null, empty, only punctuation) has no shingles and no
links and is a class alone. Rows that repeat an id are kept, one result row
each; rows with a null id take part like others, and a class whose ids are all
null has a null class_id. An empty table gives an empty result. Only the id and
text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import dealt_join, grouped, pieces, shared_folder, table, written
from sleuthframe.llm.components import components
from sleuthframe.llm.shingles import SHINGLE_SQL, SIMILARITY, WORDS_SQL, constants, distinct, mix, shingles

#: Hash functions that a text may be given; bands of more rows propose fewer pairs in vain, but take more of them.
MOST_HASHES = 128
#: Classes of one bucket that a block holds on average.
BLOCK = 512
#: Rows of ids and hashes that may be sent to every worker; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def band_plan(similarity: float = SIMILARITY, recall: float = 1 - 1e-6, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows of a band) that find a pair at the threshold with at least
    this probability: the most rows whose bands need at most `most` hashes."""
    plans = [(math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1, rows) for rows in range(1, 17)]
    return max((p for p in plans if p[0] * p[1] <= most), key=lambda p: p[1], default=plans[0])


def band_keys(sets: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each non-empty set (row) and band (column)."""
    xor, factor = constants(bands * rows, 31), constants(bands * rows, 37)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat((sets ^ xor[k]) * factor[k], offsets[:-1])
        out[:, k // rows] = mix(out[:, k // rows] + least * factor[k] + np.uint64(k))
    return out


def _fixed(column, width: int, kind) -> np.ndarray:
    """An Arrow list column whose lists all have this length, as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(kind).reshape(-1, width)


def _sketches(bands: int, band_rows: int):
    """(id, print, key, bands) of each row; key is null for texts without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets, offsets = distinct(*shingles(part.column("text").to_pylist()))
                size = np.diff(offsets)
                full = size > 0
                found = band_keys(sets, np.append(offsets[:-1][full], len(sets)), bands, band_rows) if full.any() else np.zeros((0, bands), np.uint64)
                keys = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                rows = iter(found.view(np.int64))
                yield pa.record_batch([part.column("id"), part.column("print"), pa.array(keys, pa.binary()), pa.array([next(rows) if f else None for f in full], pa.list_(pa.int64()))], ["id", "print", "key", "bands"])

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            sets, offsets = distinct(*shingles(part.column("text").to_pylist()))
            keys = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sets.view(np.int64)))], ["key", "shingles"])


def _first_shared(group: pa.Table, width: int) -> np.ndarray:
    """Which pairs of the group (row before column) count in its bucket: those
    of its two blocks whose classes share no earlier band."""
    band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
    keys, block = _fixed(group.column("bands"), width, np.int64), group.column("block").to_numpy()
    out = np.triu(np.ones((len(keys), len(keys)), bool), 1)
    if i != j:
        out = (block[:, None] == i) & (block[None, :] == j)
    for b in range(band):
        out &= keys[:, None, b] != keys[None, :, b]
    return out


def _needed(width: int):
    """The classes of each group that are in a pair that counts there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "i", "j"]):
            if group.num_rows > 1:
                pairs = _first_shared(group, width)
                keep = pairs.any(0) | pairs.any(1)
                if keep.any():
                    yield from group.filter(pa.array(keep)).select(["bucket", "band", "i", "j", "block", "key"]).combine_chunks().to_batches()

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted distinct arrays, by
    multiplying slices of the membership matrix."""
    joined = np.concatenate(sets)
    names, which, count = np.unique(joined, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = count[which] > 1
    which, owner = which[often], owner[often]
    number = np.cumsum(count > 1) - 1
    which = number[which]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(which[-1]) + 1 if len(which) else 0, 4096):
        a, b = np.searchsorted(which, [begin, begin + 4096])
        member = np.zeros((len(sets), 4096), np.float32)
        member[owner[a:b], which[a:b] - begin] = 1
        out += member @ member.T
    return out


def _verified(width: int, similarity: float):
    """(key, links, root) for the classes of each group that have links in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "i", "j"]):
            if group.num_rows < 2:
                continue
            pairs = _first_shared(group, width)
            lists = group.column("shingles").combine_chunks()
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            sets = [flat[a:b] for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
            size = np.array([len(s) for s in sets])
            if len(sets) == 2:
                common = np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)))
            else:
                common = shared_counts(sets)
            # similarity as a fraction of ten thousandths, so that no rounding decides
            linked = pairs & (common * 10_000 >= round(similarity * 10_000) * (size[:, None] + size[None, :] - common))
            linked |= linked.T
            some = np.flatnonzero(linked.any(0))
            if len(some):
                copies, keys = group.column("copies").to_numpy(), group.column("key").to_pylist()
                root = list(range(len(keys)))
                for r in some:
                    stack = [r] if root[r] == r else []
                    while stack:
                        x = stack.pop()
                        new = [y for y in np.flatnonzero(linked[x]) if root[y] == y and y != r]
                        for y in new:
                            root[y] = r
                        stack += new
                yield pa.record_batch([pa.array([keys[x] for x in some], pa.binary()), pa.array((linked[some] * copies[None, :]).sum(1).astype(np.int64)), pa.array([keys[root[x]] for x in some], pa.binary())], ["key", "links", "root"])

    return run


def _joined(df: DataFrame, id_col: str, text_col: str, similarity: float, recall: float, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, print, key) of each row, where print tells its text beside the id,
    and (key, root, copy, copies, links) of each class: copy is its least
    (id is null, id, print)."""
    bands, band_rows = band_plan(similarity, recall)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = written(docs.mapInArrow(_sketches(bands, band_rows), f"id {kind}, print bigint, key binary, bands array<bigint>"), f"{folder}/rows")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("copy_id"), F.min_by("print", F.struct(F.col("id").isNull(), "id", "print")).alias("copy_print"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes, f"{folder}/classes")
    slots = classes.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.col("band").cast("int").alias("band"), F.xxhash64("band", "value").alias("bucket"))
    shared = slots.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = slots.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    meets = members.join(classes.select("key", "bands"), "key").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meets = meets.select("bucket", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "bands")
    place, order = ["bucket", "i", "j"], ["bucket", "i", "j", "key"]
    needed = meets.repartition(*place).sortWithinPartitions(*order).mapInArrow(_needed(bands), "bucket bigint, band int, i int, j int, block int, key binary")
    needed = written(needed, f"{folder}/needed")
    wanted = written(needed.select("key").distinct().join(classes, "key"), f"{folder}/wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    asked = wanted.select("copy_id", "copy_print")
    texts = docs.join(F.broadcast(asked) if few else asked, (F.col("print") == F.col("copy_print")) & F.col("id").eqNullSafe(F.col("copy_id")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "key binary, shingles array<bigint>").join(wanted, "key").dropDuplicates(["key"])
    sets = written(sets.select("key", "copies", "bands", "shingles"), f"{folder}/sets")
    full = needed.join(sets, "key").repartition(*place).sortWithinPartitions(*order)
    links = written(full.mapInArrow(_verified(bands, similarity), "key binary, links bigint, root binary"), f"{folder}/links")
    roots = components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    found = classes.select("key", "copy_id", "copy_print", "copies").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return rows.select("id", "print", "key"), written(found, f"{folder}/found")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = 1 - 1e-6) -> DataFrame:
    """One row per row of df: id, class_id (least id among the texts that hang
    together by links), copy_id (least id with the same shingles) and n_links
    (other rows whose text is at least this similar)."""
    rows, found = _joined(df, id_col, text_col, similarity, recall, shared_folder(df.sparkSession))
    named = found.join(found.groupBy("root").agg(F.min("copy_id").alias("class_id")), "root").select("key", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # a class of very many copies is dealt to several tasks; texts without words need no join
    out = dealt_join(rows.filter("key IS NOT NULL"), named, "key", "id", "inner").unionByName(rows.filter("key IS NULL"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of similar texts: that of the least
    id (null ids last), then of the least hash of its text. Texts without words
    all stay. A row is known by its id and text, so null and repeated ids keep
    what isn't similar; of rows equal in both the one whose columns have the
    least hash stays."""
    rows, found = _joined(docs, id_col, text_col, SIMILARITY, 1 - 1e-6, folder := shared_folder(docs.sparkSession))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "copy_print")).alias("w")).select("w.copy_id", "w.copy_print")
    # rows that go: those with words that aren't the first of their group
    going = rows.filter("key IS NOT NULL").groupBy("id", "print").agg(F.count("*").alias("n")).join(first, F.col("id").eqNullSafe(F.col("copy_id")) & (F.col("print") == F.col("copy_print")), "left")
    marked = written(going.select(F.col("id").alias("_id"), F.col("print").alias("_print"), F.col("copy_print").isNull().alias("_goes"), "n").filter("_goes OR n > 1"), f"{folder}/going")
    few = marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_print"))
    held = F.broadcast(marked) if few else marked
    stay = docs.join(held.select("_id", "_print"), same, "left_anti")
    if not marked.filter("NOT _goes").limit(1).count():
        return stay
    ordered = F.xxhash64(*[c for c, f in zip(docs.columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()])
    again = docs.join(held.filter("NOT _goes").select("_id", "_print"), same, "inner").groupBy("_id", "_print").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), ordered).alias("row")).select("row.*")
    return stay.unionByName(again)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({SHINGLE_SQL}) AS g FROM words),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c, x.n AS na, y.n AS nb FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 10000 >= 8000 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS class_id,
    least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE l.a = d.doc_id AND c = na AND c = nb), d.doc_id)) AS copy_id,
    (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""
