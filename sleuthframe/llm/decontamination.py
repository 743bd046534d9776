"""Benchmark items inside documents, by containment of their word shingles.

Items are partitioned by size. An item of n distinct shingles whose containment
must reach c needs at least ceil(c n) of them in the document, so of its
n - ceil(c n) + 1 least MinHash values one at least is a shingle of the document.
Each size partition takes the sketch length of its largest size; a document is
probed with the sketches of all partitions, and exact containment over all the
item's shingles decides. So the search is exact, however long the document is.

An item of one to four words is one shingle of all its words, and documents are
cut into shingles of as many words to look for it. Shingles are compared as
64-bit values; of what they find, the words themselves decide, in the path that
shuffles as in the other.

Null, empty and wordless texts or items match nothing. Repeated rows give
repeated results, null ids stay null. Either table empty: no rows. Only ids and
texts are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import dealt_join, kept, pieces, shared_folder, table, written
from sleuthframe.llm.shingles import SHINGLE_SQL, SIMILARITY, WORDS, WORDS_SQL, constants, distinct, joined_words, shingles, split_words, words

#: Items' shingles (8 bytes each) and bytes of text that may be sent to every worker; more are joined by shuffling.
BROADCAST_SHINGLES, BROADCAST_BYTES = 2_000_000, 64_000_000


def least_shared(n: np.ndarray, containment: float) -> np.ndarray:
    """ceil(containment * n) in whole numbers."""
    return -(-(np.asarray(n, np.int64) * round(containment * 10_000)) // 10_000)


def sketch_length(n: np.ndarray, containment: float) -> np.ndarray:
    """How many least MinHash values stand for an item of n shingles: what the
    largest size of its partition, sizes from 2**p to 2**(p+1) - 1, needs."""
    upper = (1 << np.frexp(np.asarray(n, float))[1].astype(np.int64)) - 1
    return np.minimum(n, upper - least_shared(upper, containment) + 1)


def _items(containment: float):
    """(item, n, shingles in MinHash order, length of the sketch, words, text) of
    each item; words: of one shingle."""
    xor, factor = constants(1, 41)[0], constants(1, 43)[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                hashes, bounds = words(texts)
                sets, offsets = distinct(*joined_words(hashes, bounds, WORDS))
                found = [s[np.argsort((s ^ xor) * factor)] for s in (sets[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))]
                size = np.diff(offsets)
                length = np.where(size > 0, sketch_length(np.maximum(size, 1), containment), 0)
                yield pa.record_batch([part.column("id"), pa.array(size), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array(length), pa.array(np.minimum(np.diff(bounds), WORDS)), pa.array(texts, pa.string())], ["item", "n", "shingles", "sketch", "words", "text"])

    return run


def word_shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    """The shingles of n words as words; fewer words are one shingle."""
    found = split_words(text)
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


class Index:
    """Sketches of a bounded set of items (item, shingles, sketch, words, text),
    probed with whole documents."""

    def __init__(self, items: list[tuple]):
        self.ids = [i[0] for i in items]
        self.words = np.array([i[3] for i in items], np.int64)
        self.sets = [np.sort(np.array(i[1], np.int64).view(np.uint64)) for i in items]
        self.exact = [word_shingles(i[4], i[3]) for i in items]
        sketch = [np.array(s[:k], np.int64).view(np.uint64) for _, s, k, _, _ in items]
        values = np.concatenate([*sketch, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(s) for s in sketch])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.values >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, texts: list[str | None], containment: float) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of the pairs that reach the containment."""
        hashes, bounds = words(texts)
        out = []
        for n in np.unique(self.words).tolist():
            out += self._matches(texts, *joined_words(hashes, bounds, n, short=n == WORDS), n, containment)
        return out

    def _matches(self, texts: list[str | None], hashes: np.ndarray, offsets: np.ndarray, n: int, containment: float) -> Iterator[tuple[int, int, int]]:
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        low, high = np.searchsorted(self.values, hashes[maybe], "left"), np.searchsorted(self.values, hashes[maybe], "right")
        text = np.searchsorted(offsets, maybe, "right") - 1
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        pairs = np.unique(np.stack([np.repeat(text, count), self.owner[at]]), axis=1)
        pairs = pairs[:, self.words[pairs[1]] == n]
        last, own, exact = -1, None, None
        for t, i in pairs.T.tolist():
            if t != last:
                last, own, exact = t, np.unique(hashes[offsets[t] : offsets[t + 1]]), None
            if int(np.isin(self.sets[i], own, assume_unique=True).sum()) < least_shared(len(self.sets[i]), containment):
                continue
            exact = word_shingles(texts[t], n) if exact is None else exact
            shared = len(self.exact[i] & exact)
            if shared >= least_shared(len(self.exact[i]), containment):
                yield t, i, shared


def _probe(name: str, shared_items, containment: float, item_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept(("items", name), lambda: Index(shared_items.value))
        for batch in batches:
            for part in pieces(batch, "text"):
                found = index.matches(part.column("text").to_pylist(), containment)
                at = pa.array([t for t, _, _ in found], pa.int64())
                yield pa.record_batch([part.column("id").take(at), part.column("print").take(at), pa.array([index.ids[i] for _, i, _ in found], item_type), pa.array([k for _, _, k in found], pa.int64()), pa.array([len(index.exact[i]) for _, i, _ in found], pa.int64())], ["id", "print", "item", "shared", "n"])

    return run


def _document_sets(sizes: list[int]):
    """(id, print, row, shingles) of each text, with shingles of all these sizes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, bounds = words(part.column("text").to_pylist())
                found = [joined_words(hashes, bounds, n, short=n == WORDS) for n in sizes]
                owner = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(o)) for _, o in found])
                order = np.argsort(owner, kind="stable")
                sets, offsets = distinct(np.concatenate([h for h, _ in found])[order], np.searchsorted(owner[order], np.arange(part.num_rows + 1)))
                yield pa.record_batch([part.column("id"), part.column("print"), part.column("row"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sets.view(np.int64)))], ["id", "print", "row", "shingles"])

    return run


def text_print(column: str) -> Column:
    """A 64-bit value that, beside an id, tells which row's text is meant."""
    return F.xxhash64(F.col(column).cast("string"))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, containment: float, broadcast_shingles: int) -> DataFrame:
    """(id, print, item, shared, n) for each document and item that it contains."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_print(text_col).alias("print"))
    kind, item_kind = narrow.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    asked = written(asked.mapInArrow(_items(containment), f"item {item_kind}, n bigint, shingles array<bigint>, sketch bigint, words bigint, text string").filter("n > 0").withColumn("k", F.monotonically_increasing_id()), f"{folder}/items")
    schema = f"id {kind}, print bigint, item {item_kind}, shared bigint, n bigint"
    n_shingles, n_bytes = asked.agg(F.sum("n"), F.sum(F.octet_length("text"))).first()
    if (n_shingles or 0) <= broadcast_shingles and (n_bytes or 0) <= BROADCAST_BYTES:
        from pyspark.sql.pandas.types import to_arrow_type

        held = spark.sparkContext.broadcast([tuple(r) for r in asked.select("item", "shingles", "sketch", "words", "text").collect()])
        return narrow.mapInArrow(_probe(folder, held, containment, to_arrow_type(asked.schema["item"].dataType)), schema)
    sizes = sorted(r["words"] for r in asked.select("words").distinct().collect())
    rows = narrow.withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.mapInArrow(_document_sets(sizes), f"id {kind}, print bigint, row bigint, shingles array<bigint>"), f"{folder}/sets")
    each = rows.select("row", F.explode("shingles").alias("g"))
    sketch = asked.select("k", F.explode(F.slice("shingles", F.lit(1), F.col("sketch").cast("int"))).alias("g"))
    pairs = written(dealt_join(each, sketch, "g", "row", "inner").select("row", "k").distinct(), f"{folder}/pairs")
    found = dealt_join(pairs, asked.select("k", "n", "shingles"), "k", "row", "inner").join(rows.select("id", "print", "row", F.col("shingles").alias("own")), "row")
    found = found.withColumn("shared", F.size(F.array_intersect("shingles", "own"))).filter(F.col("shared") * 10_000 >= F.col("n") * round(containment * 10_000))
    found = written(found.select("id", "print", "row", "k"), f"{folder}/found")
    # the texts of what the values found: equal ids and prints are equal texts, of which one is enough
    meant = found.select(F.col("id").alias("_id"), F.col("print").alias("_print")).distinct()
    texts = narrow.join(meant, narrow["id"].eqNullSafe(meant["_id"]) & (narrow["print"] == meant["_print"]), "left_semi").dropDuplicates(["id", "print"]).select(F.col("id").alias("_id"), F.col("print").alias("_print"), "text")
    both = found.join(texts, found["id"].eqNullSafe(texts["_id"]) & (found["print"] == texts["_print"])).select("id", "print", "row", "k", "text")
    both = dealt_join(both, asked.select("k", "item", "words", F.col("text").alias("item_text")), "k", "row", "inner")
    return both.mapInArrow(_verified(containment), schema)


def _verified(containment: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared, sizes = [], [], []
            for i in range(batch.num_rows):
                text, item, n = (batch.column(c)[i].as_py() for c in ("text", "item_text", "words"))
                asked = word_shingles(item, n)
                both = len(asked & word_shingles(text, n))
                if both >= least_shared(len(asked), containment):
                    keep.append(i)
                    shared.append(both)
                    sizes.append(len(asked))
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(at) for c in ("id", "print", "item")), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], ["id", "print", "item", "shared", "n"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = SIMILARITY, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(id, item, containment) for each document and item that it contains."""
    found = _found(docs, items, id_col, text_col, item_col, item_text_col, containment, broadcast_shingles)
    return found.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), (F.col("shared") / F.col("n")).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that contain an item. A row goes by its id and text, so
    null and repeated ids take no other rows with them."""
    gone = written(_found(docs, items, id_col, text_col, "item_id", "text", SIMILARITY, BROADCAST_SHINGLES).select(F.col("id").alias("_id"), F.col("print").alias("_print")).distinct())
    few = gone.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES // 4
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].eqNullSafe(F.col("_id")) & (text_print(text_col) == F.col("_print")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = rf"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
iw AS (SELECT row_number() OVER () AS k, item_id, {WORDS_SQL} AS w FROM benchmark), sizes AS (SELECT DISTINCT least(len(w), 5) AS s FROM iw WHERE len(w) > 0),
d AS (SELECT DISTINCT r, doc_id, s, unnest(CASE WHEN s = 5 THEN {SHINGLE_SQL} ELSE list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' ')) END) AS g FROM dw, sizes),
i AS (SELECT DISTINCT k, item_id, least(len(w), 5) AS s, unnest({SHINGLE_SQL}) AS g FROM iw),
n AS (SELECT k, count(*) AS n FROM i GROUP BY k)
SELECT doc_id, item_id, count(*) / n AS containment
FROM d JOIN i USING (s, g) JOIN n USING (k) GROUP BY r, k, doc_id, item_id, n HAVING count(*) * 10000 >= n * 8000
"""
