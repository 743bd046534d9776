"""Importance resampling towards a target: hashed n-gram weights, one draw.

Words are those of ascii_words; a document's features are its runs of 1 to
`order` consecutive words, repeats counted, each in the bucket that the crc32 of
its bytes, words joined by one space, gives. The logarithm of how much more
often the target's texts use a bucket than all documents do is the bucket's
gain, a document's weight the sum of its features' gains. To each weight a
Gumbel number made from the document's id is added, and of the documents with
enough words the share asked for with the highest scores is drawn: a draw without
replacement, in proportion to the weights, that reruns repeat.

A long text is split at word boundaries into chunks that go to different tasks.
A chunk owns the features that start at its own words and carries order - 1 words
of the next chunk to complete them; counts and weights are summed by document.
What the driver sees is one count and gain for each bucket. The ranks come from
a range sort, whose parts are numbered on their own and then moved by the sizes
of those before them.

Null and empty texts have no features and weight 0. Each row is a document of its
own, repeated ids included; equal rows get consecutive ranks. A null id counts as
an empty text in the Gumbel number and comes last among ties. No target texts:
gains tell of the documents alone. Empty tables give an empty result. Only the id
and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.llm.ascii_words import WINDOW, Words, text_bytes, word_spans
from sleuthframe.llm.common import pieces, shared_folder, table, written

#: Longest run of words, buckets, seed of the draw, percent to draw, and words of a document that may be drawn.
ORDER, BUCKETS, SEED, SHARE, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of text above which a document is split, and of its chunks.
CHUNK = 65_536


def _chunked(order: int, chunk: int):
    """(id, key, head, owned, text): the chunks of each text. key: what equal
    texts share; head: whether it is the text's first; owned: its own words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw, offsets = text_bytes(row.column("text"))
                begin, end = word_spans(raw, offsets)
                if not len(begin):
                    # one empty chunk stands for a text without words
                    begin, end = np.zeros(1, np.int64), np.zeros(1, np.int64)
                first = np.unique(np.searchsorted(begin, np.arange(0, len(raw), chunk)))
                first = first[first < len(begin)]
                after = np.append(first[1:], len(begin))
                last = end[np.minimum(after + order - 1, len(begin)) - 1]
                own = (after - first) * (last > begin[first])
                key = xxhash.xxh3_128_digest(raw)
                for a in range(0, len(first), 64):
                    b = min(a + 64, len(first))
                    texts = [raw[begin[f] : e].tobytes() for f, e in zip(first[a:b], last[a:b], strict=True)]
                    head = np.arange(a, b) == 0
                    yield pa.record_batch([pc.take(row.column("id"), pa.array(np.zeros(b - a, np.int64))), pa.array([key] * (b - a), pa.binary()), pa.array(head), pa.array(own[a:b]), pa.array(texts, pa.binary())], ["id", "key", "head", "owned", "text"])

    return run


def chunks(docs: DataFrame, order: int = ORDER, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """docs(id, text) as (short texts, chunks of the others, dealt out and written)."""
    kind = docs.schema["id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    cut = docs.filter(size > chunk).mapInArrow(_chunked(order, chunk), f"id {kind}, key binary, head boolean, owned bigint, text binary")
    return docs.filter(size <= chunk), written(cut.repartition(F.xxhash64("text")), f"{shared_folder(docs.sparkSession)}/chunks")


def features(words: Words, owned: np.ndarray | None, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its text) of each feature of some texts; owned: how many
    words of each may begin one, if not all."""
    texts, code, owner = words.texts.to_pylist(), words.code, words.owner()
    count = np.diff(words.first)
    place = np.arange(len(code)) - words.first[:-1][owner]
    begins = place < (count if owned is None else owned)[owner]
    state = np.array([zlib.crc32(t) for t in texts], np.uint32)[code] if texts else np.zeros(0, np.uint32)
    found, owners = [], []
    for n in range(1, order + 1):
        whole = begins & (place + n <= count[owner])
        found.append(state[whole] % buckets)
        owners.append(owner[whole])
        if n < order:
            on = np.flatnonzero(begins & (place + n < count[owner]))
            pair, back = np.unique(state[on].astype(np.uint64) << np.uint64(32) | code[on + n].astype(np.uint64), return_inverse=True)
            state[on] = np.array([zlib.crc32(b" " + texts[p & 0xFFFFFFFF], p >> 32) for p in pair.tolist()], np.uint32)[back]
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def _owned(part: pa.RecordBatch) -> np.ndarray | None:
    return part.column("owned").to_numpy() if "owned" in part.schema.names else None


def _counted(order: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text", WINDOW):
                total += np.bincount(features(Words(part.column("text")), _owned(part), order, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(parts: tuple[DataFrame, ...], order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the texts are in each bucket: a task adds up its own."""
    total = np.zeros(buckets, np.int64)
    for texts in parts:
        columns = [c for c in ("owned", "text") if c in texts.columns]
        made = texts.select(columns).mapInArrow(_counted(order, buckets), "bucket int, n bigint")
        for bucket, n in made.groupBy("bucket").agg(F.sum("n")).collect():
            total[bucket] += n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray, order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", WINDOW):
                words, owned = Words(part.column("text")), _owned(part)
                bucket, owner = features(words, owned, order, len(gain))
                n = np.bincount(owner, minlength=part.num_rows)
                sums = np.zeros(part.num_rows, np.int64)
                np.add.at(sums, owner, gain[bucket])
                own = np.diff(words.first) if owned is None else owned
                kept = [c for c in ("id", "key", "head") if c in part.schema.names]
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array(own.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(sums)], [*kept, "n_words", "n_features", "weight"])

    return run


def weights(short: DataFrame, long: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """(id, n_words, n_features, weight) of each document of chunks()."""
    kind = short.schema["id"].dataType.simpleString()
    numbers = "n_words bigint, n_features bigint, weight bigint"
    whole = short.mapInArrow(_weighed(gain, order), f"id {kind}, {numbers}")
    parts = long.mapInArrow(_weighed(gain, order), f"id {kind}, key binary, head boolean, {numbers}")
    sums = parts.groupBy("id", "key").agg(F.sum(F.col("head").cast("int")).alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    # equal rows have equal sums, so each has its part of them
    each = sums.select("id", F.explode(F.sequence(F.lit(1), F.col("copies"))), *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")))
    return whole.unionByName(each.drop("col"))


def gumbel(id_text: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the sha256 of seed:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS, chunk: int = CHUNK) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of docs; rank: its place
    in the draw, null if it isn't drawn."""
    folder = shared_folder(docs.sparkSession)
    short, long = chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), order, chunk)
    aims = chunks(target.select(F.lit(None).cast("long").alias("id"), F.col(target_col).cast("string").alias("text")), order, chunk)
    gain = gains(bucket_counts((short, long), order, buckets), bucket_counts(aims, order, buckets))
    rows = weights(short, long, gain, order)
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("id").cast("string"), seed)).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, f"{folder}/scored")
    able = F.col("n_words") >= least_words
    draw = rows.filter(able).count() * share // 100
    order_by = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("row")]
    # the high bits of this number tell the part of the range sort, the low ones the place in it
    placed = written(rows.filter(able).repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("at", F.monotonically_increasing_id()), f"{folder}/placed")
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row for each part
    parts = F.broadcast(parts.select("part", before.alias("before")))
    ranks = placed.withColumn("part", part).join(parts, "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    out = ranks.select("id", "n_features", "weight", "score", "rank").unionByName(rows.filter(~able).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    return out.withColumnRenamed("id", id_col)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_BUCKETS_SQL = r"""unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"""
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
f AS (SELECT r, {_BUCKETS_SQL.format(text="text")} FROM d),
a AS (SELECT {_BUCKETS_SQL.format(text="text")} FROM benchmark),
h AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM f UNION SELECT word FROM a)),
b AS (SELECT word, list_transform(range(1, len(x) + 1, 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1) AS bytes FROM h),
c AS (SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(bytes, lambda y: [CAST(y AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, y: xor(xor(s, y) >> 1, (xor(s, y) & 1) * 3988292384)), 4294967295) % 10000 AS bucket FROM b),
s AS (SELECT bucket, count(*) AS n FROM f JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM a JOIN c USING (word) GROUP BY bucket),
g AS (SELECT c.word, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM f) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM a) + 10000)))) AS BIGINT) AS gain
    FROM c LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (word) GROUP BY r),
k AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
o AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM k),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM p) THEN rank END AS rank FROM o LEFT JOIN p USING (r)
"""
