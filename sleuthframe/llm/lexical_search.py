"""Ranked lexical search: document shards of integer impacts, exact top k.

Documents become shards as they are read, without a shuffle: a shard holds the
documents of one piece of a batch, numbered by ascending id, and for each of its
terms a posting list, document numbers beside impacts. An impact is what one
term gives to one document before the term's own weight,
(1000000000 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, and is made
once, when the index is written; N and L come from a pass over all documents
before that. A search weighs the queries' terms by their document frequencies in
all shards, takes the postings of those terms alone out of the index, and hands
each shard's to one task. There, term after term is added to a dense array of
the shard's documents; what is at or above the k-th greatest sum is selected,
ties by id. A task merges the best of its shards, and a window those of all tasks.

A term is a maximal run of ASCII letters and digits and of characters beyond
ASCII, A-Z lower-cased. Null texts and texts without terms have none: they
count nowhere and are never found; queries of that kind find nothing. Each row is
a document or a query of its own, repeated ids included: rows of equal score
and id are ranked one after another. Null ids come last among ties. Empty
tables give an empty result. Only the id and text columns are read, so other
columns may have any names. Long texts are counted in parts that are cut between terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.llm.ascii_words import WINDOW, Words, text_bytes, windows, word_spans
from sleuthframe.llm.common import dealt_join, grouped, pieces, shared_folder, table, written

#: (query, term) rows that a search takes to its tasks at once; more queries go in blocks.
BLOCK = 500_000
#: Terms of a block that may be broadcast for the join with the postings.
BROADCAST_TERMS = 200_000
#: Found rows that a task holds before it keeps only the best of each query.
HELD = 1_000_000


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents with terms, terms) of each batch."""
    for batch in batches:
        with_terms, terms = set(), 0
        for at, _, part in windows(batch.column("text")):
            raw, offsets = text_bytes(part)
            count = np.diff(np.searchsorted(word_spans(raw, offsets)[0], offsets))
            with_terms.update((at + np.flatnonzero(count)).tolist())
            terms += int(count.sum())
        yield pa.record_batch([pa.array([len(with_terms)], pa.int64()), pa.array([terms], pa.int64())], ["n", "l"])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """N, the documents with at least one term, and L, all their terms with repeats."""
    n, length = _narrow(docs, id_col, text_col).select("text").mapInArrow(_sizes, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, length or 0


def counted(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, code, document, tf, n): each distinct term of each text of a column
    with its occurrences, sorted by term code and document, and the number of
    terms of each text."""
    n, parts = np.zeros(len(column), np.int64), []
    for at, many, part in windows(column):
        words = Words(part)
        n[at : at + many] += np.diff(words.first)
        pair, tf = np.unique(words.code * many + words.owner(), return_counts=True)
        parts.append((words.texts, pair // many, at + pair % many, tf))
    if not parts:
        return pa.array([], pa.large_binary()), *(np.zeros(0, np.int64) for _ in range(3)), n
    if len(parts) == 1:
        terms, code, doc, tf = parts[0]
        return terms, code, doc, tf.astype(np.int64), n
    coded = pa.chunked_array([p[0] for p in parts]).dictionary_encode().combine_chunks()
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum([0, *(len(p[0]) for p in parts)])
    code = np.concatenate([own[b + p[1]] for b, p in zip(begin, parts, strict=False)])
    pair, back = np.unique(code * len(column) + np.concatenate([p[2] for p in parts]), return_inverse=True)
    tf = np.zeros(len(pair), np.int64)
    np.add.at(tf, back, np.concatenate([p[3] for p in parts]))
    return coded.dictionary, pair // len(column), pair % len(column), tf, n


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The integer impact of each posting: its tf in a document of n terms, among
    so many documents with so many terms altogether."""
    m = 75 + (25 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _sharded(documents: int, terms: int, id_type: pa.DataType, piece: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, made = TaskContext.get(), 0
        task = (context.partitionId() if context else 0) << 32
        names = ["shard", "term", "docs", "impacts", "ids"]
        for batch in batches:
            for part in pieces(batch, "text", piece):
                order = pa.compute.sort_indices(part.column("id"))
                part = part.take(order)
                words, code, doc, tf, n = counted(part.column("text"))
                if not len(code):
                    continue
                bounds = np.searchsorted(code, np.arange(len(words) + 1)).astype(np.int32)
                shard, made = task | made, made + 1
                value = impacts(tf, n[doc], documents, terms).astype(np.int32)
                for a in range(0, len(words), 20_000):
                    b = min(a + 20_000, len(words))
                    own = slice(bounds[a], bounds[b])
                    at = pa.array(bounds[a : b + 1] - bounds[a])
                    yield pa.record_batch(
                        [
                            pa.array(np.full(b - a, shard)),
                            words.slice(a, b - a).cast(pa.binary()),
                            pa.ListArray.from_arrays(at, pa.array(doc[own].astype(np.int32))),
                            pa.ListArray.from_arrays(at, pa.array(value[own])),
                            pa.nulls(b - a, pa.list_(id_type)),
                        ],
                        names,
                    )
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                none = pa.nulls(1, pa.list_(pa.int32()))
                yield pa.record_batch([pa.array([shard]), pa.nulls(1, pa.binary()), none, none, ids], names)

    return run


def index(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", piece: int = WINDOW) -> tuple[DataFrame, int]:
    """The index of docs, written to a folder, and N. Its rows are posting lists
    (shard, term, docs, impacts) and, where term is null, the shard's ids. piece:
    bytes of text in a shard; a longer document is one by itself."""
    narrow = _narrow(docs, id_col, text_col)
    documents, terms = sizes(docs, id_col, text_col)
    kind = narrow.schema["id"].dataType
    run = _sharded(documents, terms, _arrow(kind), piece)
    made = narrow.mapInArrow(run, f"shard bigint, term binary, docs array<int>, impacts array<int>, ids array<{kind.simpleString()}>")
    return written(made, folder), documents


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query number, item id, [(term, occurrences)]) of each item with terms."""
    context, made = TaskContext.get(), 0
    task = (context.partitionId() if context else 0) << 32
    kind = pa.list_(pa.struct([("term", pa.binary()), ("n", pa.int64())]))
    for batch in batches:
        terms, code, doc, tf, _ = counted(batch.column("text"))
        order = np.lexsort((code, doc))
        code, doc, tf = code[order], doc[order], tf[order]
        bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([terms.take(pa.array(code)).cast(pa.binary()), pa.array(tf)], ["term", "n"])
        yield pa.record_batch([pa.array(task | (made + np.arange(batch.num_rows))), batch.column("id"), pa.ListArray.from_arrays(pa.array(bounds), pairs).cast(kind)], ["q", "id", "terms"])
        made += batch.num_rows


def top(sums: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k greatest sums above 0; of equal ones the first."""
    n = int(np.count_nonzero(sums > 0))
    if n <= k:
        return np.flatnonzero(sums > 0)
    least = sums[np.argpartition(sums, len(sums) - k)[len(sums) - k]]
    above = np.flatnonzero(sums > least)
    return np.concatenate([above, np.flatnonzero(sums == least)[: k - len(above)]])


def merged(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, ties by id, null ids last."""
    found = found.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = found.column("q").to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q, "left") < k))


def _scored(asked: pa.Table, k: int, id_type: pa.DataType):
    """The best documents of each task's shards. asked: (q, term, n) of a block, sorted by q."""
    schema = pa.schema([("q", pa.int64()), ("id", id_type), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.column("q").to_numpy()
        coded = asked.column("term").combine_chunks().dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        n = asked.column("n").to_numpy()
        held, rows = [], 0
        for shard in grouped(batches, ["shard"]):
            has_ids = shard.column("ids").is_valid()
            ids = shard.filter(has_ids).column("ids").combine_chunks().flatten()
            lists = shard.filter(pa.compute.invert(has_ids)).combine_chunks()
            if not lists.num_rows:
                continue
            docs, value = lists.column("docs").combine_chunks(), lists.column("impacts").combine_chunks().flatten().to_numpy().astype(np.int64)
            bounds, docs = docs.offsets.to_numpy() - docs.offsets[0].as_py(), docs.flatten().to_numpy()
            weight = lists.column("w").to_numpy()
            # where each term of the block has its list in this shard
            place = np.full(len(terms), -1)
            there = pa.compute.index_in(lists.column("term").combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
            place[there.astype(np.int64)] = np.arange(lists.num_rows)
            some = np.flatnonzero(place[code] >= 0)
            sums = np.zeros(len(ids), np.int64)
            cut = np.flatnonzero(np.diff(q[some], prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(some)], strict=True):
                sums[:] = 0
                for i in some[a:b]:
                    t = place[code[i]]
                    own = slice(bounds[t], bounds[t + 1])
                    sums[docs[own]] += n[i] * weight[t] * value[own]
                best = top(sums, k)
                held.append(pa.table([np.full(len(best), q[some[a]]), ids.take(pa.array(best)), sums[best]], schema=schema))
                rows += len(best)
                if rows > HELD:
                    held = [merged(pa.concat_tables(held), k)]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from held.pop().to_batches(50_000)
                        rows = 0
        if held:
            yield from merged(pa.concat_tables(held), k).combine_chunks().to_batches(50_000)

    return run


def weight(documents: Column, frequency: Column) -> Column:
    """A term's weight: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log((2 * documents + 2) / (2 * frequency + 1))).cast("long")


def search(postings: DataFrame, documents: int, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(item, rank, id, score): the k best documents of an index() for each row of items."""
    spark, folder = items.sparkSession, shared_folder(items.sparkSession)
    kind, item_kind = postings.schema["ids"].dataType.elementType, items.schema[item_col].dataType.simpleString()
    asked = _narrow(items, item_col, text_col).mapInArrow(_asked, f"q bigint, id {item_kind}, terms array<struct<term:binary,n:bigint>>")
    asked = written(asked.filter(F.size("terms") > 0), f"{folder}/asked")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1))).cast("int"))
    results = []
    for b in range(blocks):
        # whole queries, about `block` rows of theirs; a query of more terms makes its block larger
        own = asked.filter(F.col("block") == b).select("q", F.explode("terms").alias("t")).select("q", "t.term", "t.n")
        terms = written(own.select("term").distinct(), f"{folder}/terms{b}")
        few = terms.count() <= BROADCAST_TERMS
        lists = postings.filter("term IS NOT NULL").select("shard", "term", "docs", "impacts")
        hits = lists.join(F.broadcast(terms), "term") if few else dealt_join(lists, terms, "term", "shard", "inner")
        hits = written(hits, f"{folder}/hits{b}")
        weights = hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).select("term", weight(F.lit(documents), F.col("df")).alias("w"))
        weighed = hits.join(F.broadcast(weights), "term") if few else dealt_join(hits, weights, "term", "shard", "inner")
        ids = postings.filter("term IS NULL").select("shard", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("array<int>").alias("docs"), F.lit(None).cast("array<int>").alias("impacts"), F.lit(None).cast("long").alias("w"), "ids")
        rows = weighed.select("shard", "term", "docs", "impacts", "w", F.lit(None).cast(postings.schema["ids"].dataType).alias("ids")).unionByName(ids)
        rows = rows.repartition("shard").sortWithinPartitions("shard")
        run = _scored(own.orderBy("q", "term").toArrow(), k, _arrow(kind))
        results.append(written(rows.mapInArrow(run, f"q bigint, id {kind.simpleString()}, score bigint"), f"{folder}/found{b}"))
    found = results[0] if results else spark.createDataFrame([], f"q bigint, id {kind.simpleString()}, score bigint")
    for r in results[1:]:
        found = found.union(r)
    best = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = asked.select("q", F.col("id").alias(item_col))
    return names.join(ranked, "q").select(item_col, "rank", F.col("id").alias(id_col), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, documents = index(table(spark, sf_dir, "documents"))
    return search(postings, documents, table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, r, term, count(*) AS n FROM (SELECT item_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT r, count(*) AS n FROM d GROUP BY r),
g AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
m AS (SELECT r, 75 + (25 * n * all_docs) // all_terms AS m FROM lengths, g),
p AS (SELECT doc_id, r, term, count(*) AS tf FROM d SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, all_docs),
s AS (SELECT item_id, i.r AS q, doc_id, p.r, CAST(sum(i.n * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM i JOIN p USING (term) JOIN w USING (term) JOIN m ON m.r = p.r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
"""
