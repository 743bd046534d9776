"""Approximate nearest neighbours by cross-polytope hashing.

Vectors become unit vectors by one more coordinate, so that the largest inner
product is the nearest direction. A hash function turns them with three rounds
of sign flips and a fast Hadamard transform and gives the nearest signed axis. A
table concatenates as many functions as it takes for the axes of all but the
last to part the vectors into groups of no more than SLICE on average; the last
axis parts a group once more. A query looks under its best combinations of axes
in every table, as many as a bounded sample of queries, ranked against all
vectors, shows are needed for the recall asked for. If MOST_PROBES combinations
don't reach it, the number of tables is doubled, up to MOST_TABLES; if that
doesn't either, nothing is hashed and all queries are ranked against all
candidates in blocks. What a query finds is ranked by the exact inner product of the original vectors.

Only candidates of like norms share tables: they are parted into shells by
norm, each with a longest of its own, for next to one far longer vector all
others would point alike. Neighbouring shells that together fit one slice are
not hashed but ranked whole. A query that has then found fewer rows than are
due is ranked against all candidates in blocks.

Equal vectors are one candidate that stands for its least ids, as many as a
query can return. A crowded group is dealt to slices, of candidates and of
queries, so a task holds a bounded part of it. Vectors that are null, zero or
hold null or non-finite components, and rows with a null id, take no part;
shorter vectors count as padded with zeros. Rows that repeat an id and vector
count once. With fewer candidates than asked for, a query gets all of them.
Ties, of equal exact inner products, go to the smaller id; an inner product that
is not a number, of terms beyond the range of doubles, comes last. Norms are held
as logarithms, so that no vector is too long or too short for them. Empty tables give an
empty result; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.llm.common import grouped, shared_folder, table, written
from sleuthframe.llm.shingles import constants

#: Tables; the share of true neighbours that a sample of so many queries must find; combinations of axes that a query may look under in a table; and tables that may be tried.
TABLES, RECALL, SAMPLE, MOST_PROBES, MOST_TABLES = 12, 0.95, 100, 4096, 48
#: Rows of one group that a slice holds.
SLICE = 4096
#: Pairs of vectors that are multiplied at once.
PAIRS = 50_000
#: Shells in each halving of the norm.
SHELLS = 2
#: Found pairs that a task holds before it keeps only the best of each query.
HELD = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """x under the pseudo-rotation of one table."""
    for k in range(3):
        signs = np.where(constants(x.shape[1], 1000 * which + 7 * k + 1) >> np.uint64(63), -1.0, 1.0)
        x = hadamard(x * signs)
    return x


def functions_needed(n: int, dims: int) -> int:
    """How many hash functions a table of n vectors concatenates."""
    m = 1
    while n > SLICE * (2 * dims) ** (m - 1):
        m += 1
    return m


def filed_under(x: np.ndarray, table: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a table files each row: (group, last axis). A signed axis is i or
    dims + i; the axes of all functions but the last make up the group."""
    group = np.zeros(len(x), np.int64)
    for f in range(functions):
        turned = rotated(x, table * 16 + f)
        both = np.concatenate([turned, -turned], 1)
        axis = both.argmax(1)
        if f < functions - 1:
            group = group * both.shape[1] + axis
    return group, axis


def looked_under(x: np.ndarray, table: int, functions: int, probes: int, most: int = MOST_PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Where a table has each row of x look, best first: (groups, last axes), two
    matrices. A combination of axes is as good as its functions' squared
    shortfalls from their nearest axes are small. most: combinations that are looked at."""
    wide = min(2 * x.shape[1], max(1, int(most ** (1 / functions))))
    loss, group = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for f in range(functions):
        turned = rotated(x, table * 16 + f)
        both = np.concatenate([turned, -turned], 1)
        axis = np.argsort(-both, axis=1, kind="stable")[:, :wide]
        short = np.take_along_axis(both, axis, 1)
        short = (short[:, :1] - short) ** 2
        loss = (loss[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        last = np.tile(axis, (1, group.shape[1]))
        group = np.repeat(group, wide, axis=1) * (both.shape[1] if f < functions - 1 else 1) + (last if f < functions - 1 else 0)
    order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(group, order, 1), np.take_along_axis(last, order, 1)


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column as rows of float64, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def log_norm(vector: str) -> Column:
    """log2 of the norm of an array of doubles that is neither empty nor zero;
    squares are of the components over the largest, so none leaves a double's range."""
    most = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    return F.log2(most) + 0.5 * F.log2(squares)


def on_sphere(x: np.ndarray, longest: float, *, query: bool) -> np.ndarray:
    """Unit vectors of which queries and candidates have inner products in the
    order of the original ones. longest: log2 of the greatest norm of candidates.
    The last coordinate of x is free for that."""
    if query:
        out = x / np.abs(x).max(1, keepdims=True)
        return out / np.linalg.norm(out, axis=1, keepdims=True)
    whole = int(np.floor(longest))
    out = np.ldexp(x, -whole) * 2.0 ** (whole - longest)
    out[:, -1] = np.sqrt(np.maximum(0, 1 - (out * out).sum(1)))
    return out


def _filed(dims: int, shells: list[tuple[float, bool]], tables: int, functions: int, probes: int, most: int):
    """(g, kind, at) of each vector, and once more as a query: at holds (table,
    group, last axes) of where it is filed or looks. Each shell, (longest, is
    ranked whole), has tables of its own, and one with one group if it is ranked
    whole."""
    place = pa.struct([("t", pa.int32()), ("p", pa.int64()), ("last", pa.list_(pa.int32()))])

    def rows(g: np.ndarray, kind: int, owner: np.ndarray, t: np.ndarray, p: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        """Rows of g, of whose indices owner holds one for each axis looked under."""
        order = np.lexsort((last, p, t, owner))
        owner, t, p, last = owner[order], t[order], p[order], last[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        first = np.flatnonzero(new)
        lasts = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(last.astype(np.int32)))
        at = pa.StructArray.from_arrays([pa.array(t[first].astype(np.int32)), pa.array(p[first]), lasts], fields=list(place))
        bounds = np.searchsorted(owner[first], np.arange(len(g) + 1)).astype(np.int32)
        return pa.record_batch([pa.array(g), pa.array(np.full(len(g), kind, np.int32)), pa.ListArray.from_arrays(pa.array(bounds), at)], ["g", "kind", "at"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                asked = np.flatnonzero(batch.column("query").to_numpy(zero_copy_only=False).astype(bool))
                x, group, shell = matrix(batch.column("vector"), dims), batch.column("g").to_numpy(), batch.column("shell").to_numpy()
                asking = on_sphere(x[asked], 0.0, query=True)
                hashed = not all(exact for _, exact in shells)
                found: tuple[list, list] = ([], [])
                looks = [looked_under(asking, k, functions, probes, most) for k in range(tables)] if hashed and len(asked) else []
                for s, (longest, exact) in enumerate(shells):
                    there = np.flatnonzero(shell == s)
                    if exact:
                        for rows_, kind in ((there, 0), (np.arange(len(asked)), 1)):
                            found[kind].append([rows_, np.full(len(rows_), s * tables), np.zeros(len(rows_), np.int64), np.zeros(len(rows_), np.int64)])
                        continue
                    points = on_sphere(x[there], longest, query=False)
                    for k in range(tables):
                        p, last = filed_under(points, k, functions)
                        found[0].append([there, np.full(len(there), s * tables + k), p, last])
                        if len(asked):
                            p, last = looks[k]
                            found[1].append([np.repeat(np.arange(len(asked)), p.shape[1]), np.full(p.size, s * tables + k), p.reshape(-1), last.reshape(-1)])
                yield rows(group, 0, *map(np.concatenate, zip(*found[0], strict=True)))
                if len(asked):
                    yield rows(group[asked], 1, *map(np.concatenate, zip(*found[1], strict=True)))

    return run


def best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best found of each query, each once; ties to the smaller id."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
    query, found, score = query[new], found[new], score[new]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], found[keep], score[keep]


def _scored(x: np.ndarray, asked: np.ndarray, there: np.ndarray, own: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, exact inner product), PAIRS or so at once: each query
    against those of `there` whose last axis, sorted in `own`, it looks under."""
    size = bounds[asked + 1] - bounds[asked]
    at = np.arange(size.sum()) + np.repeat(bounds[asked] - np.cumsum(size) + size, size)
    low, high = np.searchsorted(own, last[at], "left"), np.searchsorted(own, last[at], "right")
    asking, count = np.repeat(asked, size)[high > low], (high - low)[high > low]
    low = low[high > low]
    total, begin = np.cumsum(count), 0
    while begin < len(count):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        n = count[begin:end]
        q = np.repeat(asking[begin:end], n)
        c = there[np.arange(n.sum()) + np.repeat(low[begin:end] - np.cumsum(n) + n, n)]
        # always the same sum over one row, so that equal vectors tie
        yield q, c, (x[c] * x[q]).sum(-1)
        begin = end


def falling() -> Column:
    """Scores from the highest; what is not a number comes last."""
    return F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double")))


def _searched(dims: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def cut() -> None:
            nonlocal held, rows
            held = [best(*map(np.concatenate, zip(*held, strict=True)), k)]
            rows = len(held[0][0])

        def out() -> Iterator[pa.RecordBatch]:
            cut()
            for a in range(0, rows, 50_000):
                yield pa.record_batch([pa.array(c[a : a + 50_000]) for c in held[0]], ["gq", "g", "score"])
            held.clear()

        for group in grouped(batches, ["t", "p", "c", "q"]):
            kind, name = group.column("kind").to_numpy(), group.column("g").to_numpy()
            if kind[0] == kind[-1]:
                continue
            x, lists = matrix(group.column("vector"), dims), group.column("last").combine_chunks()
            last, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            last, bounds = last, bounds - bounds[0]
            asked, there = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
            own = last[bounds[there]]
            order = np.argsort(own, kind="stable")
            own, there = own[order], there[order]
            for q, c, score in _scored(x, asked, there, own, last, bounds):
                held.append(best(name[q], name[c], score, k))
                rows += len(held[-1][0])
                if rows > HELD:
                    cut()
                    if rows > HELD // 2:
                        yield from out()
                        rows = 0
        if held:
            yield from out()

    return run


def _shells(groups: DataFrame, longest: float) -> tuple[list[tuple[float, bool]], DataFrame]:
    """(log2 of the longest norm, is ranked whole) of each shell, and groups with the number of
    their shell. Neighbours that fit one slice together become one shell."""
    ring = F.floor(F.least(F.lit(5000.0), SHELLS * (F.lit(longest) - F.col("norm")))).cast("int")
    groups = groups.withColumn("ring", ring)
    shells, number, room = [], [], 0
    # a row for each ring that has vectors: SHELLS for each halving of the longest norm
    for r in groups.groupBy("ring").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy("ring").collect():
        if not shells or not shells[-1][1] or r["n"] > room:
            room = SLICE
            shells.append((r["longest"], r["n"] <= SLICE))
        room -= r["n"]
        number.append((r["ring"], len(shells) - 1))
    named = groups.sparkSession.createDataFrame(number, "ring int, shell int")
    return shells, groups.join(F.broadcast(named), "ring").drop("ring")


def _completed(groups: DataFrame, found: DataFrame, k: int, dims: int, folder: str) -> DataFrame:
    """found(gq, g, score), where queries that found fewer rows than are due are
    ranked against all groups, in blocks of candidates and queries."""
    sizes = groups.select("g", F.size("members").alias("size"))
    n_groups, rows = sizes.agg(F.count("*"), F.sum("size")).first()
    due = min(k, (rows or 0) - 1)
    got = found.join(sizes, "g").groupBy("gq").agg((F.sum("size") - F.max((F.col("gq") == F.col("g")).cast("int"))).alias("got"))
    asking = groups.filter("query").select(F.col("g").alias("gq"), "vector")
    short = written(asking.join(got, "gq", "left").filter(F.coalesce("got", F.lit(0)) < due).drop("got"), f"{folder}/short")
    n_short = short.count()
    if not n_short:
        return found
    blocks, parts = -(-n_groups // SLICE), -(-n_short // SLICE)

    def dealt(name: str, n: int):
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none, whole = [F.lit(0).alias("t"), F.lit(0).cast("long").alias("p")], F.array(F.lit(0)).alias("last")
    there = groups.select(*none, dealt("g", blocks).alias("c"), each(parts).alias("q"), F.lit(0).alias("kind"), "g", whole, "vector")
    asked = short.select(*none, each(blocks).alias("c"), dealt("gq", parts).alias("q"), F.lit(1).alias("kind"), F.col("gq").alias("g"), whole, "vector")
    dealt_out = there.union(asked).repartition("t", "p", "c", "q").sortWithinPartitions("t", "p", "c", "q", "kind")
    ranked = dealt_out.mapInArrow(_searched(dims, k + 1), "gq bigint, g bigint, score double")
    order = W.partitionBy("gq").orderBy(falling(), "g")
    ranked = ranked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return found.select("gq", "g", "score").join(short.select("gq"), "gq", "left_anti").union(ranked.select("gq", "g", "score"))


def _ranked(dims: int, queries: np.ndarray, names: np.ndarray, k: int):
    """The k best candidates, with their vectors, of each of a few queries, in
    the rows of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, g = matrix(batch.column("vector"), dims), batch.column("g").to_numpy()
            near = queries @ x.T
            near[names[:, None] == g[None, :]] = -np.inf
            n = min(k, len(g))
            top = np.argpartition(-near, n - 1, axis=1)[:, :n]
            yield pa.record_batch([pa.array(np.repeat(names, n)), pa.array(g[top].reshape(-1)), pa.array(np.take_along_axis(near, top, 1).reshape(-1)), batch.column("vector").take(pa.array(top.reshape(-1))), batch.column("shell").take(pa.array(top.reshape(-1)))], ["gq", "g", "score", "vector", "shell"])

    return run


def probes_needed(points: DataFrame, shells: list[tuple[float, bool]], dims: int, functions: int, k: int, tables: int, recall: float, most: int = MOST_PROBES, sample: int = SAMPLE) -> tuple[int, int] | None:
    """(tables, combinations that a query must look under in each), so that a
    sample of queries (those of least hash, at most `sample`) finds the share
    `recall` of the k best of all candidates; None if MOST_TABLES tables don't
    reach it. The driver gets sample x k rows."""
    asking = points.filter("query").orderBy(F.xxhash64("g"), "g").limit(sample).select("g", "vector").collect()
    if not asking:
        return tables, 1
    x, names = np.zeros((len(asking), dims)), np.array([r["g"] for r in asking])
    for i, r in enumerate(asking):
        x[i, : len(r["vector"])] = r["vector"]
    order = W.partitionBy("gq").orderBy(falling(), "g")
    true = points.mapInArrow(_ranked(dims, x, names, k), "gq bigint, g bigint, score double, vector array<double>, shell int")
    true = true.withColumn("n", F.row_number().over(order)).filter((F.col("n") <= k) & (F.col("gq") != F.col("g"))).collect()
    where, unit = {int(g): i for i, g in enumerate(names)}, on_sphere(x, 0.0, query=True)
    true = [r for r in true if not shells[r["shell"]][1]]
    if not true:
        return tables, 1
    owner = np.array([where[r["gq"]] for r in true])
    near = np.zeros((len(true), dims))
    for i, r in enumerate(true):
        near[i, : len(r["vector"])] = r["vector"]
        near[i : i + 1] = on_sphere(near[i : i + 1], shells[r["shell"]][0], query=False)
    rank, made = np.full(len(true), most), 0
    while made < MOST_TABLES:
        for table in range(made, tables):
            groups, lasts = looked_under(unit, table, functions, most, most)
            p, last = filed_under(near, table, functions)
            for a in range(0, len(true), 500):
                hit = (groups[owner[a : a + 500]] == p[a : a + 500, None]) & (lasts[owner[a : a + 500]] == last[a : a + 500, None])
                rank[a : a + 500] = np.where(hit.any(1), np.minimum(rank[a : a + 500], hit.argmax(1)), rank[a : a + 500])
        needed = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))])
        if needed < most:
            return tables, needed + 1
        made, tables = tables, min(2 * tables, MOST_TABLES)
    return None


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL, probes: int | None = None, most_probes: int = MOST_PROBES) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product found for
    each row of df where is_query holds, itself left out. probes: combinations
    looked under in a table, in place of those that the sample asks for;
    most_probes: the most that it may ask for."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), is_query.alias("query"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("id IS NOT NULL AND vector IS NOT NULL").filter(finite & F.exists("vector", lambda x: x != 0))
    rows = rows.select("id", F.transform("vector", lambda x: x + 0.0).alias("vector"), "query").distinct()
    rows = rows.withColumn("name", F.xxhash64("vector"))
    place = W.partitionBy("name", "vector").orderBy("id")
    least = rows.select("id", "name", "vector", F.row_number().over(place).alias("n")).filter(F.col("n") <= k + 1)
    groups = least.groupBy("name", "vector").agg(F.min("id").alias("g"), F.sort_array(F.collect_list("id")).alias("members"))
    asking = rows.filter("query").groupBy("name", "vector").agg(F.lit(True).alias("query"))
    groups = groups.join(asking, ["name", "vector"], "left").withColumn("query", F.coalesce("query", F.lit(False)))
    groups = written(groups.withColumn("norm", log_norm("vector")), f"{folder}/groups")
    longest, width, n_groups = groups.agg(F.max("norm"), F.max(F.size("vector")), F.count("*")).first()
    dims = 1 << int(np.ceil(np.log2((width or 1) + 1)))
    shells, groups = _shells(groups, longest or 0.0)
    points, functions = groups.select("g", "query", "vector", "shell"), functions_needed(n_groups, dims)
    if probes is None and all(exact for _, exact in shells):
        probes = 1
    elif probes is None:
        plan = probes_needed(points, shells, dims, functions, k, tables, recall, most_probes)
        if plan is None:
            shells, plan = [(longest, True) for longest, _ in shells], (tables, 1)
        tables, probes = plan
    filed = points.mapInArrow(_filed(dims, shells, tables, functions, probes, most_probes), "g bigint, kind int, at array<struct<t:int,p:bigint,last:array<int>>>")
    filed = written(filed, f"{folder}/filed").join(groups.select("g", "vector"), "g").select("g", "kind", "vector", F.explode("at").alias("at")).select("g", "kind", "vector", "at.*")
    crowds = filed.groupBy("t", "p").agg(F.sum(1 - F.col("kind")).alias("cs"), F.sum("kind").alias("qs"))
    # groups that no query looks under go, crowded ones are dealt out; there are few for their size
    crowds = crowds.filter("qs > 0 AND cs > 0").select("t", "p", F.ceil(F.col("cs") / SLICE).cast("int").alias("cs"), F.ceil(F.col("qs") / SLICE).cast("int").alias("qs"))
    hot = written(crowds.filter("cs > 1 OR qs > 1"), f"{folder}/hot")
    some = hot.limit(1).count() > 0
    filed = filed.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, ["t", "p"], "left") if some else filed.withColumn("cs", F.lit(1)).withColumn("qs", F.lit(1))
    own = F.pmod(F.xxhash64("g"), F.coalesce(F.when(F.col("kind") == 0, F.col("cs")).otherwise(F.col("qs")), F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.when(F.col("kind") == 0, F.col("qs")).otherwise(F.col("cs")), F.lit(1)) - 1))
    filed = filed.select("t", "p", "kind", "g", "last", "vector", own.alias("own"), other.alias("other"))
    filed = filed.select("t", "p", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")).alias("c"), F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own")).alias("q"), "kind", "g", "last", "vector")
    filed = filed.repartition("t", "p", "c", "q").sortWithinPartitions("t", "p", "c", "q", "kind")
    found = filed.mapInArrow(_searched(dims, k + 1), "gq bigint, g bigint, score double").dropDuplicates(["gq", "g"])
    order = W.partitionBy("gq").orderBy(falling(), "g")
    found = written(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n"), f"{folder}/found")
    if not all(exact for _, exact in shells):
        found = _completed(groups, found, k, dims, folder)
    queries = rows.filter("query").select(F.col("id").alias("query_id"), "name", "vector").join(groups.select("name", "vector", F.col("g").alias("gq")), ["name", "vector"]).select("query_id", "gq")
    pairs = queries.join(found, "gq").join(groups.select("g", "members"), "g").select("query_id", "score", F.explode("members").alias("id")).filter("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(falling(), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
