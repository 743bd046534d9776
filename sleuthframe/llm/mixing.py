"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words. Its documents lie one after another,
in the order of a hash of their ids, on the axis of the source's demand, and
again from the start when a pass is used up. The source's weight changes
linearly over training; the integral of that schedule is the demand met so far,
and its inverse gives each document its position between 0 and 1. Sorting by
position by range yields the training order.

A null text has size 0 and takes nothing. A null source is a source of its own,
the last one. Rows that repeat an id, and rows without one, take part row by row;
a row is known by a hash of all its columns, so only equal rows are taken for each
other. Ties in the order are equal rows. An empty table gives an empty result. Other
columns may have any names. Targets are worked out in one task, from one row per
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.llm.common import shared_folder, table, written

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Relative change of a source's weight from the middle of training to its end, by the same turn as WEIGHTS.
SLOPES = (-0.5, 0.0, 0.5)


def turn(values: tuple, rank: Column) -> Column:
    """values[rank mod len]."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST_REPEATS) -> DataFrame:
    """sizes(source, source_size) with weight, slope and target. The targets sum
    to all sizes; none is above `most` times its source, and what that cuts off
    goes to the others by weight. One row per source, so one task may hold them:
    sorted by cap over weight, those that stay at their cap come first."""
    named = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(named) - 1
    s = sizes.withColumn("rank", rank).withColumn("weight", turn(weights, F.col("rank")).cast("long")).withColumn("slope", turn(slopes, F.col("rank")).cast("double"))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    s = s.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("capped", F.col("weight") * F.col("left") > F.col("cap") * F.col("open"))
    free = W.partitionBy()
    s = s.withColumn("free_left", F.max(F.when(~F.col("capped"), F.struct("open", "left"))).over(free))
    share = F.col("free_left.left") * F.col("weight") / F.col("free_left.open")
    return s.select("source", "source_size", "weight", "slope", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def position(share: Column, slope: Column) -> Column:
    """When this share of a source's demand is met: the inverse of
    t + slope (t**2 - t), the integral of a weight that changes linearly."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def row_key(df: DataFrame) -> Column:
    """A hash of a row's columns (but for maps, which have none)."""
    return F.xxhash64(*[df[f.name] for f in df.schema if "map<" not in f.dataType.simpleString()])


def mixing_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST_REPEATS) -> DataFrame:
    """Per row: id, key (row_key), size, source_size, target, demand (whole words asked of the
    source), begin (words of the source before this document), slope, taken."""
    rows = df.select(F.col(id_col).alias("id"), row_key(df).alias("key"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = rows.withColumn("place", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn("bin", F.substring("place", 1, 3))
    rows = written(rows, f"{shared_folder(df.sparkSession)}/sizes")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, slopes, most)
    goal = goal.withColumn("demand", F.floor(F.col("target") + 0.5).cast("long"))
    before = F.coalesce(F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before", before).alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).drop(F.col("g.source"))
    bins = bins.withColumnRenamed("source", "bin_source").withColumnRenamed("bin", "bin_name")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "bin").orderBy("place", "id", "size", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("inside", inside).join(bins, F.col("source").eqNullSafe(F.col("bin_source")) & (F.col("bin") == F.col("bin_name")))
    at = at.withColumn("begin", F.col("before") + F.col("inside"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("demand") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("demand") - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begin")))
    return at.select("id", "key", "source", "size", "source_size", "target", "demand", "begin", "slope", (F.col("size") * passes + part).cast("long").alias("taken"))


def first_position() -> Column:
    """Position of a row's first take in mixing_plan(); null if nothing is taken."""
    return F.when(F.col("taken") > 0, position(F.col("begin") / F.col("demand"), F.col("slope")))


def in_order(df: DataFrame, place: str, *ties: str) -> DataFrame:
    """df in training order, sorted by ranges of positions; what has none comes last."""
    return df.orderBy(F.col(place).asc_nulls_last(), *ties)


def training_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as whole documents, in training order: a document comes once for
    each pass that reaches its middle word. The columns are those of df."""
    plan = mixing_plan(df, id_col, text_col, source_col)
    middle = F.col("begin") + F.col("size") / 2
    passes = F.ceil((F.col("demand") - middle) / F.col("source_size")).cast("int")
    plan = plan.filter("size > 0").withColumn("passes", passes).filter("passes > 0")
    takes = plan.select(F.col("id").alias("_take_id"), F.col("key").alias("_take_key"), F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("_pass"), "begin", "source_size", "demand", "slope")
    share = F.least(F.lit(1.0), (F.col("begin") + F.col("_pass") * F.col("source_size")) / F.col("demand"))
    takes = written(takes.select("_take_id", "_take_key", position(share, F.col("slope")).alias("_position")))
    docs = df.withColumn("_key", row_key(df))
    # of equal rows one is joined with all their takes
    if docs.groupBy(id_col, "_key").count().filter("count > 1").limit(1).count():
        docs = docs.dropDuplicates([id_col, "_key"])
    joined = docs.join(takes, docs[id_col].eqNullSafe(takes["_take_id"]) & (docs["_key"] == takes["_take_key"]))
    return in_order(joined, "_position", "_take_id", "_take_key").select(*[docs[c] for c in df.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's documents in the order of their first takes."""
    plan = in_order(mixing_plan(table(spark, sf_dir, "documents")).withColumn("position", first_position()), "position", "id", "key")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, r % 3 + 1 AS weight, CAST(r % 3 - 1 AS DOUBLE) / 2 AS slope, 3 * source_size AS cap FROM s),
o AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM w),
f AS (SELECT max(open) AS open, max_by(rest, open) AS rest FROM o WHERE weight * rest <= cap * open),
t AS (SELECT o.*, CASE WHEN weight * o.rest > cap * o.open THEN CAST(cap AS DOUBLE) ELSE CAST(f.rest * weight AS DOUBLE) / f.open END AS target FROM o, f),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS demand FROM t),
p AS (SELECT d.doc_id, size, source_size, target, demand, slope, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin,
    CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS passes FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CAST(size * passes + greatest(0, least(size, demand - passes * source_size - begin)) AS BIGINT) AS taken FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN begin / demand
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (begin / demand)) - (1 - slope)) / (2 * slope) END END AS position FROM q
"""
