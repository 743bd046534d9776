"""Analytics over compared diagnostics and over tables of results per rule.

Null keys are a group like others; null values take no part (a group of nothing
else has null percentiles, and counts as not passed). Repeated rows count as often
as they occur; empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts between the least and the greatest value of a key.
BUCKETS = 1024


def match_ratio(classes: DataFrame) -> DataFrame:
    """Per rule: what both sides have over what either has; 1 where neither has any."""
    either = F.col("exact") + F.col("left_only") + F.col("right_only")
    return classes.select("rule", F.when(either == 0, F.lit(1.0)).otherwise(F.col("exact") / either).alias("ratio"))


def signature_gap(classes: DataFrame) -> DataFrame:
    """Per rule: what one side only has, the widest gap first."""
    return classes.select("rule", (F.col("left_only") + F.col("right_only")).alias("gap")).orderBy(F.desc("gap"), "rule")


def combined(batches: DataFrame) -> DataFrame:
    """Sums over projects of (rule, exact, left_only, right_only, failure): any
    failure decides, then dormant (nothing found), exact or mismatch."""
    sums = batches.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("exact", "left_only", "right_only")], F.max("failure").alias("failure"))
    one_sided = F.col("left_only") + F.col("right_only")
    kind = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("exact") + one_sided == 0, "dormant").when(one_sided == 0, "exact").otherwise("mismatch")
    return sums.withColumn("outcome", kind)


def repeated_rules(batches: DataFrame) -> DataFrame:
    """(batch, rule) that more than one row reports."""
    return batches.groupBy("batch", "rule").agg(F.count("*").alias("times")).filter("times > 1")


def regressions(counts: DataFrame, floors: DataFrame) -> DataFrame:
    """Rules below their floor(rule, floor), with what they have; 0 if missing."""
    n = counts.groupBy("rule").agg(F.sum("offenses").alias("offenses"))
    return floors.join(n, "rule", "left").select("rule", "floor", F.coalesce("offenses", F.lit(0)).cast("long").alias("offenses")).filter("offenses < floor")


def drift(results: DataFrame, verified: DataFrame) -> DataFrame:
    """(rule, kind): rules that pass but aren't verified, are verified but don't
    pass, or pass with correctable cases that no correction asserts. results
    has rule, passing, correctable_cases, assertions; verified has rule."""
    both = results.join(verified.select("rule", F.lit(True).alias("verified")).distinct(), "rule", "full_outer")
    passing, known = F.coalesce("passing", F.lit(False)), F.coalesce("verified", F.lit(False))
    unasserted = passing & (F.coalesce("correctable_cases", F.lit(0)) > 0) & (F.coalesce("assertions", F.lit(0)) == 0)
    kinds = F.array(F.when(passing & ~known, "passing_not_promoted"), F.when(known & ~passing, "verified_regression"), F.when(unasserted, "passing_without_correction_assertions"))
    return both.select("rule", F.explode(F.array_compact(kinds)).alias("kind"))


def pass_rates(cases: DataFrame) -> DataFrame:
    """(rule, passed, total, rate) of cases(rule, passed boolean)."""
    return cases.groupBy("rule").agg(F.sum(F.coalesce(F.col("passed").cast("long"), F.lit(0))).alias("passed"), F.count("*").alias("total")).withColumn("rate", F.col("passed") / F.col("total"))


def timings(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Median and 95th percentile of a value for each key, interpolated between
    neighbours. Values are counted, and the counts of BUCKETS equal parts between a
    key's least and greatest value tell in which part a percentile lies; only that
    part's values are then put in order. So no task holds all values of a key."""
    v = F.col("v")
    rows = samples.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    each = rows.filter("v IS NOT NULL").groupBy("key", "v").agg(F.count("*").alias("n"))
    span = each.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))

    def same_key(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
        right = right.select(*(F.col(c).alias(f"_{c}" if c in ("key", *also) else c) for c in right.columns))
        on = left["key"].eqNullSafe(right["_key"])
        for c in also:
            on = on & (left[c] == right[f"_{c}"])
        return left.join(right, on).drop("_key", *(f"_{c}" for c in also))

    part = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(BUCKETS - 1), F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS))).cast("int")
    placed = same_key(each, span).select("key", "v", "n", "total", part.alias("part"))
    parts = placed.groupBy("key", "part").agg(F.sum("n").alias("held"), F.max("total").alias("total"))
    parts = parts.withColumn("before", F.sum("held").over(W.partitionBy("key").orderBy("part")) - F.col("held"))
    at = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.lit(p) * (F.col("total") - 1)).cast("long").alias("rank")) for name, p, rank in (("m0", 0.5, F.floor), ("m1", 0.5, F.ceil), ("p0", 0.95, F.floor), ("p1", 0.95, F.ceil))))
    asked = parts.select("key", "part", "before", "held", F.explode(at).alias("a")).filter("a.rank >= before AND a.rank < before + held").select("key", "part", "before", "a.name", "a.rank")
    own = W.partitionBy("key", "part", "name").orderBy("v")
    near = same_key(placed.select("key", "part", "v", "n"), asked, "part").withColumn("upto", F.col("before") + F.sum("n").over(own))
    hit = near.filter("rank < upto AND rank >= upto - n")
    values = hit.groupBy("key").agg(*(F.max(F.when(F.col("name") == n, v)).alias(n) for n in ("m0", "m1", "p0", "p1")))

    def between(low: str, high: str, p: float):
        share = F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1))
        return F.round(F.col(low) + (F.col(high) - F.col(low)) * share, 6)

    told = same_key(values, span.select("key", "total")).select("key", between("m0", "m1", 0.5).alias("median"), between("p0", "p1", 0.95).alias("p95"))
    told = told.unionByName(rows.groupBy("key").agg(F.count("v").alias("c")).filter("c = 0").select("key", F.lit(None).cast("double").alias("median"), F.lit(None).cast("double").alias("p95")))
    return told.withColumnRenamed("key", key)


def flattened(reports: DataFrame, root: str = "") -> DataFrame:
    """Rows of the diagnostics in nested reports(path, offenses), paths below root."""
    each = reports.select("path", F.explode("offenses").alias("o"))
    return each.select(F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path")).alias("path"), "o.*")
