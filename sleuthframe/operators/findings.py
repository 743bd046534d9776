"""Algebra over diagnostics: suppression, comparison, counts, reports.

Nulls in keys compare as equal to each other when counted and never match a
suppression; repeated rows count as often as they occur; ties in orders are equal
rows; empty inputs give empty results (summary() one row of zeros). Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.text import neighbours
from sleuthframe.operators.line_rules import findings_in

SIGNATURE = ("path", "rule", "severity", "line", "column")


def unsuppressed(found: DataFrame, suppressed_paths: DataFrame) -> DataFrame:
    """Findings outside the suppressed files."""
    return found.join(suppressed_paths.select("path").distinct(), "path", "left_anti")


def compare(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """Multiset comparison: keys with how many match and how many only one side
    has. Both sides are counted before they meet, in one shuffle by key."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return n.select(*keys, F.least("l", "r").alias("exact"), F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("left_only"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("right_only"))


def compare_rules(files: DataFrame, left: tuple, right: tuple, keys: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """compare() of what two sets of line rules find in the same files, in one
    projection: a rule of both sides is evaluated once."""
    both = [(r, r in left, r in right) for r in dict.fromkeys((*left, *right))]

    def side(a: bool, b: bool):
        return lambda f: F.struct(f.alias("f"), F.lit(int(a)).alias("l"), F.lit(int(b)).alias("r"))

    tagged = F.flatten(F.array(*[F.transform(findings_in([r]), side(a, b)) for r, a, b in both]))
    found = neighbours(files).select("path", "line", F.explode(tagged).alias("x")).select("path", "line", "x.f.*", "x.l", "x.r")
    n = found.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return n.select(*keys, F.least("l", "r").alias("exact"), F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("left_only"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("right_only"))


def classified(compared: DataFrame) -> DataFrame:
    """Per rule: the sums of a comparison and what they amount to."""
    sums = compared.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("exact", "left_only", "right_only")])
    kind = F.when((F.col("left_only") == 0) & (F.col("right_only") == 0), "exact").when(F.col("exact") == 0, "disjoint").otherwise("mismatch")
    return sums.withColumn("outcome", kind)


def first_unmatched(compared: DataFrame, n: int = 3) -> DataFrame:
    """The first n keys of each rule that only one side has."""
    order = W.partitionBy("rule").orderBy("path", "line", "column", "severity")
    some = compared.filter("left_only + right_only > 0").withColumn("nth", F.row_number().over(order))
    return some.filter(F.col("nth") <= n)


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("offenses"), F.countDistinct("path").alias("files"))


def summary(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row: findings, files with findings, files inspected."""
    return found.agg(F.count("*").alias("offense_count"), F.countDistinct("path").alias("offending_files")).crossJoin(files.agg(F.count("*").alias("inspected_file_count")))


def report(found: DataFrame) -> DataFrame:
    """(path, offenses) with each file's findings in order of position and rule."""
    item = F.struct("line", "column", "rule", "severity", "message", "length")
    return found.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("offenses"))
