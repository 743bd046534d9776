"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.common import shared_folder, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v): root is the least node of its
    component. Rounds of large-star and small-star steps, each written to the
    shared folder, until no edge changes; a round halves a path's length, and a
    node's neighbours are only ever reduced by min(), never gathered. An empty
    table gives an empty result; loops and repeated edges are allowed."""
    folder, k = shared_folder(edges.sparkSession), 0

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{folder}/0")
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m").toDF("u", "v"))
        k += 1
        edges = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/{k}")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
