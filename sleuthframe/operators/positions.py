"""Where things are in files: occurrences, and lines and columns of offsets.

Offsets and columns count code points; offsets begin at 0, lines and columns at
1. Line starts and offsets are sorted together once per file, so an offset's
line costs no join on ranges.

Null contents have no occurrences; null paths stay null and meet no hits; repeated
files give repeated positions; an empty needle is not allowed; empty tables give
empty results; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def occurrences(files: DataFrame, needle: str) -> DataFrame:
    """(path, offset) of the non-overlapping occurrences of a string, from the left."""
    parts = files.select("path", F.posexplode(F.split("content", F.concat(F.lit("\\Q"), F.lit(needle), F.lit("\\E")), -1)).alias("pos", "part"))
    sizes = parts.select("path", "pos", (F.length("part") + len(needle)).alias("size"))
    ends = F.sum("size").over(W.partitionBy("path").orderBy("pos"))
    last = F.lead("pos").over(W.partitionBy("path").orderBy("pos")).isNull()
    return sizes.select("path", (ends - len(needle)).alias("offset"), last.alias("last")).filter("NOT last").select("path", "offset")


def line_starts(files: DataFrame) -> DataFrame:
    """(path, start): 0, and the offset after each newline."""
    return files.select("path", F.lit(0).cast("long").alias("start")).unionByName(occurrences(files, "\n").select("path", (F.col("offset") + 1).alias("start")))


def located(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, offset, line, column) of each row of offsets(path, offset)."""
    starts = line_starts(files).select("path", F.col("start").alias("offset"), F.lit(True).alias("begins"))
    both = starts.unionByName(offsets.select("path", F.col("offset").cast("long").alias("offset"), F.lit(False).alias("begins")))
    so_far = W.partitionBy("path").orderBy("offset", F.desc("begins")).rowsBetween(W.unboundedPreceding, 0)
    at = both.withColumn("line", F.count(F.when(F.col("begins"), 1)).over(so_far)).withColumn("start", F.max(F.when(F.col("begins"), F.col("offset"))).over(so_far))
    return at.filter("NOT begins").select("path", "offset", F.col("line").cast("int").alias("line"), (F.col("offset") - F.col("start") + 1).cast("int").alias("column"))


def around(lines: DataFrame, hits: DataFrame, reach: int) -> DataFrame:
    """The lines at most `reach` lines from a line of hits(path, line), each once.
    Only the hits are spread out; a line's body stays where it is unless the hits
    are too many to be broadcast."""
    near = hits.select("path", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line")).distinct()
    return lines.join(near, ["path", "line"], "left_semi").select("path", "line", "body")
