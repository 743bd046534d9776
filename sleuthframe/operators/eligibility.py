"""Which rules look at which files: Include and Exclude of the configuration.

A rule looks at a path that one of its Include globs matches, if it has any, and
none of its own or AllCops' Exclude globs does. In a glob * stands for any
characters, / among them, and ? for one; a glob matches a whole path. Globs become
regular expressions once; the rules that have some are one broadcast row, so the
table of paths and the rules that pass them by is a projection over the files.

A null path matches no glob. Without globs nothing is passed by. Repeated paths
give repeated rows; no files give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.config import Value
from sleuthframe.operators.settings import listed

#: What stands for all rules in a list of those that pass a file by.
ALL = "*"


def regex(glob: str) -> str:
    return "(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def _globs(config: Mapping[str, Mapping[str, Value]], rule: str, key: str) -> list[str]:
    told = config.get(rule, {}).get(key)
    return [regex(g) for g in listed(told)] if told else []


def with_skips(files: DataFrame, names: Iterable[str], config: Mapping[str, Mapping[str, Value]] | None) -> DataFrame:
    """files with a column skip: the names of the rules that pass the path by."""
    config = config or {}
    some = [(n, _globs(config, n, "Include"), _globs(config, n, "Exclude")) for n in sorted(set(names))]
    some = [(n, a, b) for n, a, b in some if a or b]
    everywhere = _globs(config, "AllCops", "Exclude")
    if everywhere:
        some.append((ALL, [], everywhere))
    if not some:
        return files.withColumn("skip", F.array().cast("array<string>"))
    # one row, of the rules that have globs
    row = files.sparkSession.createDataFrame([(some,)], "_globs array<struct<rule:string,include:array<string>,exclude:array<string>>>")
    hit = "exists(g.{0}, r -> coalesce(path rlike concat('^', r, '$'), false))"
    passed = F.expr(f"transform(filter(_globs, g -> {hit.format('exclude')} OR size(g.include) > 0 AND NOT {hit.format('include')}), g -> g.rule)")
    return files.crossJoin(F.broadcast(row)).withColumn("skip", passed).drop("_globs")


def looked_at(rule: Column) -> Column:
    """Whether a rule looks at a row's file, by its column skip."""
    return ~(F.array_contains(F.col("skip"), rule) | F.array_contains(F.col("skip"), F.lit(ALL)))
