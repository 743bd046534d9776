"""Suppression by comments in the source.

`# rubocop:disable NAMES`, `todo` and `enable`, with an optional reason after
two hyphens. A name is a rule, a department or `all`. On a line of its own a
comment holds from there on; after code it holds for that line only.
The state of a finding's rule, its department and `all` is that of the last
own-line comment up to it, unless its own line says otherwise. All of a file's
directives travel with each of its rows, so that suppression needs no join.
Names are compared as written, but `all` in any case. Files without directives
keep all findings; null contents have none; repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.functions.text import split_lines

DIRECTIVE = r"^(.*?)# rubocop:\s*(disable|todo|enable)([^\r]*)"


def directives(content: Column) -> Column:
    """array<struct<line, disabled, own, names>> of a text's directives, in order."""
    told = F.transform(split_lines(content), lambda raw, i: F.struct((i + 1).alias("line"), raw.alias("raw")))
    told = F.filter(told, lambda x: F.contains(x["raw"], F.lit("# rubocop:")) & F.rlike(x["raw"], F.lit(DIRECTIVE)))

    def part(x: Column, k: int) -> Column:
        return F.regexp_extract(x["raw"], DIRECTIVE, k)

    def names(x: Column) -> Column:
        each = F.filter(F.split(F.split(part(x, 3), "--", 2)[0], r"[,\s]+", -1), lambda n: n != "")
        return F.transform(each, lambda n: F.when(F.lower(n) == "all", F.lit("all")).otherwise(n))

    empty = F.array().cast("array<struct<line:int,disabled:boolean,own:boolean,names:array<string>>>")
    some = F.transform(told, lambda x: F.struct(x["line"].alias("line"), (part(x, 2) != "enable").alias("disabled"), (F.trim(part(x, 1)) == "").alias("own"), names(x).alias("names")))
    return F.when(F.contains(F.coalesce(content, F.lit("")), F.lit("# rubocop:")), some).otherwise(empty)


def without_disabled(found: DataFrame) -> DataFrame:
    """Findings that no directive in their column `dirs` disables."""
    from sleuthframe.rules.engine import SUPPRESSED

    return found.filter(~F.expr(SUPPRESSED.format(line="line")))
