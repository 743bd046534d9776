"""Rules about the comments that suppress rules: ranges against findings.

A disable on a line of its own opens a range for each of its names, which the next
event for that name ends: an enable of the name, its department or all, or
another disable of it; without one the range reaches the end of the file. After
code a disable holds for its line. Ranges are opened and closed by a window over
each file's events for a name; whether a range holds anything is told by a window
over its beginning and the findings from there on, so no range is paired with
every finding in it. Findings are those before suppression.

- Lint/RedundantCopDisableDirective: names of a disable whose range has no finding.
- Lint/MissingCopEnableDirective: ranges that nothing ends.
- Lint/RedundantCopEnableDirective: enables on whose line no range is open that they end.
- Style/DisableCopsWithinSourceCodeDirective (on request): directives for rules
  that AllowedCops doesn't hold.

Files without directives give nothing. Null contents have none; null paths are
files like others. Repeated names in a comment count once; a path must not repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.text import split_lines
from sleuthframe.operators.config import Value
from sleuthframe.operators.line_rules import DIAGNOSTICS, severity
from sleuthframe.operators.settings import listed

#: The comment, and what comes before its names.
COMMENT = r"# rubocop:\s*(?:disable|todo|enable)\b[^\r]*"
HEAD = r"^# rubocop:\s*(disable|todo|enable)\s+"
REDUNDANT, MISSING, ENABLING, WITHIN = "Lint/RedundantCopDisableDirective", "Lint/MissingCopEnableDirective", "Lint/RedundantCopEnableDirective", "Style/DisableCopsWithinSourceCodeDirective"
NAMES = (REDUNDANT, MISSING, ENABLING, WITHIN)


def department(name: Column) -> Column:
    return F.split(name, "/")[0]


def named(files: DataFrame) -> DataFrame:
    """(path, line, column, comment, disabled, own, name, at, size) of each name that a
    directive has; at: the name's column; size: how many names it has."""
    lines = files.filter(F.contains("content", F.lit("# rubocop:"))).select("path", F.posexplode(split_lines(F.col("content"))).alias("i", "raw")).filter(F.col("raw").rlike(COMMENT))
    comment = F.rtrim(F.regexp_extract("raw", f"({COMMENT})", 1))
    found = lines.select("path", (F.col("i") + 1).alias("line"), F.locate("# rubocop:", F.col("raw")).alias("column"), comment.alias("comment"), (F.trim(F.regexp_extract("raw", r"^(.*?)# rubocop:", 1)) == "").alias("own"))
    head = F.regexp_extract("comment", HEAD, 0)
    told = F.regexp_replace(F.split(F.substring(F.col("comment"), F.length(head) + 1, F.length("comment")), "--", 2)[0], r"\s+$", "")
    found = found.withColumn("told", told).withColumn("disabled", F.regexp_extract("comment", HEAD, 1) != "enable").filter(head != "")
    each = F.array_distinct(F.filter(F.split("told", r"[,\s]+"), lambda n: n != ""))
    out = found.withColumn("head", F.length(head)).withColumn("names", each).withColumn("size", F.size("names")).select("*", F.explode("names").alias("name"))
    at = F.col("column") + F.col("head") + F.position(F.col("name"), F.col("told")) - 1
    return out.select("path", "line", "column", "comment", "disabled", "own", F.when(F.lower("name") == "all", "all").otherwise(F.col("name")).alias("name"), at.alias("at"), "size")


def keys(name: Column) -> Column:
    """A name, its department and `all`."""
    return F.array_distinct(F.array(name, department(name), F.lit("all")))


def ranges(directives: DataFrame) -> DataFrame:
    """named() disables with `end`: the line of the event that ends the range, null
    if none does; a disable after code ends on its line."""
    own = directives.filter("own")
    opened = own.filter("disabled").select("path", F.col("name").alias("range_name")).distinct()
    enables = own.filter("NOT disabled").select("path", "line", F.col("name").alias("key"))
    # what may end a range of a name: enables of its keys, and disables of itself
    ends = opened.select("path", "range_name", F.explode(keys(F.col("range_name"))).alias("key")).join(enables, ["path", "key"]).select("path", "range_name", "line", F.lit(None).cast("struct<column:int,comment:string,at:int,size:int>").alias("d"))
    begins = own.filter("disabled").select("path", F.col("name").alias("range_name"), "line", F.struct("column", "comment", "at", "size").alias("d"))
    order = W.partitionBy("path", "range_name").orderBy("line")
    closed = begins.unionByName(ends).withColumn("end", F.lead("line").over(order)).filter("d IS NOT NULL")
    closed = closed.select("path", "line", "d.column", "d.comment", F.lit(True).alias("own"), F.col("range_name").alias("name"), "d.at", "d.size", "end")
    alone = directives.filter("disabled AND NOT own").select("path", "line", "column", "comment", "own", "name", "at", "size", F.col("line").alias("end"))
    return closed.unionByName(alone)


def unused(found: DataFrame, disabled: DataFrame, whole_run: bool = True) -> DataFrame:
    """The ranges that hold none of the findings found(path, line, rule); without
    whole_run, ranges are of names of rules only, so that findings count for these alone."""
    name = F.explode(keys(F.col("rule"))) if whole_run else F.col("rule")
    # equal ones say the same, so they need not be told apart
    hits = found.select("path", name.alias("name"), F.col("line").alias("hit"))
    begins = disabled.select("path", "name", F.col("line").alias("hit"), F.struct("line", "column", "comment", "own", "at", "size", "end").alias("r"))
    both = begins.unionByName(hits.withColumn("r", F.lit(None).cast(begins.schema["r"].dataType)))
    # at one line the range comes first, so that what is found there follows it
    after = W.partitionBy("path", "name").orderBy("hit", F.col("r").isNull()).rowsBetween(W.currentRow, W.unboundedFollowing)
    following = F.min(F.when(F.col("r").isNull(), F.col("hit"))).over(after)
    held = both.withColumn("following", following).filter("r IS NOT NULL")
    return held.filter("following IS NULL OR r.end IS NOT NULL AND following > r.end").select("path", "name", "r.*")


def needless_enables(directives: DataFrame, disabled: DataFrame) -> DataFrame:
    """named() enables on whose lines no range of ranges() is open that they could
    end: of the name itself, its department or all, or of a part of what it stands for."""
    enables = directives.filter("own AND NOT disabled").select("path", "name", "line", F.struct("column", "comment", "at").alias("e"))
    asked = enables.select("path", F.col("name").alias("asked")).distinct()
    off = disabled.filter("own").select("path", "line", "name", F.coalesce("end", F.lit(2_000_000_000)).alias("end"))
    none = F.lit(None).cast(enables.schema["e"].dataType).alias("e")
    above = asked.select("path", "asked", F.explode(keys(F.col("asked"))).alias("name")).join(off, ["path", "name"]).select("path", F.col("asked").alias("name"), "line", none, "end")
    below = off.select("path", "line", "end", F.explode(keys(F.col("name"))).alias("asked")).join(asked, ["path", "asked"]).select("path", F.col("asked").alias("name"), "line", none, "end")
    events = enables.withColumn("end", F.lit(None).cast("int")).unionByName(above).unionByName(below).distinct()
    until = F.max("end").over(W.partitionBy("path", "name").orderBy("line", F.col("e").isNotNull()).rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("until", until).filter("e IS NOT NULL AND (until IS NULL OR until < line)").select("path", "name", "line", "e.*")


def _told(name: Column, known: Iterable[str]) -> Column:
    """How a message names a rule, a department or all."""
    mark = F.when(name == "all", F.lit("all cops")).when(~F.contains(name, F.lit("/")), F.concat(F.lit("`"), name, F.lit("` department"))).otherwise(F.concat(F.lit("`"), name, F.lit("`")))
    return F.when((name == "all") | ~F.contains(name, F.lit("/")) | name.isin(*known), mark).otherwise(F.concat(mark, F.lit(" (unknown cop)")))


def _rows(df: DataFrame, rule: str, message: Column, column: str, length: Column, correctable: bool) -> DataFrame:
    made = df.select("path", "line", F.col(column).alias("column"), F.col("line").alias("last_line"), (F.col(column) + length - 1).alias("last_column"), length.alias("length"), F.lit(rule).alias("rule"), F.lit(severity(rule)).alias("severity"), message.alias("message"), F.lit(correctable).alias("correctable"))
    return made.select(*DIAGNOSTICS)


def directive_diagnostics(files: DataFrame, found: DataFrame, names: Iterable[str] = NAMES, run: Iterable[str] = (), whole_run: bool = True, config: Mapping[str, Mapping[str, Value]] | None = None) -> DataFrame | None:
    """diagnostics of these rules in files(path, content); found: what all rules
    find before suppression; run: the rules that did; whole_run: whether these are
    all there are, so that other names, departments and `all` can be judged too."""
    # all parts read the names, which take all lines and several patterns to find
    names, known, told = set(names), sorted(run), named(files).persist()
    parts = []
    disabled = ranges(told).persist() if names & {REDUNDANT, MISSING, ENABLING} else None
    whole, one = F.length("comment"), F.length("name")
    if REDUNDANT in names:
        # a comment is one finding if all its names are redundant
        judged = disabled if whole_run else disabled.filter(F.col("name").isin(*known))
        left = unused(found, judged, whole_run).persist()
        # most comments have one name, and need no counting
        alone = left.filter("size = 1").select("path", "line", "column", "comment", _told(F.col("name"), known).alias("told"))
        several = left.filter("size > 1").withColumn("n", F.count("*").over(W.partitionBy("path", "line")))
        every = several.filter("n = size").groupBy("path", "line", "column", "comment").agg(F.array_join(F.array_sort(F.collect_set(_told(F.col("name"), known))), ", ").alias("told"))
        every, some = alone.unionByName(every), several.filter("n < size")
        parts.append(_rows(every, REDUNDANT, F.concat(F.lit("Unnecessary disabling of "), "told", F.lit(".")), "column", whole, True))
        parts.append(_rows(some, REDUNDANT, F.concat(F.lit("Unnecessary disabling of "), _told(F.col("name"), known), F.lit(".")), "at", one, True))
    if MISSING in names:
        kind = F.when(F.contains("name", F.lit("/")), F.lit("cop")).otherwise(F.lit("department"))
        message = F.when(F.col("name") == "all", F.lit("Re-enable all cops with `# rubocop:enable` after disabling it.")).otherwise(F.concat(F.lit("Re-enable "), "name", F.lit(" "), kind, F.lit(" with `# rubocop:enable` after disabling it.")))
        parts.append(_rows(disabled.filter("own AND end IS NULL"), MISSING, message, "column", whole, False))
    if ENABLING in names:
        name = F.when(F.col("name") == "all", F.lit("all cops")).otherwise(F.col("name"))
        parts.append(_rows(needless_enables(told, disabled), ENABLING, F.concat(F.lit("Unnecessary enabling of "), name, F.lit(".")), "at", one, True))
    if WITHIN in names:
        allowed = listed((config or {}).get(WITHIN, {}).get("AllowedCops", []))
        per = told.filter(~F.col("name").isin(*allowed)).groupBy("path", "line", "column", "comment").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("`"), "name", F.lit("`")))), ", ").alias("told"))
        message = F.concat(F.lit("RuboCop disable/enable directives for "), "told", F.lit(" are not permitted.")) if allowed else F.lit("RuboCop disable/enable directives are not permitted.")
        parts.append(_rows(per, WITHIN, message, "column", whole, True))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
