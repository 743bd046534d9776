"""Lines and matches in texts.

A null content counts as empty. Repeated rows give repeated results; no rows give
none. Only path and content (or the named columns) are read, so other columns may
have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_lines(content: Column) -> Column:
    """The lines of a text with their carriage returns. An empty text has none,
    and a final newline begins no further line."""
    split = F.split(F.coalesce(content, F.lit("")), "\n", -1)
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def lines(files: DataFrame) -> DataFrame:
    """lines(path, line, body): lines from 1, without their endings."""
    each = files.select("path", F.posexplode(split_lines(F.col("content"))).alias("pos", "raw"))
    return each.select("path", (F.col("pos") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("body"))


def neighbours(files: DataFrame, *keep: str) -> DataFrame:
    """lines with what is beside them: (path, line, n_lines, body, prev, next,
    ending, final) and the columns to keep. ending: a carriage return or nothing;
    prev and next are null at the ends; final: whether the text ends with a newline."""
    split = files.select("path", *keep, split_lines(F.col("content")).alias("parts"), F.endswith(F.coalesce("content", F.lit("")), F.lit("\n")).alias("final"))
    each = split.select("path", *keep, "parts", "final", F.posexplode("parts").alias("pos", "raw"))
    bare = [F.regexp_replace(c, "\r$", "").alias(n) for c, n in ((F.col("raw"), "body"), (F.expr("get(parts, pos - 1)"), "prev"), (F.expr("get(parts, pos + 1)"), "next"))]
    return each.select("path", *keep, (F.col("pos") + 1).alias("line"), F.size("parts").alias("n_lines"), *bare, F.when(F.endswith("raw", F.lit("\r")), "\r").otherwise("").alias("ending"), "final")


def matches(lines: DataFrame, pattern: str) -> DataFrame:
    """(path, line, column, length) of every match of a pattern in lines(path,
    line, body), which never matches nothing."""
    found = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    gaps = F.split("body", pattern, -1)
    each = lines.filter(F.rlike("body", F.lit(pattern))).select("path", "line", found.alias("m"), gaps.alias("g"))
    before = F.expr("transform(m, (x, i) -> named_struct('column', 1 + aggregate(slice(g, 1, i + 1), 0, (a, y) -> a + length(y)) + aggregate(slice(m, 1, i), 0, (a, y) -> a + length(y)), 'length', length(x)))")
    return each.select("path", "line", F.explode(before).alias("x")).select("path", "line", "x.column", "x.length")


LINES_SQL = """
split_{name} AS (SELECT {path} AS path, string_split(coalesce({content}, ''), chr(10)) AS parts, ends_with(coalesce({content}, ''), chr(10)) AS final FROM {name}),
lines_{name} AS (SELECT path, line, CAST(n AS INT) AS n_lines, regexp_replace(parts[line], '\\r$', '') AS body,
        CASE WHEN line > 1 THEN regexp_replace(parts[line - 1], '\\r$', '') END AS prev, CASE WHEN line < n THEN regexp_replace(parts[line + 1], '\\r$', '') END AS next,
        CASE WHEN ends_with(parts[line], chr(13)) THEN chr(13) ELSE '' END AS ending, final
    FROM (SELECT path, parts, final, n, unnest(range(1, n + 1)) AS line FROM (SELECT *, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS n FROM split_{name})))"""


def matches_sql(name: str, pattern: str) -> str:
    """matches() over lines_{name} in DuckDB's SQL."""
    return f"""SELECT path, CAST(line AS INT) AS line, CAST(1 + list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS INT) AS "column", CAST(len(m[i]) AS INT) AS length
    FROM (SELECT path, line, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT path, line, regexp_extract_all(body, '{pattern}') AS m, string_split_regex(body, '{pattern}') AS g FROM lines_{name}))"""
