"""Registered queries over positions, files as a whole and results per rule."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.functions.text import lines
from sleuthframe.operators.analysis import analyze
from sleuthframe.operators.differential import drift, match_ratio, pass_rates, regressions, signature_gap, timings
from sleuthframe.operators.file_rules import FILE_RULES, file_diagnostics, file_rule_sql
from sleuthframe.operators.findings import classified, counts
from sleuthframe.operators.positions import around, located, occurrences
from sleuthframe.operators.reporting import json_report, simple_report, totals
from sleuthframe.functions.text import matches
from sleuthframe.operators.reporting import json_document
from sleuthframe.plans.catalog import COMMA, COMPARED_SQL, DIGITS, RULES, SEMICOLON, all_matches, compared, diagnostics_sql, found, lines_sql, register
from sleuthframe.sources.tables import PATHS, files, table

DOC, _ = PATHS["documents"]


def _located(spark, sf_dir):
    docs = files(spark, sf_dir, "documents")
    return located(docs, occurrences(docs, ", "))


register(
    "offset_to_line_column",
    _located,
    f"""WITH f AS (SELECT {DOC} AS path, coalesce(text, '') AS content FROM documents),
p AS (SELECT path, string_split(content, ', ') AS parts FROM f), q AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS k FROM p),
o AS (SELECT path, k, sum(len(parts[k]) + 2) OVER (PARTITION BY path ORDER BY k) - 2 AS "offset", len(parts) AS n FROM q),
l AS (SELECT path, string_split(content, chr(10)) AS parts FROM f), m AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS line FROM l),
s AS (SELECT path, line, coalesce(sum(len(parts[line]) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m)
SELECT o.path, CAST(o."offset" AS BIGINT) AS "offset", CAST(s.line AS INT) AS line, CAST(o."offset" - s.start + 1 AS INT) AS "column"
FROM (SELECT * FROM o WHERE k < n) o ASOF JOIN s ON o.path = s.path AND o."offset" >= s.start""",
)
for _name in PATHS:
    _path, _content = PATHS[_name]
    register(
        f"lint_files_{_name}",
        lambda s, d, n=_name: file_diagnostics(files(s, d, n)),
        f"WITH f AS (SELECT {_path} AS path, coalesce({_content}, '') AS content FROM {_name})\n" + "\nUNION ALL ".join(file_rule_sql(r, "f") for r in FILE_RULES),
    )
register(
    "out_of_order_in_scope",
    lambda s, d: table(s, d, "lineitem").withColumn("before", F.lag("l_shipdate").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))).filter("l_shipdate < before").select("l_orderkey", "l_linenumber", "l_shipdate"),
    "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS before FROM lineitem) WHERE l_shipdate < before",
)
register(
    "lines_around_hits",
    lambda s, d: around(lines(files(s, d, "documents")), matches(lines(files(s, d, "documents")), DIGITS), 2).withColumn("line", F.col("line").cast("int")),
    f"""WITH {lines_sql("documents")}
SELECT path, CAST(line AS INT) AS line, body FROM (SELECT path, line, body, max(CASE WHEN regexp_matches(body, '{DIGITS}') THEN 1 END) OVER (PARTITION BY path ORDER BY line RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines_documents) WHERE near = 1""",
)
for _key, _pattern in (("missing_space_after_comma", COMMA), ("long_digit_run", DIGITS), ("statement_separator_semicolon", SEMICOLON)):
    for _name in ("documents", "pages"):
        register(f"{_key}_{_name}", *all_matches(_name, _pattern))
register(
    "license_line_presence",
    lambda s, d: files(s, d, "documents").filter(F.rlike("content", F.lit("(?i)copyright|licen[cs]ed?"))).select("path"),
    f"SELECT {DOC} AS path FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)copyright|licen[cs]ed?')",
)
_CLASSES = "g AS (SELECT rule, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(left_only) AS BIGINT) AS left_only, CAST(sum(right_only) AS BIGINT) AS right_only FROM c GROUP BY rule)"
register("match_ratio_per_rule", lambda s, d: match_ratio(classified(compared(s, d))), f"{COMPARED_SQL}, {_CLASSES} SELECT rule, CASE WHEN exact + left_only + right_only = 0 THEN 1.0 ELSE exact / (exact + left_only + right_only) END AS ratio FROM g")
register("signature_gap_per_rule", lambda s, d: signature_gap(classified(compared(s, d))), f"{COMPARED_SQL}, {_CLASSES} SELECT rule, left_only + right_only AS gap FROM g")

FLOORS = (("Layout/LineLength", 10), ("Layout/TrailingEmptyLines", 10**9), ("Layout/EndOfLine", 1))
register(
    "baseline_regressions",
    lambda s, d: regressions(counts(found(s, d)), s.createDataFrame(FLOORS, "rule string, floor bigint")),
    f"WITH {diagnostics_sql('documents', RULES)}, b(rule, floor) AS (VALUES {', '.join(f'({chr(39)}{r}{chr(39)}, CAST({n} AS BIGINT))' for r, n in FLOORS)}), n AS (SELECT rule, count(*) AS n FROM found GROUP BY rule) SELECT b.rule, b.floor, coalesce(n.n, 0) AS offenses FROM b LEFT JOIN n USING (rule) WHERE coalesce(n.n, 0) < b.floor",
)
register(
    "pass_rates_by_language",
    lambda s, d: pass_rates(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("lang").alias("rule"), (F.col("quality") == 1).alias("passed"))),
    "SELECT lang AS rule, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)


def _drift(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("rule")).agg(F.count("*").alias("correctable_cases"), F.sum("o_totalprice").alias("s"))
    results = asked.select("rule", (F.pmod(F.col("rule").cast("long"), F.lit(3)) != 0).alias("passing"), "correctable_cases", F.pmod(F.col("rule").cast("long"), F.lit(2)).alias("assertions"))
    return drift(results, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("rule")))


register(
    "drift_of_keys",
    _drift,
    """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS rule, o_custkey % 3 <> 0 AS passing, count(*) AS cases, o_custkey % 2 AS assertions FROM orders GROUP BY o_custkey),
v AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS rule FROM customer)
SELECT rule, 'passing_not_promoted' AS kind FROM r WHERE passing AND rule NOT IN (SELECT rule FROM v)
UNION ALL SELECT rule, 'verified_regression' FROM v WHERE rule NOT IN (SELECT rule FROM r WHERE passing)
UNION ALL SELECT rule, 'passing_without_correction_assertions' FROM r WHERE passing AND cases > 0 AND assertions = 0""",
)
register(
    "timings_by_source",
    lambda s, d: timings(table(s, d, "documents"), "source", "n_chars"),
    "SELECT source, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY source",
)
register(
    "report_lines",
    lambda s, d: simple_report(found(s, d)).select("path", "text"),
    f"WITH {diagnostics_sql('documents', RULES)} SELECT path, format('C:{{:>3}}:{{:>3}}:{{}} {{}}: {{}}', line, \"column\", CASE WHEN correctable THEN ' [Correctable]' ELSE '' END, rule, message) AS text FROM found",
)
register(
    "report_totals",
    lambda s, d: totals(found(s, d), files(s, d, "documents")),
    f"WITH {diagnostics_sql('documents', RULES)} SELECT (SELECT count(*) FROM documents) AS inspected, (SELECT count(*) FROM found) AS offenses, CAST(0 AS BIGINT) AS corrected, (SELECT count(*) FROM found WHERE correctable) AS correctable",
)
OFFENSE_SQL = """{'severity': severity, 'message': message, 'cop_name': rule, 'corrected': false, 'correctable': correctable, 'location': {'start_line': line, 'start_column': "column", 'last_line': last_line, 'last_column': last_column, 'length': length, 'line': line, 'column': "column"}}"""
JSON_SQL = f"""SELECT path, CAST(to_json({{'path': path, 'offenses': list({OFFENSE_SQL} ORDER BY line, "column", rule, message, last_line, last_column, length)}}) AS VARCHAR) AS json FROM found GROUP BY path"""
register("json_report", lambda s, d: json_report(found(s, d)), f"WITH {diagnostics_sql('documents', RULES)} {JSON_SQL}")
register(
    "json_document",
    lambda s, d: json_document(found(s, d, "conversations"), files(s, d, "conversations")),
    f"""WITH {diagnostics_sql("conversations", RULES)}, n AS (SELECT (SELECT count(*) FROM found) AS offenses, (SELECT count(*) FROM conversations) AS files)
SELECT 'summary' AS part, NULL AS path, CAST(to_json({{'offense_count': offenses, 'target_file_count': files, 'inspected_file_count': files}}) AS VARCHAR) AS json FROM n
UNION ALL SELECT 'file', path, json FROM ({JSON_SQL})
UNION ALL SELECT 'file', path, CAST(to_json({{'path': path, 'offenses': []}}) AS VARCHAR) FROM (SELECT {PATHS["conversations"][0]} AS path FROM conversations) WHERE path NOT IN (SELECT path FROM found)""",
)
register(
    "analyze_documents",
    lambda s, d: analyze(files(s, d, "documents"), only=["Layout/LineLength", "Layout/TrailingEmptyLines", "Style/FrozenStringLiteralComment", "Lint/EmptyFile"]),
    f"""WITH {diagnostics_sql("documents", tuple(r for r in RULES if r.name in ("Layout/LineLength", "Layout/TrailingEmptyLines")))}, f AS (SELECT {DOC} AS path, coalesce(text, '') AS content FROM documents)
SELECT * FROM found UNION ALL """ + "\nUNION ALL ".join(file_rule_sql(r, "f") for r in FILE_RULES if r.name in ("Style/FrozenStringLiteralComment", "Lint/EmptyFile")),
)
