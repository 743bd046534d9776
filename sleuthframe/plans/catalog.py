"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import dataclasses

from sleuthframe.functions.text import LINES_SQL, lines, matches, matches_sql
from sleuthframe.operators.findings import classified, compare, compare_rules, counts, first_unmatched, report, summary, unsuppressed
from sleuthframe.operators.line_rules import RULES as ALL_LINE_RULES
from sleuthframe.operators.line_rules import LineRule, diagnostics, rule_sql, selected
from sleuthframe.plans.examples import expected
from sleuthframe.rules import RULES as NODE_RULES
from sleuthframe.rules.engine import node_diagnostics
from sleuthframe.sources.tables import FEW_CONTENTS, PATHS, files, spread, table

#: The line rules that run by default.
RULES = selected(rules=ALL_LINE_RULES)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def lines_sql(name: str) -> str:
    path, content = PATHS[name]
    return LINES_SQL.format(name=name, path=path, content=content)


def diagnostics_sql(name: str, rules: tuple[LineRule, ...], view: str = "found") -> str:
    return f"{lines_sql(name)},\n{view} AS (" + "\nUNION ALL ".join(rule_sql(r, name) for r in rules) + ")"


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def found(spark: SparkSession, sf_dir: str, name: str = "documents", rules: tuple[LineRule, ...] = RULES) -> DataFrame:
    return diagnostics(files(spark, sf_dir, name), rules)


#: Patterns of which every match in a line counts.
NON_ASCII, DIGITS, COMMA, SEMICOLON = r"[^\x00-\x7F]+", r"\b[0-9]{6,}\b", r",[^ \t,\)\]\}\"]", r";"


def all_matches(name: str, pattern: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    return lambda s, d: matches(lines(files(s, d, name)), pattern), f"WITH {lines_sql(name)} {matches_sql(name, pattern)}"


for _name in PATHS:
    register(f"lint_{_name}" if _name != "documents" else "lint_diagnostics", lambda s, d, n=_name: found(s, d, n), f"WITH {diagnostics_sql(_name, RULES)} SELECT * FROM found")
    register(f"line_length_{_name}", lambda s, d, n=_name: found(s, d, n, selected(["Layout/LineLength"], ALL_LINE_RULES)), f"WITH {diagnostics_sql(_name, selected(['Layout/LineLength'], ALL_LINE_RULES))} SELECT * FROM found")
    register(f"non_ascii_line_{_name}", *all_matches(_name, NON_ASCII))

register(
    "missing_final_newline",
    lambda s, d: files(s, d, "documents").filter((F.col("content") != "") & ~F.endswith("content", F.lit("\n"))).select("path"),
    f"SELECT {PATHS['documents'][0]} AS path FROM documents WHERE coalesce(text, '') <> '' AND NOT ends_with(text, chr(10))",
)
register(
    "file_too_many_lines",
    lambda s, d: lines(files(s, d, "documents")).groupBy("path").agg(F.count("*").alias("n_lines")).filter("n_lines > 20"),
    f"WITH {lines_sql('documents')} SELECT path, count(*) AS n_lines FROM lines_documents GROUP BY path HAVING count(*) > 20",
)
register(
    "duplicate_line_in_file",
    lambda s, d: lines(files(s, d, "documents")).groupBy("path", "body").agg(F.count("*").alias("times"), F.min("line").alias("first_line")).filter("times > 1"),
    f"WITH {lines_sql('documents')} SELECT path, body, count(*) AS times, CAST(min(line) AS INT) AS first_line FROM lines_documents GROUP BY path, body HAVING count(*) > 1",
)
register(
    "unsorted_adjacent_lines",
    lambda s, d: lines(files(s, d, "documents")).withColumn("before", F.lag("body").over(W.partitionBy("path").orderBy("line"))).filter("body < before").select("path", "line"),
    f"WITH {lines_sql('documents')} SELECT path, CAST(line AS INT) AS line FROM (SELECT path, line, body, lag(body) OVER (PARTITION BY path ORDER BY line) AS before FROM lines_documents) WHERE body < before",
)
register(
    "identical_documents",
    lambda s, d: files(s, d, "documents").groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1"),
    f"SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies, min({PATHS['documents'][0]}) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1",
)
register(
    "duplicate_key_in_scope",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("times")).filter("times > 1"),
    "SELECT l_orderkey, l_partkey, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
register(
    "scope_over_threshold",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).filter("n_lines > 4"),
    "SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1 HAVING count(*) > 4",
)
register(
    "identical_neighbours",
    lambda s, d: table(s, d, "events").withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).filter("event_type = before").select("event_id", "user_id", "event_type"),
    "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type = before",
)


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.expr(PATHS["documents"][0]).alias("path"))
    return unsuppressed(found(spark, sf_dir, rules=selected(["Layout/LineLength"])), marked)


register("suppressed_findings", _suppressed, f"WITH {diagnostics_sql('documents', selected(['Layout/LineLength']))} SELECT * FROM found WHERE path NOT IN (SELECT {PATHS['documents'][0]} FROM labels WHERE toxic = 1)")

LINE_LENGTH = selected(["Layout/LineLength"], ALL_LINE_RULES)[0]
SPACES = selected(["Layout/SpaceAfterComma", "Layout/SpaceAfterSemicolon"], ALL_LINE_RULES)
SHORT = (LINE_LENGTH, SPACES[0])
LONG = (dataclasses.replace(LINE_LENGTH, options={"Max": "200"}), *SPACES)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_rules(files(spark, sf_dir, "documents"), SHORT, LONG, ("path", "rule", "severity", "line"))


COMPARED_SQL = f"""WITH {diagnostics_sql("documents", SHORT, "a")}, b AS ({" UNION ALL ".join(rule_sql(r, "documents") for r in LONG)}),
n AS (SELECT path, rule, severity, line, sum(l) AS l, sum(r) AS r FROM (SELECT path, rule, severity, line, 1 AS l, 0 AS r FROM a UNION ALL SELECT path, rule, severity, line, 0, 1 FROM b) GROUP BY ALL),
c AS (SELECT path, rule, severity, line, CAST(least(l, r) AS BIGINT) AS exact, CAST(greatest(l - r, 0) AS BIGINT) AS left_only, CAST(greatest(r - l, 0) AS BIGINT) AS right_only FROM n)"""
register("compare_two_configs", compared, f"{COMPARED_SQL} SELECT * FROM c")
register(
    "classify_by_rule",
    lambda s, d: classified(compared(s, d)),
    f"{COMPARED_SQL} SELECT rule, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(left_only) AS BIGINT) AS left_only, CAST(sum(right_only) AS BIGINT) AS right_only, CASE WHEN sum(left_only) = 0 AND sum(right_only) = 0 THEN 'exact' WHEN sum(exact) = 0 THEN 'disjoint' ELSE 'mismatch' END AS outcome FROM c GROUP BY rule",
)
register(
    "top3_unmatched_per_rule",
    lambda s, d: first_unmatched(compare_rules(files(s, d, "documents"), SHORT, LONG, ("path", "rule", "severity", "line", "column"))).select("path", "rule", "line", "nth"),
    f"""WITH {diagnostics_sql("documents", SHORT, "a")}, b AS ({" UNION ALL ".join(rule_sql(r, "documents") for r in LONG)}),
u AS ((SELECT path, rule, severity, line, "column" FROM a EXCEPT ALL SELECT path, rule, severity, line, "column" FROM b) UNION ALL (SELECT path, rule, severity, line, "column" FROM b EXCEPT ALL SELECT path, rule, severity, line, "column" FROM a))
SELECT path, rule, line, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line, "column", severity) AS nth FROM u) WHERE nth <= 3""",
)
register("counts_by_rule_and_severity", lambda s, d: counts(found(s, d)), f"WITH {diagnostics_sql('documents', RULES)} SELECT rule, severity, count(*) AS offenses, count(DISTINCT path) AS files FROM found GROUP BY 1, 2")
register(
    "report_summary",
    lambda s, d: summary(found(s, d), files(s, d, "documents")),
    f"WITH {diagnostics_sql('documents', RULES)} SELECT count(*) AS offense_count, count(DISTINCT path) AS offending_files, (SELECT count(*) FROM documents) AS inspected_file_count FROM found",
)
ITEM_SQL = "{'line': line, 'column': \"column\", 'rule': rule, 'severity': severity, 'message': message, 'length': length}"
register(
    "nested_report",
    lambda s, d: report(found(s, d)).select("path", F.to_json("offenses").alias("offenses")),
    f"WITH {diagnostics_sql('documents', RULES)} SELECT path, CAST(to_json(list({ITEM_SQL} ORDER BY line, \"column\", rule, severity, message, length)) AS VARCHAR) AS offenses FROM found GROUP BY path",
)

#: Rules whose examples one query deals over the rows of part.
CHUNK = 12


def example_files(spark: SparkSession, sf_dir: str, some: list) -> DataFrame:
    """files(path, content, example): each row of part is a file that holds one of
    the examples, by its key; the examples are a bounded table."""
    known = spark.createDataFrame([(i, k, path, source) for i, (k, _, path, source, _) in enumerate(some)], "i int, example int, name string, content string")
    # the keys are dealt out before they become sources, for parsing takes the time
    keys = spread(table(spark, sf_dir, "part").select("p_partkey"), FEW_CONTENTS)
    parts = keys.select("p_partkey", F.pmod("p_partkey", F.lit(len(some))).cast("int").alias("i"))
    return parts.join(F.broadcast(known), "i").select(F.concat(F.lit("part/"), "p_partkey", F.lit("/"), "example", F.lit("/"), "name").alias("path"), "content")


def examples_found(spark: SparkSession, sf_dir: str, some: list) -> DataFrame:
    """What each example's own rule reports in its files."""
    rules = {rule for _, rule, *_ in some}
    own = F.create_map(*[F.lit(x) for k, rule, *_ in some for x in (str(k), rule)])
    found = node_diagnostics(example_files(spark, sf_dir, some), [r for r in NODE_RULES if r.name in rules])
    return found.filter(F.col("rule") == own[F.split("path", "/")[2]]).drop("severity", "correctable")


def examples_sql(some: list) -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({i}, {k}, {text(path)}, {text(rule)}, {', '.join(map(str, r[:5]))}, {text(r[5])})" for i, (k, rule, path, _, spans) in enumerate(some) for r in spans)
    return f"""WITH e(i, example, name, rule, line, "column", last_line, last_column, length, message) AS (VALUES {rows})
SELECT concat('part/', p_partkey, '/', example, '/', name) AS path, CAST(line AS INT) AS line, CAST("column" AS INT) AS "column", CAST(last_line AS INT) AS last_line, CAST(last_column AS INT) AS last_column, CAST(length AS INT) AS length, rule, replace(message, '{{path}}', concat('part/', p_partkey, '/', example, '/', name)) AS message
FROM part JOIN e ON p_partkey % {len(some)} = i"""


def _register_examples() -> None:
    by_department: dict[str, list] = {}
    for example in expected():
        by_department.setdefault(example[1].partition("/")[0].lower(), []).append(example)
    for department, some in sorted(by_department.items()):
        names = sorted({e[1] for e in some})
        for n, begin in enumerate(range(0, len(names), CHUNK), 1):
            chunk = [e for e in some if e[1] in names[begin : begin + CHUNK]]
            register(f"rules_{department}_{n}", lambda s, d, c=chunk: examples_found(s, d, c), examples_sql(chunk))


_register_examples()
