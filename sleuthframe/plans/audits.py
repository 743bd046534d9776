"""Registered audits of rule sets over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.operators.audits import batches, isolated, mutations, under_configurations
from sleuthframe.operators.line_rules import LineRule, diagnostics, selected
from sleuthframe.plans.catalog import RULES as LINE_RULES
from sleuthframe.plans.catalog import diagnostics_sql, register
from sleuthframe.plans.documents import CONFIG, TOLD, lines_cte, sources
from sleuthframe.rules import RULES
from sleuthframe.sources.tables import files, table

#: Rules that fail on documents: one on every line, one on lines that hold a word.
FAILING = (LineRule("Audit/NotANumber", "=cast(cast(body AS INT) AS STRING)", "length(body) > 0"), LineRule("Audit/NotADate", "=cast(cast(body AS DATE) AS STRING)", "contains(body, 'the')"))


def isolated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, failed = isolated(files(spark, sf_dir, "documents"), (*LINE_RULES, *FAILING), lambda f, rules: diagnostics(f, tuple(rules)))
    counted = found.groupBy("rule").agg(F.count("*").alias("findings"))
    return counted.withColumn("failed", F.lit(False)).unionByName(failed.select("rule", F.lit(0).cast("long").alias("findings"), F.lit(True).alias("failed")))


register(
    "isolated_rules",
    isolated_rules,
    f"""WITH {diagnostics_sql("documents", LINE_RULES)}
SELECT rule, count(*) AS findings, false AS failed FROM found GROUP BY rule UNION ALL SELECT 'Audit/NotANumber', 0, true UNION ALL SELECT 'Audit/NotADate', 0, true""",
)

CONFIGS = [{}, CONFIG, {"Style/GlobalVars": CONFIG["Style/GlobalVars"], "Metrics/ParameterLists": {"Max": "3"}}]
register(
    "configuration_mutations",
    lambda s, d: mutations(under_configurations(sources(s, d, TOLD), selected(list(CONFIG), RULES), CONFIGS), len(CONFIGS)),
    f"""WITH {lines_cte(TOLD)},
f AS (SELECT CASE k WHEN 0 THEN 'Style/ClassCheck' WHEN 1 THEN 'Style/ClassCheck' WHEN 2 THEN 'Style/NilComparison' WHEN 3 THEN 'Style/NilComparison' WHEN 4 THEN 'Style/StringLiterals' WHEN 5 THEN 'Style/StringLiterals'
    WHEN 6 THEN 'Style/NumericPredicate' WHEN 7 THEN 'Style/NumericPredicate' WHEN 8 THEN 'Style/GlobalVars' ELSE 'Metrics/ParameterLists' END AS rule,
  k IN (1, 2, 5, 8) AS a, k IN (0, 3, 4, 6, 9) OR k = 7 AND x NOT LIKE 'qst%' OR k = 8 AND x NOT IN ('qan', 'qthe') AS b,
  k IN (1, 2, 5) OR k = 8 AND x NOT IN ('qan', 'qthe') AS c FROM t),
e AS (SELECT rule, 1 AS config, a, b FROM f WHERE a OR b OR c UNION ALL SELECT rule, 2, a, c FROM f WHERE a OR b OR c)
SELECT rule, CAST(config AS INT) AS config, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN NOT a AND b THEN 1 ELSE 0 END) AS BIGINT) AS gained FROM e GROUP BY ALL""",
)

RESULTS = "l_orderkey AS run, l_tax AS batch, l_linestatus AS revision, 1 AS version, CAST(l_quantity AS INT) % 9 AS position, l_returnflag AS classification, l_linenumber AS \"left\", l_partkey AS \"right\", l_suppkey AS exact, CAST(round(l_extendedprice) AS BIGINT) AS left_seconds, CAST(round(l_discount * 100) AS BIGINT) AS right_seconds"
register(
    "batch_runs",
    lambda s, d: batches(table(s, d, "lineitem").selectExpr(*RESULTS.replace('"', "`").split(", "))).select("run", "status", "batches", "first", "last", "positions", "islands", "left", "right", "exact", "left_seconds", "right_seconds", F.array_join(F.map_keys("classifications"), ",").alias("classes")),
    f"""WITH r AS (SELECT {RESULTS} FROM lineitem),
p AS (SELECT DISTINCT run, position FROM r), q AS (SELECT run, position - row_number() OVER (PARTITION BY run ORDER BY position) AS g FROM p),
i AS (SELECT run, count(DISTINCT g) AS islands FROM q GROUP BY run),
s AS (SELECT run, count(DISTINCT batch) AS batches, count(DISTINCT revision) AS revisions, count(*) AS n, count(DISTINCT position) AS positions, min(position) AS first, max(position) AS last, CAST(sum("left") AS BIGINT) AS "left", CAST(sum("right") AS BIGINT) AS "right", CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(left_seconds) AS BIGINT) AS left_seconds, CAST(sum(right_seconds) AS BIGINT) AS right_seconds, array_to_string(list_sort(list_distinct(list(classification))), ',') AS classes FROM r GROUP BY run),
t AS (SELECT *, CASE WHEN revisions > 1 THEN 'several revisions' WHEN n > positions THEN 'repeated positions' WHEN last - first + 1 > positions THEN 'missing positions' ELSE 'complete' END AS status FROM s)
SELECT run, status, batches, first, last, positions, islands, CASE WHEN status = 'complete' THEN "left" END AS "left", CASE WHEN status = 'complete' THEN "right" END AS "right", CASE WHEN status = 'complete' THEN exact END AS exact,
  CASE WHEN status = 'complete' THEN left_seconds END AS left_seconds, CASE WHEN status = 'complete' THEN right_seconds END AS right_seconds, classes FROM t JOIN i USING (run)""",
)
