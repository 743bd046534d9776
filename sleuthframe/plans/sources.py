"""Registered queries over sources made of the rows of part: what the engine does with
them follows from the row, and the SQL says it so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.operators.analysis import analyze
from sleuthframe.operators.autocorrect import autocorrect
from sleuthframe.operators.config import parse_config
from sleuthframe.operators.line_rules import selected
from sleuthframe.parser.nodes import ALWAYS, Asked, nodes
from sleuthframe.plans.catalog import register
from sleuthframe.rules import RULES
from sleuthframe.sources.decode import decode
from sleuthframe.sources.tables import FEW_CONTENTS, spread, table

#: Small sources of different contents that one task parses.
PER_TASK = 5000
PATH = "concat('part/', cast(p_partkey AS STRING), '.rb')"


def made(spark: SparkSession, sf_dir: str, content: str, per_task: int = PER_TASK) -> DataFrame:
    """files(path, content): a source for each row of part, by an SQL expression."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), per_task)
    return part.select(F.expr(PATH).alias("path"), F.expr(content).alias("content"))


NODES = "concat('part_', cast(p_partkey AS STRING), '(', cast(p_size AS STRING), ')\\nclass C', cast(p_partkey AS STRING), '\\n  def m; end\\nend\\n')"
SHOWN = frozenset(["call", "integer", "class", "constant_read", "def"])
register(
    "nodes_table",
    lambda s, d: nodes(made(s, d, NODES), Asked(SHOWN, columns=ALWAYS)).filter(F.col("kind").isin(*SHOWN)).select("path", "kind", "name", "role", "depth", "at.line", "at.column", "at.last_line", "at.last_column"),
    f"""WITH t AS (SELECT {PATH.replace("STRING", "VARCHAR")} AS path, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS n FROM part)
SELECT path, 'call' AS kind, concat('part_', k) AS name, 'body' AS role, CAST(1 AS INT) AS depth, CAST(1 AS INT) AS line, CAST(1 AS INT) AS "column", CAST(1 AS INT) AS last_line, CAST(len(k) + len(n) + 7 AS INT) AS last_column FROM t
UNION ALL SELECT path, 'integer', n, 'arg', 2, 1, len(k) + 7, 1, len(k) + len(n) + 6 FROM t
UNION ALL SELECT path, 'class', concat('C', k), 'body', 1, 2, 1, 4, 3 FROM t
UNION ALL SELECT path, 'constant_read', concat('C', k), 'path', 2, 2, 7, 2, len(k) + 7 FROM t
UNION ALL SELECT path, 'def', 'm', 'body', 2, 3, 3, 3, 12 FROM t""",
)
register(
    "parse_errors",
    lambda s, d: analyze(made(s, d, "if(p_partkey % 3 = 0, concat('x = (', cast(p_size AS STRING)), 'x = 1\\n')", FEW_CONTENTS), ["Lint/Syntax", "Style/Not"]).select("path", "rule", "severity", "line", "column"),
    f"SELECT {PATH.replace('STRING', 'VARCHAR')} AS path, 'Lint/Syntax' AS rule, 'warning' AS severity, CAST(1 AS INT) AS line, CAST(6 + len(CAST(p_size AS VARCHAR)) AS INT) AS \"column\" FROM part WHERE p_partkey % 3 = 0",
)
DISABLED = "concat('eval(a)\\n# rubocop:disable Security/Eval -- known\\n', repeat('eval(b)\\n', p_size % 4), '# rubocop:enable Security/Eval\\neval(c) # rubocop:todo Security\\neval(d)\\n')"
register(
    "suppressed_by_directives",
    lambda s, d: analyze(made(s, d, DISABLED, FEW_CONTENTS), ["Security/Eval"]),
    f"""WITH t AS (SELECT {PATH.replace("STRING", "VARCHAR")} AS path, unnest([1, p_size % 4 + 5]) AS line FROM part)
SELECT path, CAST(line AS INT) AS line, CAST(1 AS INT) AS "column", CAST(line AS INT) AS last_line, CAST(4 AS INT) AS last_column, CAST(4 AS INT) AS length, 'Security/Eval' AS rule, 'convention' AS severity, 'The use of `eval` is a serious security risk.' AS message, false AS correctable FROM t""",
)
WRONG = "concat('x.kind_of?(Part', cast(p_partkey AS STRING), ')\\ny = ?', chr(cast(97 + p_size % 26 AS INT)), if(p_size % 2 = 0, ' # rubocop:disable Style/CharacterLiteral', ''), '\\n')"
FIXERS = ["Style/ClassCheck", "Style/CharacterLiteral"]
register(
    "autocorrected_sources",
    lambda s, d: autocorrect(made(s, d, WRONG), selected(FIXERS, RULES))[1].select("path", "content", F.size("accepted").alias("accepted")),
    f"""SELECT {PATH.replace("STRING", "VARCHAR")} AS path, concat('x.is_a?(Part', p_partkey, ')', chr(10), 'y = ', CASE WHEN p_size % 2 = 0 THEN concat('?', chr(CAST(97 + p_size % 26 AS INT)), ' # rubocop:disable Style/CharacterLiteral') ELSE concat('''', chr(CAST(97 + p_size % 26 AS INT)), '''') END, chr(10)) AS content,
    CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS INT) AS accepted FROM part""",
)
register(
    "corrected_findings",
    lambda s, d: autocorrect(made(s, d, WRONG), selected(FIXERS, RULES))[0].groupBy("rule", "corrected").agg(F.count("*").alias("n")),
    "SELECT 'Style/ClassCheck' AS rule, true AS corrected, count(*) AS n FROM part UNION ALL SELECT 'Style/CharacterLiteral', true, count(*) FROM part WHERE p_size % 2 = 1",
)
LIMITS = parse_config("Metrics/ParameterLists:\n  Max: 3\nLayout/LineLength:\n  Max: 20\n")
SIGNED = "concat('def m(', array_join(transform(sequence(1, 1 + p_size % 7), i -> concat('a', cast(i AS STRING))), ', '), ')\\nend\\n')"
register(
    "configured_limits",
    lambda s, d: analyze(made(s, d, SIGNED, FEW_CONTENTS), ["Metrics/ParameterLists", "Layout/LineLength"], LIMITS).select("path", "rule", "line", "column", "last_column", "message"),
    f"""WITH t AS (SELECT {PATH.replace("STRING", "VARCHAR")} AS path, 1 + p_size % 7 AS n FROM part), u AS (SELECT path, n, 4 * n + 5 AS wide FROM t)
SELECT path, 'Metrics/ParameterLists' AS rule, CAST(1 AS INT) AS line, CAST(6 AS INT) AS "column", CAST(wide AS INT) AS last_column, concat('Avoid parameter lists longer than 3 parameters. [', n, '/3]') AS message FROM u WHERE n > 3
UNION ALL SELECT path, 'Layout/LineLength', 1, 21, CAST(wide AS INT), concat('Line is too long. [', wide, '/20]') FROM u WHERE wide > 20""",
)
register(
    "decoded_bytes",
    lambda s, d: decode(table(s, d, "part").select(F.expr(PATH).alias("path"), F.expr("if(p_size % 2 = 0, concat(cast(p_name AS BINARY), X'FF41FE'), cast(p_name AS BINARY))").alias("raw"))).select("path", F.length("content").alias("characters"), F.hex(F.encode("marker", "UTF-8")).alias("marker"), F.hex("invalid").alias("invalid")),
    f"""SELECT {PATH.replace("STRING", "VARCHAR")} AS path, CAST(len(p_name) + CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END AS INT) AS characters, CASE WHEN p_size % 2 = 0 THEN '01' END AS marker, CASE WHEN p_size % 2 = 0 THEN 'FFFE' ELSE '' END AS invalid FROM part""",
)
register(
    "repeated_paths",
    lambda s, d: analyze(made(s, d, "'!!x\\n'", FEW_CONTENTS).union(made(s, d, "'!!x\\n'", FEW_CONTENTS)), ["Style/DoubleNegation"]).select("path", "line", "column"),
    f"SELECT {PATH.replace('STRING', 'VARCHAR')} AS path, CAST(1 AS INT) AS line, CAST(1 AS INT) AS \"column\" FROM part",
)
