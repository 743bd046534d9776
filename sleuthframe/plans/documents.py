"""Registered queries over sources made of every document's words: three words
make a statement, which statement it is goes by its place. What rules find and
correct in them follows from the words, and the SQL says it so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.operators.analysis import analyze
from sleuthframe.operators.autocorrect import autocorrect
from sleuthframe.operators.line_rules import selected
from sleuthframe.plans.catalog import register
from sleuthframe.rules import RULES
from sleuthframe.sources.tables import spread, table

#: Documents that one task makes sources of and parses.
PER_TASK = 500

#: Statements of the words {x}, {y} and {z} and what they read when corrected.
STATEMENTS = (
    ("{x} == nil", "{x}.nil?"),
    ("not {x}", "!{x}"),
    ("{x}.collect {{ |v| v + 1 }}", "{x}.map {{ |v| v + 1 }}"),
    ("raise Exception, '{z}'", "raise StandardError, '{z}'"),
    ("puts {x}.to_s", "puts {x}"),
    ("{x}.{y} if !{z}", "{x}.{y} unless {z}"),
    ("{x}.map {{ |v| [v, {y}] }}.to_h", "{x}.to_h {{ |v| [v, {y}] }}"),
    ("@{x} = {{ :{y} => {z}, :{x} => 1 }}", "@{x} = {{ {y}: {z}, {x}: 1 }}"),
    ("!!{x}", "!{x}.nil?"),
    ("{x}.{y}.size == 0", "{x}.{y}.empty?"),
    ("{x}.each_with_object([]) {{ |v| v }}", "{x}.each {{ |v| v }}"),
    ("[{x}.min, {x}.max]", "{x}.minmax"),
    ("{y} {z} {{ |v| v }}", "{y}({z} {{ |v| v }})"),
    ("@{x} = {z} ? true : false if {y} == {x}", "@{x} = {z} ? true : false if {y} == {x}"),
)
CORRECTING = ["Style/NilComparison", "Style/Not", "Style/CollectionMethods", "Lint/RaiseException", "Lint/RedundantStringCoercion", "Style/NegatedIf", "Style/MapToHash", "Style/HashSyntax", "Style/DoubleNegation", "Style/ZeroLengthPredicate", "Lint/RedundantWithObject", "Style/MinMax", "Lint/AmbiguousBlockAssociation"]


def _parts(statement: str) -> list[str]:
    """A statement as SQL texts and columns to be joined."""
    out = []
    for piece in statement.replace("{{", "\x01").replace("}}", "\x02").replace("{", "\x00{").replace("}", "}\x00").split("\x00"):
        piece = piece.replace("\x01", "{").replace("\x02", "}")
        if piece:
            out.append(piece)
    return out


def _sql(statement: str, quote) -> str:
    return "concat(" + ", ".join(p[1] if p in ("{x}", "{y}", "{z}") else quote(p) for p in _parts(statement)) + ")"


def sources(spark: SparkSession, sf_dir: str, statements: tuple[str, ...], path: str = "concat('documents/', cast(doc_id AS STRING), '.rb')") -> DataFrame:
    """files(path, content): each document's words, by threes, as these statements in turn."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([a-z]+)"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), PER_TASK).select(F.expr(path).alias("path"), F.transform(words, lambda w: F.concat(F.lit("q"), w)).alias("words"))
    each = " ".join(f"WHEN {k} THEN {_sql(s, lambda t: repr(t) if chr(39) not in t else chr(34) + t + chr(34))}" for k, s in enumerate(statements))
    line = f"CASE pmod(i, {len(statements)}) {each} END"
    for name, at in (("x", 0), ("y", 1), ("z", 2)):
        line = line.replace(f", {name})", f", get(words, 3 * i + {at}))").replace(f", {name},", f", get(words, 3 * i + {at}),").replace(f"({name},", f"(get(words, 3 * i + {at}),").replace(f"({name})", f"(get(words, 3 * i + {at}))")
    made = f"if(size(words) < 3, '', array_join(transform(sequence(0, cast(size(words) div 3 AS int) - 1), i -> concat({line}, '\\n')), ''))"
    return docs.select("path", F.expr(made).alias("content"))


def lines_cte(statements: tuple[str, ...], path: str = "concat('documents/', doc_id, '.rb')") -> str:
    """DuckDB's SQL of the same statements: t(path, i, k, x, y, z, line)."""
    each = " ".join(f"WHEN {k} THEN " + _sql(s, lambda t: "'" + t.replace("'", "''") + "'") for k, s in enumerate(statements))
    return f"""w AS (SELECT {path} AS path, list_transform(regexp_extract_all(coalesce(text, ''), '[a-z]+'), lambda w: 'q' || w) AS words FROM documents),
u AS (SELECT path, words, unnest(range(0, len(words) // 3)) AS i FROM w),
v AS (SELECT path, i, i % {len(statements)} AS k, words[3 * i + 1] AS x, words[3 * i + 2] AS y, words[3 * i + 3] AS z FROM u),
t AS (SELECT *, CASE k {each} END AS line FROM v)"""


BEFORE, AFTER = tuple(b for b, _ in STATEMENTS), tuple(a for _, a in STATEMENTS)
register(
    "corrected_documents",
    lambda s, d: autocorrect(sources(s, d, BEFORE), selected(CORRECTING, RULES))[1].select("path", "content", F.size("accepted").alias("accepted")),
    f"""WITH {lines_cte(AFTER)},
c AS (SELECT path, string_agg(line || chr(10), '' ORDER BY i) AS content, sum(CASE k WHEN 13 THEN 0 WHEN 7 THEN 2 ELSE 1 END) AS accepted FROM t GROUP BY path)
SELECT w.path, coalesce(content, '') AS content, CAST(coalesce(accepted, 0) AS INT) AS accepted FROM w LEFT JOIN c USING (path)""",
)

#: A configuration; statements; and by their numbers the rule, column and message reported, and a condition.
CONFIG = {
    "Style/ClassCheck": {"EnforcedStyle": "kind_of?"},
    "Style/NilComparison": {"EnforcedStyle": "comparison"},
    "Style/StringLiterals": {"EnforcedStyle": "double_quotes"},
    "Style/NumericPredicate": {"EnforcedStyle": "comparison", "AllowedMethods": ["qallowed"], "AllowedPatterns": ["^qst"]},
    "Style/GlobalVars": {"AllowedVariables": ["$qan", "$qthe"]},
    "Metrics/ParameterLists": {"Max": "2"},
}
TOLD = ("{x}.is_a?({y})", "{x}.kind_of?({y})", "{x} == nil", "{x}.nil?", "@{x} = '{y}'", '@{x} = "{y}"', "{x}.{y}.zero?", "{x}({y}.positive?)", "${x} = 1", "def {x}(a, b, c); end")
REPORTED = {
    0: ("Style/ClassCheck", "len(x) + 2", "'Prefer `Object#kind_of?` over `Object#is_a?`.'", "true"),
    3: ("Style/NilComparison", "len(x) + 2", "'Prefer the use of the `==` comparison.'", "true"),
    4: ("Style/StringLiterals", "len(x) + 5", "'Prefer double-quoted strings unless you need single quotes to avoid extra backslashes for escaping.'", "true"),
    6: ("Style/NumericPredicate", "1", "'Use `' || x || '.' || y || ' == 0` instead of `' || line || '`.'", "true"),
    7: ("Style/NumericPredicate", "len(x) + 2", "'Use `' || y || ' > 0` instead of `' || y || '.positive?`.'", "x NOT LIKE 'qst%'"),
    8: ("Style/GlobalVars", "1", "'Do not introduce global variables.'", "x NOT IN ('qan', 'qthe')"),
    9: ("Metrics/ParameterLists", "len(x) + 5", "'Avoid parameter lists longer than 2 parameters. [3/2]'", "true"),
}


def _reported(place: int, quote=lambda t: t) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {quote(r[place])}" for k, r in REPORTED.items()) + " END"


register(
    "configured_documents",
    lambda s, d: analyze(sources(s, d, TOLD), list(CONFIG), CONFIG).select("path", "line", "column", "rule", "message"),
    f"""WITH {lines_cte(TOLD)}
SELECT path, CAST(i + 1 AS INT) AS line, CAST({_reported(1)} AS INT) AS "column", {_reported(0, lambda r: f"'{r}'")} AS rule, {_reported(2)} AS message
FROM t WHERE k IN ({', '.join(map(str, REPORTED))}) AND {_reported(3)}""",
)

GLOBS = {"AllCops": {"Exclude": ["fr/*"]}, "Style/NilComparison": {"Exclude": ["*/?eb/*7.rb", "es/*"]}, "Style/Not": {"Include": ["en/*", "*2.rb"]}}
PATHS = "concat(coalesce(lang, 'none'), '/', coalesce(source, 'none'), '/', {id}, '.rb')"
ASKED = ("{x} == nil", "not {x}")
register(
    "eligible_documents",
    lambda s, d: analyze(sources(s, d, ASKED, PATHS.format(id="cast(doc_id AS STRING)")), ["Style/NilComparison", "Style/Not"], GLOBS).groupBy("path", "rule").agg(F.count("*").alias("findings")),
    f"""WITH {lines_cte(ASKED, PATHS.format(id="doc_id"))}
SELECT path, CASE k WHEN 0 THEN 'Style/NilComparison' ELSE 'Style/Not' END AS rule, count(*) AS findings FROM t
WHERE NOT path LIKE 'fr/%' AND CASE k WHEN 0 THEN NOT (path LIKE '%/_eb/%7.rb' OR path LIKE 'es/%') ELSE path LIKE 'en/%' OR path LIKE '%2.rb' END GROUP BY ALL""",
)

#: Lines of a source by the lengths of every third of a document's words, with directives among them.
DIRECTED = "CASE length(w) % 7 WHEN 0 THEN '# rubocop:disable Style/NilComparison' WHEN 1 THEN '# rubocop:enable Style/NilComparison' WHEN 2 THEN concat('q', w, ' == nil') WHEN 3 THEN concat('q', w, ' == nil # rubocop:disable Style/NilComparison') WHEN 4 THEN concat('q', w, '.nil? # rubocop:disable Style/NilComparison') ELSE concat('q', w, '.nil?') END"
DIRECTIVES = ["Style/NilComparison", "Lint/RedundantCopDisableDirective", "Lint/MissingCopEnableDirective", "Lint/RedundantCopEnableDirective"]


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([a-z]+)"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), PER_TASK)
    return docs.select(F.expr("concat('documents/', cast(doc_id AS STRING), '.rb')").alias("path"), words.alias("words")).select("path", F.expr(f"array_join(transform(filter(words, (w, i) -> i % 3 = 0), w -> concat({DIRECTED}, '\\n')), '')").alias("content"))


register(
    "directive_ranges",
    lambda s, d: analyze(directed(s, d), DIRECTIVES).select("path", "line", "column", "last_column", "rule", "message"),
    f"""WITH w AS (SELECT concat('documents/', doc_id, '.rb') AS path, regexp_extract_all(coalesce(text, ''), '[a-z]+') AS words FROM documents),
u AS (SELECT path, words, unnest(range(0, (len(words) + 2) // 3)) AS i FROM w),
t AS (SELECT path, words[3 * i + 1] AS w, i + 1 AS line, length(words[3 * i + 1]) % 7 AS k FROM u),
own AS (SELECT path, line, k, lead(line) OVER p AS "end", lag(k) OVER p AS before FROM t WHERE k IN (0, 1) WINDOW p AS (PARTITION BY path ORDER BY line)),
hits AS (SELECT path, line FROM t WHERE k IN (2, 3)),
open AS (SELECT o.path, o.line, o."end", (SELECT min(h.line) FROM hits h WHERE h.path = o.path AND h.line >= o.line) AS hit FROM own o WHERE k = 0),
state AS (SELECT t.path, t.line, t.k, last_value(CASE WHEN k IN (0, 1) THEN k END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS s FROM t)
SELECT path, CAST(line AS INT) AS line, CAST(1 AS INT) AS "column", CAST(37 AS INT) AS last_column, 'Lint/RedundantCopDisableDirective' AS rule, 'Unnecessary disabling of `Style/NilComparison`.' AS message FROM open WHERE hit IS NULL OR hit > "end"
UNION ALL SELECT path, line, len(w) + 8, len(w) + 44, 'Lint/RedundantCopDisableDirective', 'Unnecessary disabling of `Style/NilComparison`.' FROM t WHERE k = 4
UNION ALL SELECT path, line, 1, 37, 'Lint/MissingCopEnableDirective', 'Re-enable Style/NilComparison cop with `# rubocop:enable` after disabling it.' FROM open WHERE "end" IS NULL
UNION ALL SELECT path, line, 18, 36, 'Lint/RedundantCopEnableDirective', 'Unnecessary enabling of Style/NilComparison.' FROM own WHERE k = 1 AND before IS DISTINCT FROM 0
UNION ALL SELECT s.path, s.line, len(w) + 3, len(w) + 4, 'Style/NilComparison', 'Prefer the use of the `nil?` predicate.' FROM state s JOIN t ON t.path = s.path AND t.line = s.line WHERE s.k = 2 AND s.s IS DISTINCT FROM 0""",
)
