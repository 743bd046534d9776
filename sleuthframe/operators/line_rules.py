"""Rules that look at one line of any text, and at the lines beside it.

A rule is SQL that Spark and DuckDB read alike, over (path, line, n_lines, body,
prev, next, ending, final). All selected rules are one projection over the
lines; each gives at most one finding a line. The same rules run on the rows of
kind `line` of a nodes table (see rules.engine), so that a run with syntax trees
needs no second pass.

Null contents count as empty; conditions that come out null count as false.
Repeated rows give repeated findings; no files give none. Other columns of files
may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.functions.text import neighbours

#: Rules outside Lint that warn.
WARNINGS = frozenset(["Bundler/DuplicatedGem", "Bundler/DuplicatedGroup", "Bundler/InsecureProtocolSource", "Gemspec/DeprecatedAttributeAssignment", "Gemspec/DuplicatedAssignment", "Gemspec/RequireMFA", "Gemspec/RequiredRubyVersion", "Gemspec/RubyVersionGlobalsUsage", "Layout/BeginEndAlignment", "Layout/DefEndAlignment", "Layout/EndAlignment"])
#: Rules that run only when asked for by their full name.
ON_REQUEST = frozenset(["Naming/InclusiveLanguage", "RSpec/MessageChain", "RSpec/MultipleExpectations", "RSpec/MultipleMemoizedHelpers", "RSpec/PendingWithoutReason", "Security/IoMethods", "Style/Copyright", "Style/DisableCopsWithinSourceCodeDirective", "Style/Documentation"])
#: Withdrawn rules, which run only when asked for by their full name as well.
WITHDRAWN = frozenset(["Layout/EmptyLines", "Layout/SpaceAfterComma", "Layout/SpaceAfterSemicolon", "Lint/AssignmentInCondition", "Lint/DuplicateHashKey", "Lint/TopLevelReturnWithArgument", "Style/InlineComment"])
DIAGNOSTICS = ["path", "line", "column", "last_line", "last_column", "length", "rule", "severity", "message", "correctable"]


def severity(rule: str) -> str:
    return "warning" if rule.startswith("Lint/") or rule in WARNINGS else "convention"


@dataclass(frozen=True)
class LineRule:
    """where: SQL of the condition; column and length: SQL of what to report;
    message: text, or SQL after `=`; options: configuration keys with their
    defaults, whose values stand for {Key}; needs: a string that every hit holds,
    looked for first."""

    name: str
    message: str
    where: str
    column: str = "1"
    length: str = "length(body)"
    correctable: bool = False
    needs: str | None = None
    options: Mapping[str, str] = field(default_factory=dict, hash=False)

    @property
    def severity(self) -> str:
        return severity(self.name)

    def filled(self, text: str) -> str:
        """text with the options' values in place of {Key}."""
        return re.sub(r"\{(\w+)\}", lambda m: str(self.options[m[1]]) if m[1] in self.options else m[0], text)

    @property
    def message_sql(self) -> str:
        text = self.filled(self.message)
        return text[1:] if text.startswith("=") else "'" + text.replace("'", "''") + "'"

    @property
    def where_sql(self) -> str:
        where = self.filled(self.where)
        return f"contains(body, '{self.needs}') AND ({where})" if self.needs else where


def part(pattern: str) -> dict[str, str]:
    """Condition, column and length of a pattern's second group, the first being
    what stands before it on the line."""
    return {"where": f"regexp_like(body, '{pattern}')", "column": f"length(regexp_extract(body, '{pattern}', 1)) + 1", "length": f"length(regexp_extract(body, '{pattern}', 2))"}


TRIMMED = {"column": "length(body) - length(ltrim(body)) + 1", "length": "length(trim(body))"}
#: Messages are fixed values.
RULES = (
    LineRule("Layout/LineLength", "=concat('Line is too long. [', length(body), '/', {Max}, ']')", "length(body) > {Max}", "{Max} + 1", "length(body) - {Max}", options={"Max": "120"}),
    LineRule("Layout/TrailingWhitespace", "Trailing whitespace detected.", "right(body, 1) IN (' ', '	', '　')", "length(regexp_replace(body, '[ \t　]+$', '')) + 1", "length(body) - length(regexp_replace(body, '[ \t　]+$', ''))", correctable=True),
    LineRule("Layout/IndentationStyle", "Tab detected in indentation.", correctable=True, needs="\t", **part("^( *)(\t+)")),
    LineRule("Layout/EmptyLines", "Extra blank line detected.", "line > 1 AND trim(body) = '' AND trim(prev) = ''", length="1", correctable=True),
    LineRule("Layout/InitialIndentation", "Indentation of first line in file detected.", "line = 1 AND regexp_like(body, '^[ \t]+[^ \t#]')", "length(regexp_extract(body, '^[ \t]+', 0)) + 1", "1", correctable=True),
    LineRule("Layout/TrailingEmptyLines", "=CASE WHEN NOT final THEN 'Final newline missing.' ELSE '1 trailing blank lines detected.' END", "line = n_lines AND (NOT final OR trim(body) = '' AND trim(prev) <> '')", "CASE WHEN final THEN 1 ELSE length(body) END", "1", correctable=True),
    LineRule("Layout/EndOfLine", "Carriage return character detected.", "ending <> '' AND line = 1", length="length(body) + 1"),
    LineRule("Rails/DefaultScope", "Avoid using `default_scope`.", needs="default_scope", **part("^([^#]*?)(default_scope)")),
    LineRule("Rails/FilePath", "Prefer `Rails.root.join`.", needs="Rails.root", **part("^(.*?)(File\\.join\\(Rails\\.root|Rails\\.root\\.to_s)")),
    LineRule("Rails/ApplicationJob", "Jobs should subclass `ApplicationJob`.", f"contains(path, '/app/jobs/') AND {part('^(.*?< *)(ActiveJob::Base)')['where']}", part("^(.*?< *)(ActiveJob::Base)")["column"], part("^(.*?< *)(ActiveJob::Base)")["length"], needs="ActiveJob::Base"),
    LineRule("Rails/ReversibleMigration", "Use reversible migration helpers or define `up` and `down`.", "contains(path, '/db/migrate/') AND regexp_like(body, '^ *(execute|drop_table|remove_column|change_column)( |\\()')", **TRIMMED),
    LineRule("RSpec/Focus", "Focused spec found.", "regexp_like(body, '^\\s*(fdescribe|fcontext|fit)') OR contains(body, 'focus: true')", **TRIMMED),
    LineRule("RSpec/MessageChain", "Avoid stubbing using `receive_message_chain`.", needs="receive_message_chain", **part("^(.*?)(receive_message_chain)")),
    LineRule("RSpec/PendingWithoutReason", "Give the reason for pending.", "regexp_like(body, '^\\s*(pending|skip)\\s*$')", **TRIMMED),
    LineRule("RSpec/VariableName", "Use snake_case for variable names.", needs="(:", **part("^(\\s*(?:let!?|subject!?)\\(:)([a-z0-9_]*[A-Z][A-Za-z0-9_]*)")),
    LineRule("Style/DoubleCopDisableDirective", "More than one disable comment on one line.", correctable=True, needs="# rubocop:", **part("^(.*?)(# rubocop:(?:disable|todo) .*# rubocop:(?:disable|todo).*)$")),
    LineRule("Migration/DepartmentName", "Department name is missing.", correctable=True, needs="# rubocop:", **part("^(.*# rubocop:(?:disable|todo|enable) +(?:[A-Z][A-Za-z]*/[A-Za-z]+, *)*)([A-Z][A-Za-z]*[a-z][A-Z][A-Za-z]*)(?: |,|$)")),
    LineRule("Layout/SpaceAfterComma", "Space missing after comma.", needs=",", **part("^(.*?)(,)[^ \t,)\\]}\"]")),
    LineRule("Layout/SpaceAfterSemicolon", "Space missing after semicolon.", needs=";", **part("^(.*?)(;)[^ \t;]")),
)


def enabled(rule: str, only: list[str] | None = None) -> bool:
    """Whether a selection of exact names and departments asks for a rule."""
    quiet = rule in ON_REQUEST or rule in WITHDRAWN
    if only is None:
        return not quiet
    return rule in only or not quiet and rule.partition("/")[0] in only


def selected(only: list[str] | None = None, rules: tuple = RULES) -> tuple:
    """Rules by exact name or by department; all but those on request by default.
    Unknown names select nothing."""
    return tuple(r for r in rules if enabled(r.name, only))


def _spark(sql: str) -> str:
    """A rule's SQL for Spark, whose string literals take backslashes as escapes."""
    return sql.replace("\\", "\\\\")


def _finding(rule: LineRule) -> str:
    return f"CASE WHEN {_spark(rule.where_sql)} THEN named_struct('rule', '{rule.name}', 'severity', '{rule.severity}', 'message', {_spark(rule.message_sql)}, 'column', {_spark(rule.filled(rule.column))}, 'length', greatest(1, {_spark(rule.filled(rule.length))}), 'correctable', {str(rule.correctable).lower()}) END"


def findings_in(rules: Iterable[LineRule]):
    """Array of the findings of a line."""
    each = [_finding(r) for r in rules]
    return F.expr(f"array_compact(array({', '.join(each)}))" if each else "cast(array() AS array<struct<rule:string,severity:string,message:string,column:int,length:int,correctable:boolean>>)")


def diagnostics(files: DataFrame, rules: tuple[LineRule, ...] | None = None, *keep: str) -> DataFrame:
    """diagnostics(path, line, column, last_line, last_column, length, rule,
    severity, message, correctable) and the columns of files to keep."""
    rules = selected() if rules is None else rules
    found = neighbours(files, *keep).select("path", "line", *keep, F.explode(findings_in(rules)).alias("f"))
    return found.select("path", "line", "f.column", F.col("line").alias("last_line"), (F.col("f.column") + F.col("f.length") - 1).alias("last_column"), "f.length", "f.rule", "f.severity", "f.message", "f.correctable", *keep)


def rule_sql(rule: LineRule, name: str) -> str:
    """The rule's findings in the lines_{name} of LINES_SQL, in DuckDB's SQL."""
    column, length = rule.filled(rule.column), f"greatest(1, {rule.filled(rule.length)})"
    sql = f"SELECT path, CAST(line AS INT) AS line, CAST({column} AS INT) AS \"column\", CAST(line AS INT) AS last_line, CAST({column} + {length} - 1 AS INT) AS last_column, CAST({length} AS INT) AS length, '{rule.name}' AS rule, '{rule.severity}' AS severity, {rule.message_sql} AS message, {str(rule.correctable).lower()} AS correctable FROM lines_{name} WHERE {rule.where_sql}"
    return sql.replace("regexp_like(", "regexp_matches(")
