"""Rules that look at a file as a whole: its path and content. All are one
projection over the files; a finding stands at the beginning of its file.

Null contents count as empty. Repeated rows give repeated findings; no files give
none. Other columns of files may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.line_rules import severity


@dataclass(frozen=True)
class FileRule:
    """A condition on path and content, in SQL that both engines run, and the
    pattern of the paths it is asked of; message: text, or SQL after `=`."""

    name: str
    message: str
    condition: str
    paths: str | None = None

    @property
    def where(self) -> str:
        return f"({self.condition})" + (f" AND regexp_like(path, '{self.paths}')" if self.paths else "")

    @property
    def message_sql(self) -> str:
        return self.message[1:] if self.message.startswith("=") else "'" + self.message.replace("'", "''") + "'"


BASE = "regexp_extract(path, '[^/]*$', 0)"
#: Messages are fixed values.
FILE_RULES = (
    FileRule("Lint/EmptyFile", "Empty file detected.", "content = ''"),
    FileRule("Layout/LeadingEmptyLines", "Unnecessary blank line at the beginning of the source.", "regexp_like(content, '^[ \t\r\n]*\n[ \t\r\n]*[^ \t\r\n]')"),
    FileRule("Style/FrozenStringLiteralComment", "Missing frozen string literal comment.", "content <> '' AND NOT regexp_like(content, '^(#[^\n]*\n|[ \t]*\n)*#[^\n]*frozen[_-]string[_-]literal:')"),
    FileRule("Naming/FileName", f"=concat('The name of this source file (`', {BASE}, '`) should use snake_case.')", "NOT regexp_like(path, '(^|/)[a-z0-9_.?!]+$')", "[.](rb|rake)$"),
    FileRule("RSpec/SpecFilePathFormat", "Spec path has invalid format.", "contains(path, '__')", "(^|/)spec/"),
    FileRule("RSpec/SpecFilePathSuffix", "Spec path should end with `_spec.rb`.", "NOT regexp_like(path, '_spec[.]rb$')", "(^|/)spec/"),
    FileRule("Bundler/GemFilename", f"=concat('`gems.rb` file was found but `Gemfile` is required (file path: ', path, ').')", "regexp_like(path, '(^|/)gems[.]rb$')"),
    FileRule("Gemspec/RequireMFA", "`metadata['rubygems_mfa_required']` must be set to `'true'`.", "NOT regexp_like(content, '(^|\n)[^#\n]*rubygems_mfa_required')", "[.]gemspec$"),
    FileRule("Gemspec/RequiredRubyVersion", "`required_ruby_version` should be specified.", "NOT regexp_like(content, '(^|\n)[^#\n]*required_ruby_version')", "[.]gemspec$"),
)


def _finding(rule: FileRule) -> str:
    def spark(sql: str) -> str:
        return sql.replace("\\", "\\\\")

    return f"CASE WHEN {spark(rule.where)} THEN named_struct('rule', '{rule.name}', 'severity', '{severity(rule.name)}', 'message', {spark(rule.message_sql)}) END"


def findings_in(rules: tuple[FileRule, ...]) -> Column:
    """Array of the findings of a file."""
    return F.expr(f"array_compact(array({', '.join(map(_finding, rules))}))")


def file_diagnostics(files: DataFrame, rules: tuple[FileRule, ...] = FILE_RULES, *keep: str) -> DataFrame:
    """diagnostics(...) at the beginning of each file that a rule hits."""
    whole = files.select("path", F.coalesce("content", F.lit("")).alias("content"), *keep)
    found = whole.select("path", *keep, F.explode(findings_in(rules)).alias("f"))
    one = F.lit(1)
    return found.select("path", one.alias("line"), one.alias("column"), one.alias("last_line"), one.alias("last_column"), one.alias("length"), "f.rule", "f.severity", "f.message", F.lit(False).alias("correctable"), *keep)


def file_rule_sql(rule: FileRule, view: str) -> str:
    where, message = rule.where.replace("regexp_like(", "regexp_matches("), rule.message_sql
    return f"SELECT path, 1 AS line, 1 AS \"column\", 1 AS last_line, 1 AS last_column, 1 AS length, '{rule.name}' AS rule, '{severity(rule.name)}' AS severity, {message} AS message, false AS correctable FROM {view} WHERE {where}"
