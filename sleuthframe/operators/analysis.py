"""One call from files to diagnostics: built-in rules, configuration, own rules.

Settings and globs of the configuration are data beside the files (see settings
and eligibility). The plan depends on the rules asked for. Rules over lines and whole files alone
are evaluated without parsing; as soon as a rule needs syntax trees, everything
is evaluated over the nodes table, in one pass over the files.

A null content counts as empty. A path that repeats counts once: of its contents
that of the least hash. No files give no findings. Other columns of files may
have any names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators import file_rules as whole
from sleuthframe.operators.config import Value, configured
from sleuthframe.operators.directives import directives as directives_of
from sleuthframe.operators.directives import without_disabled
from sleuthframe.operators.directive_rules import NAMES as DIRECTIVE_RULES
from sleuthframe.operators.directive_rules import directive_diagnostics
from sleuthframe.operators.eligibility import looked_at, with_skips
from sleuthframe.operators.file_rules import FILE_RULES, file_diagnostics
from sleuthframe.operators.line_rules import DIAGNOSTICS, diagnostics, enabled, selected
from sleuthframe.operators.line_rules import RULES as LINE_RULES
from sleuthframe.rules import RULES as NODE_RULES
from sleuthframe.rules.engine import SUPPRESSED, from_line_rule, node_diagnostics

#: A rule of the caller's own: files(path, content) to diagnostics rows.
OwnRule = Callable[[DataFrame], DataFrame]


def rule_names() -> list[str]:
    """The names of all built-in rules, sorted, each once."""
    return sorted({*(r.name for r in (*LINE_RULES, *FILE_RULES, *NODE_RULES)), *DIRECTIVE_RULES})


def one_of_each_path(files: DataFrame) -> DataFrame:
    """files with one row of each path. Only the paths are shuffled, unless one repeats."""
    if not files.groupBy("path").count().filter("count > 1").limit(1).count():
        return files
    return files.groupBy("path").agg(F.min_by("content", F.struct(F.xxhash64("content"), "content")).alias("content"))


def analyze(files: DataFrame, only: list[str] | None = None, config: dict[str, dict[str, Value]] | None = None, own: Iterable[OwnRule] = (), directives: bool = True) -> DataFrame:
    """Diagnostics of the selected rules and of `own`; a path counts once. With
    `directives`, comments in the source suppress findings of every kind."""
    files = one_of_each_path(files.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")))
    chosen = tuple(selected(only, rules) for rules in (LINE_RULES, FILE_RULES, NODE_RULES))
    asked = [n for n in DIRECTIVE_RULES if enabled(n, only)] if directives else []
    marked = F.contains("content", F.lit("# rubocop:"))
    some = files.filter(marked)
    if not (asked and some.limit(1).count()):
        parts, asked = [_found(files, *chosen, directives, config)], []
    else:
        # files that have directives are looked at once, also for what is found before suppression
        raw = _found(some, *chosen, directives, config).persist()
        parts = [_found(files.filter(~marked), *chosen, directives, config), raw]
    parts = [p.filter("NOT off").select(*DIAGNOSTICS) for p in parts] if any(chosen) else []
    for rule in own:
        found = _own(rule, files)
        parts.append(without_disabled(found.join(files.select("path", directives_of(F.col("content")).alias("dirs")), "path", "left")).select(*DIAGNOSTICS) if directives else found)
    if asked:
        run = sorted({r.name for rules in chosen for r in rules})
        before = [raw.select(*DIAGNOSTICS), *(_own(rule, some) for rule in own)] if run else [diagnostics(some).limit(0)]
        parts.append(directive_diagnostics(some, functools.reduce(DataFrame.unionByName, before), asked, run, only is None, config))
    return functools.reduce(DataFrame.unionByName, parts) if parts else diagnostics(files).limit(0)


def _found(files: DataFrame, line_rules: tuple, file_rules: tuple, node_rules: tuple, directives: bool, config: dict[str, dict[str, Value]] | None) -> DataFrame:
    """Diagnostics of these rules with `off`: whether comments in the source disable them."""
    looked = with_skips(files, [r.name for r in (*line_rules, *file_rules, *node_rules)], config)
    if node_rules:
        told = looked.withColumn("told", whole.findings_in(file_rules)) if file_rules else looked
        return node_diagnostics(told, (*node_rules, *map(from_line_rule, line_rules)), directives, config, marked=True)
    looked = looked.withColumn("dirs", directives_of(F.col("content"))) if directives else looked
    keep = ("dirs", "skip") if directives else ("skip",)
    line_rules = configured(line_rules, config or {})
    found = [diagnostics(looked, line_rules, *keep)] if line_rules else []
    found += [file_diagnostics(looked, file_rules, *keep)] if file_rules else []
    off = F.expr(SUPPRESSED.format(line="line")) if directives else F.lit(False)
    found = [f.filter(looked_at(F.col("rule"))).select(*DIAGNOSTICS, off.alias("off")) for f in found]
    return functools.reduce(DataFrame.unionByName, found) if found else diagnostics(files).limit(0).withColumn("off", F.lit(False))


def _own(rule: OwnRule, files: DataFrame) -> DataFrame:
    """What a rule of the caller's own finds, with all columns of diagnostics."""
    found = rule(files)
    for name, other in (("last_line", F.col("line")), ("last_column", F.col("column") + F.col("length") - 1), ("correctable", F.lit(False))):
        found = found if name in found.columns else found.withColumn(name, other)
    return found.select(*DIAGNOSTICS)
