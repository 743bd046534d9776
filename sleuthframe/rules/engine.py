"""Node rules: conditions on the rows of the nodes table, all in one projection.

A rule names the kinds of nodes it looks at, a condition, a message and the span
to report, in SQL over the columns of `nodes` and those that view() adds. Any
number of rules costs one pass: a row is tested against the rules of its kind
only, and its findings are exploded.

Conditions that come out null count as false. Repeated files give repeated
findings; a file with a parse error has no nodes, and `Lint/Syntax` alone reports
it. No files give no findings. Columns of files other than path and content are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sleuthframe.operators.eligibility import looked_at
from sleuthframe.operators.line_rules import LineRule, severity
from sleuthframe.operators.settings import setting, settings
from sleuthframe.parser.nodes import ALWAYS, SPAN_SQL, Asked, of_each_path, shared_nodes
from sleuthframe.rules.edits import LINE_EDITS

DIAGNOSTICS = ["path", "line", "column", "last_line", "last_column", "length", "rule", "severity", "message", "correctable"]

#: An edit puts a text in place of what lies between two offsets; equal ones insert.
EDIT_SQL = "struct<start:int,end:int,text:string>"
EDITS_SQL = f"array<{EDIT_SQL}>"

#: Columns that conditions may name beside those of the nodes table.
VIEW = {
    "recv": "get(kids, i_recv)",
    "args": "slice(kids, coalesce(i_arg, 0) + 1, n_arg)",
    "blk": "get(kids, i_block)",
    "body": "slice(kids, coalesce(i_body, 0) + 1, n_body)",
    "cond": "get(kids, i_cond)",
    "val": "get(kids, i_value)",
    "els": "get(kids, i_else)",
    "params": "get(kids, i_params)",
    "oper": "get(kids, i_operator)",
    "p": "get(up, 0)",
    "pp": "get(up, 1)",
    "a0": "if(n_arg > 0, get(kids, i_arg), null)",
    "a1": "if(n_arg > 1, get(kids, i_arg + 1), null)",
    "b0": "if(n_body > 0, get(kids, i_body), null)",
    "argc": "n_arg",
    "nbody": "n_body",
    "rk": "slice(kids2, 1, coalesce(get(kids, 0).n, 0))",
    "bk": "slice(kids2, size(kids2) - coalesce(get(kids, size(kids) - 1).n, 0) + 1, coalesce(get(kids, size(kids) - 1).n, 0))",
    "scope": "get(up, i_scope)",
}


@dataclass(frozen=True)
class NodeRule:
    """kinds: node kinds, separated by blanks; where: a condition; message: text,
    or SQL after `=`, or after `@` SQL of an array of
    messages beside those of many=True; at: SQL of the span to report, or of an array of spans with
    many=True; options: configuration keys with their defaults, whose values {Key}
    and lists {Key[]} are in all SQL of the rule (see operators.settings); only: a
    condition beside where, on the configuration; fix: SQL of the text to put at the span;
    edits: SQL of an array of edits (see EDIT_SQL) instead, in which x is the
    reported span and {told} the first text in backquotes of the message. A finding
    whose edits come out null, or have a null in them, has none. indirect: the
    correction counts as done too if others rewrite all that it would."""

    name: str
    kinds: str
    where: str
    message: str
    at: str = "at"
    many: bool = False
    fix: str | None = None
    edits: str | None = None
    indirect: bool = False
    only: str = "true"
    options: Mapping[str, str | tuple[str, ...]] = field(default_factory=dict)

    @property
    def severity(self) -> str:
        return severity(self.name)

    @property
    def correctable(self) -> bool:
        return self.edits_sql is not None

    @property
    def edits_sql(self) -> str | None:
        if self.edits is not None:
            return self.filled(self.edits).replace("{told}", f"regexp_extract({self.message_sql}, '`([^`]*)`', 1)")
        return f"array(named_struct('start', x.start, 'end', x.end, 'text', {self.filled(self.fix)}))" if self.fix is not None else None

    def filled(self, text: str) -> str:
        """text with SQL of the settings in place of {Key} and {Key[]}."""

        def sql(m: re.Match) -> str:
            if m[1] not in self.options:
                return m[0]
            values, default = setting(self.name, m[1]), self.options[m[1]]
            return values if m[2] else f"cast(get({values}, 0) AS int)" if isinstance(default, str) and default.isdecimal() else f"get({values}, 0)"

        return re.sub(r"\{(\w+)(\[\])?\}", sql, text)

    @property
    def message_sql(self) -> str:
        text = self.filled(self.message)
        return text[1:] if text[0] in "=@" else quoted(text)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def span(start: str, end: str, of: str = "at") -> str:
    """A span within the first line of the node `of`: SQL of its offsets."""
    return f"named_struct('start', {start}, 'end', {end}, 'line', {of}.line, 'column', {of}.column + ({start}) - {of}.start, 'last_line', {of}.line, 'last_column', {of}.column + ({end}) - {of}.start - 1)"


def tail(start: str, end: str, of: str = "at") -> str:
    """A span within the last line of the node `of`."""
    return f"named_struct('start', {start}, 'end', {end}, 'line', {of}.last_line, 'column', {of}.last_column - ({of}.end - 1 - ({start})), 'last_line', {of}.last_line, 'last_column', {of}.last_column - ({of}.end - ({end})))"


def thru(first: str, last: str) -> str:
    """From the beginning of one span to the end of another."""
    return f"named_struct('start', {first}.start, 'end', {last}.end, 'line', {first}.line, 'column', {first}.column, 'last_line', {last}.last_line, 'last_column', {last}.last_column)"


#: What the columns of line rules are called on rows of kind `line`.
LINE_COLUMNS = {"body": "src", "prev": "prev", "next": "next", "line": "at.line", "n_lines": "depth", "ending": "coalesce(op, '')", "final": "(open <=> 'final')"}


def from_line_rule(rule: LineRule) -> NodeRule:
    """The same rule over the rows of kind `line`."""

    def sql(text: str) -> str:
        pieces = re.split(r"('(?:[^']|'')*')", text)
        pieces[::2] = [re.sub(r"\b(" + "|".join(LINE_COLUMNS) + r")\b", lambda m: LINE_COLUMNS[m[1]], p) for p in pieces[::2]]
        return "".join(pieces).replace("\\", "\\\\")

    message = rule.message[1:] if rule.message.startswith("=") else rule.message_sql
    start = f"at.start + ({sql(rule.column)}) - 1"
    where = f"contains(body, '{rule.needs}') AND ({rule.where})" if rule.needs else rule.where
    return NodeRule(rule.name, "line", sql(where), "=" + sql(message), span(start, f"{start} + greatest(1, {sql(rule.length)})"), edits=LINE_EDITS.get(rule.name), options=rule.options)


def hits(pattern: str, column: str = "name") -> str:
    """Spans of all matches of a pattern in a line, in SQL; pattern: of Java."""
    p = quoted(pattern)
    start = _START.format(c=column, p=p)
    return f"transform(regexp_extract_all({column}, {p}, 0), (m, i) -> {span(start, start + ' + length(m)')})"


_START = "(at.start + aggregate(slice(split({c}, {p}, -1), 1, i + 1), 0, (a, y) -> a + length(y)) + aggregate(slice(regexp_extract_all({c}, {p}, 0), 1, i), 0, (a, y) -> a + length(y)))"

#: Whether comments in the source disable a finding f of a row.
SUPPRESSED = """exists(array(rule, split(rule, '/')[0], 'all'), n -> CASE
    WHEN exists(dirs, d -> NOT d.own AND d.line = {line} AND array_contains(d.names, n)) THEN exists(dirs, d -> NOT d.own AND d.line = {line} AND array_contains(d.names, n) AND d.disabled)
    ELSE coalesce(get(reverse(filter(dirs, d -> d.own AND d.line <= {line} AND array_contains(d.names, n))), 0).disabled, false) END)"""


def view(rows: DataFrame) -> DataFrame:
    """The nodes table with the columns that rules name."""
    return rows.selectExpr("*", *(f"{sql} AS {name}" for name, sql in VIEW.items()))


def _finding(rule: NodeRule, corrects: bool) -> str:
    at = f"cast({rule.filled(rule.at if rule.many else f'array({rule.at})')} AS array<{SPAN_SQL}>)"
    edits = f"transform({at}, x -> cast({rule.edits_sql} AS {EDITS_SQL}))" if corrects and rule.correctable else f"cast(null AS array<{EDITS_SQL}>)"
    message = rule.message_sql if rule.message[0] == "@" else f"array({rule.message_sql})"
    return f"CASE WHEN {_asked(rule)} THEN named_struct('rule', {quoted(rule.name)}, 'severity', {quoted(rule.severity)}, 'messages', cast({message} AS array<string>), 'correctable', {str(rule.correctable).lower()}, 'indirect', {str(rule.indirect).lower()}, 'edits', {edits}, 'spans', {at}) END"


def _asked(rule: NodeRule) -> str:
    where = rule.filled(rule.where)
    return where if rule.only == "true" else f"({where}) AND ({rule.filled(rule.only)})"


def conjuncts(where: str) -> list[str]:
    """The parts that a condition joins by AND; the whole, if it has an OR outside
    of brackets and quotes."""
    parts, depth, begin, i, quote = [], 0, 0, 0, False
    while i < len(where):
        c = where[i]
        if c == "\\":
            i += 1
        elif c == "'":
            quote = not quote
        elif not quote:
            depth += (c == "(") - (c == ")")
            if depth == 0 and where.startswith(" OR ", i):
                return [where]
            if depth == 0 and where.startswith(" BETWEEN ", i):
                return [where]
            if depth == 0 and where.startswith(" AND ", i):
                parts.append(where[begin:i])
                begin = i + 5
        i += 1
    return [*parts, where[begin:]]


def names_asked(rule: NodeRule) -> list[str] | None:
    """The only names of nodes that a rule can hit, as SQL literals, if it says so."""
    return literals_asked(rule, "name")


def literals_asked(rule: NodeRule, column: str) -> list[str] | None:
    """The only values of a column that a rule can hit, as SQL literals, if it says so."""
    for part in conjuncts(rule.filled(rule.where)):
        m = re.fullmatch(column + r" (?:= ('[^'\\]*')|IN \((('[^'\\]*'(, )?)+)\))", part)
        if m:
            return [m[1]] if m[1] else re.findall(r"'[^']*'", m[2])
    return None


def _of_kind(rules: list[NodeRule], corrects: bool) -> str:
    """Findings of the rules of one kind. Rules that can only hit certain names are
    tried on rows with one of those names alone."""
    asked = [(r, names_asked(r)) for r in rules]
    free, bound = [r for r, n in asked if n is None], [r for r, n in asked if n is not None]
    some = f"array_compact(array({', '.join(_finding(r, corrects) for r in free)}))" if free else None
    if len(bound) < 8:
        return f"array_compact(array({', '.join(_finding(r, corrects) for r in rules)}))"
    names = sorted({x for _, n in asked if n for x in n})
    tried = f"CASE WHEN name IN ({', '.join(names)}) THEN array_compact(array({', '.join(_finding(r, corrects) for r in bound)})) ELSE {NONE} END"
    return f"concat({some}, {tried})" if some else tried


NONE = f"cast(array() AS array<struct<rule:string,severity:string,messages:array<string>,correctable:boolean,indirect:boolean,edits:array<{EDITS_SQL}>,spans:array<{SPAN_SQL}>>>)"


def asked_of(rules: Iterable[NodeRule], corrects: bool = False) -> Asked:
    """The rows and columns of the nodes table that rules look at. A column counts as
    read if its name occurs in their SQL at all."""
    by_kind: dict[str, list[NodeRule]] = {}
    for rule in rules:
        for kind in rule.kinds.split():
            by_kind.setdefault(kind, []).append(rule)
    words = {w for some in by_kind.values() for r in some for w in re.findall(r"\w+", _finding(r, corrects))}
    words |= {w for name, sql in VIEW.items() if name in words for w in re.findall(r"\w+", sql)}
    bound = []
    for kind, some in sorted(by_kind.items()):
        told = [(names_asked(r), literals_asked(r, "form")) for r in some]
        if (None, None) not in told:
            names = frozenset(n[1:-1] for by_name, _ in told for n in by_name or ())
            bound.append((kind, (names, frozenset(f[1:-1] for by_name, forms in told if by_name is None for f in forms))))
    return Asked(frozenset(["file", *by_kind]), tuple(bound), ALWAYS | words)


def node_findings(rows: DataFrame, rules: Iterable[NodeRule], corrects: bool = False, config: Mapping | None = None, settings_rows: DataFrame | None = None) -> DataFrame:
    """(path, dirs, rule, severity, message, correctable, indirect, edits, at) of nodes(files)
    or shared_nodes(files), whose rows are looked at once for all their paths unless a rule reads these
    together with other columns, and what the files carry along in `told`. edits are null unless it `corrects`.
    settings_rows(cfg, bit): rows of settings to look under, in place of those of config."""
    rules, by_kind = list(rules), {}
    shared, of_paths = asked_of_paths(rules, corrects) if "paths" in rows.columns else (rules, {})
    for rule in shared:
        for kind in rule.kinds.split():
            by_kind.setdefault(kind, []).append(rule)
    if not by_kind:
        by_kind = {"": []}
    each = " ".join(f"WHEN {quoted(kind)} THEN {_of_kind(some, corrects)}" for kind, some in by_kind.items() if some)
    found = F.expr(f"CASE kind {each} ELSE {NONE} END" if each else NONE)
    # one row, or as many as there are configurations
    told = settings(rows.sparkSession, rules, config) if settings_rows is None else settings_rows
    keep = [*([] if settings_rows is None else ["bit"]), *(["kind"] if of_paths else [])]
    rows = rows.filter(F.col("kind").isin("file", *by_kind)).crossJoin(F.broadcast(told))
    found = F.when(F.col("kind") == "file", F.expr(TOLD)).otherwise(found)
    if "paths" in rows.columns and not of_paths and any(reads_path(r, corrects) for r in shared):
        rows = of_each_path(rows)
    path = "paths" if "paths" in rows.columns else "path"
    looked = view(rows).select(path, "dirs", *keep, F.explode(F.filter(found, lambda f: looked_at(f["rule"]))).alias("f"))
    told = looked.select(path, "dirs", *keep, "f.*").select(path, "dirs", *keep, "rule", "severity", "messages", "correctable", "indirect", "edits", F.posexplode("spans").alias("i", "at")).select(path, "dirs", "rule", "severity", F.expr("coalesce(get(messages, i), get(messages, 0))").alias("message"), "correctable", "indirect", F.expr("get(edits, i)").alias("edits"), "at", *keep)
    told = of_each_path(told) if path == "paths" else told
    each = " ".join(f"WHEN {quoted(name)} THEN {asked}" for name, asked in of_paths.items())
    return told.filter(f"kind = 'file' OR CASE rule {each} ELSE true END").drop("kind") if of_paths else told


#: A condition on the path and nothing else.
OF_PATH = re.compile(r"path r?like '(?:[^'\\]|\\.)*'")


def asked_of_paths(rules: list[NodeRule], corrects: bool = False) -> tuple[list[NodeRule], dict[str, str]]:
    """The rules with their conditions on the path asked of any of a row's `paths`, and
    by their names what must hold of each path then. If that leaves a rule that reads
    the path, or rules of one name ask for other paths, the rules as they are."""
    shared, of_paths = [], {}
    for rule in rules:
        parts = conjuncts(rule.where) if reads_path(rule, corrects) else []
        asked = " AND ".join(p for p in parts if OF_PATH.fullmatch(p))
        if of_paths.setdefault(rule.name, asked) != asked:
            return rules, {}
        shared.append(replace(rule, where=" AND ".join(f"exists(paths, path -> {p})" if OF_PATH.fullmatch(p) else p for p in parts)) if asked else rule)
        if reads_path(replace(rule, where=" AND ".join(p for p in parts if not OF_PATH.fullmatch(p)) or "true") if asked else rule, corrects):
            return rules, {}
    return shared, {name: asked for name, asked in of_paths.items() if asked}


def reads_path(rule: NodeRule, corrects: bool = False) -> bool:
    """Whether a rule's SQL names the path of files."""
    return re.search(r"\bpath\b", re.sub(r"'(?:[^'\\]|\\.)*'", "''", _finding(rule, corrects))) is not None


TOLD = f"transform(told, t -> named_struct('rule', t.rule, 'severity', t.severity, 'messages', array(t.message), 'correctable', false, 'indirect', false, 'edits', cast(null AS array<{EDITS_SQL}>), 'spans', cast(array(named_struct('start', 0, 'end', 1, 'line', 1, 'column', 1, 'last_line', 1, 'last_column', 1)) AS array<{SPAN_SQL}>)))"


def node_diagnostics(files: DataFrame, rules: Iterable[NodeRule], directives: bool = False, config: Mapping | None = None, marked: bool = False) -> DataFrame:
    """diagnostics(path, line, column, last_line, last_column, length, rule,
    severity, message, correctable) of files(path, content). With `directives`,
    without those that comments in the source disable, or, if `marked`, all with
    `off`: whether they do."""
    rules = list(rules)
    found = node_findings(shared_nodes(files, asked_of(rules)), rules, config=config)
    off = F.expr(SUPPRESSED.format(line="at.line")) if directives else F.lit(False)
    found = found if marked or not directives else found.filter(~off)
    return found.select("path", "at.line", "at.column", "at.last_line", "at.last_column", F.greatest(F.lit(1), F.col("at.end") - F.col("at.start")).alias("length"), "rule", "severity", "message", "correctable", *([off.alias("off")] if marked else []))


def numbered(found: DataFrame) -> DataFrame:
    """Findings with a number of their own within each file, in order of place."""
    order = Window.partitionBy("path").orderBy("at.start", "at.end", "rule", "message")
    return found.withColumn("correction_id", F.row_number().over(order).cast("long"))


def edits(found: DataFrame) -> DataFrame:
    """edits(path, correction_id, start, end, replacement, indirect) of numbered
    findings that say how to correct what they report: a row for each edit."""
    whole = found.filter("edits IS NOT NULL AND forall(edits, e -> e.start IS NOT NULL AND e.end IS NOT NULL AND e.text IS NOT NULL)")
    return whole.select("path", "correction_id", "indirect", F.explode("edits").alias("e")).select("path", "correction_id", "e.start", "e.end", F.col("e.text").alias("replacement"), "indirect")
