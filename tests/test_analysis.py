"""Positions, directives, corrections, configuration, reports and analytics on small inputs."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sleuthframe.functions.text import lines, matches
from sleuthframe.operators import differential as diff
from sleuthframe.operators.analysis import analyze, rule_names
from sleuthframe.operators.config import configured, merged, parse_config, ruby_version
from sleuthframe.operators.corrections import choose, corrected, rewrite
from sleuthframe.operators.differential import flattened
from sleuthframe.operators.directives import directives
from sleuthframe.operators.file_rules import FILE_RULES, file_diagnostics
from sleuthframe.operators.line_rules import RULES, diagnostics, selected, severity
from sleuthframe.operators.positions import around, located, occurrences
from sleuthframe.operators.findings import report
from sleuthframe.operators.reporting import document, exit_status, simple_report, totals


def files_of(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_positions(spark):
    files = files_of(spark, ("a", "é, b\nc, d, "), ("none", "x"), ("empty", ""), ("dots", "..a."))
    got = sorted(tuple(r) for r in located(files, occurrences(files, ", ")).collect())
    assert got == [("a", 1, 1, 2), ("a", 6, 2, 2), ("a", 9, 2, 5)]
    assert sorted(tuple(r) for r in occurrences(files, ".").collect()) == [("dots", 0), ("dots", 1), ("dots", 3)]


def test_lines_around_hits(spark):
    each = lines(files_of(spark, ("a", "\n".join("abcdefg"))))
    hits = spark.createDataFrame([("a", 2), ("a", 2), ("a", 6)], "path string, line int")
    assert sorted(r["body"] for r in around(each, hits, 1).collect()) == list("abcefg")


SOURCE = """eval(a)
# rubocop:disable Security/Eval, Layout -- reason
eval(b)
eval(c) # rubocop:enable Security/Eval
# rubocop:enable Security/Eval
eval(d)
eval(e) # rubocop:todo ALL
eval(f) # rubocop:disable Security
eval(g)  
"""


def test_directives(spark):
    files = files_of(spark, ("a", SOURCE), ("b", "eval(a)\n"), ("c", None))
    kept = sorted((r["path"], r["line"], r["rule"]) for r in analyze(files, ["Security/Eval", "Layout/TrailingWhitespace"]).collect())
    assert kept == [("a", 1, "Security/Eval"), ("a", 4, "Security/Eval"), ("a", 6, "Security/Eval"), ("a", 9, "Security/Eval"), ("b", 1, "Security/Eval")]
    told = {r["path"]: r["d"] for r in files.select("path", directives(F.col("content")).alias("d")).collect()}
    assert [(d["line"], d["disabled"], d["own"], d["names"]) for d in told["a"]][:2] == [(2, True, True, ["Security/Eval", "Layout"]), (4, False, False, ["Security/Eval"])]
    assert told["b"] == told["c"] == []


def test_both_plans_find_the_same(spark):
    text = "  x = 1\n" + "y" * 130 + "  \n\n\nz\t \n# rubocop:disable Layout/LineLength\n" + "w" * 130 + "\nfit 'x'\n\n"
    files = files_of(spark, ("spec/A.rb", text), ("spec/b_spec.rb", text.replace("\n", "\r\n")), ("c.rb", "x"), ("d.rb", ""), ("e.rb", "(" + text))
    names = [r.name for r in (*RULES, *FILE_RULES)]
    plain = analyze(files, names)
    parsed = analyze(files, [*names, "Security/Eval"])
    assert "MapInArrow" not in plain._jdf.queryExecution().toString() and "MapInArrow" in parsed._jdf.queryExecution().toString()
    assert plain.columns == parsed.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, parsed.collect())) and plain.count() > 20


def test_choose_corrections():
    taken, done = choose(20, {1: (False, [(0, 10, "x")]), 2: (False, [(0, 10, "x")]), 3: (False, [(2, 4, "y")]), 4: (False, [(8, 12, "z")]), 5: (False, [(12, 12, "i")]), 6: (False, []), 7: (False, [(5, 3, "")]), 8: (False, [(19, 30, "")])})
    assert sorted(taken) == [1, 5]
    assert done == {2, 3}
    assert choose(9, {1: (False, [(0, 2, ""), (4, 6, "")]), 2: (True, [(4, 5, "q")]), 3: (False, [(4, 5, "r")])})[1] == {2}
    assert rewrite("abcdef", [(1, 2, "X"), (4, 4, "+"), (1, 2, "X")]) == "aXcd+ef"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.tuples(st.booleans(), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.sampled_from("xy")), max_size=3)), max_size=12))
def test_taken_edits_never_overlap(asked):
    taken, done = choose(12, asked)
    flat = [e for c in taken.values() for e in c]
    assert not any(p[0] < q[1] and q[0] < p[1] for k, p in enumerate(flat) for q in flat[k + 1 :])
    assert not done & set(taken)
    assert done | set(taken) <= set(asked)


def test_corrected(spark):
    files = files_of(spark, ("a", "YAML.load(x)"), ("b", "é"), ("c", ""))
    edits = spark.createDataFrame([("a", 1, 5, 9, "safe_load", False), ("a", 2, 5, 9, "safe_load", None), ("b", 1, 0, 1, None, False)], "path string, correction_id int, start int, end int, replacement string, indirect boolean")
    got = {r["path"]: (r["content"], r["accepted"], r["subsumed"]) for r in corrected(files, edits).collect()}
    assert got == {"a": ("YAML.safe_load(x)", [1], [2]), "b": ("", [1], []), "c": ("", [], [])}


CONFIG = """
AllCops:
  TargetRubyVersion: 3.2
Layout/LineLength:
  Max: 10 # short
  AllowedPatterns: ['a', "b"]
  Words:
    - one
    - two
  Map:
    k: v
unknown:
  Max: 1
"""


def test_config(spark):
    config = parse_config(CONFIG)
    assert config == {"AllCops": {"TargetRubyVersion": "3.2"}, "Layout/LineLength": {"Max": "10", "AllowedPatterns": ["a", "b"], "Words": ["one", "two"], "Map": {"k": "v"}}}
    assert ruby_version(config) == (3, 2) and ruby_version({}) == (2, 7)
    assert merged(config, {"Layout/LineLength": {"Max": "5", "Map": {"l": "w"}}})["Layout/LineLength"]["Map"] == {"k": "v", "l": "w"}
    found = diagnostics(files_of(spark, ("a", "x" * 12)), configured(selected(["Layout/LineLength"], RULES), config)).collect()
    assert [(r["column"], r["length"], r["last_column"], r["message"]) for r in found] == [(11, 2, 12, "Line is too long. [12/10]")]
    odd = parse_config("Layout/LineLength:\n  Max: many\nMetrics/ParameterLists:\n  Max: 1\n")
    assert configured(selected(["Layout/LineLength"], RULES), odd)[0].options == {"Max": "120"}
    assert [(r["line"], r["message"]) for r in analyze(files_of(spark, ("a.rb", "def a(b, c)\n  b\nend\n")), ["Metrics"], odd).collect()] == [(1, "Avoid parameter lists longer than 1 parameters. [2/1]")]


FILE_CASES = [("lib/a.rb", "", "Lint/EmptyFile"), ("lib/a.rb", "\n\nx\n", "Layout/LeadingEmptyLines"), ("lib/FooBar.rb", "x\n", "Naming/FileName"), ("spec/a__b_spec.rb", "x\n", "RSpec/SpecFilePathFormat"), ("spec/a.rb", "x\n", "RSpec/SpecFilePathSuffix"), ("gems.rb", "x\n", "Bundler/GemFilename"), ("a.gemspec", "x\n", "Gemspec/RequireMFA"), ("a.gemspec", "x\n", "Gemspec/RequiredRubyVersion"), ("lib/a.rb", "x\n", "Style/FrozenStringLiteralComment")]


def test_file_rules(spark):
    files = files_of(spark, *{(f"{k}/{p}", c) for k, (p, c, _) in enumerate(FILE_CASES)}, ("99/lib/clean.rb", "# frozen_string_literal: true\n\nx\n"))
    got = {(r["path"], r["rule"]) for r in file_diagnostics(files).collect()}
    assert {(f"{k}/{p}", rule) for k, (p, _, rule) in enumerate(FILE_CASES)} <= got
    assert not [g for g in got if g[0].startswith("99/")]
    assert {c[2] for c in FILE_CASES} == {r.name for r in FILE_RULES}


#: path, lines, rule, (line, column, length) of what it reports.
LINE_CASES = [
    ("a.rb", "x = 1  \n", "Layout/TrailingWhitespace", (1, 6, 2)),
    ("a.rb", "x\u3000\n", "Layout/TrailingWhitespace", (1, 2, 1)),
    ("a.rb", "  \tx\n", "Layout/IndentationStyle", (1, 3, 1)),
    ("a.rb", "é" * 121 + "\r\n", "Layout/LineLength", (1, 121, 1)),
    ("a.rb", "x\n\n\ny\n", "Layout/EmptyLines", (3, 1, 1)),
    ("a.rb", "  x\n", "Layout/InitialIndentation", (1, 3, 1)),
    ("a.rb", "x\ny", "Layout/TrailingEmptyLines", (2, 1, 1)),
    ("a.rb", "x\n\n", "Layout/TrailingEmptyLines", (2, 1, 1)),
    ("a.rb", "x\r\n", "Layout/EndOfLine", (1, 1, 2)),
    ("/db/migrate/1.rb", "  drop_table :x\n", "Rails/ReversibleMigration", (1, 3, 13)),
    ("a.rb", "x = default_scope\n", "Rails/DefaultScope", (1, 5, 13)),
    ("a.rb", "x = File.join(Rails.root, 'y')\n", "Rails/FilePath", (1, 5, 20)),
    ("/app/jobs/a.rb", "class A < ActiveJob::Base\n", "Rails/ApplicationJob", (1, 11, 15)),
    ("a.rb", "  fit 'x' do\n", "RSpec/Focus", (1, 3, 10)),
    ("a.rb", "  pending\n", "RSpec/PendingWithoutReason", (1, 3, 7)),
    ("a.rb", "x.receive_message_chain(:y)\n", "RSpec/MessageChain", (1, 3, 21)),
    ("a.rb", "  let(:fooBar) { 1 }\n", "RSpec/VariableName", (1, 8, 6)),
    ("a.rb", "x # rubocop:disable A/B # rubocop:disable C/D\n", "Style/DoubleCopDisableDirective", (1, 3, 43)),
    ("a.rb", "x # rubocop:disable LineLength\n", "Migration/DepartmentName", (1, 21, 10)),
]
CLEAN = ["pending 'why'\n", "let(:foo_bar) { 1 }\n", "x # rubocop:disable Layout/LineLength\n", "x\n\ny\n", "x # rubocop:disable Layout\n", "x\n", "é" * 120 + "\n", "# default_scope\n"]


def test_line_rules(spark):
    files = files_of(spark, *[(f"{k}{p}", b) for k, (p, b, _, _) in enumerate(LINE_CASES)])
    rules = selected([c[2] for c in LINE_CASES], RULES)
    got = {(r["path"], r["rule"], r["line"], r["column"], r["length"], r["last_line"], r["last_column"]) for r in diagnostics(files, rules).collect()}
    assert {(f"{k}{p}", rule, *at, at[0], at[1] + at[2] - 1) for k, (p, _, rule, at) in enumerate(LINE_CASES)} <= got
    assert {r.name for r in RULES} - {c[2] for c in LINE_CASES} == {"Layout/SpaceAfterComma", "Layout/SpaceAfterSemicolon"}
    assert diagnostics(files_of(spark, *[(str(k), b) for k, b in enumerate(CLEAN)]), rules).collect() == []


def test_all_matches_of_a_line(spark):
    each = lines(files_of(spark, ("a", "é,b,,c,\n,x"), ("b", "none"), ("c", None)))
    assert sorted(map(tuple, matches(each, ",[^,]").collect())) == [("a", 1, 2, 2), ("a", 1, 5, 2), ("a", 2, 1, 2)]


def test_severity_and_names():
    assert [severity(r) for r in ("Lint/EmptyFile", "Gemspec/RequireMFA", "Security/Eval")] == ["warning", "warning", "convention"]
    assert rule_names() == sorted(set(rule_names()))


def test_analyze_and_reports(spark):
    files = files_of(spark, ("a.rb", "# frozen_string_literal: true\n\neval(x)\n"), ("a.rb", "eval(x)\n"), ("b.rb", "# frozen_string_literal: true\n"))
    own = lambda f: f.selectExpr("path", "1 AS line", "1 AS column", "1 AS length", "'My/Rule' AS rule", "'convention' AS severity", "'Mine.' AS message")
    found = analyze(files.filter("path = 'b.rb'"), only=["Security"], own=[own])
    assert [r["rule"] for r in found.collect()] == ["My/Rule"]
    assert exit_status(found) == 1 and exit_status(analyze(files, only=["No/Such"])) == 0
    assert [r["text"] for r in simple_report(found).collect()] == ["C:  1:  1: My/Rule: Mine."]
    assert tuple(totals(found, files).first()) == (3, 1, 0, 0)
    told = json.loads(document(found, files, {"version": "1"}))
    assert [f["path"] for f in told["files"]] == ["a.rb", "b.rb"] and told["files"][0]["offenses"] == []
    assert told["files"][1]["offenses"][0]["location"] == {"start_line": 1, "start_column": 1, "last_line": 1, "last_column": 1, "length": 1, "line": 1, "column": 1}
    assert told["summary"] == {"offense_count": 1, "target_file_count": 3, "inspected_file_count": 3} and told["metadata"] == {"version": "1"}
    assert len(analyze(files, only=["Security"]).collect()) == 1
    flat = flattened(report(found), "b")
    assert [(r["path"], r["line"], r["rule"]) for r in flat.collect()] == [(".rb", 1, "My/Rule")]


def test_analytics(spark):
    batches = spark.createDataFrame([("p", "a", 2, 0, 0, None), ("q", "a", 1, 1, 0, None), ("p", "b", 0, 0, 0, None), ("p", "b", 0, 0, 0, None), ("p", "c", 1, 0, 0, "crash")], "batch string, rule string, exact int, left_only int, right_only int, failure string")
    classes = diff.combined(batches)
    assert {r["rule"]: r["outcome"] for r in classes.collect()} == {"a": "mismatch", "b": "dormant", "c": "crash"}
    assert {r["rule"]: r["ratio"] for r in diff.match_ratio(classes).collect()} == {"a": 0.75, "b": 1.0, "c": 1.0}
    assert [r["rule"] for r in diff.repeated_rules(batches).collect()] == ["b"]
    assert diff.signature_gap(classes).first()["rule"] == "a"
    results = spark.createDataFrame([("x", True, 1, 0), ("y", False, 0, 0)], "rule string, passing boolean, correctable_cases int, assertions int")
    verified = spark.createDataFrame([("y",), ("z",)], "rule string")
    assert sorted(tuple(r) for r in diff.drift(results, verified).collect()) == [("x", "passing_not_promoted"), ("x", "passing_without_correction_assertions"), ("y", "verified_regression"), ("z", "verified_regression")]


def test_empty_tables(spark):
    none = files_of(spark).filter("false")
    assert analyze(none).count() == 0
    assert located(none, occurrences(none, ",")).count() == 0
    assert corrected(none, spark.createDataFrame([], "path string, correction_id int, start int, end int, replacement string, indirect boolean")).count() == 0
