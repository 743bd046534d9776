"""Rules about suppression comments on small sources, and what rows carry of them."""

from pyspark.sql import functions as F

from sleuthframe.operators.analysis import analyze
from sleuthframe.operators.directive_rules import NAMES, WITHIN, directive_diagnostics, named
from sleuthframe.parser.nodes import Near, nodes

SOURCE = """eval(a)
# rubocop:disable Security/Eval, Style/Not -- why
eval(b)
# rubocop:enable Security/Eval
x # rubocop:disable Style/Not, Security/Eval
not y # rubocop:disable Style/Not
# rubocop:enable Security
# rubocop:disable Lint
# rubocop:enable all
# rubocop:disable all
"""


def told(df):
    return sorted((r["path"], r["line"], r["column"], r["last_column"], r["rule"], r["message"]) for r in df.collect())


def test_ranges_of_directives(spark):
    files = spark.createDataFrame([("a.rb", SOURCE, 1), ("b.rb", None, 1), ("c.rb", "eval(a)\n", 1)], "path string, content string, line int")
    found = spark.createDataFrame([("a.rb", 1, "Security/Eval"), ("a.rb", 3, "Security/Eval"), ("a.rb", 6, "Style/Not"), ("c.rb", 1, "Security/Eval")], "path string, line int, rule string")
    got = told(directive_diagnostics(files, found, NAMES[:3], ["Security/Eval", "Style/Not"]))
    assert got == sorted([
        ("a.rb", 5, 3, 44, "Lint/RedundantCopDisableDirective", "Unnecessary disabling of `Security/Eval`, `Style/Not`."),
        ("a.rb", 7, 18, 25, "Lint/RedundantCopEnableDirective", "Unnecessary enabling of Security."),
        ("a.rb", 8, 1, 22, "Lint/RedundantCopDisableDirective", "Unnecessary disabling of `Lint` department."),
        ("a.rb", 10, 1, 21, "Lint/MissingCopEnableDirective", "Re-enable all cops with `# rubocop:enable` after disabling it."),
        ("a.rb", 10, 1, 21, "Lint/RedundantCopDisableDirective", "Unnecessary disabling of all cops."),
    ])
    # of rules that did not run nothing is said
    some = told(directive_diagnostics(files, found.filter("rule = 'Style/Not'"), NAMES[:1], ["Style/Not"], whole_run=False))
    assert [(r[1], r[2], r[5]) for r in some] == [(5, 21, "Unnecessary disabling of `Style/Not`.")]
    assert told(directive_diagnostics(files.filter("false"), found.filter("false"))) == []


def test_directives_that_are_not_permitted(spark):
    files = spark.createDataFrame([("a.rb", "# rubocop:disable A/B, C/D\nx # rubocop:todo A/B\n")], "path string, content string")
    got = told(directive_diagnostics(files, None, [WITHIN]))
    assert [(r[1], r[2], r[3], r[5]) for r in got] == [(1, 1, 26, "RuboCop disable/enable directives are not permitted."), (2, 3, 20, "RuboCop disable/enable directives are not permitted.")]
    got = told(directive_diagnostics(files, None, [WITHIN], config={WITHIN: {"AllowedCops": ["A/B"]}}))
    assert [(r[1], r[5]) for r in got] == [(1, "RuboCop disable/enable directives for `C/D` are not permitted.")]


def test_names_of_directives(spark):
    files = spark.createDataFrame([(None, "x\r\n  # rubocop:disable  A/B , ALL,A/B  -- so\r\n")], "path string, content string")
    assert [(r["path"], r["line"], r["column"], r["name"], r["at"], r["own"], r["disabled"]) for r in named(files).orderBy("at").collect()] == [(None, 2, 3, "A/B", 22, True, True), (None, 2, 3, "all", 28, True, True)]


def test_analysis_tells_of_directives(spark):
    files = spark.createDataFrame([("a.rb", "# rubocop:disable Style/Not\nx\n# rubocop:enable Style/Not\nnot y\n")], "path string, content string")
    got = analyze(files, ["Style/Not", "Lint/RedundantCopDisableDirective"]).select("line", "rule").collect()
    assert sorted(map(tuple, got)) == [(1, "Lint/RedundantCopDisableDirective"), (4, "Style/Not")]


def test_rows_carry_few_directives(spark):
    """What a row carries decides as all directives would, and is little in a file with many."""
    dirs = [{"line": k, "disabled": k % 3 > 0, "own": k % 4 > 0, "names": [f"A/{k % 5}"]} for k in range(1, 400)]

    def off(some, line, name):
        own_line = [d for d in some if not d["own"] and d["line"] == line and name in d["names"]]
        if own_line:
            return any(d["disabled"] for d in own_line)
        before = [d for d in some if d["own"] and d["line"] <= line and name in d["names"]]
        return bool(before) and before[-1]["disabled"]

    near = Near(dirs)
    for first, last in ((1, 1), (7, 9), (100, 130), (380, 399), (390, 500)):
        some = near.of(first, last)
        assert len(some) <= 5 + last - first + 5
        assert all(off(some, line, f"A/{n}") == off(dirs, line, f"A/{n}") for line in range(first, last + 1) for n in range(5))
    text = "".join(f"x{k} = 1\n# rubocop:disable A/B{k % 7}\n" for k in range(300))
    rows = nodes(spark.createDataFrame([("a.rb", text)], "path string, content string")).filter("kind = 'line'").agg(F.max(F.size("dirs"))).first()
    assert rows[0] <= 7 + 6
