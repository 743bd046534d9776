"""Isolated failures, configurations compared in one pass, batches put together."""

from pyspark.sql import functions as F

from sleuthframe.operators.audits import batches, islands, isolated, mutations, under_configurations
from sleuthframe.operators.eligibility import regex, with_skips
from sleuthframe.operators.line_rules import LineRule, diagnostics
from sleuthframe.rules import RULES
from sleuthframe.rules.engine import NodeRule, node_diagnostics

GOOD = (LineRule("A/One", "one", "length(body) > 1"), LineRule("A/Two", "two", "length(body) > 2"), LineRule("A/Three", "three", "true"))
BAD = LineRule("A/Bad", "=cast(cast(body AS INT) AS STRING)", "true")


def lines(files, rules):
    return diagnostics(files, tuple(rules))


def test_a_failing_rule_takes_down_no_other(spark):
    files = spark.createDataFrame([("a", "xy\nz\n"), (None, "abc\n"), ("b", None)], "path string, content string")
    found, failed = isolated(files, (*GOOD, BAD), lines)
    assert [r["rule"] for r in failed.collect()] == ["A/Bad"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, lines(files, GOOD).collect()), key=repr)
    found, failed = isolated(files, [BAD], lines)
    assert found.collect() == [] and failed.count() == 1
    found, failed = isolated(files, GOOD, lines)
    assert failed.collect() == [] and found.count() == 6
    assert isolated(files, [], lines)[1].collect() == []


def test_a_rule_that_cannot_be_analysed_is_isolated(spark):
    files = spark.createDataFrame([("a.rb", "x == nil\n")], "path string, content string")
    rules = [*(r for r in RULES if r.name == "Style/NilComparison"), NodeRule("A/Odd", "call", "no_such_column = 1", "odd")]
    found, failed = isolated(files, rules, node_diagnostics)
    assert [r["rule"] for r in found.collect()] == ["Style/NilComparison"] and [r["rule"] for r in failed.collect()] == ["A/Odd"]


def test_configurations_in_one_pass(spark):
    files = spark.createDataFrame([("a.rb", "x.is_a?(B)\nx.kind_of?(B)\n", 1), ("a.rb", "x.is_a?(B)\n", 1), (None, None, 1)], "path string, content string, bit int")
    rules = [r for r in RULES if r.name == "Style/ClassCheck"]
    other = {"Style/ClassCheck": {"EnforcedStyle": "kind_of?"}}
    found = under_configurations(files, rules, [{}, other, {}])
    assert sorted((r["line"], r["configs"], r["n"]) for r in found.collect()) == [(1, 2, 2), (2, 5, 1)]
    assert sorted(map(tuple, mutations(found, 3).collect())) == [("Style/ClassCheck", 1, 0, 1, 2), ("Style/ClassCheck", 2, 1, 0, 0)]
    assert under_configurations(files.filter("false"), rules, [{}]).collect() == [] == under_configurations(files, rules, []).collect()


def test_batches(spark):
    schema = "run string, batch int, revision string, version string, position int, classification string, left long, right long, exact long, left_seconds double, right_seconds double, status string"
    rows = [("ok", 1, "r", "1", 2, "exact", 1, 2, 1, 0.5, 1.0, "x"), ("ok", 2, "r", "1", 3, "exact", 1, 2, 1, 0.5, 1.0, "x"), ("ok", 2, "r", "1", 4, None, 1, None, 1, 0.5, 1.0, "x"),
            ("mixed", 1, "r", "1", 1, "exact", 1, 1, 1, 0.0, 0.0, "x"), ("mixed", 2, None, "1", 2, "exact", 1, 1, 1, 0.0, 0.0, "x"),
            ("versions", 1, "r", "1", 1, "exact", 1, 1, 1, 0.0, 0.0, "x"), ("versions", 2, "r", "2", 2, "exact", 1, 1, 1, 0.0, 0.0, "x"),
            ("twice", 1, "r", "1", 1, "exact", 1, 1, 1, 0.0, 0.0, "x"), ("twice", 2, "r", "1", 1, "crash", 1, 1, 1, 0.0, 0.0, "x"),
            ("gap", 1, "r", "1", 1, "exact", 1, 1, 1, 0.0, 0.0, "x"), ("gap", 2, "r", "1", 5, "exact", 1, 1, 1, 0.0, 0.0, "x"), ("gap", 2, "r", "1", 6, "exact", 1, 1, 1, 0.0, 0.0, "x")]
    results = spark.createDataFrame(rows, schema)
    got = {r["run"]: r for r in batches(results).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ok": "complete", "mixed": "several revisions", "versions": "several versions", "twice": "repeated positions", "gap": "missing positions"}
    ok = got["ok"]
    assert (ok["batches"], ok["first"], ok["last"], ok["positions"], ok["islands"], ok["left"], ok["right"], ok["left_seconds"], ok["classifications"]) == (2, 2, 4, 3, 1, 3, 4, 1.5, {"exact": 2, "none": 1})
    assert got["gap"]["left"] is None and got["gap"]["islands"] == 2
    assert sorted(map(tuple, islands(results.filter("run = 'gap'")).collect())) == [("gap", 1, 1), ("gap", 5, 6)]
    assert batches(results.filter("false")).collect() == []


def test_globs(spark):
    assert regex("a*b?.c") == "(?s)a.*b.\\.c"
    files = spark.createDataFrame([("lib/a.rb", 1), ("spec/x/b_spec.rb", 1), ("vendor/c.rb", 1), (None, 1)], "path string, skip int").drop("skip")
    config = {"AllCops": {"Exclude": ["vendor/*"]}, "A/One": {"Include": ["spec/*_spec.rb"]}, "A/Two": {"Exclude": "lib/?.rb"}}
    got = {r["path"]: sorted(r["skip"]) for r in with_skips(files, ["A/One", "A/Two", "A/Three"], config).collect()}
    assert got == {"lib/a.rb": ["A/One", "A/Two"], "spec/x/b_spec.rb": [], "vendor/c.rb": ["*", "A/One"], None: ["A/One"]}
    assert [r["skip"] for r in with_skips(files, ["A/One"], None).collect()] == [[]] * 4
    assert with_skips(files.filter("false"), ["A/One"], config).select(F.col("skip")).collect() == []
