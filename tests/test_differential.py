"""Analytics over results on hard rows."""

import random

from pyspark.sql import functions as F

from sleuthframe.operators.differential import drift, match_ratio, pass_rates, regressions, repeated_rules, signature_gap, timings
from sleuthframe.operators.findings import counts, first_unmatched, report, summary


def test_percentiles_are_exact(spark):
    r = random.Random(2)
    rows = [("a", float(r.randint(0, 50))) for _ in range(501)] + [("b", r.gauss(0, 1e6)) for _ in range(1000)] + [("c", 7.0)] * 9 + [(None, x) for x in (1.0, None, 2.0)] + [("d", None), ("e", -1.5), ("f", 1e-300), ("f", 1e300)]
    df = spark.createDataFrame([(*row, 1, 2) for row in rows], "source string, seconds double, key int, v int")
    got = {x["source"]: (x["median"], x["p95"]) for x in timings(df, "source", "seconds").collect()}
    want = {x["source"]: (x["m"], x["p"]) for x in df.groupBy("source").agg(F.round(F.percentile("seconds", 0.5), 6).alias("m"), F.round(F.percentile("seconds", 0.95), 6).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert all(a == b or abs(a - b) <= 1e-6 + abs(b) * 1e-12 for a, b in zip(got[k], want[k], strict=True)) if want[k][0] is not None else got[k] == (None, None), k
    assert timings(df.filter("false"), "source", "seconds").collect() == []


def test_rates_and_floors(spark):
    cases = spark.createDataFrame([("a", True), ("a", None), ("a", False), (None, True), (None, True)], "rule string, passed boolean")
    assert {r["rule"]: (r["passed"], r["total"]) for r in pass_rates(cases).collect()} == {"a": (1, 3), None: (2, 2)}
    n = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "rule string, offenses long")
    floors = spark.createDataFrame([("a", 4), ("b", 5), ("c", 1)], "rule string, floor long")
    assert sorted(map(tuple, regressions(n, floors).collect())) == [("a", 4, 3), ("c", 1, 0)]
    assert regressions(n.filter("false"), floors.filter("false")).collect() == []


def test_drift_and_repeats(spark):
    results = spark.createDataFrame([("a", True, 0, 0), ("b", False, 1, 1), ("c", True, 2, 0), ("d", True, 1, 1)], "rule string, passing boolean, correctable_cases int, assertions int")
    verified = spark.createDataFrame([("b",), ("c",), ("c",), ("d",), ("e",)], "rule string")
    assert sorted(map(tuple, drift(results, verified).collect())) == [("a", "passing_not_promoted"), ("b", "verified_regression"), ("c", "passing_without_correction_assertions"), ("e", "verified_regression")]
    batches = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, None), (None, None)], "batch int, rule string")
    assert sorted(map(tuple, repeated_rules(batches).collect()), key=repr) == [(1, "a", 2), (None, None, 2)]


def test_reports_of_ties_and_nothing(spark):
    schema = "path string, line int, column int, rule string, severity string, message string, length int, id int"
    found = spark.createDataFrame([("a", 2, 1, "R", "c", "m", 1, 0), ("a", 1, 1, "S", "c", "m", 1, 0), ("a", 1, 1, "R", "c", "m", 1, 0), ("a", 1, 1, "R", "c", "m", 1, 1), (None, 1, 1, "R", "c", None, 1, 0)], schema)
    got = {r["path"]: [(o["line"], o["rule"]) for o in r["offenses"]] for r in report(found).collect()}
    assert got == {"a": [(1, "R"), (1, "R"), (1, "S"), (2, "R")], None: [(1, "R")]}
    assert {(r["rule"], r["offenses"], r["files"]) for r in counts(found).collect()} == {("R", 4, 1), ("S", 1, 1)}
    assert summary(found.filter("false"), found.filter("false")).first()[0:3] == (0, 0, 0)
    compared = spark.createDataFrame([("R", f"p{k % 3}", k // 3, 1, "c", 0, 1, 0) for k in range(9)] + [("S", "p", 1, 1, "c", 1, 0, 0)], "rule string, path string, line int, column int, severity string, exact int, left_only int, right_only int")
    assert [(r["path"], r["line"], r["nth"]) for r in first_unmatched(compared, 2).orderBy("nth").collect()] == [("p0", 0, 1), ("p0", 1, 2)]
    # no task gets all of a rule's keys: each keeps its first ones before they are dealt out
    assert "WindowGroupLimit" in first_unmatched(compared)._jdf.queryExecution().executedPlan().toString()
    ratio = spark.createDataFrame([("R", 1, 1, 2), ("S", 0, 0, 0)], "rule string, exact int, left_only int, right_only int")
    assert {r["rule"]: r["ratio"] for r in match_ratio(ratio).collect()} == {"R": 0.25, "S": 1.0}
    assert [tuple(r) for r in signature_gap(ratio).collect()] == [("R", 3), ("S", 0)]
