"""Every query against its SQL on the smallest tables, and rules on goldens."""

import os

import duckdb
import pytest

import __spark_entry__
from sleuthframe.functions.text import lines
from sleuthframe.operators.findings import compare
from sleuthframe.operators.line_rules import RULES, selected
from sleuthframe.plans import analytics, catalog, sources  # noqa: F401
from sleuthframe.rules import RULES as NODE_RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lines(spark):
    files = spark.createDataFrame([("empty", ""), ("ends", "a\n\n"), ("open", "a\r\nb"), ("nl", "\n")], "path string, content string")
    got = {}
    for r in lines(files).collect():
        got.setdefault(r["path"], []).append((r["line"], r["body"]))
    assert got == {"ends": [(1, "a"), (2, "")], "open": [(1, "a"), (2, "b")], "nl": [(1, "")]}


def test_compare_counts_repeats(spark):
    schema = "path string, rule string, severity string, line int, column int"
    left = spark.createDataFrame([("a", "r", "c", 1, 1)] * 3, schema)
    right = spark.createDataFrame([("a", "r", "c", 1, 1), ("b", "r", "c", 1, 1)], schema)
    got = {r["path"]: (r["exact"], r["left_only"], r["right_only"]) for r in compare(left, right).collect()}
    assert got == {"a": (1, 2, 0), "b": (0, 0, 1)}


def test_selection():
    assert {r.name for r in selected(["Security"], NODE_RULES)} == {f"Security/{n}" for n in ("CompoundHash", "Eval", "JSONLoad", "MarshalLoad", "Open", "YAMLLoad")}
    for quiet in ("RSpec/MessageChain", "Layout/SpaceAfterComma"):
        assert quiet not in [r.name for r in selected(rules=RULES)]
        assert [r.name for r in selected([quiet], RULES)] == [quiet]
        assert not any(r.name == quiet for r in selected([quiet.partition("/")[0]], RULES))
    assert selected(["Unknown/Rule"], RULES) == ()
