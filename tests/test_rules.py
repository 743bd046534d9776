"""The parser, the nodes table and every rule's examples."""

import dataclasses
import io
import json
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sleuthframe import cli
from sleuthframe.operators.autocorrect import autocorrect
from sleuthframe.parser.nodes import nodes
from sleuthframe.parser.ruby import ParseError, parse
from sleuthframe.plans.examples import expected, read
from sleuthframe.rules import RULES
from sleuthframe.rules.engine import node_diagnostics
from sleuthframe.sources.decode import decoded, restored
from sleuthframe.sources.tables import source_tree, targets

sys.setrecursionlimit(20_000)


def shape(node):
    """kind:name(kids) of a tree."""
    inside = " ".join(shape(k) for _, k in node.kids)
    return f"{node.kind}{':' + node.name if node.name and node.kind not in ('array',) else ''}{f'({inside})' if inside else ''}"


SHAPES = {
    "puts -x": "call:puts(call:-@(call:x))",
    "x = 1; x -1": "local_variable_write:x(integer:1 token:=) call:-(local_variable_read:x integer:1)",
    "a ? b : c": "if(call:a call:b call:c)",
    "a.b&.c(1, *d, k: 2, &e)": "call:c(call:b(call:a) integer:1 splat(call:d) keyword_hash(assoc:k(symbol:k integer:2)) block_argument(call:e))",
    "f x do |y| y end": "call:f(call:x block(block_parameters(required_parameter:y) local_variable_read:y))",
    "f x { 1 }": "call:f(call:x(block(integer:1)))",
    "a || b && !c": "or:||(call:a and:&&(call:b call:!(call:c)))",
    "not a and b": "and:and(call:!(call:a) call:b)",
    "-2 ** 2": "call:-@(call:**(integer:2 integer:2))",
    "a, (b, *c) = d": "multi_write(local_variable_target:a mlhs(local_variable_target:b splat(local_variable_target:c)) call:d)",
    "x[1] ||= 2": "index_or_write:[](call:x integer:1 integer:2 token:||=)",
    "%w[a b].c": "call:c(array(string:a string:b))",
    "a / b / c": "call:/(call:/(call:a call:b) call:c)",
    "a =~ /b#{c}/i": "call:=~(call:a interpolated_regular_expression:b#{c}(embedded_statements(call:c)))",
    "def a(b, c = 1, *d, e:, f: 2, **g, &h) = b": "def:a(parameters(required_parameter:b optional_parameter:c(integer:1) rest_parameter:d required_keyword_parameter:e optional_keyword_parameter:f(integer:2) keyword_rest_parameter:g block_parameter:h) local_variable_read:b)",
    "p <<~A, <<-B\n  x\nA\n  y\n  B\nz": "call:p(string:  x\n string:  y\n) call:z",
    "a\n  .b # c\n  .d": "call:d(call:b(call:a))",
    "return if a": "if(return call:a)",
    "->(x) { x }.(1)": "call:call(lambda(block_parameters(required_parameter:x) local_variable_read:x) integer:1)",
    "{ a: 1, 'b': 2, c => 3, **d }": None,
    "case a\nin [Integer => b, *] if b > 1 then c\nin {d:}\n  d\nend": "case_match(call:a in(array_pattern(capture_pattern:b(constant_read:Integer) splat) call:>(local_variable_read:b integer:1) call:c token:then) in(hash_pattern(assoc:d(symbol:d)) local_variable_read:d))",
    "begin; a; rescue B, C => e; d; else; f; ensure; g; end": "begin(call:a rescue(constant_read:B constant_read:C local_variable_target:e call:d) else(call:f) ensure(call:g))",
    "class A::B < C; def self.x; end; end": "class:B(constant_path:B(constant_read:A) constant_read:C def:x(self:self))",
    "foo.bar = 1, 2": "call_write:bar(call:foo array(integer:1 integer:2) token:=)",
    "a ? x[:b] : :c": "if(call:a call:[](call:x symbol:b) symbol:c)",
    "while x do y end": "while(call:x call:y token:do)",
    "x = y rescue z": "local_variable_write:x(rescue_modifier(call:y call:z) token:=)",
    "yield a, b": "yield(call:a call:b)",
    "$1 + @a + @@b + $x": "call:+(call:+(call:+(numbered_reference_read:$1 instance_variable_read:@a) class_variable_read:@@b) global_variable_read:$x)",
    "a <=> b": "call:<=>(call:a call:b)",
}


@pytest.mark.parametrize("source", SHAPES)
def test_trees(source):
    if SHAPES[source] is None:
        assert parse(f"x = {source}")
    else:
        assert " ".join(shape(k) for _, k in parse(source)[0].kids) == SHAPES[source]


@pytest.mark.parametrize("source", ["(", "def a", "x = [1", "'abc", "a b c)", "<<~X\nabc", "if a", "%w[", "}", "a = = b"])
def test_errors(source):
    with pytest.raises(ParseError):
        parse(source)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n\"'#{}[]()|&*.:=<~%?@$-/,;d\\oend", max_size=40))
def test_any_text_is_a_tree_or_an_error(text):
    try:
        tree, _ = parse(text)
    except ParseError as e:
        assert 0 <= e.at <= len(text) + 1
        return
    todo = [tree]
    while todo:
        node = todo.pop()
        assert 0 <= node.start <= node.end <= len(text)
        todo += [k for _, k in node.kids]


def test_nodes_table(spark):
    files = spark.createDataFrame([("a.rb", "x = 'é' # c\r\n"), ("b.rb", "("), ("c.rb", None), (None, "y")], "path string, content string")
    got = {}
    for r in nodes(files).collect():
        got.setdefault(r["path"], []).append(r)
    by = {r["kind"]: r for r in got["a.rb"]}
    assert (by["string"]["at"]["column"], by["string"]["at"]["last_column"], by["string"]["src"]) == (5, 7, "'é'")
    assert by["comment"]["src"] == "# c" and by["line"]["src"] == "x = 'é' # c" and by["line"]["name"] == "x = '\x01'    "
    assert by["line"]["op"] == "\r" and [u["kind"] for u in by["string"]["up"]] == ["local_variable_write", "program"]
    assert [r["kind"] for r in got["b.rb"]] == ["file", "error", "line"] and [r["kind"] for r in got["c.rb"]] == ["file", "program"]
    assert {r["kind"] for r in got[None]} == {"file", "program", "call", "line"}
    assert nodes(files.filter("false")).collect() == []


def test_positions_at_the_edges():
    from sleuthframe.parser.nodes import Places

    def last(text, a, b):
        s = Places(text).span(a, b)
        return s[2:]

    assert last("", 0, 0) == (1, 1, 1, 0)
    assert last("ab\ncd", 0, 2) == (1, 1, 1, 2) and last("ab\ncd", 1, 3) == (1, 2, 2, 1) and last("ab\n", 3, 3) == (2, 1, 2, 0)


def test_examples_of_every_rule(spark):
    some = expected()
    files = spark.createDataFrame([(f"{k}/{path}", source) for k, _, path, source, _ in some], "path string, content string").repartition(4)
    found = {}
    for r in node_diagnostics(files, RULES).collect():
        found.setdefault((int(r["path"].split("/")[0]), r["rule"]), set()).add((r["line"], r["column"], r["last_line"], r["last_column"], r["length"], r["message"].replace(r["path"], "{path}")))
    wrong = [(rule, source, found.get((k, rule)), rows) for k, rule, _, source, rows in some if found.get((k, rule), set()) != set(rows)]
    assert wrong == []
    assert {r.name for r in RULES} - {e[1] for e in some} == {"Lint/Syntax"}


def test_rules_hold_in_crlf_and_leave_strings_and_comments(spark):
    some = [e for e in expected() if "\n" in e[3] and "<<" not in e[3] and "\\" not in e[3]]
    crlf = spark.createDataFrame([(f"{k}/{path}", source.replace("\n", "\r\n")) for k, _, path, source, _ in some], "path string, content string").repartition(4)
    found = {}
    for r in node_diagnostics(crlf, RULES).collect():
        found.setdefault((int(r["path"].split("/")[0]), r["rule"]), set()).add((r["line"], r["column"]))
    lost = [e[1] for e in some if found.get((e[0], e[1]), set()) != {r[:2] for r in e[4]}]
    assert lost == []
    quiet = spark.createDataFrame([("s.rb", "X = <<~TEXT.freeze\n  eval(a); YAML.load(b) and !!c\nTEXT\n")], "path string, content string")
    assert {r["rule"] for r in node_diagnostics(quiet, RULES).collect()} == set()


def test_syntax_errors_are_findings(spark):
    files = spark.createDataFrame([("a.rb", "x = 1\ny = (\neval(z)\n")], "path string, content string")
    assert [(r["rule"], r["line"]) for r in node_diagnostics(files, RULES).collect()] == [("Lint/Syntax", 4)]


def test_examples_read():
    assert read("a«b»c\n«d»") == ("abc\nd", [(1, 2), (4, 5)])


def test_autocorrect(spark):
    source = "a = ?x\nb.kind_of?(C)\nif d and e\n  fail 'no' # rubocop:disable Style/SignalException\nend\n"
    rules = [r for r in RULES if r.name in ("Style/CharacterLiteral", "Style/ClassCheck", "Style/AndOr", "Style/SignalException", "Style/Send")]
    found, after = autocorrect(spark.createDataFrame([("a.rb", source), ("b.rb", None)], "path string, content string"), rules)
    assert {r["path"]: r["content"] for r in after.collect()} == {"a.rb": "a = 'x'\nb.is_a?(C)\nif d && e\n  fail 'no' # rubocop:disable Style/SignalException\nend\n", "b.rb": ""}
    assert sorted((r["rule"], r["corrected"]) for r in found.collect()) == [("Style/AndOr", True), ("Style/CharacterLiteral", True), ("Style/ClassCheck", True)]


@given(st.binary(max_size=60))
def test_bytes_come_back(raw):
    text, marker, invalid = decoded(raw)
    assert restored(text, marker, invalid) == raw and (marker is None) == (not invalid)


def test_no_character_left():
    with pytest.raises(ValueError):
        decoded(bytes(range(1, 32)) + b"\xff")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tmp" / "proj"
    for name, raw in {"lib/a.rb": b"eval(x)\n", "Dangerfile": b"x\n", "Capfile": b"x\n", "lib/.hidden.rb": b"x\n", "node_modules/b.rb": b"x\n", "vendor/gems/c.rb": b"x\n", "tmp/d.rb": b"x\n", "lib/bad.rake": b"y = '\xff'\n", "lib/notes.txt": b"x\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    return root


def test_source_tree(spark, tree):
    got = {r["path"]: r for r in source_tree(spark, str(tree)).collect()}
    assert sorted(got) == ["Dangerfile", "lib/a.rb", "lib/bad.rake"]
    bad = got["lib/bad.rake"]
    assert len(bad["content"]) == 8 and restored(bad["content"], bad["marker"], bytes(bad["invalid"])) == b"y = '\xff'\n"
    assert sorted(r["path"] for r in targets(spark, [f"{tree}/lib", f"{tree}/Capfile"]).collect()) == sorted([f"{tree}/lib/a.rb", f"{tree}/lib/bad.rake", f"{tree}/Capfile"])


def run(spark, *args, stdin=b""):
    out = io.StringIO()
    return cli.main(list(args), spark, out, io.BytesIO(stdin)), out.getvalue()


def test_command_line(spark, tree, capsys):
    status, text = run(spark, "--only", "Security", str(tree))
    assert status == 1 and "lib/a.rb: C:  1:  1: Security/Eval: The use of `eval` is a serious security risk." in text and "3 files inspected, 1 offenses detected, 0 corrected, 0 correctable" in text
    status, text = run(spark, "--only=Security/Eval", "--format=json", "--stdin", "s.rb", stdin=b"x\neval(y)\n")
    told = json.loads(text)
    assert status == 1 and told["files"][0]["offenses"][0]["location"]["start_line"] == 2 and told["summary"]["target_file_count"] == 1
    assert run(spark, "--only", "No/Such", str(tree))[0] == 0
    assert run(spark, "--version") == (0, cli.VERSION + "\n") and "Style/Not\n" in run(spark, "--show-cops")[1]
    for wrong in (["--bogus"], ["--format", "xml"], ["/no/such/path"], ["--jobs", "0"], ["--config", "/no/such.yml"]):
        assert run(spark, *wrong)[0] == 2


def test_command_line_corrects(spark, tree):
    path = tree / "lib" / "a.rb"
    path.write_bytes(b"x = ?a # \xff\n")
    status, text = run(spark, "-a", "--only", "Style/CharacterLiteral", str(path))
    assert status == 0 and path.read_bytes() == b"x = 'a' # \xff\n" and "1 corrected" in text


def test_command_line_corrects_by_rules_of_every_kind(spark, tree):
    """Line, node and file rules report under -a; settings and globs act; each file is put back whole."""
    a, b = tree / "lib" / "a.rb", tree / "lib" / "b.rb"
    a.write_text("x.is_a?(B)  \nraise Exception, 'c' if !d\n")
    b.write_text("y.is_a?(B)  \n")
    told = tree / "settings.yml"
    told.write_text("Style/ClassCheck:\n  EnforcedStyle: kind_of?\n  Exclude:\n    - '*/b.rb'\n")
    only = "Style/ClassCheck,Style/NegatedIf,Lint/RaiseException,Layout/TrailingWhitespace,Style/FrozenStringLiteralComment"
    status, text = run(spark, "-a", "--only", only, "--config", str(told), str(a), str(b))
    assert status == 1 and text.count("Missing frozen string literal comment.") == 2 and "5 corrected" in text
    assert a.read_text() == "x.kind_of?(B)\nraise StandardError, 'c' unless d\n" and b.read_text() == "y.is_a?(B)\n"
    assert sorted(p.name for p in (tree / "lib").iterdir() if "corrected" in p.name) == []


def test_files_are_corrected_by_a_local_master_only(spark, monkeypatch):
    files = spark.createDataFrame([("a.rb", "x", None, None)], "path string, content string, marker string, invalid binary")
    monkeypatch.setattr(files.sparkSession.sparkContext, "master", "spark://far:7077")
    with pytest.raises(ValueError, match="local master"):
        cli.write_back(files.select("path", "content"), files)


def test_options_replace_defaults(spark):
    """A setting takes the place of the default in condition and message alike."""
    rule = next(r for r in RULES if r.name == "Metrics/ParameterLists")
    files = spark.createDataFrame([("a.rb", "def a(b, c, d)\n  b\nend\n\ndef e(f, g)\n  f\nend\n")], "path string, content string")

    def found(*given):
        return [(r["line"], r["message"]) for r in node_diagnostics(files, *given).collect()]

    told = [(1, "Avoid parameter lists longer than 2 parameters. [3/2]")]
    assert found([dataclasses.replace(rule, options={"Max": "2"})]) == told
    assert found([rule], False, {"Metrics/ParameterLists": {"Max": "2"}}) == told
    assert found([rule]) == []
