"""What keeps large inputs within their limits: tables dealt out, rows and columns
asked for, statements known by their shape, results shuffled once."""

import pyarrow as pa

from sleuthframe.operators.analysis import analyze
from sleuthframe.operators.audits import batches, under_configurations
from sleuthframe.operators.autocorrect import autocorrect
from sleuthframe.operators.directive_rules import directive_diagnostics
from sleuthframe.operators.line_rules import diagnostics, selected
from sleuthframe.parser import ruby
from sleuthframe.parser import nodes as table
from sleuthframe.parser.nodes import ALWAYS, Asked, nodes, shared_nodes
from sleuthframe.plans import documents, sources
from sleuthframe.rules import RULES
from sleuthframe.rules import engine
from sleuthframe.rules.engine import asked_of, names_asked, node_findings, reads_path
from sleuthframe.plans.catalog import example_files
from sleuthframe.sources.tables import FEW_CONTENTS, spread

LINES = ["{a} == nil", "not {a}", "@{a} = {{ :{b} => {c}, :{a} => 1 }}", "{a}.{b} if !{c} # {b}", "{a}.map {{ |v| [v, {b}] }}.to_h", "raise Exception, '{c}'", "{a} = 1", "{a} ? {b} : {c}", "puts \"#{{{a}}} {b}\"", "{a}.{b}({c}) do |x| x end", "%w[{a} {b}]", "{a} /{b}/ {c}", "?a.{b}", "{a}\n  .{b}", "{a} rescue {b}", "def {a}({b}) = {c}", "{a} <<~{b}\n  {b}\n{b}", "{b} [{c}]", "{a} :{b}, {c}: 1"]
WORDS = [("foo", "bar", "baz"), ("q", "r", "q"), ("Foo", "x1", "Bar"), ("long_name", "i", "w"), ("nil", "foo", "self"), ("a12", "b", "c"), ("foo", "foo", "foo"), ("ärger", "x", "y")]


def read(text, known):
    kept, ruby.Parser.known_statement = ruby.Parser.known_statement, known
    try:
        tree, parser = ruby.parse(text)
        return tree, parser.literal, [(c.start, c.end, c.name) for c in parser.comments]
    except ruby.ParseError as e:
        return e.at, e.message
    finally:
        ruby.Parser.known_statement = kept


def test_statements_of_known_shape_read_the_same():
    ruby.SHAPES.clear()
    known, hits = ruby.Parser.known_statement, []

    def counted(self):
        node = known(self)
        hits.append(node is not None)
        return node

    for _ in range(4):
        for a, b, c in WORDS:
            for end in ("\n", "\r\n"):
                some = [s.format(a=a, b=b, c=c) for s in LINES]
                for text in (*some, "\n".join(some[:6]), f"def m\n  {a} = 2\n  " + "\n  ".join(some[:6]) + "\nend\n"):
                    plain, fast = read(text.replace("\n", end), lambda self: None), read(text.replace("\n", end), counted)
                    assert plain[1:] == fast[1:] and (ruby.same(plain[0], fast[0]) if isinstance(plain[0], ruby.Node) else plain == fast), text
    assert sum(hits) > 200
    # a name that is a local variable has no shape of its own
    tree, _ = ruby.parse("foo == nil\nbar == nil\nbaz == nil\nfoo = 1\nfoo == nil\n")
    assert tree.kids[-1][1].kids[0][1].kind == "local_variable_read"


def test_only_what_rules_look_at(spark):
    rules = selected(["Style/NilComparison", "Style/Not"], RULES)
    text = "foo == nil\nbar(1, 2) { |x| x }\nnot baz\n"
    files = spark.createDataFrame([(p, text) for p in ("a.rb", "b.rb", None)], "path string, content string")
    every = {(r["path"], r["id"]): r for r in nodes(files).collect()}
    asked = asked_of(rules)
    some = nodes(files, asked).collect()
    assert len(some) == 6 and {r["name"] for r in some} == {"==", "!"}
    for r in some:
        whole = every[r["path"], r["id"]]
        assert all(r[c] == whole[c] for c in r.asDict() if c in asked.columns) and r["kids2"] is None and r["kids"] is not None
    assert nodes(files, Asked()).count() == len(every)


def made_rows(contents, asked, by_columns):
    """Rows of two batches of files, and how many files were left to be read."""
    table.FILES.clear(), ruby.SHAPES.clear()
    read, filled, kept = [], table.fill, table.Tables.sorted_out

    def counted(rows, paths, text, *rest):
        read.append(text)
        return filled(rows, paths, text, *rest)

    table.fill = counted
    if not by_columns:
        table.Tables.sorted_out = lambda self, files: (files, iter(()))
    try:
        batches = [pa.RecordBatch.from_pylist([{"path": str(i), "content": c, "told": [], "skip": ["x"] * (i % 2)} for i, c in enumerate(contents)], pa.schema([("path", pa.string()), ("content", pa.string()), ("told", table.SCHEMA.field("told").type), ("skip", pa.list_(pa.string()))])) for _ in range(2)]
        out = [r for b in table._nodes(iter(batches), asked) for r in b.to_pylist()]
    finally:
        table.fill, table.Tables.sorted_out = filled, kept
    return sorted(map(repr, out)), len(read)


def test_rows_made_by_columns_are_those_read():
    lines = [s for s, _ in documents.STATEMENTS] + list(documents.TOLD)
    corpus = ["".join(f"{'  ' * (k % 3)}{s.format(x=f'qa{k % 7}', y='q' + 'b' * (k % 5), z=f'qc{i}')}\n{chr(10) * (k % 2)}" for k, s in enumerate(lines)) for i in range(60)]
    small = [f"part_{i}({i % 50 + 1})\nclass C{i}\n  def m; end\nend\n" for i in range(60)] + [f"x.kind_of?(Part{i})\ny = ?{'ab'[i % 2]}{' # rubocop:disable Style/CharacterLiteral' if i % 2 else ''}\n" for i in range(100)]
    odd = ["", "x1 = (5", "__END__\nx1", "a1 = 1\na1 == nil\n", "qa1 == nil\n  .foo\n", "qä == nil\n"]
    asks = [asked_of(selected(n, RULES), c) for n, c in ((documents.CORRECTING, True), (list(documents.CONFIG), False), (["Style/NilComparison", "Style/Not"], False), (sources.FIXERS, True))] + [Asked(sources.SHOWN, columns=ALWAYS)]
    for asked in asks:
        fast, read = made_rows(corpus + small + odd, asked, True)
        slow, all_read = made_rows(corpus + small + odd, asked, False)
        assert fast == slow and len(fast) > 200
        assert all_read == 2 * len(corpus + small + odd) and read < all_read / 2 + 30, (read, all_read)


def test_rows_of_equal_contents_are_shared(spark):
    files = spark.createDataFrame([(f"{i}.rb", ("a == nil\n", "not b\n")[i % 2]) for i in range(200)], "path string, content string").coalesce(1)
    rules = selected(["Style/NilComparison", "Style/Not"], RULES)
    rows = shared_nodes(files, asked_of(rules))
    assert rows.count() == 2 and nodes(files, asked_of(rules)).count() == 200
    assert node_findings(rows, rules).select("path").distinct().count() == 200
    by_path = selected(["Gemspec/AddRuntimeDependency"], RULES)
    assert reads_path(by_path[0]) and not any(map(reads_path, rules))
    kept, table.COPIES = table.COPIES, 20
    try:
        schema = pa.schema([("path", pa.string()), ("content", pa.string()), ("told", table.SCHEMA.field("told").type), ("skip", pa.list_(pa.string()))])
        some = pa.RecordBatch.from_pylist([{"path": str(i), "content": "a == nil\n" * 4, "told": [], "skip": []} for i in range(50)], schema)
        out = [r for b in table._nodes([some], asked_of(rules)) for r in b.to_pylist()]
    finally:
        table.COPIES = kept
    assert len(out) == 40 and max(len(r["paths"]) for r in out) == 5 and len({(p, r["id"]) for r in out for p in r["paths"]}) == 200


def test_corrections_are_made_from_findings_made_once(spark):
    files = spark.createDataFrame([("a.rb", "a == nil\nnot b\n"), ("b.rb", None), (None, "not c\n"), ("d.rb", "1\n")], "path string, content string")
    found, after = autocorrect(files, selected(["Style/NilComparison", "Style/Not"], RULES))
    for out in (found, after):
        # one that reads the sources, one that writes them
        assert str(out._jdf.queryExecution().optimizedPlan().toString()).count("MapInArrow") == 2
    assert sorted((r["path"] or "", r["rule"], r["corrected"]) for r in found.collect()) == [("", "Style/Not", False), ("a.rb", "Style/NilComparison", True), ("a.rb", "Style/Not", True)]
    assert sorted((r["path"] or "", r["content"], r["accepted"], r["subsumed"]) for r in after.collect()) == [("", "not c\n", [], []), ("a.rb", "a.nil?\n!b\n", [1, 2], []), ("b.rb", "", [], []), ("d.rb", "1\n", [], [])]


def test_names_in_a_list_bound_a_rule():
    rule = next(r for r in RULES if r.name == "Style/NilComparison" and "IN" in r.where)
    assert names_asked(rule) == ["'=='", "'==='"]


def test_tables_are_dealt_out(spark):
    rows = spread(spark.range(0, 1050, 1, 1), 100)
    assert rows.rdd.getNumPartitions() == 11 and rows.distinct().count() == 1050
    assert spread(spark.range(0), 100).count() == 0
    assert sources.made(spark, "/root/testdata/sf0.01", "'x'").rdd.getNumPartitions() > 1


def test_results_of_a_run_are_shuffled_once(spark):
    schema = "run long, batch string, revision string, version string, position long, classification string, left long, right long, exact long, left_seconds long, right_seconds long"
    rows = [(1, "a", "r", "v", p, c, 1, 1, 1, 1, 1) for p, c in ((0, "x"), (1, None), (1, "x"), (4, "y"), (5, "none"), (9, "x"))]
    rows += [(2, b, "r", None, p, "x", 1, 1, 1, 1, 1) for b, p in ((None, 1), ("", 2), ("b", 3))] + [(3, "a", None, "v", None, "x", 1, 1, 1, 1, 1), (3, "a", "", "v", 7, "x", 1, 1, 1, 1, 1)]
    out = batches(spark.createDataFrame(rows, schema))
    got = {r["run"]: (r["status"], r["batches"], r["first"], r["last"], r["positions"], r["islands"], r["left"], r["classifications"]) for r in out.collect()}
    assert got == {1: ("repeated positions", 1, 0, 9, 5, 3, None, {"none": 2, "x": 3, "y": 1}), 2: ("complete", 2, 1, 3, 3, 1, 3, {"x": 3}), 3: ("repeated positions", 1, 7, 7, 1, 2, None, {"x": 2})}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1


def test_names_of_directives_are_found_once(spark):
    files = spark.createDataFrame([("a.rb", "# rubocop:disable Style/Not\nx = 1\n# rubocop:enable Style/Not\n")], "path string, content string")
    found = directive_diagnostics(files, diagnostics(files).limit(0), run=["Style/Not"])
    assert "InMemoryRelation" in found._jdf.queryExecution().withCachedData().toString()
    assert [r["line"] for r in found.collect() if r["rule"] == "Lint/RedundantCopDisableDirective"] == [1]


def test_tasks_of_few_contents_are_few(spark, tmp_path):
    spark.range(250_000).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    some = [(k, "Style/Not", "a.rb", "not a\n", []) for k in range(3)]
    for files in (sources.made(spark, str(tmp_path), "'x'", FEW_CONTENTS), example_files(spark, str(tmp_path), some)):
        assert files.rdd.getNumPartitions() == 5 and files.count() == 250_000
    assert sources.made(spark, str(tmp_path), "'x'").rdd.getNumPartitions() == 50


def test_empty_lists_are_not_made_one_by_one():
    kind = pa.list_(pa.string())
    assert table._lists(pa.array([[], None, []], kind)) == [(), (), ()]
    assert table._lists(pa.array([["a"], None, []], kind)) == [["a"], None, []]
    assert table._lists(pa.array([["a"], [], []], kind).slice(1)) == [(), ()]


def test_paths_are_asked_of_findings(spark, monkeypatch):
    text = "Gem::Specification.new do |s|\n  s.add_runtime_dependency 'a'\nend\nx == nil\n"
    files = spark.createDataFrame([(p, text) for p in ("a.gemspec", "b.rb", "c.gemspec", None, "gemspec")], "path string, content string").coalesce(1)
    rules, dealt = selected(["Gemspec/AddRuntimeDependency", "Gemspec/DependencyVersion", "Style/NilComparison"], RULES), []
    monkeypatch.setattr(engine, "of_each_path", lambda rows: dealt.append(rows.columns) or table.of_each_path(rows))
    got = sorted((r["path"] or "", r["rule"]) for r in node_findings(shared_nodes(files, asked_of(rules)), rules).collect())
    # rows are dealt out to paths once they are findings
    assert len(dealt) == 1 and "rule" in dealt[0]
    want = sorted((r["path"] or "", r["rule"]) for r in node_findings(nodes(files, asked_of(rules)), rules).collect())
    assert got == want and len(got) == 2 * 2 + 5 and {p for p, r in got if r.startswith("Gemspec")} == {"a.gemspec", "c.gemspec"}
    # what a file carries along isn't asked for its path
    carried = files.selectExpr("*", "array(named_struct('rule', 'Gemspec/DependencyVersion', 'severity', 'warning', 'message', 'm')) AS told")
    assert node_findings(shared_nodes(carried, asked_of(rules)), rules).filter("message = 'm'").count() == 5
    # a rule that reads the path beside other columns sees each path
    both = [*rules, *selected(["Lint/RequireRelativeSelfPath"], RULES)]
    assert engine.asked_of_paths(both) == (both, {})


def test_lines_with_comments_are_made_by_columns():
    lines = ["q{a} == nil", "q{a} == nil # rubocop:disable Style/NilComparison", "  # rubocop:enable Style/NilComparison, ALL -- why", "q{a}.nil? # no reason", "# rubocop:disable Style/Not", "", "not q{a}"]
    corpus = ["".join(lines[(i + k) % 7].format(a=chr(97 + i % 26) * (1 + i // 26 + k % 3)) + "\n" for k in range(30)) for i in range(80)]
    odd = ["# only\n", "qa == '#'\n", "qa == nil # it's\n", "qa ? # x\n  1 : 2\n", "qa == ?# # b\n", "qa == nil # x\n# y\n  .foo\n", "qa == :# x\n", "qa == nil # rubocop:disable Style/Not"]
    asked = asked_of(selected(["Style/NilComparison", "Style/Not"], RULES))
    fast, read = made_rows(corpus + odd, asked, True)
    slow, all_read = made_rows(corpus + odd, asked, False)
    assert fast == slow and len(fast) > 1000 and any("'own': False" in r for r in fast)
    assert read < all_read / 2 + 20, (read, all_read)


def test_files_with_directives_are_read_once(spark):
    files = spark.createDataFrame([("a.rb", "# rubocop:disable Style/Not\nnot x\n# rubocop:enable Style/Not\nnot y\n"), ("b.rb", "not z\n"), ("c.rb", "# rubocop:disable Style/Not\n")], "path string, content string")
    found = analyze(files, ["Style/Not", "Lint/RedundantCopDisableDirective", "Lint/MissingCopEnableDirective"], own=[lambda f: f.selectExpr("path", "1 AS line", "1 AS column", "1 AS length", "'Style/Not' AS rule", "'x' AS severity", "'own' AS message").filter("path = 'c.rb'")])
    # those without directives; what is found in the others is kept
    outside, kept = [], None
    for line in found._jdf.queryExecution().withCachedData().toString().split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        if kept is None or at <= kept:
            kept = at if "InMemoryRelation" in line else None
            outside.append(line)
    assert sum("MapInArrow" in line for line in outside) == 1
    assert sorted((r["path"], r["line"], r["rule"], r["message"] == "own") for r in found.collect()) == [("a.rb", 4, "Style/Not", False), ("b.rb", 1, "Style/Not", False), ("c.rb", 1, "Lint/MissingCopEnableDirective", False)]


def test_findings_under_configurations_are_shuffled_once(spark):
    files = spark.createDataFrame([("a.rb", "a == nil\nb.nil?\n"), ("a.rb", "a == nil\n"), (None, "c == nil\n")], "path string, content string")
    other = {"Style/NilComparison": {"EnforcedStyle": "comparison"}}
    rules = selected(["Style/NilComparison"], RULES)
    out = under_configurations(files, rules, [{}, other, {}])
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["path"] or "", r["line"], r["n"], r["configs"]) for r in out.collect()) == [("", 1, 1, 5), ("a.rb", 1, 2, 5), ("a.rb", 2, 1, 2)]
    assert under_configurations(files, rules, []).count() == 0


def test_what_lines_have_in_common_is_told_once(monkeypatch):
    told, kept = [], table.keyed
    monkeypatch.setattr(table, "keyed", lambda line: told.append(line) or kept(line))
    corpus = ["".join(f"qa{i} == nil\nnot q{k}\nqb.foo(qb, q{i})\n" for k in range(20)) for i in range(60)]
    made_rows(corpus, asked_of(selected(["Style/NilComparison", "Style/Not"], RULES)), True)
    assert 0 < len(told) < 100


def test_texts_are_corrected_without_what_findings_say(spark):
    files = spark.createDataFrame([("a.rb", "a == nil\n")], "path string, content string")
    found, after = autocorrect(files, selected(["Style/NilComparison"], RULES))
    listed = [next(x for x in str(df._jdf.queryExecution().analyzed().toString()).split("\n") if "collect_list" in x) for df in (found, after)]
    assert ["severity" in x for x in listed] == [True, False]
