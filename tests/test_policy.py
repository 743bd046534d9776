"""What configuration changes: other styles, and what is allowed."""

import re

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators.corrections import corrected
from sleuthframe.operators.settings import listed, settings
from sleuthframe.parser.nodes import nodes
from sleuthframe.plans.examples import read
from sleuthframe.rules import RULES
from sleuthframe.rules.engine import edits, node_diagnostics, node_findings, numbered

#: (rule, settings, source with « » around what is reported, first message, source after corrections or None, path if it matters)
STYLED = [
    ("Bundler/GemVersion", {"EnforcedStyle": "forbidden"}, "gem 'a'\n«gem 'b', '1'»\n", "Gem version specification is forbidden.", None, "Gemfile"),
    ("Gemspec/DependencyVersion", {"EnforcedStyle": "forbidden"}, "Gem::Specification.new do |spec|\n  spec.add_dependency 'a'\n  «spec.add_dependency 'b', '1'»\nend\n", "Dependency version specification is forbidden.", None, "a.gemspec"),
    ("Layout/AccessModifierIndentation", {"EnforcedStyle": "outdent"}, "class A\n  «private»\n\n  def b; end\nend\n", "Outdent access modifiers like `private`.", "class A\nprivate\n\n  def b; end\nend\n"),
    ("Layout/DotPosition", {"EnforcedStyle": "trailing"}, "a\n  «.»b\nc.\n  d\n", "Place the . on the previous line, together with the method call receiver.", "a.\n  b\nc.\n  d\n"),
    ("Layout/EmptyLinesAroundAccessModifier", {"EnforcedStyle": "only_before"}, "class A\n  b\n\n  «private»\n\n  def c; end\nend\n", "Remove a blank line after `private`.", "class A\n  b\n\n  private\n  def c; end\nend\n"),
    ("Layout/EmptyLinesAroundClassBody", {"EnforcedStyle": "empty_lines"}, "class A\n  «b»\n«end»\n", "Empty line missing at class body beginning.", "class A\n\n  b\n\nend\n"),
    ("Layout/EmptyLinesAroundModuleBody", {"EnforcedStyle": "empty_lines"}, "module A\n\n  b\n«end»\n", "Empty line missing at module body end.", "module A\n\n  b\n\nend\n"),
    ("Layout/EmptyLinesAroundBlockBody", {"EnforcedStyle": "empty_lines"}, "a do\n  «b»\n«end»\n", "Empty line missing at block body beginning.", "a do\n\n  b\n\nend\n"),
    ("Layout/LineContinuationSpacing", {"EnforcedStyle": "no_space"}, "a = b« \\»\n  + 1\n", "Use zero spaces in front of backslash.", "a = b\\\n  + 1\n"),
    ("Layout/SpaceAroundEqualsInParameterDefault", {"EnforcedStyle": "no_space"}, "def a(b« = »1, c=2)\n  b + c\nend\n", "Surrounding space detected in default value assignment.", "def a(b=1, c=2)\n  b + c\nend\n"),
    ("Layout/SpaceBeforeBlockBraces", {"EnforcedStyle": "no_space"}, "a.b« »{ c }\na.b{ c }\n", "Space detected to the left of {.", "a.b{ c }\na.b{ c }\n"),
    ("Layout/SpaceInLambdaLiteral", {"EnforcedStyle": "require_space"}, "a = «->(b)» { b }\nc = -> (d) { d }\n", "Use a space between `->` and `(` in lambda literals.", "a = -> (b) { b }\nc = -> (d) { d }\n"),
    ("Layout/SpaceInsideParens", {"EnforcedStyle": "space"}, "a = («b» + «c»)\n".replace("«c»", "c").replace("«b» + c)", "«b» + c«)»"), "No space inside parentheses detected.", "a = ( b + c )\n"),
    ("Layout/SpaceInsideReferenceBrackets", {"EnforcedStyle": "space"}, "a«[»1«]»\nb[ 1 ]\n", "Use space inside reference brackets.", "a[ 1 ]\nb[ 1 ]\n"),
    ("Layout/SpaceInsideStringInterpolation", {"EnforcedStyle": "space"}, 'a = "«#{»b«}»"\nc = "#{ d }"\n', "Use space inside string interpolation.", 'a = "#{ b }"\nc = "#{ d }"\n'),
    ("Lint/InheritException", {"EnforcedStyle": "runtime_error"}, "class A < «Exception»\n  x\nend\nB = Class.new(«Exception»)\n", "Inherit from `RuntimeError` instead of `Exception`.", "class A < RuntimeError\n  x\nend\nB = Class.new(RuntimeError)\n"),
    ("Naming/HeredocDelimiterCase", {"EnforcedStyle": "lowercase"}, "a = <<~TEXT\n  x\n«TEXT»\n", "Use lowercase heredoc delimiters.", "a = <<~text\n  x\ntext\n"),
    ("Naming/MethodName", {"EnforcedStyle": "camelCase", "AllowedPatterns": ["^on_"]}, "def «a_b»; end\ndef cD; end\ndef on_e; end\n", "Use camelCase for method names.", None),
    ("Style/Alias", {"EnforcedStyle": "prefer_alias_method"}, "class A\n  «alias» b c\n  alias_method :d, :e\nend\n", "Use `alias_method` instead of `alias`.", "class A\n  alias_method :b, :c\n  alias_method :d, :e\nend\n"),
    ("Style/AndOr", {"EnforcedStyle": "always"}, "a «and» b\np 1 if c «or» d\n", "Use `&&` instead of `and`.", "a && b\np 1 if c || d\n"),
    ("Style/BarePercentLiterals", {"EnforcedStyle": "percent_q"}, "a = «%(»x \"y\" #{z})\n", "Use `%Q` instead of `%`.", "a = %Q(x \"y\" #{z})\n"),
    ("Style/ClassAndModuleChildren", {"EnforcedStyle": "compact"}, "module «A»\n  class B\n    c\n  end\nend\nclass D::E\n  f\nend\n", "Use compact module/class definition instead of nested style.", None),
    ("Style/ClassCheck", {"EnforcedStyle": "kind_of?"}, "x.«is_a?»(B)\nx.kind_of?(C)\n", "Prefer `Object#kind_of?` over `Object#is_a?`.", "x.kind_of?(B)\nx.kind_of?(C)\n"),
    ("Style/CommandLiteral", {"EnforcedStyle": "percent_x"}, "a = «`ls`»\nb = %x(ls)\n", "Use `%x` around command string.", "a = %x(ls)\nb = %x(ls)\n"),
    ("Style/DoubleNegation", {"EnforcedStyle": "forbidden"}, "def a?\n  «!»!b\nend\n", "Avoid the use of double negation (`!!`).", "def a?\n  !b.nil?\nend\n"),
    ("Style/EmptyElse", {"EnforcedStyle": "empty"}, "if a\n  b\n«else»\nend\nif a\n  b\nelse\n  nil\nend\n", "Redundant `else`-clause.", None),
    ("Style/EmptyMethod", {"EnforcedStyle": "expanded"}, "«def a; end»\ndef b\nend\n", "Put the `end` of empty method definitions on the next line.", "def a\nend\ndef b\nend\n"),
    ("Style/For", {"EnforcedStyle": "for"}, "«a.each do |b|\n  c(b)\nend»\na.each { |b| c(b) }\n", "Prefer `for` over `each`.", "for b in a do\n  c(b)\nend\na.each { |b| c(b) }\n"),
    ("Style/FormatString", {"EnforcedStyle": "sprintf"}, "a = «format»('%d', 1)\nb = '%d' «%» 1\n", "Favor `sprintf` over `format`.", "a = sprintf('%d', 1)\nb = sprintf('%d', 1)\n"),
    ("Style/FormatString", {"EnforcedStyle": "percent"}, "a = «format»('%d', 1)\nb = «sprintf»('%d%d', 1, 2)\n", "Favor `String#%` over `format`.", "a = '%d' % 1\nb = '%d%d' % [1, 2]\n"),
    ("Style/HashAsLastArrayItem", {"EnforcedStyle": "no_braces"}, "a = [1, «{ b: 2 }»]\nc = [1, b: 2]\n", "Omit the braces around the hash.", "a = [1, b: 2]\nc = [1, b: 2]\n"),
    ("Style/HashSyntax", {"EnforcedStyle": "hash_rockets"}, "a = { «b:» 1, «c:» 2 }\nd = { :e => 1 }\n", "Use hash rockets syntax.", "a = { :b => 1, :c => 2 }\nd = { :e => 1 }\n"),
    ("Style/Lambda", {"EnforcedStyle": "lambda"}, "a = «->» { 1 }\nb = lambda { |x| x }\n", "Use the `lambda` method for all lambdas.", "a = lambda { 1 }\nb = lambda { |x| x }\n"),
    ("Style/Lambda", {"EnforcedStyle": "literal"}, "a = «lambda» do |x|\n  x\nend\nb = -> { 1 }\n", "Use the `-> { ... }` lambda literal syntax for all lambdas.", "a = ->(x) do\n  x\nend\nb = -> { 1 }\n"),
    ("Style/LambdaCall", {"EnforcedStyle": "braces"}, "«a.call(1)»\na.(1)\n", "Prefer the use of `a.(1)` over `a.call(1)`.", "a.(1)\na.(1)\n"),
    ("Style/MagicCommentFormat", {"EnforcedStyle": "kebab_case"}, "# «frozen_string_literal»: true\n\na\n", "Prefer kebab case for magic comments.", "# frozen-string-literal: true\n\na\n"),
    ("Style/MethodDefParentheses", {"EnforcedStyle": "require_no_parentheses"}, "def a«(b, c)»\n  1\nend\n", "Use def without parentheses.", "def a b, c\n  1\nend\n"),
    ("Style/ModuleFunction", {"EnforcedStyle": "extend_self"}, "module A\n  «module_function»\nend\n", "Use `extend self` instead of `module_function`.", "module A\n  extend self\nend\n"),
    ("Style/NegatedIf", {"EnforcedStyle": "prefix"}, "p 1 if !a\n«if !b\n  c\nend»\n", "Favor `unless` over `if` for negative conditions.", "p 1 if !a\nunless b\n  c\nend\n"),
    ("Style/NegatedUnless", {"EnforcedStyle": "postfix"}, "«p 1 unless !a»\nunless !b\n  c\nend\n", "Favor `if` over `unless` for negative conditions.", "p 1 if a\nunless !b\n  c\nend\n"),
    ("Style/NilComparison", {"EnforcedStyle": "comparison"}, "a.«nil?»\na == nil\n", "Prefer the use of the `==` comparison.", "a == nil\na == nil\n"),
    ("Style/NumericLiteralPrefix", {"EnforcedOctalStyle": "zero_only"}, "a = «0o123»\nb = 0123\nc = «0X1F»\n", "Use 0 for octal literals.", "a = 0123\nb = 0123\nc = 0x1F\n"),
    ("Style/NumericPredicate", {"EnforcedStyle": "comparison", "AllowedMethods": ["where"]}, "«a.zero?»\n«a.positive?»\na == 0\nwhere(b.zero?)\n", "Use `a == 0` instead of `a.zero?`.", "a == 0\na > 0\na == 0\nwhere(b.zero?)\n"),
    ("Style/ObjectThen", {"EnforcedStyle": "yield_self"}, "a.«then» { |x| x }\na.yield_self { |x| x }\n", "Prefer `yield_self` over `then`.", "a.yield_self { |x| x }\na.yield_self { |x| x }\n"),
    ("Style/PercentQLiterals", {"EnforcedStyle": "upper_case_q"}, "a = «%q(»x)\nb = %Q(x)\n", "Use `%Q` instead of `%q`.", "a = %Q(x)\nb = %Q(x)\n"),
    ("Style/PreferredHashMethods", {"EnforcedStyle": "verbose"}, "a.«key?»(1)\na.has_key?(1)\n", "Use `Hash#has_key?` instead of `Hash#key?`.", "a.has_key?(1)\na.has_key?(1)\n"),
    ("Style/RaiseArgs", {"EnforcedStyle": "compact"}, "«raise A, 'x'»\nraise A.new('x')\n", "Provide an exception object as an argument to `raise`.", "raise A.new('x')\nraise A.new('x')\n"),
    ("Style/RegexpLiteral", {"EnforcedStyle": "percent_r"}, "a = «/x/i»\nb = %r{x}\n", "Use `%r` around regular expression.", "a = %r{x}i\nb = %r{x}\n"),
    ("Style/RescueStandardError", {"EnforcedStyle": "implicit"}, "begin\n  a\n«rescue StandardError»\n  b\nend\n", "Omit the error class when rescuing `StandardError` by itself.", "begin\n  a\nrescue\n  b\nend\n"),
    ("Style/ReturnNil", {"EnforcedStyle": "return_nil"}, "def a\n  «return» if b\n\n  return nil if c\nend\n", "Prefer `return nil` over `return`.", "def a\n  return nil if b\n\n  return nil if c\nend\n"),
    ("Style/SignalException", {"EnforcedStyle": "only_fail"}, "«raise» 'x'\nfail 'x'\n", "Always use `fail` to signal exceptions.", "fail 'x'\nfail 'x'\n"),
    ("Style/SpecialGlobalVars", {"EnforcedStyle": "use_perl_names"}, "p «$ERROR_INFO»\np $!\n", "Prefer `$!` over `$ERROR_INFO`.", "p $!\np $!\n"),
    ("Style/StabbyLambdaParentheses", {"EnforcedStyle": "require_no_parentheses"}, "a = ->«(x)» { x }\nb = ->x { x }\n", "Do not wrap stabby lambda arguments with parentheses.", "a = ->x { x }\nb = ->x { x }\n"),
    ("Style/StringLiterals", {"EnforcedStyle": "double_quotes"}, "a = «'x'»\nb = \"x\"\nc = 'say \"x\"'\n", "Prefer double-quoted strings unless you need single quotes to avoid extra backslashes for escaping.", "a = \"x\"\nb = \"x\"\nc = 'say \"x\"'\n"),
    ("Style/StringLiteralsInInterpolation", {"EnforcedStyle": "double_quotes"}, "a = \"#{b[«'c'»]}\"\n", "Prefer double-quoted strings inside interpolations.", "a = \"#{b[\"c\"]}\"\n"),
    ("Style/SymbolArray", {"EnforcedStyle": "brackets"}, "a = «%i[b c]»\nd = [:e, :f]\n", "Use `[:b, :c]` for an array of symbols.", "a = [:b, :c]\nd = [:e, :f]\n"),
    ("Style/TernaryParentheses", {"EnforcedStyle": "require_parentheses"}, "a = «b ? 1 : 2»\nc = (d) ? 1 : 2\n", "Use parentheses for ternary conditions.", "a = (b) ? 1 : 2\nc = (d) ? 1 : 2\n"),
    ("Style/UnlessLogicalOperators", {"EnforcedStyle": "forbid_logical_operators"}, "«p 1 unless a && b»\np 1 unless a\n", "Do not use any logical operator in an `unless`.", None),
    ("Style/WordArray", {"EnforcedStyle": "brackets"}, "a = «%w[b c]»\nd = ['e', 'f']\n", "Use `['b', 'c']` for an array of words.", "a = ['b', 'c']\nd = ['e', 'f']\n"),
    ("Style/YodaCondition", {"EnforcedStyle": "forbid_for_equality_operators_only"}, "p 1 if «1 == a»\np 1 if 1 < a\n", "Reverse the order of the operands `1 == a`.", "p 1 if a == 1\np 1 if 1 < a\n"),
    ("Style/SendWithLiteralMethodName", {"AllowSend": "false"}, "a.«send(:b, 1)»\na.send(c)\n", "Use `b` method call directly instead.", "a.b(1)\na.send(c)\n"),
    ("Bundler/GemComment", {"IgnoredGems": ["a"]}, "gem 'a'\n«gem 'b'»\n", "Missing gem description comment.", None, "Gemfile"),
    ("Bundler/GemVersion", {"AllowedGems": ["a"]}, "gem 'a'\n«gem 'b'»\n", "Gem version specification is required.", None, "Gemfile"),
    ("Layout/EmptyLinesAroundAttributeAccessor", {"AllowedMethods": ["delegate"]}, "class A\n  attr_reader :b\n  delegate :c\nend\n", "", None),
    ("Lint/AmbiguousBlockAssociation", {"AllowedMethods": ["b"], "AllowedPatterns": ["^d"]}, "a b { |c| c }\na da { |c| c }\n«a e { |c| c }»\n", "Parenthesize the param `e { |c| c }` to make sure that the block will be associated with the `e` method call.", None),
    ("Lint/ConstantDefinitionInBlock", {"AllowedMethods": ["a"]}, "a do\n  B = 1\nend\nc do\n  «D = 1»\nend\n", "Do not define constants this way within a block.", None),
    ("Lint/NestedMethodDefinition", {"AllowedMethods": ["b"]}, "def a\n  b do\n    def c; end\n  end\nend\n", "", None),
    ("Lint/NumberConversion", {"IgnoredClasses": ["Foo"], "AllowedMethods": ["minutes"]}, "Foo.new.to_i\n1.minutes.to_i\n«a.to_i»\n", "Replace unsafe number conversion with number class parsing, instead of using `a.to_i`, use stricter `Integer(a, 10)`.", None),
    ("Lint/RaiseException", {"AllowedImplicitNamespaces": ["Foo"]}, "module Foo\n  raise Exception\nend\nraise «Exception»\n", "Use `StandardError` over `Exception`.", None),
    ("Lint/UselessDefaultValueArgument", {"AllowedReceivers": ["Rails.cache"]}, "Rails.cache.fetch(:b, c) { d }\na.fetch(:b, «c») { d }\n", "Block supersedes default value argument.", None),
    ("Style/CaseEquality", {"AllowOnConstant": "true"}, "A === b\na «===» b\n", "Avoid the use of the case equality operator `===`.", None),
    ("Style/ClassEqualityComparison", {"AllowedMethods": ["same?"]}, "def same?(b)\n  a.class == b.class\nend\ndef ==(b)\n  a.class == b.class\nend\n", "", None),
    ("Style/FetchEnvVar", {"AllowedVars": ["X"]}, "a = ENV['X']\nb = «ENV['Y']»\n", "Use `ENV.fetch('Y', nil)` instead of `ENV['Y']`.", None),
    ("Style/GlobalVars", {"AllowedVariables": ["$a"]}, "$a = 1\n«$b» = 1\n", "Do not introduce global variables.", None),
    ("Style/HashEachMethods", {"AllowedReceivers": ["a"]}, "a.keys.each { |k| p k }\nb.«keys.each» { |k| p k }\n", "Use `each_key` instead of `keys.each`.", None),
    ("Style/IpAddresses", {"AllowedAddresses": ["10.0.0.1"]}, "a = '10.0.0.1'\nb = «'10.0.0.2'»\n", "Do not hardcode IP addresses.", None),
    ("Style/MethodCallWithoutArgsParentheses", {"AllowedMethods": ["b"]}, "a.b()\na.c«()»\n", "Do not use parentheses for method calls with no arguments.", None),
    ("Style/NumericLiterals", {"AllowedNumbers": ["80000"], "AllowedPatterns": ["^9"]}, "a = 80000\nb = 99999\nc = «80001»\n", "Use underscores(_) as thousands separator and separate every 3 digits with them.", None),
    ("Style/RaiseArgs", {"AllowedCompactTypes": ["A"]}, "raise A.new('x')\n«raise B.new('x')»\n", "Provide an exception class and message as arguments to `raise`.", None),
    ("Style/RedundantReturn", {"AllowMultipleReturnValues": "true"}, "def a\n  return 1, 2\nend\n", "", None),
    ("Style/SafeNavigation", {"AllowedMethods": ["b"]}, "p a && a.b\np «a && a.c»\n", "Use safe navigation (`&.`) instead of checking if an object exists before calling the method.", None),
    ("Style/SymbolProc", {"AllowedMethods": ["b"], "AllowedPatterns": ["^m"]}, "a.b { |x| x.c }\na.map { |x| x.c }\na.d «{ |x| x.c }»\n", "Pass `&:c` as an argument to `d` instead of a block.", None),
    ("Style/StringConcatenation", {"Mode": "conservative"}, "a = «'b' + c»\nd = e + 'f'\n", "Prefer string interpolation to string concatenation.", None),
    ("Style/TrivialAccessors", {"AllowedMethods": ["b"]}, "class A\n  def b\n    @b\n  end\n\n  «def» c\n    @c\n  end\nend\n", "Use `attr_reader` to define trivial reader methods.", None),
    ("Style/YodaExpression", {"SupportedOperators": ["*"]}, "p 1 + a\np «2 * a»\n", "Non-literal operand (`a`) should be first.", None),
    ("Layout/ArrayAlignment", {"EnforcedStyle": "with_fixed_indentation"}, "a = [1,\n     «2»]\nb = [1,\n  2]\n", "Use one level of indentation for elements following the first line of a multi-line array.", "a = [1,\n  2]\nb = [1,\n  2]\n"),
    ("Layout/FirstArgumentIndentation", {"IndentationWidth": "4"}, "a(\n  «1»\n)\nb(\n    1\n)\n", "Indent the first argument one step more than the start of the previous line.", "a(\n    1\n)\nb(\n    1\n)\n"),
    ("Metrics/MethodLength", {"Max": "1", "AllowedMethods": ["a"]}, "def a\n  1\n  2\nend\n\n«def b\n  1\n  2\nend»\n", "Method has too many lines. [2/1]", None),
    ("Metrics/ParameterLists", {"Max": "1"}, "def a«(b, c)»\n  1\nend\n", "Avoid parameter lists longer than 1 parameters. [2/1]", None),
    ("Naming/RescuedExceptionsVariableName", {"PreferredName": "error"}, "begin\n  a\nrescue B => «e»\n  c\nend\n", "Use `error` instead of `e`.", None),
]


def rounds():
    """The cases in rounds in which no rule has two settings."""
    out = []
    for i, case in enumerate(STYLED):
        some = next((r for r in out if len(r) < 30 and all(c[0] != case[0] for _, c in r)), None)
        if some is None:
            out.append(some := [])
        some.append((i, case))
    return out


@pytest.mark.parametrize("some", rounds(), ids=lambda r: str(r[0][0]))
def test_settings_change_rules(spark, some):
    """Each rule under its settings: what it reports, and what its corrections make of it."""
    names = {case[0]: case[1] for _, case in some}
    rows = [(f"{i}/{case[0]}/{case[5] if len(case) > 5 else 'a.rb'}", read(case[2])[0]) for i, case in some]
    files = spark.createDataFrame(rows, "path string, content string")
    own = F.col("rule") == F.concat_ws("/", F.split("path", "/")[1], F.split("path", "/")[2])
    found = numbered(node_findings(nodes(files), [r for r in RULES if r.name in names], corrects=True, config=names).filter(own))
    got = found.select("path", "at.start", "at.end", "message").orderBy("path", "start", "end").collect()
    after = {r["path"]: r["content"] for r in corrected(files, edits(found)).collect()}
    wrong = []
    for (path, _), (_, case) in zip(rows, some, strict=True):
        spans = [(r["start"], r["end"]) for r in got if r["path"] == path]
        told_first = next((r["message"] for r in got if r["path"] == path), "")
        if spans != read(case[2])[1] or told_first != case[3] or case[4] is not None and after[path] != case[4]:
            wrong.append((case[0], case[1], spans, read(case[2])[1], told_first, after[path]))
    assert wrong == []


def test_one_row_of_settings(spark):
    rules = [r for r in RULES if r.name in ("Metrics/MethodLength", "Style/ClassCheck", "Style/HashConversion")]
    row = settings(spark, rules, {"Metrics/MethodLength": {"Max": "many", "AllowedMethods": ["a", "b"]}, "Style/ClassCheck": {"EnforcedStyle": "kind_of?"}, "Other/Rule": {"X": "1"}}).first()["cfg"].asDict()
    assert row["Metrics/MethodLength.Max"] == ["10"] and row["Metrics/MethodLength.AllowedMethods"] == ["a", "b"]
    assert row["Style/ClassCheck.EnforcedStyle"] == ["kind_of?"] and row["Style/HashConversion.AllowSplatArgument"] == ["true"]
    assert settings(spark, []).count() == 1 and listed({"a": "1"}) == ["a=1"]


def test_the_plan_does_not_change_with_the_configuration(spark):
    files = spark.createDataFrame([("a.rb", "x.is_a?(B)\n")], "path string, content string")
    rules = [r for r in RULES if r.name == "Style/ClassCheck"]
    plans = [node_diagnostics(files, rules, config=c)._jdf.queryExecution().optimizedPlan().toString() for c in ({}, {"Style/ClassCheck": {"EnforcedStyle": "kind_of?"}})]
    first, second = (re.sub(r"#\d+L?|_\d+|@\w+", "", p) for p in plans)
    assert first == second and "kind_of?" in first
