"""What files read after the corrections of one rule."""

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators.autocorrect import autocorrect
from sleuthframe.operators.corrections import corrected
from sleuthframe.parser.nodes import nodes
from sleuthframe.rules import RULES
from sleuthframe.rules.engine import NodeRule, edits, node_diagnostics, node_findings, numbered

#: (rule, before, after, path if it matters)
CORRECTED = [
    ('Lint/BigDecimalNew', "x = BigDecimal.new('1.5')\ny = ::BigDecimal.new(2)\n", "x = BigDecimal('1.5')\ny = BigDecimal(2)\n"),
    ('Lint/BooleanSymbol', 'a = :true\nb = { false: 1 }\nc = %i[true]\n', 'a = true\nb = { false => 1 }\nc = %i[true]\n'),
    ('Lint/DeprecatedClassMethods', "File.exists?('a')\niterator?\nFile.exist?('a')\n", "File.exist?('a')\nblock_given?\nFile.exist?('a')\n"),
    ('Lint/EmptyEnsure', 'begin\n  a\nensure\nend\n', 'begin\n  a\n\nend\n'),
    ('Lint/EmptyInterpolation', 'x = "a#{}b#{c}"\n', 'x = "ab#{c}"\n'),
    ('Lint/IdentityComparison', 'a.object_id == b.object_id\na.object_id != b.object_id\n', 'a.equal?(b)\n!a.equal?(b)\n'),
    ('Lint/ImplicitStringConcatenation', "x = 'a' 'b'\ny = 'a' + 'b'\n", "x = 'a' + 'b'\ny = 'a' + 'b'\n"),
    ('Lint/InheritException', 'class A < Exception\n  x\nend\nB = Class.new(Exception)\nclass C < StandardError\n  x\nend\n', 'class A < StandardError\n  x\nend\nB = Class.new(StandardError)\nclass C < StandardError\n  x\nend\n'),
    ('Lint/InterpolationCheck', "a = 'x #{y}'\nb = 'plain'\n", 'a = "x #{y}"\nb = \'plain\'\n'),
    ('Lint/LiteralInInterpolation', 'x = "a#{1}b#{c}"\n', 'x = "a1b#{c}"\n'),
    ('Lint/MultipleComparison', 'a = 1 < x < 9\nb = 1 < x && x < 9\n', 'a = 1 < x && x < 9\nb = 1 < x && x < 9\n'),
    ('Lint/OrAssignmentToConstant', 'LIMIT ||= 5\nx ||= 5\n', 'LIMIT = 5\nx ||= 5\n'),
    ('Lint/PercentStringArray', "a = %w('x', 'y')\nb = %w[x y]\n", 'a = %w(x y)\nb = %w[x y]\n'),
    ('Lint/PercentSymbolArray', 'a = %i(:x, :y)\nb = %i[x y]\n', 'a = %i(x y)\nb = %i[x y]\n'),
    ('Lint/RaiseException', "raise Exception, 'no'\nraise Exception.new('no')\nraise StandardError, 'no'\n", "raise StandardError, 'no'\nraise StandardError.new('no')\nraise StandardError, 'no'\n"),
    ('Lint/RedundantRequireStatement', "require 'thread'\nrequire 'json'\n", "require 'json'\n"),
    ('Lint/RedundantStringCoercion', 'a = "x#{b.to_s}"\nputs c.to_s\nputs to_s\n', 'a = "x#{b}"\nputs c\nputs to_s\n'),
    ('Lint/RedundantWithIndex', 'a.each_with_index { |v| p v }\na.each_with_index { |v, i| p v, i }\n', 'a.each { |v| p v }\na.each_with_index { |v, i| p v, i }\n'),
    ('Lint/RegexpAsCondition', 'p 1 if /x/\np 2 if a =~ /x/\n', 'p 1 if /x/ =~ $_\np 2 if a =~ /x/\n'),
    ('Lint/SafeNavigationWithEmpty', 'p 1 if a&.empty?\np 1 if a.empty?\n', 'p 1 if a && a.empty?\np 1 if a.empty?\n'),
    ('Lint/SendWithMixinArgument', 'A.send(:include, B)\nA.include B\n', 'A.include B\nA.include B\n'),
    ('Lint/SymbolConversion', 'a = :foo.to_sym\nb = "x#{y}".to_sym\nc = :"bar"\nd = \'x-y\'\n', 'a = :foo\nb = :"x#{y}"\nc = :bar\nd = \'x-y\'\n'),
    ('Lint/ToJSON', 'class A\n  def to_json\n    1\n  end\nend\n', 'class A\n  def to_json(*_args)\n    1\n  end\nend\n'),
    ('Lint/UnifiedInteger', 'a = Fixnum\nb = Integer\n', 'a = Integer\nb = Integer\n'),
    ('Lint/UriRegexp', "a = URI.regexp('http')\n", "a = URI::DEFAULT_PARSER.make_regexp('http')\n"),
    ('Lint/AmbiguousRange', 'a = (b || 1..2)\nc = (1..2)\n', 'a = ((b || 1)..2)\nc = (1..2)\n'),
    ('Security/IoMethods', "IO.read(path)\nFile.read(path)\nIO.read('| ls')\n", "File.read(path)\nFile.read(path)\nIO.read('| ls')\n"),
    ('Security/JSONLoad', 'JSON.load(a)\n::JSON.restore(a)\nJSON.parse(a)\n', 'JSON.parse(a)\n::JSON.parse(a)\nJSON.parse(a)\n'),
    ('Security/YAMLLoad', 'YAML.load(a)\nYAML.safe_load(a)\n', 'YAML.safe_load(a)\nYAML.safe_load(a)\n'),
    ('Style/AndOr', 'p 1 if a and b\np 1 if a or b\nx = a && b\n', 'p 1 if a && b\np 1 if a || b\nx = a && b\n'),
    ('Style/ArrayFirstLast', 'a = b[0]\nc = b[-1]\nd = b[1]\n', 'a = b.first\nc = b.last\nd = b[1]\n'),
    ('Style/ArrayIntersectWithSingleElement', 'a.intersect?([b])\na.intersect?([b, c])\n', 'a.include?(b)\na.intersect?([b, c])\n'),
    ('Style/ArrayJoin', "%w[a b] * ','\n%w[a b] * 2\n", "%w[a b].join(',')\n%w[a b] * 2\n"),
    ('Style/Attr', 'class A\n  attr :x\n  attr_reader :y\nend\n', 'class A\n  attr_reader :x\n  attr_reader :y\nend\n'),
    ('Style/BarePercentLiterals', 'a = %Q(x "y" #{z})\nb = %(x)\n', 'a = %(x "y" #{z})\nb = %(x)\n'),
    ('Style/BlockComments', 'a = 1\n=begin\ntext\n=end\nb = 2\n', 'a = 1\n# text\nb = 2\n'),
    ('Style/CaseEquality', 'A === b\na == b\n', 'b.is_a?(A)\na == b\n'),
    ('Style/CharacterLiteral', "a = ?x\nb = 'x'\nc = a ? 1 : 2\n", "a = 'x'\nb = 'x'\nc = a ? 1 : 2\n"),
    ('Style/ClassCheck', 'a.kind_of?(B)\na.is_a?(B)\n', 'a.is_a?(B)\na.is_a?(B)\n'),
    ('Style/ClassEqualityComparison', 'a.class == B\na.instance_of?(B)\n', 'a.instance_of?(B)\na.instance_of?(B)\n'),
    ('Style/ClassMethods', 'class A\n  def A.b\n    1\n  end\n\n  def self.c\n    1\n  end\nend\n', 'class A\n  def self.b\n    1\n  end\n\n  def self.c\n    1\n  end\nend\n'),
    ('Style/CollectionMethods', 'a.collect { |x| x + 1 }\na.detect { |x| x }\na.map { |x| x }\n', 'a.map { |x| x + 1 }\na.find { |x| x }\na.map { |x| x }\n'),
    ('Style/ColonMethodCall', 'a::b\nA::B\nA.c\n', 'a.b\nA::B\nA.c\n'),
    ('Style/ColonMethodDefinition', 'class A\n  def self::b\n    1\n  end\nend\n', 'class A\n  def self.b\n    1\n  end\nend\n'),
    ('Style/CommentedKeyword', 'def m # why\n  1 # fine\nend\n\nclass A # :nodoc:\nend\n', '# why\ndef m\n  1 # fine\nend\n\nclass A # :nodoc:\nend\n'),
    ('Style/ConcatArrayLiterals', 'a.concat([1, 2], [3])\na.concat(b)\n', 'a.push(1, 2, 3)\na.concat(b)\n'),
    ('Style/DefWithParentheses', 'def a()\n  1\nend\n\ndef b\n  1\nend\n', 'def a\n  1\nend\n\ndef b\n  1\nend\n'),
    ('Style/Dir', 'a = File.expand_path(File.dirname(__FILE__))\nb = __dir__\n', 'a = __dir__\nb = __dir__\n'),
    ('Style/DoubleNegation', 'a = !!b\nc = !d\n', 'a = !b.nil?\nc = !d\n'),
    ('Style/EachForSimpleLoop', '(0...5).each { p 1 }\n(0...5).each { |i| p i }\n', '5.times { p 1 }\n(0...5).each { |i| p i }\n'),
    ('Style/EmptyCaseCondition', 'case\nwhen a\n  1\nend\ncase b\nwhen c\n  1\nend\n', 'if a\n  1\nend\ncase b\nwhen c\n  1\nend\n'),
    ('Style/EmptyLambdaParameter', 'a = ->() { 1 }\nb = ->(x) { x }\n', 'a = -> { 1 }\nb = ->(x) { x }\n'),
    ('Style/EmptyLiteral', 'a = Array.new\nb = Hash.new\nc = Array.new(3)\n', 'a = []\nb = {}\nc = Array.new(3)\n'),
    ('Style/EmptyMethod', 'def a(b)\nend\n\ndef c; end\n', 'def a(b); end\n\ndef c; end\n'),
    ('Style/EndBlock', 'END { a }\n', 'at_exit { a }\n'),
    ('Style/EnvHome', "a = ENV['HOME']\nb = ENV.fetch('HOME', nil)\nc = ENV['PATH']\n", "a = Dir.home\nb = Dir.home\nc = ENV['PATH']\n"),
    ('Style/EvenOdd', 'a % 2 == 0\na % 2 == 1\na % 3 == 0\n', 'a.even?\na.odd?\na % 3 == 0\n'),
    ('Style/FetchEnvVar', "a = ENV['X']\nb = ENV.fetch('X')\np 1 if ENV['X']\n", "a = ENV.fetch('X', nil)\nb = ENV.fetch('X')\np 1 if ENV['X']\n"),
    ('Style/For', 'for a in b do\n  c\nend\n', 'b.each do |a|\n  c\nend\n'),
    ('Style/FormatString', "a = sprintf('%d', 1)\nb = '%d' % 1\nc = format('%d', 1)\n", "a = format('%d', 1)\nb = format('%d', 1)\nc = format('%d', 1)\n"),
    ('Style/GlobalStdStream', 'STDOUT.puts 1\n$stdout.puts 1\n', '$stdout.puts 1\n$stdout.puts 1\n'),
    ('Style/HashEachMethods', 'a.keys.each { |k| p k }\na.values.each { |v| p v }\na.each_key { |k| p k }\n', 'a.each_key { |k| p k }\na.each_value { |v| p v }\na.each_key { |k| p k }\n'),
    ('Style/HashSyntax', "a = { :b => 1, :c => 2 }\nd = { 'e' => 1 }\nf = { g: 1 }\n", "a = { b: 1, c: 2 }\nd = { 'e' => 1 }\nf = { g: 1 }\n"),
    ('Style/InfiniteLoop', 'while true\n  a\nend\nwhile b\n  a\nend\n', 'loop do\n  a\nend\nwhile b\n  a\nend\n'),
    ('Style/InPatternThen', 'case a\nin 1; b\nin 2 then c\nend\n', 'case a\nin 1 then b\nin 2 then c\nend\n'),
    ('Style/InverseMethods', 'p !a.any?\np a.none?\n', 'p a.none?\np a.none?\n'),
    ('Style/Lambda', 'a = lambda { |x| x }\nb = ->(x) do\n  x\nend\nc = ->(x) { x }\n', 'a = ->(x) { x }\nb = ->(x) do\n  x\nend\nc = ->(x) { x }\n'),
    ('Style/LambdaCall', 'a.(1)\na.call(1)\n', 'a.call(1)\na.call(1)\n'),
    ('Style/MapToHash', 'a.map { |x| [x, 1] }.to_h\na.to_h { |x| [x, 1] }\n', 'a.to_h { |x| [x, 1] }\na.to_h { |x| [x, 1] }\n'),
    ('Style/MapToSet', 'a.map { |x| x }.to_set\n', 'a.to_set { |x| x }\n'),
    ('Style/MethodCallWithoutArgsParentheses', 'a.b()\nc()\nd(1)\nString()\n', 'a.b\nc\nd(1)\nString()\n'),
    ('Style/MethodDefParentheses', 'def a b, c\n  1\nend\n\ndef d(e)\n  1\nend\n', 'def a(b, c)\n  1\nend\n\ndef d(e)\n  1\nend\n'),
    ('Style/MinMax', 'a = [b.min, b.max]\nc = [b.min, d.max]\n', 'a = b.minmax\nc = [b.min, d.max]\n'),
    ('Style/ModuleFunction', 'module A\n  extend self\nend\n', 'module A\n  module_function\nend\n'),
    ('Style/MultilineIfThen', 'if a then\n  b\nend\nif a then b end\n', 'if a\n  b\nend\nif a then b end\n'),
    ('Style/MultilineTernaryOperator', 'a = b ?\n  1 : 2\nc = d ? 1 : 2\n', 'a = if b\n  1\nelse\n  2\nend\nc = d ? 1 : 2\n'),
    ('Style/MutableConstant', 'A = [1]\nB = { a: 1 }\nC = [1].freeze\nD = 1\n', 'A = [1].freeze\nB = { a: 1 }.freeze\nC = [1].freeze\nD = 1\n'),
    ('Style/NegatedIf', 'p 1 if !a\nif !b\n  c\nend\np 1 if a\n', 'p 1 unless a\nunless b\n  c\nend\np 1 if a\n'),
    ('Style/NegatedUnless', 'p 1 unless !a\np 1 unless a\n', 'p 1 if a\np 1 unless a\n'),
    ('Style/NegatedWhile', 'while !a\n  b\nend\nuntil a\n  b\nend\n', 'until a\n  b\nend\nuntil a\n  b\nend\n'),
    ('Style/NilComparison', 'a == nil\na.nil?\n', 'a.nil?\na.nil?\n'),
    ('Style/NilLambda', 'a = -> { nil }\nb = -> { 1 }\n', 'a = -> {}\nb = -> { 1 }\n'),
    ('Style/NonNilCheck', 'p 1 if a != nil\np 1 if a\n', 'p 1 if !a.nil?\np 1 if a\n'),
    ('Style/Not', 'a = (not b)\nc = !b\n', 'a = (!b)\nc = !b\n'),
    ('Style/NumericLiteralPrefix', 'a = 0123\nb = 0X1F\nc = 0o17\n', 'a = 0o123\nb = 0x1F\nc = 0o17\n'),
    ('Style/NumericLiterals', "a = 123456\nb = 123_456\nc = 1234\nd = '123456' # 123456\n", "a = 123_456\nb = 123_456\nc = 1234\nd = '123456' # 123456\n"),
    ('Style/NumericPredicate', 'a == 0\n0 < a\n(a + 1) > 0\na == 1\n', 'a.zero?\na.positive?\n(a + 1).positive?\na == 1\n'),
    ('Style/ObjectThen', 'a.yield_self { |x| x }\na.then { |x| x }\n', 'a.then { |x| x }\na.then { |x| x }\n'),
    ('Style/OrAssignment', 'a = a ? a : 1\na ||= 1\n', 'a ||= 1\na ||= 1\n'),
    ('Style/ParallelAssignment', 'a, b = 1, 2\na, b = b, a\nc, d = e\n', 'a = 1\nb = 2\na, b = b, a\nc, d = e\n'),
    ('Style/ParenthesesAroundCondition', 'if (a)\n  b\nend\nb while (c)\nif (d = 1)\n  b\nend\n', 'if a\n  b\nend\nb while c\nif (d = 1)\n  b\nend\n'),
    ('Style/PercentLiteralDelimiters', 'a = %w(x y)\nb = %w[x y]\nc = %q{x}\n', 'a = %w[x y]\nb = %w[x y]\nc = %q(x)\n'),
    ('Style/PercentQLiterals', 'a = %Q(x)\nb = %Q(x#{y})\n', 'a = %q(x)\nb = %Q(x#{y})\n'),
    ('Style/PerlBackrefs', 'a =~ /(x)/\np $1\nclass A\n  p $&\nend\n', 'a =~ /(x)/\np Regexp.last_match(1)\nclass A\n  p ::Regexp.last_match(0)\nend\n'),
    ('Style/PreferredHashMethods', 'a.has_key?(1)\na.key?(1)\n', 'a.key?(1)\na.key?(1)\n'),
    ('Style/Proc', 'a = Proc.new { 1 }\nb = proc { 1 }\n', 'a = proc { 1 }\nb = proc { 1 }\n'),
    ('Style/RaiseArgs', "raise A.new('x')\nraise A, 'x'\n", "raise A, 'x'\nraise A, 'x'\n"),
    ('Style/RedundantArrayConstructor', 'a = Array.new([1, 2])\nb = [1, 2]\n', 'a = [1, 2]\nb = [1, 2]\n'),
    ('Style/RedundantArrayFlatten', 'a.flatten.join\na.flatten(2, 3).first\n', 'a.join\na.flatten(2, 3).first\n'),
    ('Style/RedundantCapitalW', 'a = %W[x y]\nb = %W[x #{y}]\n', 'a = %w[x y]\nb = %W[x #{y}]\n'),
    ('Style/RedundantConditional', 'a = b == c ? true : false\nd = b == c ? false : true\n', 'a = b == c\nd = !(b == c)\n'),
    ('Style/RedundantCurrentDirectoryInPath', "require_relative './a'\nrequire_relative 'a'\n", "require_relative 'a'\nrequire_relative 'a'\n"),
    ('Style/RedundantException', "raise RuntimeError, 'x'\nraise 'x'\nraise RuntimeError.new('x')\n", "raise 'x'\nraise 'x'\nraise 'x'\n"),
    ('Style/RedundantFetchBlock', 'a.fetch(:b) { 1 }\na.fetch(:b) { c }\n', 'a.fetch(:b, 1)\na.fetch(:b) { c }\n'),
    ('Style/RedundantFileExtensionInRequire', "require 'a.rb'\nrequire 'a'\n", "require 'a'\nrequire 'a'\n"),
    ('Style/RedundantFreeze', "A = 1.freeze\nB = :a.freeze\nC = 'a'.freeze\n", "A = 1\nB = :a\nC = 'a'.freeze\n"),
    ('Style/RedundantInterpolation', 'a = "#{b}"\nc = "x#{b}"\n', 'a = b.to_s\nc = "x#{b}"\n'),
    ('Style/RedundantReturn', 'def a\n  b\n  return c\nend\n\ndef d\n  return 1, 2\nend\n', 'def a\n  b\n  c\nend\n\ndef d\n  [1, 2]\nend\n'),
    ('Style/RedundantSort', 'a.sort.first\na.min\n', 'a.min\na.min\n'),
    ('Style/RedundantSortBy', 'a.sort_by { |x| x }\na.sort_by { |x| -x }\n', 'a.sort\na.sort_by { |x| -x }\n'),
    ('Style/RegexpLiteral', 'a = %r{x}\nb = %r{x/y}\nc = /x/\n', 'a = /x/\nb = %r{x/y}\nc = /x/\n'),
    ('Style/RescueModifier', 'a rescue nil\n', 'begin\n  a\nrescue\n  nil\nend\n'),
    ('Style/RescueStandardError', 'begin\n  a\nrescue\n  b\nend\nbegin\n  a\nrescue StandardError\n  b\nend\n', 'begin\n  a\nrescue StandardError\n  b\nend\nbegin\n  a\nrescue StandardError\n  b\nend\n'),
    ('Style/ReturnNil', 'def a\n  return nil if b\n  return if c\nend\n', 'def a\n  return if b\n  return if c\nend\n'),
    ('Style/Sample', 'a.shuffle.first\na.sample\n', 'a.sample\na.sample\n'),
    ('Style/SelfAssignment', 'a = 1\na = a + 1\n@b = @b || 2\na = b + 1\n', 'a = 1\na += 1\n@b ||= 2\na = b + 1\n'),
    ('Style/SignalException', "fail 'x'\nraise 'x'\n", "raise 'x'\nraise 'x'\n"),
    ('Style/SingleArgumentDig', 'a.dig(:b)\na.dig(:b, :c)\n', 'a[:b]\na.dig(:b, :c)\n'),
    ('Style/SlicingWithRange', 'a[1..-1]\na[1..]\n', 'a[1..]\na[1..]\n'),
    ('Style/SpecialGlobalVars', 'p $!\np $0\n', 'p $ERROR_INFO\np $PROGRAM_NAME\n'),
    ('Style/StabbyLambdaParentheses', 'a = ->x { x }\nb = ->(x) { x }\n', 'a = ->(x) { x }\nb = ->(x) { x }\n'),
    ('Style/StderrPuts', "$stderr.puts 'x'\nwarn 'x'\n", "warn 'x'\nwarn 'x'\n"),
    ('Style/StringChars', "a.split('')\na.split(//)\na.chars\n", 'a.chars\na.chars\na.chars\n'),
    ('Style/StringHashKeys', "a = { 'b' => 1 }\nc = { d: 1 }\n", 'a = { :b => 1 }\nc = { d: 1 }\n'),
    ('Style/StringLiterals', 'a = "x"\nb = "x\\n"\nc = "it\'s"\nd = <<~T\n  "x"\nT\n', 'a = \'x\'\nb = "x\\n"\nc = "it\'s"\nd = <<~T\n  "x"\nT\n'),
    ('Style/StringMethods', 'a.intern\na.to_sym\n', 'a.to_sym\na.to_sym\n'),
    ('Style/Strip', 'a.lstrip.rstrip\na.strip\n', 'a.strip\na.strip\n'),
    ('Style/SuperWithArgsParentheses', 'def a(b)\n  super b\nend\n', 'def a(b)\n  super(b)\nend\n'),
    ('Style/SymbolArray', 'a = [:b, :c]\nd = %i[b c]\n', 'a = %i[b c]\nd = %i[b c]\n'),
    ('Style/SymbolLiteral', 'a = :"b"\nc = :"d e"\n', 'a = :b\nc = :"d e"\n'),
    ('Style/SymbolProc', 'a.map { |x| x.b }\na.map(&:b)\n', 'a.map(&:b)\na.map(&:b)\n'),
    ('Style/TernaryParentheses', 'a = (b) ? 1 : 2\nc = b ? 1 : 2\n', 'a = b ? 1 : 2\nc = b ? 1 : 2\n'),
    ('Style/TrailingCommaInArrayLiteral', 'a = [1, 2,]\nb = [1, 2]\n', 'a = [1, 2]\nb = [1, 2]\n'),
    ('Style/TrailingCommaInHashLiteral', 'a = { b: 1, }\nc = { b: 1 }\n', 'a = { b: 1 }\nc = { b: 1 }\n'),
    ('Style/TrailingCommaInArguments', 'a(1, 2,)\na(1, 2)\n', 'a(1, 2)\na(1, 2)\n'),
    ('Style/TrivialAccessors', 'class A\n  def b\n    @b\n  end\n\n  def c=(v)\n    @c = v\n  end\nend\n', 'class A\n  attr_reader :b\n\n  attr_writer :c\nend\n'),
    ('Style/UnlessElse', 'unless a\n  b\nelse\n  c\nend\nunless a\n  b\nend\n', 'if a\n  c\nelse\n  b\nend\nunless a\n  b\nend\n'),
    ('Style/UnpackFirst', "a.unpack('h').first\na.unpack1('h')\n", "a.unpack1('h')\na.unpack1('h')\n"),
    ('Style/VariableInterpolation', 'a = "x#@b"\nc = "x#{@b}"\n', 'a = "x#{@b}"\nc = "x#{@b}"\n'),
    ('Style/WhenThen', 'case a\nwhen 1; b\nwhen 2 then c\nend\n', 'case a\nwhen 1 then b\nwhen 2 then c\nend\n'),
    ('Style/WhileUntilDo', 'while a do\n  b\nend\nwhile a\n  b\nend\n', 'while a\n  b\nend\nwhile a\n  b\nend\n'),
    ('Style/WordArray', "a = ['b', 'c']\nd = ['e f', 'g']\nh = %w[i j]\n", "a = %w[b c]\nd = ['e f', 'g']\nh = %w[i j]\n"),
    ('Style/YodaCondition', 'p 1 if 1 == a\np 1 if a == 1\n', 'p 1 if a == 1\np 1 if a == 1\n'),
    ('Style/ZeroLengthPredicate', 'a.size == 0\na.length > 0\na.empty?\n', 'a.empty?\n!a.empty?\na.empty?\n'),
    ('Naming/HeredocDelimiterCase', 'a = <<~text\n  x\ntext\n', 'a = <<~TEXT\n  x\nTEXT\n'),
    ('Bundler/InsecureProtocolSource', "source :gemcutter\nsource 'https://rubygems.org'\n", "source 'https://rubygems.org'\nsource 'https://rubygems.org'\n", 'Gemfile'),
    ('Gemspec/AddRuntimeDependency', "Gem::Specification.new do |spec|\n  spec.add_runtime_dependency('a')\n  spec.add_dependency('b')\nend\n", "Gem::Specification.new do |spec|\n  spec.add_dependency('a')\n  spec.add_dependency('b')\nend\n", 'a.gemspec'),
    ('Gemspec/DeprecatedAttributeAssignment', "Gem::Specification.new do |spec|\n  spec.test_files = []\n  spec.name = 'a'\nend\n", "Gem::Specification.new do |spec|\n  spec.name = 'a'\nend\n", 'a.gemspec'),
    ('Lint/RedundantWithObject', 'a.each_with_object([]) { |v| p v }\na.each_with_object([]) { |v, o| o << v }\n', 'a.each { |v| p v }\na.each_with_object([]) { |v, o| o << v }\n'),
    ('Lint/TrailingCommaInAttributeDeclaration', 'class A\n  attr_reader :b,\n\n  def c\n    1\n  end\nend\n', 'class A\n  attr_reader :b\n\n  def c\n    1\n  end\nend\n'),
    ('Style/BitwisePredicate', '(a & b) != 0\n(a & b) == c\n', 'a.anybits?(b)\n(a & b) == c\n'),
    ('Style/CommandLiteral', 'a = %x(ls)\nb = `ls`\n', 'a = `ls`\nb = `ls`\n'),
    ('Style/IfUnlessModifierOfIfUnless', 'if a\n  b\nend unless c\n', 'unless c\nif a\n  b\nend\nend\n'),
    ('Layout/EmptyLinesAroundMethodBody', 'def a\n\n  b\n\nend\n\ndef c\n  d\nend\n', 'def a\n  b\nend\n\ndef c\n  d\nend\n'),
    ('Layout/EmptyLinesAroundClassBody', 'class A < B\n\n  c\nend\n\nclass D\n  e\nend\n', 'class A < B\n  c\nend\n\nclass D\n  e\nend\n'),
    ('Layout/EmptyLinesAroundModuleBody', 'module A\n  b\n\nend\n', 'module A\n  b\nend\n'),
    ('Layout/EmptyLinesAroundBlockBody', 'a.each do |b|\n\n  c\nend\n', 'a.each do |b|\n  c\nend\n'),
    ('Layout/EmptyLinesAroundBeginBody', 'begin\n\n  a\nrescue B\n  c\nend\n', 'begin\n  a\nrescue B\n  c\nend\n'),
    ('Layout/DefEndAlignment', 'class A\n  def b\n    c\n    end\nend\n', 'class A\n  def b\n    c\n  end\nend\n'),
    ('Layout/EndAlignment', 'if a\n  b\n  end\nmodule C\n  d\nend\n', 'if a\n  b\nend\nmodule C\n  d\nend\n'),
    ('Layout/BeginEndAlignment', 'begin\n  a\n  end\n', 'begin\n  a\nend\n'),
    ('Layout/AccessModifierIndentation', 'class A\nprivate\n\n  def b\n    1\n  end\nend\n', 'class A\n  private\n\n  def b\n    1\n  end\nend\n'),
    ('Layout/BlockEndNewline', 'a do\n  b end\nc do\n  d\nend\n', 'a do\n  b\nend\nc do\n  d\nend\n'),
    ('Layout/CaseIndentation', 'case a\n  when 1\n  b\nend\ncase c\nwhen 1\n  d\nend\n', 'case a\nwhen 1\n  b\nend\ncase c\nwhen 1\n  d\nend\n'),
    ('Layout/ConditionPosition', 'if\n  a\n  b\nend\nif c\n  d\nend\n', 'if a\n  b\nend\nif c\n  d\nend\n'),
    ('Layout/DotPosition', 'a.\n  b\nc\n  .d\n', 'a\n  .b\nc\n  .d\n'),
    ('Layout/ElseAlignment', 'if a\n  b\n  else\n  c\nend\n', 'if a\n  b\nelse\n  c\nend\n'),
    ('Layout/EmptyComment', 'a\n#\nb\n# c\n#\n# d\n', 'a\nb\n# c\n#\n# d\n'),
    ('Layout/EmptyLineAfterGuardClause', 'def a\n  return if b\n  c\nend\n\ndef d\n  return if e\n\n  f\nend\n', 'def a\n  return if b\n\n  c\nend\n\ndef d\n  return if e\n\n  f\nend\n'),
    ('Layout/EmptyLineAfterMultilineCondition', 'if a &&\n   b\n  c\nend\n', 'if a &&\n   b\n\n  c\nend\n'),
    ('Layout/EmptyLineBetweenDefs', 'class A\n  def b\n    1\n  end\n  def c\n    1\n  end\n\n  def d\n    1\n  end\nend\n', 'class A\n  def b\n    1\n  end\n\n  def c\n    1\n  end\n\n  def d\n    1\n  end\nend\n'),
    ('Layout/EmptyLinesAfterModuleInclusion', 'class A\n  include B\n  c\nend\n', 'class A\n  include B\n\n  c\nend\n'),
    ('Layout/EmptyLinesAroundAccessModifier', 'class A\n  b\n\n  private\n  def c\n    1\n  end\nend\n', 'class A\n  b\n\n  private\n\n  def c\n    1\n  end\nend\n'),
    ('Layout/EmptyLinesAroundAttributeAccessor', 'class A\n  attr_reader :b\n  def c\n    1\n  end\nend\n', 'class A\n  attr_reader :b\n\n  def c\n    1\n  end\nend\n'),
    ('Layout/EmptyLinesAroundExceptionHandlingKeywords', 'begin\n  a\n\nrescue B\n  c\nend\n', 'begin\n  a\nrescue B\n  c\nend\n'),
    ('Layout/ExtraSpacing', "a =  1\n\nbc  = 2\nd   = 3\ne = 'x  y' # z\n", "a = 1\n\nbc  = 2\nd   = 3\ne = 'x  y' # z\n"),
    ('Layout/LeadingCommentSpace', '#!/usr/bin/env ruby\n#a\n# b\n#: c\n', '#!/usr/bin/env ruby\n# a\n# b\n#: c\n'),
    ('Layout/LineContinuationSpacing', 'a = b\\\n  + 1\nc = d \\\n  + 1\n', 'a = b \\\n  + 1\nc = d \\\n  + 1\n'),
    ('Layout/MultilineArrayLineBreaks', 'a = [\n  1, 2,\n  3\n]\n', 'a = [\n  1, \n2,\n  3\n]\n'),
    ('Layout/MultilineMethodArgumentLineBreaks', 'a(b, c,\n  d: 1)\ne(f,\n  g)\n', 'a(b, \nc,\n  d: 1)\ne(f,\n  g)\n'),
    ('Layout/MultilineMethodParameterLineBreaks', 'def a(b, c,\n      d)\n  1\nend\n', 'def a(b, \nc,\n      d)\n  1\nend\n'),
    ('Layout/MultilineMethodDefinitionBraceLayout', 'def a(b,\n      c\n)\n  1\nend\n', 'def a(b,\n      c)\n  1\nend\n'),
    ('Layout/ParameterAlignment', 'def a(b,\n  c)\n  1\nend\n', 'def a(b,\n      c)\n  1\nend\n'),
    ('Layout/RescueEnsureAlignment', 'begin\n  a\n  rescue B\n  c\nend\n', 'begin\n  a\nrescue B\n  c\nend\n'),
    ('Layout/SpaceAfterColon', 'a = { b:1, c: 2 }\ndef d(e:1)\n  e\nend\n', 'a = { b: 1, c: 2 }\ndef d(e: 1)\n  e\nend\n'),
    ('Layout/SpaceAfterMethodName', 'def a (b)\n  b\nend\n', 'def a(b)\n  b\nend\n'),
    ('Layout/SpaceAroundEqualsInParameterDefault', 'def a(b=1, c = 2)\n  b + c\nend\n', 'def a(b = 1, c = 2)\n  b + c\nend\n'),
    ('Layout/SpaceAroundKeyword', 'a if(b)\nwhile(c)\n  d\nend\ne.if(1)\n', 'a if (b)\nwhile (c)\n  d\nend\ne.if(1)\n'),
    ('Layout/SpaceAroundMethodCallOperator', 'a .b\nc.d\n', 'a.b\nc.d\n'),
    ('Layout/SpaceAroundOperators', 'a = b+c\nd=1\ne = f &&g\nh = i ** j\nk = i**j\n', 'a = b + c\nd = 1\ne = f && g\nh = i ** j\nk = i**j\n'),
    ('Layout/SpaceBeforeBlockBraces', 'a.b{ c }\na.b { c }\n', 'a.b { c }\na.b { c }\n'),
    ('Layout/SpaceBeforeFirstArg', 'a  b\nc d\n', 'a b\nc d\n'),
    ('Layout/SpaceInLambdaLiteral', 'a = -> (b) { b }\nc = ->(d) { d }\n', 'a = ->(b) { b }\nc = ->(d) { d }\n'),
    ('Layout/SpaceInsideArrayLiteralBrackets', 'a = [ 1, 2 ]\nb = [1, 2]\nc = [\n  1\n]\n', 'a = [1, 2]\nb = [1, 2]\nc = [\n  1\n]\n'),
    ('Layout/SpaceInsideArrayPercentLiteral', 'a = %w[b  c d]\n', 'a = %w[b c d]\n'),
    ('Layout/SpaceInsideBlockBraces', 'a {b }\na { b}\na {|b| b }\na { }\na { b }\na {}\n', 'a { b }\na { b }\na { |b| b }\na {}\na { b }\na {}\n'),
    ('Layout/SpaceInsideParens', 'a = (  b + c )\nd( e)\nf(g)\n', 'a = (b + c)\nd(e)\nf(g)\n'),
    ('Layout/SpaceInsidePercentLiteralDelimiters', 'a = %w[ b c ]\nd = %w[b c]\n', 'a = %w[b c]\nd = %w[b c]\n'),
    ('Layout/SpaceInsideRangeLiteral', 'a = 1 .. 2\nb = 1..2\n', 'a = 1..2\nb = 1..2\n'),
    ('Layout/SpaceInsideReferenceBrackets', 'a[ 1 ]\nb[1]\n', 'a[1]\nb[1]\n'),
    ('Layout/SpaceInsideStringInterpolation', 'a = "#{ b }"\nc = "#{d}"\n', 'a = "#{b}"\nc = "#{d}"\n'),
    ('Layout/EmptyLineAfterMagicComment', '# frozen_string_literal: true\na\n', '# frozen_string_literal: true\n\na\n'),
    ('Lint/AmbiguousBlockAssociation', 'a b { |c| c }\na(b { |c| c })\n', 'a(b { |c| c })\na(b { |c| c })\n'),
    ('Lint/AmbiguousOperator', 'a *b\na &b\na -1\na(*b)\na - 1\n', 'a(*b)\na(&b)\na(-1)\na(*b)\na - 1\n'),
    ('Lint/AmbiguousOperatorPrecedence', 'a + b * c\nd || e && f\ng + (h * i)\nj + k - l\n', 'a + (b * c)\nd || (e && f)\ng + (h * i)\nj + k - l\n'),
    ('Lint/ConstantOverwrittenInRescue', 'begin\n  a\nrescue => StandardError\n  b\nend\n', 'begin\n  a\nrescue StandardError\n  b\nend\n'),
    ('Lint/DeprecatedConstants', 'a = NIL\nb = nil\nc = X::TRUE\n', 'a = nil\nb = nil\nc = X::TRUE\n'),
    ('Lint/DeprecatedOpenSSLConstant', "OpenSSL::Digest::SHA256.new\nOpenSSL::Digest.new('SHA256')\n", "OpenSSL::Digest.new('SHA256')\nOpenSSL::Digest.new('SHA256')\n"),
    ('Lint/DisjunctiveAssignmentInConstructor', 'class A\n  def initialize\n    @b ||= 1\n    c\n    @d ||= 2\n  end\nend\n', 'class A\n  def initialize\n    @b = 1\n    c\n    @d ||= 2\n  end\nend\n'),
    ('Lint/DuplicateRequire', "require 'a'\nrequire 'b'\nrequire 'a'\n", "require 'a'\nrequire 'b'\n"),
    ('Lint/HashNewWithKeywordArgumentsAsDefault', 'a = Hash.new(b: 1)\nc = Hash.new({ b: 1 })\n', 'a = Hash.new({b: 1})\nc = Hash.new({ b: 1 })\n'),
    ('Lint/LambdaWithoutLiteralBlock', 'lambda(&a)\nlambda { 1 }\n', 'a\nlambda { 1 }\n'),
    ('Lint/NonDeterministicRequireOrder', "Dir['*.rb'].each { |a| require a }\nDir['*.rb'].sort.each { |a| require a }\n", "Dir['*.rb'].sort.each { |a| require a }\nDir['*.rb'].sort.each { |a| require a }\n"),
    ('Lint/NumericOperationWithConstantResult', 'a * 0\na * 2\n', '0\na * 2\n'),
    ('Lint/RedundantSafeNavigation', 'A&.b\nc&.d\n', 'A.b\nc&.d\n'),
    ('Lint/RedundantSplatExpansion', 'a(*[1, 2])\na(*b)\n', 'a(1, 2)\na(*b)\n'),
    ('Lint/RedundantTypeConversion', "'a'.to_s\nb.to_s.to_s\nb.to_i\n", "'a'\nb.to_s\nb.to_i\n"),
    ('Lint/RequireRelativeSelfPath', "require_relative 'a'\nrequire_relative 'b'\n", "require_relative 'b'\n"),
    ('Lint/TripleQuotes', 'a = """b"""\nc = "d"\n', 'a = "b"\nc = "d"\n'),
    ('Lint/UnescapedBracketInRegexp', 'a = /b]/\nc = /[d]/\n', 'a = /b\\]/\nc = /[d]/\n'),
    ('Lint/UnusedBlockArgument', 'a { |b| c }\nd { |e, f| e }\ng { |_h| i }\nj { |k| k }\n', 'a { |_b| c }\nd { |e, _f| e }\ng { |_h| i }\nj { |k| k }\n'),
    ('Lint/UselessAccessModifier', 'class A\n  def b\n    1\n  end\n\n  private\nend\n', 'class A\n  def b\n    1\n  end\n\nend\n'),
    ('Lint/UselessDefaultValueArgument', 'a.fetch(:b, c) { d }\na.fetch(:b) { d }\n', 'a.fetch(:b) { d }\na.fetch(:b) { d }\n'),
    ('Lint/UselessMethodDefinition', 'class A\n  def b\n    super\n  end\n\n  def c\n    super\n    1\n  end\nend\n', 'class A\n\n  def c\n    super\n    1\n  end\nend\n'),
    ('Lint/UselessNumericOperation', 'p a + 0\np a * 1\np a + 1\n', 'p a\np a\np a + 1\n'),
    ('Lint/UselessOr', 'a = b.to_s || c\nd = b || c\n', 'a = b.to_s\nd = b || c\n'),
    ('Bundler/OrderedGems', "gem 'b'\ngem 'a'\n\ngem '0'\n", "gem 'a'\ngem 'b'\n\ngem '0'\n", 'Gemfile'),
    ('Gemspec/OrderedDependencies', "Gem::Specification.new do |spec|\n  spec.add_dependency 'b'\n  spec.add_dependency 'a'\nend\n", "Gem::Specification.new do |spec|\n  spec.add_dependency 'a'\n  spec.add_dependency 'b'\nend\n", 'a.gemspec'),
    ('Style/Alias', 'class A\n  alias_method :b, :c\n  alias d e\nend\n', 'class A\n  alias b c\n  alias d e\nend\n'),
    ('Style/ArrayCoercion', 'a = [*b]\nc = [*b, 1]\n', 'a = Array(b)\nc = [*b, 1]\n'),
    ('Style/CollectionCompact', 'a.reject(&:nil?)\na.compact\n', 'a.compact\na.compact\n'),
    ('Style/CollectionQuerying', 'a.count.positive?\na.count.zero?\na.count == 1\na.count(1) == 1\n', 'a.any?\na.none?\na.one?\na.count(1) == 1\n'),
    ('Style/ComparableBetween', 'p a >= 1 && a <= 9\np a >= 1 && b <= 9\n', 'p a.between?(1, 9)\np a >= 1 && b <= 9\n'),
    ('Style/DigChain', 'a.dig(:b).dig(:c)\na.dig(:b, :c)\n', 'a.dig(:b, :c)\na.dig(:b, :c)\n'),
    ('Style/ExactRegexpMatch', 'p a =~ /\\Abc\\z/\np a =~ /bc/\n', "p a == 'bc'\np a =~ /bc/\n"),
    ('Style/FileEmpty', "File.zero?('a')\nFile.empty?('a')\n", "File.empty?('a')\nFile.empty?('a')\n"),
    ('Style/FileNull', "a = '/dev/null'\nb = '/dev/tty'\n", "a = File::NULL\nb = '/dev/tty'\n"),
    ('Style/FileRead', "File.open('a').read\nFile.read('a')\n", "File.read('a')\nFile.read('a')\n"),
    ('Style/FileWrite', "File.open('a', 'w').write(b)\nFile.write('a', b)\n", "File.write('a', b)\nFile.write('a', b)\n"),
    ('Style/FileTouch', "File.open('a', 'a') {}\nFile.open('a', 'a') { |f| f.write(1) }\n", "FileUtils.touch('a')\nFile.open('a', 'a') { |f| f.write(1) }\n"),
    ('Style/FloatDivision', 'p a.to_f / b.to_f\np a.to_f / b\n', 'p a.to_f / b\np a.to_f / b\n'),
    ('Style/HashAsLastArrayItem', 'a = [1, b: 2]\nc = [1, { b: 2 }]\n', 'a = [1, { b: 2 }]\nc = [1, { b: 2 }]\n'),
    ('Style/HashConversion', 'Hash[a]\nHash[1, 2]\na.to_h\n', 'a.to_h\n{1 => 2}\na.to_h\n'),
    ('Style/IfUnlessModifier', 'if a\n  b\nend\nif c\n  d\nelse\n  e\nend\n', 'b if a\nif c\n  d\nelse\n  e\nend\n'),
    ('Style/IfWithBooleanLiteralBranches', 'if a == b\n  true\nelse\n  false\nend\nif a\n  true\nelse\n  false\nend\n', 'a == b\nif a\n  true\nelse\n  false\nend\n'),
    ('Style/IfWithSemicolon', 'if a; b else c end\nif a then b else c end\n', 'a ? b : c\nif a then b else c end\n'),
    ('Style/KeywordArgumentsMerging', 'a(**b.merge(c: 1))\na(**b, c: 1)\n', 'a(**b, c: 1)\na(**b, c: 1)\n'),
    ('Style/MapJoin', 'a.map(&:to_s).join\na.join\n', 'a.join\na.join\n'),
    ('Style/MethodCallWithArgsParentheses', 'def a\n  b 1\n  c(1)\nend\nd 2\n', 'def a\n  b(1)\n  c(1)\nend\nd 2\n'),
    ('Style/MinMaxComparison', 'a = b > c ? b : c\nd = b < c ? b : c\n', 'a = [b, c].max\nd = [b, c].min\n'),
    ('Style/MixinGrouping', 'class A\n  include B, C\n  include D\nend\n', 'class A\n  include C\n  include B\n  include D\nend\n'),
    ('Style/MultipleComparison', 'a = 1\np a == 1 || a == 2\np a == 1 || b == 2\n', 'a = 1\np [1, 2].include?(a)\np a == 1 || b == 2\n'),
    ('Style/NegativeArrayIndex', 'a[a.length - 2]\na[b.length - 2]\n', 'a[-2]\na[b.length - 2]\n'),
    ('Style/NestedParenthesizedCalls', 'a(b c)\na(b(c))\n', 'a(b(c))\na(b(c))\n'),
    ('Style/OperatorMethodCall', 'a.+ b\na + b\n', 'a + b\na + b\n'),
    ('Style/QuotedSymbols', 'a = :"b c"\nd = :\'e f\'\n', "a = :'b c'\nd = :'e f'\n"),
    ('Style/RedundantArgument', "a.join('')\na.join(',')\nb.split(' ')\n", "a.join\na.join(',')\nb.split\n"),
    ('Style/RedundantCondition', 'if a\n  a\nelse\n  b\nend\n', 'a || b\n'),
    ('Style/RedundantConstantBase', 'a = ::B\nmodule C\n  d = ::B\nend\n', 'a = B\nmodule C\n  d = ::B\nend\n'),
    ('Style/RedundantDoubleSplatHashBraces', 'a(**{ b: 1 })\na(**c)\n', 'a(b: 1)\na(**c)\n'),
    ('Style/RedundantEach', 'a.each.each_with_index { |b, c| p b, c }\na.each_with_index { |b, c| p b, c }\n', 'a.each_with_index { |b, c| p b, c }\na.each_with_index { |b, c| p b, c }\n'),
    ('Style/RedundantFilterChain', 'a.select { |b| b }.any?\na.any? { |b| b }\n', 'a.any? { |b| b }\na.any? { |b| b }\n'),
    ('Style/RedundantFormat', "a = format('b')\nc = format('%d', 1)\n", "a = 'b'\nc = format('%d', 1)\n"),
    ('Style/RedundantHeredocDelimiterQuotes', "a = <<~'TEXT'\n  b\nTEXT\nc = <<~'TEXT'\n  #{d}\nTEXT\n", "a = <<~TEXT\n  b\nTEXT\nc = <<~'TEXT'\n  #{d}\nTEXT\n"),
    ('Style/RedundantInitialize', 'class A\n  def initialize\n  end\nend\n\nclass B\n  def initialize\n    @c = 1\n  end\nend\n', 'class A\nend\n\nclass B\n  def initialize\n    @c = 1\n  end\nend\n'),
    ('Style/RedundantMinMaxBy', 'a.max_by { |b| b }\na.max_by { |b| -b }\n', 'a.max\na.max_by { |b| -b }\n'),
    ('Style/RedundantParentheses', 'a = (1)\nb = (c + d)\n', 'a = 1\nb = (c + d)\n'),
    ('Style/RedundantPercentQ', 'a = %q(b)\nc = %q(\'d\' "e")\n', 'a = \'b\'\nc = %q(\'d\' "e")\n'),
    ('Style/RedundantRegexpArgument', "a.gsub(/,/, '')\na.gsub(/[,;]/, '')\n", "a.gsub(',', '')\na.gsub(/[,;]/, '')\n"),
    ('Style/RedundantRegexpCharacterClass', 'a = /b[c]/\nd = /[ef]/\n', 'a = /bc/\nd = /[ef]/\n'),
    ('Style/RedundantRegexpConstructor', "a = Regexp.new(/b/)\nc = Regexp.new('d')\n", "a = /b/\nc = Regexp.new('d')\n"),
    ('Style/SelectByRegexp', 'a.select { |b| b =~ /c/ }\na.grep(/c/)\n', 'a.grep(/c/)\na.grep(/c/)\n'),
    ('Style/SendWithLiteralMethodName', 'a.public_send(:b)\na.public_send(c)\n', 'a.b\na.public_send(c)\n'),
    ('Style/TrailingBodyOnClass', 'class A; b\nend\n', 'class A\n  b\nend\n'),
    ('Style/TrailingBodyOnModule', 'module A; b\nend\n', 'module A\n  b\nend\n'),
    ('Style/TrailingCommaInBlockArgs', 'a { |b, c,| b + c }\na { |b,| b }\n', 'a { |b, c| b + c }\na { |b,| b }\n'),
    ('Style/TrailingMethodEndStatement', 'def a\n  b end\n', 'def a\n  b\nend\n'),
    ('Style/TrailingUnderscoreVariable', 'a, _ = b\n_, c = b\n', 'a, = b\n_, c = b\n'),
    ('Style/YAMLFileRead', 'YAML.load(File.read(a))\nYAML.load(b)\n', 'YAML.load_file(a)\nYAML.load(b)\n'),
    ('Style/YodaExpression', 'p 1 + a\np a + 1\n', 'p a + 1\np a + 1\n'),
    ('Layout/CommentIndentation', 'def a\n# b\n  c\n  # d\n  e\nend\n', 'def a\n  # b\n  c\n  # d\n  e\nend\n'),
    ('Lint/ParenthesesAsGroupedExpression', 'a (b)\nc(d)\n', 'a(b)\nc(d)\n'),
    ('Style/CommentAnnotation', '# todo: a\n# TODO: b\n# FIXME c\n# Note that d\n', '# TODO: a\n# TODO: b\n# FIXME: c\n# Note that d\n'),
    ('Style/DirEmpty', "Dir.children('a').empty?\nDir.empty?('a')\n", "Dir.empty?('a')\nDir.empty?('a')\n"),
    ('Style/EmptyHeredoc', "a = <<~TEXT\nTEXT\nb = ''\n", "a = ''\nb = ''\n"),
    ('Style/Encoding', '# encoding: utf-8\na\n', 'a\n'),
    ('Style/InvertibleUnlessCondition', 'p 1 unless a != b\np 1 unless c.zero?\np 1 unless d\n', 'p 1 if a == b\np 1 if c.nonzero?\np 1 unless d\n'),
    ('Style/LineEndConcatenation', "a = 'b' +\n    'c'\nd = 'e' + f\n", "a = 'b' \\\n    'c'\nd = 'e' + f\n"),
    ('Style/ModuleMemberExistenceCheck', 'A.instance_methods.include?(:b)\nA.method_defined?(:b)\n', 'A.method_defined?(:b)\nA.method_defined?(:b)\n'),
    ('Style/MultilineIfModifier', 'c(\n  {\n  a: 1\n  }\n) if b\n', 'if b\n  c(\n  {\n  a: 1\n  }\n)\nend\n'),
    ('Style/MultilineWhenThen', 'case a\nwhen 1 then\n  b\nwhen 2 then c\nend\n', 'case a\nwhen 1\n  b\nwhen 2 then c\nend\n'),
    ('Style/MultilineInPatternThen', 'case a\nin 1 then\n  b\nin 2 then c\nend\n', 'case a\nin 1\n  b\nin 2 then c\nend\n'),
    ('Style/NegatedIfElseCondition', 'a = !b ? 1 : 2\nif c\n  1\nelse\n  2\nend\n', 'a = b ? 2 : 1\nif c\n  1\nelse\n  2\nend\n'),
    ('Style/OneLineConditional', 'if a then b else c end\na ? b : c\n', 'a ? b : c\na ? b : c\n'),
    ('Style/PredicateWithKind', 'a.any? { |b| b.is_a?(C) }\na.any?(C)\n', 'a.any?(C)\na.any?(C)\n'),
    ('Style/RedundantAssignment', 'def a\n  b = c\n  b\nend\n', 'def a\n  c\nend\n'),
    ('Style/RedundantSelfAssignment', 'a = []\na = a.concat(b)\na = b.concat(a)\n', 'a = []\na.concat(b)\na = b.concat(a)\n'),
    ('Style/RequireOrder', "require 'b'\nrequire 'a'\n\nrequire '0'\n", "require 'a'\nrequire 'b'\n\nrequire '0'\n"),
    ('Style/ReturnNilInPredicateMethodDefinition', 'def a?\n  return if b\n\n  true\nend\n', 'def a?\n  return false if b\n\n  true\nend\n'),
    ('Style/SingleLineDoEndBlock', 'a do |b| c(b) end\nd { |e| f(e) }\n', 'a do |b|\n  c(b)\nend\nd { |e| f(e) }\n'),
    ('Style/SingleLineMethods', 'def a; b; end\ndef c; end\n', 'def a\n  b\nend\ndef c; end\n'),
    ('Style/StringLiteralsInInterpolation', 'a = "#{b["c"]}"\nd = "#{e[\'f\']}"\n', 'a = "#{b[\'c\']}"\nd = "#{e[\'f\']}"\n'),
    ('Style/WhileUntilModifier', 'while a\n  b\nend\nc while d\n', 'b while a\nc while d\n'),
    ('Style/SafeNavigation', 'p a && a.b\n@c = 1\n@c.d if @c\np a && b.c\n', 'p a&.b\n@c = 1\n@c&.d\np a && b.c\n'),
    ('Style/MagicCommentFormat', '# frozen-string-literal: true\n\na\n', '# frozen_string_literal: true\n\na\n'),
    ('Style/HashTransformValues', 'a.map { |b, c| [b, c.d] }.to_h\na.map { |b, c| [b, b.d(c)] }.to_h\n', 'a.transform_values { |c| c.d }\na.map { |b, c| [b, b.d(c)] }.to_h\n'),
    ('Style/HashTransformKeys', 'a.map { |b, c| [b.d, c] }.to_h\na.map { |b, c| [c, b] }.to_h\n', 'a.transform_keys { |b| b.d }\na.map { |b, c| [c, b] }.to_h\n'),
    ('Style/HashSlice', 'a.select { |b, c| b == :d }\na.select { |b, c| c == :d }\n', 'a.slice(:d)\na.select { |b, c| c == :d }\n'),
    ("Layout/ArrayAlignment", "a = [1,\n  2,\n     3]\n", "a = [1,\n     2,\n     3]\n"),
    ("Layout/AssignmentIndentation", "a =\nb + c\n@f =\n    g\n", "a =\n  b + c\n@f =\n  g\n"),
    ("Layout/FirstArgumentIndentation", "a(\n1,\n  2\n)\n", "a(\n  1,\n  2\n)\n"),
    ("Layout/FirstHashElementIndentation", "a = {\n    b: 1\n  }\n", "a = {\n  b: 1\n}\n"),
    ("Layout/FirstParameterIndentation", "def a(\nb,\n  c\n)\n  1\nend\n", "def a(\n  b,\n  c\n)\n  1\nend\n"),
    ("Layout/ClosingParenthesisIndentation", "a(\n  b\n  )\n", "a(\n  b\n)\n"),
    ("Layout/BlockAlignment", "a.each do |b|\n  c(b)\n  end\n", "a.each do |b|\n  c(b)\nend\n"),
]


def after(spark, files, rules):
    """{path: (content, corrections taken)} after the rules' edits."""
    found = numbered(node_findings(nodes(files), rules, corrects=True))
    return {r["path"]: (r["content"], len(r["accepted"])) for r in corrected(files, edits(found)).collect()}


@pytest.fixture(scope="module", params=range(0, len(CORRECTED), 80))
def some(request):
    return CORRECTED[request.param : request.param + 80]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_corrected_text(spark, some, ends):
    """Each rule's own corrections, and no others, with either kind of line ends;
    what comes out parses, and a rule that is asked again finds nothing that it
    would change any more."""
    names = {c[0] for c in some}
    rules = [r for r in RULES if r.name in names]
    rows = [(f"{i}/{rule}/{path[0] if path else 'a.rb'}", before.replace("\n", ends)) for i, (rule, before, _, *path) in enumerate(some)]
    files = spark.createDataFrame(rows, "path string, content string")
    own = F.col("rule") == F.concat_ws("/", F.split("path", "/")[1], F.split("path", "/")[2])
    found = numbered(node_findings(nodes(files), rules, corrects=True).filter(own))
    got = {r["path"]: r["content"] for r in corrected(files, edits(found)).collect()}
    for (path, _), (rule, _, want, *_) in zip(rows, some, strict=True):
        if ends == "\n" or rule not in ("Style/BlockComments",):
            assert got[path] == want.replace("\n", ends), (rule, got[path])
    again = spark.createDataFrame(list(got.items()), "path string, content string")
    broken = nodes(again).filter("kind = 'error'").select("path").collect()
    assert broken == []
    if ends == "\n":
        left = edits(numbered(node_findings(nodes(again), rules, corrects=True).filter(own))).select("path").distinct().collect()
        assert {r["path"].split("/", 1)[1].rpartition("/")[0] for r in left} <= {"Style/MultilineTernaryOperator"}
