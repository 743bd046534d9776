"""Short sources written for each rule, with what it is to report there.

«» mark a span to report; the messages follow in the order of the marks, the last
one counting for the rest. A source without marks is clean. The text after the
marks' removal is the source; line and column come from the marks alone, so they
say what a rule means and not what it does.
"""

from __future__ import annotations

#: (rule, source with marks, messages..., path if it matters as path=...)
EXAMPLES: list[tuple[str, ...]] = [
    ("Lint/BigDecimalNew", "x = BigDecimal.«new»('1.5')\ny = ::BigDecimal.«new»(2)\n", "`BigDecimal.new()` is deprecated. Use `BigDecimal()` instead."),
    ("Lint/BigDecimalNew", "x = BigDecimal('1.5')\ny = 'BigDecimal.new(1)' # BigDecimal.new(1)\n"),
    ("Lint/BinaryOperatorWithIdenticalOperands", "«a.b == a.b»\n«x && x»\nx + x\n1 - 1\n", "Binary operator `==` has identical operands.", "Binary operator `&&` has identical operands."),
    ("Lint/BooleanSymbol", "a = «:true»\nb = { «false»: 1 }\nc = %i[true]\n", "Symbol with a boolean name - you probably meant to use `true`.", "Symbol with a boolean name - you probably meant to use `false`."),
    ("Lint/CircularArgumentReference", "def m(a, b = «b», c: «c»)\n  a\nend\n", "Circular argument reference - `b`.", "Circular argument reference - `c`."),
    ("Lint/Debugger", "def m\n  «binding.pry»\n  «byebug»\n  pry\nend\n", "Remove debugger entry point `binding.pry`.", "Remove debugger entry point `byebug`."),
    ("Lint/DeprecatedClassMethods", "«File.exists?»('a')\n«iterator?»\nFile.exist?('a')\n", "`File.exists?` is deprecated in favor of `File.exist?`.", "`iterator?` is deprecated in favor of `block_given?`."),
    ("Lint/DuplicateCaseCondition", "case x\nwhen 1, 2 then a\nwhen 3, «2» then b\nend\n", "Duplicate `when` condition detected."),
    ("Lint/DuplicateHashKey", "h = { a: 1, b: 2, «a»: 3 }\ni = { 'k' => 1, «'k'» => 2, x => 1, y => 2 }\n", "Duplicated key in hash literal."),
    ("Lint/DuplicateSetElement", "s = Set[1, 2, «1»]\nt = Set.new([:a, :b, «:a»])\n", "Remove the duplicate element in Set."),
    ("Lint/EachWithObjectArgument", "«list.each_with_object(0)» { |e, a| a + e }\n".replace("»", "").replace("\n", "»\n"), "The argument to each_with_object cannot be immutable."),
    ("Lint/EmptyBlock", "«items.each { |i| }»\nitems.each { |i| p i }\nitems.each do |i|\n  # later\nend\n", "Empty block detected."),
    ("Lint/EmptyClass", "«class A\nend»\nclass B < A\nend\n", "Empty class detected."),
    ("Lint/EmptyConditionalBody", "«if a\nend»\nif b\n  c\nend\n", "Avoid `if` branches without a body."),
    ("Lint/EmptyEnsure", "begin\n  a\n«ensure»\nend\n", "Empty `ensure` block detected."),
    ("Lint/EmptyExpression", "x = «()»\ny = (1)\n", "Avoid empty expressions."),
    ("Lint/EmptyInPattern", "case a\n«in 1»\nin 2\n  b\nend\n", "Avoid `in` branches without a body."),
    ("Lint/EmptyInterpolation", "x = \"a«#{}»b#{c}\"\n", "Empty interpolation detected."),
    ("Lint/EmptyWhen", "case a\n«when 1»\nwhen 2\n  b\nwhen 3\n  # nothing to do\nend\n", "Avoid `when` branches without a body."),
    ("Lint/EnsureReturn", "def m\n  a\nensure\n  b\n  «return 1»\nend\n", "Do not return from an `ensure` block."),
    ("Lint/FloatComparison", "a = «x == 0.1»\nb = «0.2 != y»\nc = x == 0.0\nd = x == 1\n", "Avoid equality comparisons of floats as they are unreliable.", "Avoid inequality comparisons of floats as they are unreliable."),
    ("Lint/FloatOutOfRange", "a = «3.0e400»\nb = 1.5e10\n", "Float out of range."),
    ("Lint/FlipFlop", "puts 1 if «a..b»\nx = (1..2)\n", "Avoid the use of flip-flop operators."),
    ("Lint/HashCompareByIdentity", "«h.key?(o.object_id)»\nh.key?(o)\n", "Use `Hash#compare_by_identity` instead of using `object_id` for keys."),
    ("Lint/IdentityComparison", "«a.object_id == b.object_id»\n«a.object_id != b.object_id»\n", "Use `equal?` instead of `==` when comparing `object_id`.", "Use `!equal?` instead of `!=` when comparing `object_id`."),
    ("Lint/ImplicitStringConcatenation", "x = «'a' 'b'»\ny = 'a' + 'b'\n", "Combine 'a' and 'b' into a single string literal, rather than using implicit string concatenation."),
    ("Lint/InheritException", "class A < «Exception»\n  x\nend\nB = Class.new(«Exception»)\nclass C < StandardError\n  x\nend\n", "Inherit from `StandardError` instead of `Exception`."),
    ("Lint/InterpolationCheck", "a = «'x #{y}'»\nb = 'plain'\n", "Interpolation in single quoted string detected. Use double quoted strings if you need interpolation."),
    ("Lint/LiteralAsCondition", "if «1»\n  a\nend\nb if «'s'»\nwhile true\n  c\nend\n", "Literal `1` appeared as a condition.", "Literal `'s'` appeared as a condition."),
    ("Lint/LiteralInInterpolation", "x = \"a#{«1»}b#{c}\"\n", "Literal interpolation detected."),
    ("Lint/Loop", "begin\n  a\nend «until» b\n", "Use `Kernel#loop` with `break` rather than `begin/end/until`(or `while`)."),
    ("Lint/MixedCaseRange", "a = «'A'..'z'»\nb = 'a'..'z'\n", "Ranges from upper to lower case ASCII letters may include unintended characters. Instead of `A-z` (which also includes several symbols) specify each range individually: `A-Za-z` and individually specify any symbols."),
    ("Lint/MultipleComparison", "a = «1 < x < 9»\nb = 1 < x && x < 9\n", "Use the `&&` operator to compare multiple values."),
    ("Lint/NestedMethodDefinition", "def a\n  «def b\n    1\n  end»\nend\n", "Method definitions must not be nested. Use `lambda` instead."),
    ("Lint/NumberedParameterAssignment", "«_1 = 5»\n«_12 = 5»\n", "`_1` is reserved for numbered parameter; consider another name.", "`_12` is similar to numbered parameter; consider another name."),
    ("Lint/OrAssignmentToConstant", "LIMIT «||=» 5\nx ||= 5\n", "Avoid using or-assignment with constants."),
    ("Lint/PercentStringArray", "a = «%w('x', 'y')»\nb = %w[x y]\n", "Within `%w`/`%W`, quotes and ',' are unnecessary and may be unwanted in the resulting strings."),
    ("Lint/PercentSymbolArray", "a = «%i(:x, :y)»\nb = %i[x y]\n", "Within `%i`/`%I`, ':' and ',' are unnecessary and may be unwanted in the resulting symbols."),
    ("Lint/RaiseException", "raise «Exception», 'no'\nraise «Exception».new('no')\nraise StandardError, 'no'\n", "Use `StandardError` over `Exception`."),
    ("Lint/RandOne", "a = «rand(1)»\nb = «Kernel.rand(-1)»\nc = rand(2)\n", "`rand(1)` always returns `0`. Perhaps you meant `rand(2)` or `rand`?", "`Kernel.rand(-1)` always returns `0`. Perhaps you meant `rand(2)` or `rand`?"),
    ("Lint/RedundantRequireStatement", "«require 'thread'»\nrequire 'json'\n", "Remove unnecessary `require` statement."),
    ("Lint/RedundantStringCoercion", "a = \"x#{b.«to_s»}\"\nputs c.«to_s»\nputs to_s\n", "Redundant use of `Object#to_s` in interpolation.", "Redundant use of `Object#to_s` in `puts`."),
    ("Lint/RedundantWithIndex", "a.«each_with_index» { |v| p v }\na.each_with_index { |v, i| p v, i }\n", "Use `each` instead of `each_with_index`."),
    ("Lint/RegexpAsCondition", "p 1 if «/x/»\np 2 if a =~ /x/\n", "Do not use regexp literal as a condition. The regexp literal matches `$_` implicitly."),
    ("Lint/RescueException", "begin\n  a\n«rescue Exception => e\n  b»\nend\nbegin\n  a\nrescue StandardError\n  b\nend\n", "Avoid rescuing the `Exception` class. Perhaps you meant to rescue `StandardError`?"),
    ("Lint/ReturnInVoidContext", "class A\n  def initialize\n    «return» 1 if x\n  end\n\n  def b=(v)\n    «return» v\n  end\nend\n", "Do not return a value in `initialize`.", "Do not return a value in `b=`."),
    ("Lint/SafeNavigationWithEmpty", "p 1 if «a&.empty?»\np 1 if a.empty?\n", "Avoid calling `empty?` with the safe navigation operator in conditionals."),
    ("Lint/SelfAssignment", "x = 1\n«x = x»\n«@a = @a»\nx = y\n", "Self-assignment detected."),
    ("Lint/SendWithMixinArgument", "A.«send(:include, B)»\nA.include B\n", "Use `include B` instead of `send(:include, B)`."),
    ("Lint/SharedMutableDefault", "a = «Hash.new([])»\nb = Hash.new { |h, k| h[k] = [] }\n", "Do not create a Hash with a mutable default value as the default value can accidentally be changed."),
    ("Lint/SuppressedException", "begin\n  a\n«rescue A»\nend\nbegin\n  a\nrescue A\n  # fine\nend\n", "Do not suppress exceptions."),
    ("Lint/SymbolConversion", "a = «:foo.to_sym»\nb = «\"x#{y}\".to_sym»\nc = «:\"bar\"»\nd = 'x-y'\n", "Unnecessary symbol conversion; use `:foo` instead.", "Unnecessary symbol conversion; use `:\"x#{y}\"` instead.", "Unnecessary symbol conversion; use `:bar` instead."),
    ("Lint/ToJSON", "class A\n  «def to_json\n    1\n  end»\nend\n", "`#to_json` requires an optional argument to be parsable via JSON.generate(obj)."),
    ("Lint/TopLevelReturnWithArgument", "«return 1»\n", "Top level return with argument detected."),
    ("Lint/UnifiedInteger", "a = «Fixnum»\nb = Integer\n", "Use `Integer` instead of `Fixnum`."),
    ("Lint/UnreachableCode", "def m\n  return 1\n  «a»\nend\n\ndef n\n  return 1 if b\n  a\nend\n", "Unreachable code detected."),
    ("Lint/UriEscapeUnescape", "«URI.escape(a)»\n«::URI.decode(a)»\n", "`URI.escape` method is obsolete and should not be used. Instead, use `CGI.escape`, `URI.encode_www_form` or `URI.encode_www_form_component` depending on your specific use case.", "`::URI.decode` method is obsolete and should not be used. Instead, use `CGI.unescape`, `URI.decode_www_form` or `URI.decode_www_form_component` depending on your specific use case."),
    ("Lint/UriRegexp", "a = URI.«regexp»('http')\n", "`URI.regexp` is obsolete and should not be used. Instead, use `URI::DEFAULT_PARSER.make_regexp`."),
    ("Lint/UselessTimes", "«0.times { p 1 }»\n2.times { p 1 }\n", "Useless call to `0.times` detected."),
    ("Lint/AssignmentInCondition", "if a «=» 1\n  b\nend\nif (a = 1)\n  b\nend\n", "Use `==` if you meant to do a comparison or wrap the expression in parentheses to indicate you meant to assign in a condition."),
    ("Lint/AmbiguousRange", "a = («b || 1»..2)\nc = (1..2)\n", "Wrap complex range boundaries with parentheses to avoid ambiguity."),
    ("Security/CompoundHash", "def hash\n  «@a ^ @b»\nend\n", "Use `[...].hash` instead of combining hash values manually."),
    ("Security/CompoundHash", "def hash\n  [@a, @b].hash\nend\n\ndef other\n  @a ^ @b\nend\n"),
    ("Security/Eval", "é = 1\n«eval»(code)\nKernel.«eval» code\neval('1 + 1')\nx.eval(code)\n# eval(code)\n", "The use of `eval` is a serious security risk."),
    ("Security/IoMethods", "«IO.read(path)»\nFile.read(path)\nIO.read('| ls')\n", "`File.read` is safer than `IO.read`."),
    ("Security/JSONLoad", "JSON.«load»(a)\n::JSON.«restore»(a)\nJSON.parse(a)\n", "Prefer `JSON.parse` over `JSON.load`.", "Prefer `JSON.parse` over `JSON.restore`."),
    ("Security/MarshalLoad", "Marshal.«load»(a)\nMarshal.load(Marshal.dump(a))\n", "Avoid using `Marshal.load`."),
    ("Security/Open", "«open»(a)\nURI.«open»(a)\nopen('a.txt')\nFile.open(a)\n", "The use of `Kernel#open` is a serious security risk.", "The use of `URI.open` is a serious security risk."),
    ("Security/YAMLLoad", "YAML.«load»(a)\nYAML.safe_load(a)\n", "Prefer using `YAML.safe_load` over `YAML.load`."),
    ("Style/AndOr", "p 1 if a «and» b\np 1 if a «or» b\nx = a && b\n", "Use `&&` instead of `and`.", "Use `||` instead of `or`."),
    ("Style/ArrayFirstLast", "a = b«[0]»\nc = b«[-1]»\nd = b[1]\n", "Use `first`.", "Use `last`."),
    ("Style/ArrayIntersectWithSingleElement", "a.«intersect?([b])»\na.intersect?([b, c])\n", "Use `include?(element)` instead of `intersect?([element])`."),
    ("Style/ArrayJoin", "%w[a b] «*» ','\n%w[a b] * 2\n", "Favor `Array#join` over `Array#*`."),
    ("Style/AsciiComments", "a = 'é' # plain\nb = 1 # caf«é» au lait\n", "Use only ascii symbols in comments."),
    ("Style/Attr", "class A\n  «attr» :x\n  attr_reader :y\nend\n", "Do not use `attr`. Use `attr_reader` instead."),
    ("Style/BarePercentLiterals", "a = «%Q(»x \"y\" #{z})\nb = %(x)\n", "Use `%` instead of `%Q`."),
    ("Style/BeginBlock", "«BEGIN» { a }\n", "Avoid the use of `BEGIN` blocks."),
    ("Style/BlockComments", "a = 1\n«=begin\ntext\n=end»\nb = 2\n", "Do not use block comments."),
    ("Style/CaseEquality", "A «===» b\na == b\n", "Avoid the use of the case equality operator `===`."),
    ("Style/CharacterLiteral", "a = «?x»\nb = 'x'\nc = a ? 1 : 2\n", "Do not use the character literal - use string literal instead."),
    ("Style/ClassAndModuleChildren", "class «A::B»\nend\nmodule C\nend\n", "Use nested module/class definitions instead of compact style."),
    ("Style/ClassCheck", "a.«kind_of?»(B)\na.is_a?(B)\n", "Prefer `Object#is_a?` over `Object#kind_of?`."),
    ("Style/ClassEqualityComparison", "a.«class == B»\na.instance_of?(B)\n", "Use `instance_of?(B)` instead of comparing classes."),
    ("Style/ClassMethods", "class A\n  def «A».b\n    1\n  end\n\n  def self.c\n    1\n  end\nend\n", "Use `self.b` instead of `A.b`."),
    ("Style/ClassVars", "class A\n  «@@x» = 1\n  @y = @@z\nend\n", "Replace class var @@x with a class instance var."),
    ("Style/CollectionMethods", "a.«collect» { |x| x + 1 }\na.«detect» { |x| x }\na.map { |x| x }\n", "Prefer `map` over `collect`.", "Prefer `find` over `detect`."),
    ("Style/ColonMethodCall", "a«::»b\nA::B\nA.c\n", "Do not use `::` for method calls."),
    ("Style/ColonMethodDefinition", "class A\n  def self«::»b\n    1\n  end\nend\n", "Do not use `::` for defining class methods."),
    ("Style/CombinableDefined", "«defined?(A) && defined?(A::B)»\ndefined?(A) && defined?(B)\n", "Combine nested `defined?` calls."),
    ("Style/CommentedKeyword", "def m «# why»\n  1 # fine\nend\n\nclass A # :nodoc:\nend\n", "Do not place comments on the same line as the `def` keyword."),
    ("Style/ConcatArrayLiterals", "a.«concat([1, 2], [3])»\na.concat(b)\n", "Use `push(1, 2, 3)` instead of `concat([1, 2], [3])`."),
    ("Style/DataInheritance", "class A < «Data.define(:x)»\n  1\nend\n", "Don't extend an instance initialized by `Data.define`. Use a block to customize the class."),
    ("Style/DateTime", "a = «DateTime.now»\nb = Time.now\n", "Prefer `Time` over `DateTime`."),
    ("Style/DefWithParentheses", "def a«()»\n  1\nend\n\ndef b\n  1\nend\n", "Omit the parentheses in defs when the method doesn't accept any arguments."),
    ("Style/Dir", "a = «File.expand_path(File.dirname(__FILE__))»\nb = __dir__\n", "Use `__dir__` to get an absolute path to the current file's directory."),
    ("Style/DoubleNegation", "a = «!»!b\nc = !d\n", "Avoid the use of double negation (`!!`)."),
    ("Style/EachForSimpleLoop", "«(0...5).each» { p 1 }\n(0...5).each { |i| p i }\n", "Use `Integer#times` for a simple loop which iterates a fixed number of times."),
    ("Style/EmptyBlockParameter", "a.each do «||»\n  b\nend\n", "Omit pipes for the empty block parameters."),
    ("Style/EmptyCaseCondition", "«case»\nwhen a\n  1\nend\ncase b\nwhen c\n  1\nend\n", "Do not use empty `case` condition, instead use an `if` expression."),
    ("Style/EmptyElse", "if a\n  b\n«else»\nend\nif a\n  b\n«else»\n  nil\nend\n", "Redundant `else`-clause."),
    ("Style/EmptyLambdaParameter", "a = ->«()» { 1 }\nb = ->(x) { x }\n", "Omit parentheses for the empty lambda parameters."),
    ("Style/EmptyLiteral", "a = «Array.new»\nb = «Hash.new»\nc = Array.new(3)\n", "Use array literal `[]` instead of `Array.new`.", "Use hash literal `{}` instead of `Hash.new`."),
    ("Style/EmptyMethod", "«def a(b)\nend»\n\ndef c; end\n", "Put empty method definitions on a single line."),
    ("Style/EndBlock", "«END» { a }\n", "Avoid the use of `END` blocks. Use `Kernel#at_exit` instead."),
    ("Style/EnvHome", "a = «ENV['HOME']»\nb = «ENV.fetch('HOME', nil)»\nc = ENV['PATH']\n", "Use `Dir.home` instead."),
    ("Style/EvenOdd", "«a % 2 == 0»\n«a % 2 == 1»\na % 3 == 0\n", "Replace with `Integer#even?`.", "Replace with `Integer#odd?`."),
    ("Style/FetchEnvVar", "a = «ENV['X']»\nb = ENV.fetch('X')\np 1 if ENV['X']\n", "Use `ENV.fetch('X', nil)` instead of `ENV['X']`."),
    ("Style/For", "«for a in b do\n  c\nend»\n", "Prefer `each` over `for`."),
    ("Style/FormatString", "a = «sprintf»('%d', 1)\nb = '%d' «%» 1\nc = format('%d', 1)\n", "Favor `format` over `sprintf`.", "Favor `format` over `String#%`."),
    ("Style/GlobalStdStream", "«STDOUT».puts 1\n$stdout.puts 1\n", "Use `$stdout` instead of `STDOUT`."),
    ("Style/GlobalVars", "«$count» = 1\np «$count»\n$stdout.puts 1\n", "Do not introduce global variables."),
    ("Style/HashEachMethods", "a.«keys.each» { |k| p k }\na.«values.each» { |v| p v }\na.each_key { |k| p k }\n", "Use `each_key` instead of `keys.each`.", "Use `each_value` instead of `values.each`."),
    ("Style/HashSyntax", "a = { «:b =>» 1, «:c =>» 2 }\nd = { 'e' => 1 }\nf = { g: 1 }\n", "Use the new Ruby 1.9 hash syntax."),
    ("Style/ImplicitRuntimeError", "«raise 'no'»\nraise A, 'no'\n", "Use `raise` with an explicit exception class and message, rather than just a message."),
    ("Style/InfiniteLoop", "«while» true\n  a\nend\nwhile b\n  a\nend\n", "Use `Kernel#loop` for infinite loops."),
    ("Style/InlineComment", "a = 1 «# why»\n# own line\nb = '# no'\n", "Avoid trailing inline comments."),
    ("Style/InPatternThen", "case a\nin 1«;» b\nin 2 then c\nend\n", "Do not use `in 1;`. Use `in 1 then` instead."),
    ("Style/InverseMethods", "p «!a.any?»\np a.none?\n", "Use `none?` instead of inverting `any?`."),
    ("Style/IpAddresses", "a = «'192.168.0.1'»\nb = '1.2.3'\n", "Do not hardcode IP addresses."),
    ("Style/Lambda", "a = «lambda» { |x| x }\nb = «->»(x) do\n  x\nend\nc = ->(x) { x }\n", "Use the `-> { ... }` lambda literal syntax for single line lambdas.", "Use the `lambda` method for multiline lambdas."),
    ("Style/LambdaCall", "«a.(1)»\na.call(1)\n", "Prefer the use of `a.call(1)` over `a.(1)`."),
    ("Style/MapToHash", "a.«map» { |x| [x, 1] }.to_h\na.to_h { |x| [x, 1] }\n", "Pass a block to `to_h` instead of calling `map.to_h`."),
    ("Style/MapToSet", "a.«map» { |x| x }.to_set\n", "Pass a block to `to_set` instead of calling `map.to_set`."),
    ("Style/MethodCallWithoutArgsParentheses", "a.b«()»\nc«()»\nd(1)\nString()\n", "Do not use parentheses for method calls with no arguments."),
    ("Style/MethodDefParentheses", "def a «b, c»\n  1\nend\n\ndef d(e)\n  1\nend\n", "Use def with parentheses when there are parameters."),
    ("Style/MinMax", "a = «[b.min, b.max]»\nc = [b.min, d.max]\n", "Use `b.minmax` instead of `[b.min, b.max]`."),
    ("Style/MixinUsage", "«include A»\nclass B\n  include A\nend\n", "`include` is used at the top level. Use inside `class` or `module`."),
    ("Style/ModuleFunction", "module A\n  «extend self»\nend\n", "Use `module_function` instead of `extend self`."),
    ("Style/MultilineIfThen", "if a «then»\n  b\nend\nif a then b end\n", "Do not use `then` for multi-line `if`."),
    ("Style/MultilineTernaryOperator", "a = «b ?\n  1 : 2»\nc = d ? 1 : 2\n", "Avoid multi-line ternary operators, use `if` or `unless` instead."),
    ("Style/MutableConstant", "A = «[1]»\nB = «{ a: 1 }»\nC = [1].freeze\nD = 1\n", "Freeze mutable objects assigned to constants."),
    ("Style/NegatedIf", "«p 1 if !a»\n«if !b\n  c\nend»\np 1 if a\n", "Favor `unless` over `if` for negative conditions."),
    ("Style/NegatedUnless", "«p 1 unless !a»\np 1 unless a\n", "Favor `if` over `unless` for negative conditions."),
    ("Style/NegatedWhile", "«while !a\n  b\nend»\nuntil a\n  b\nend\n", "Favor `until` over `while` for negative conditions."),
    ("Style/NestedModifier", "a «if» b if c\n", "Avoid using nested modifiers."),
    ("Style/NestedTernaryOperator", "a ? («b ? 1 : 2») : 3\n", "Ternary operators must not be nested. Prefer `if` or `else` constructs instead."),
    ("Style/NilComparison", "a «==» nil\na.nil?\n", "Prefer the use of the `nil?` predicate."),
    ("Style/NilLambda", "a = «-> { nil }»\nb = -> { 1 }\n", "Use an empty lambda instead of always returning nil."),
    ("Style/NonNilCheck", "p 1 if «a != nil»\np 1 if a\n", "Prefer `!a.nil?` over `a != nil`."),
    ("Style/Not", "a = («not» b)\nc = !b\n", "Use `!` instead of `not`."),
    ("Style/NumericLiteralPrefix", "a = «0123»\nb = «0X1F»\nc = 0o17\n", "Use 0o for octal literals.", "Use 0x for hexadecimal literals."),
    ("Style/NumericLiterals", "a = «123456»\nb = 123_456\nc = 1234\nd = '123456' # 123456\n", "Use underscores(_) as thousands separator and separate every 3 digits with them."),
    ("Style/NumericPredicate", "«a == 0»\n«0 < a»\n«(a + 1) > 0»\na == 1\n", "Use `a.zero?` instead of `a == 0`.", "Use `a.positive?` instead of `0 < a`.", "Use `(a + 1).positive?` instead of `(a + 1) > 0`."),
    ("Style/ObjectThen", "a.«yield_self» { |x| x }\na.then { |x| x }\n", "Prefer `then` over `yield_self`."),
    ("Style/OneClassPerFile", "class A\nend\n\n«class B»\nend\n", "Do not define multiple classes/modules at the top level in a single file."),
    ("Style/OpenStructUse", "a = «OpenStruct».new\nb = A::OpenStruct\n", "Avoid using `OpenStruct`; use `Struct`, `Hash`, a class or test doubles instead."),
    ("Style/OptionalArguments", "def a(«b = 1», c)\n  b + c\nend\n", "Optional arguments should appear at the end of the argument list."),
    ("Style/OptionalBooleanParameter", "def a(b, «c = true»)\n  b\nend\n", "Prefer keyword arguments for arguments with a boolean default value; use `c: true` instead of `c = true`."),
    ("Style/OptionHash", "def a(b, «options = {}»)\n  b\nend\n\ndef c(d, options = {}, e: 1)\n  d\nend\n", "Prefer keyword arguments to options hashes."),
    ("Style/OrAssignment", "«a = a ? a : 1»\na ||= 1\n", "Use the double pipe equals operator `||=` instead."),
    ("Style/ParallelAssignment", "«a, b = 1, 2»\na, b = b, a\nc, d = e\n", "Do not use parallel assignment."),
    ("Style/ParenthesesAroundCondition", "if «(a)»\n  b\nend\nb while «(c)»\nif (d = 1)\n  b\nend\n", "Don't use parentheses around the condition of an `if`.", "Don't use parentheses around the condition of a `while`."),
    ("Style/PercentLiteralDelimiters", "a = «%w(x y)»\nb = %w[x y]\nc = «%q{x}»\n", "`%w`-literals should be delimited by `[` and `]`.", "`%q`-literals should be delimited by `(` and `)`."),
    ("Style/PercentQLiterals", "a = «%Q(»x)\nb = %Q(x#{y})\n", "Do not use `%Q` unless interpolation is needed. Use `%q`."),
    ("Style/PerlBackrefs", "a =~ /(x)/\np «$1»\nclass A\n  p «$&»\nend\n", "Prefer `Regexp.last_match(1)` over `$1`.", "Prefer `::Regexp.last_match(0)` over `$&`."),
    ("Style/PreferredHashMethods", "a.«has_key?»(1)\na.key?(1)\n", "Use `Hash#key?` instead of `Hash#has_key?`."),
    ("Style/Proc", "a = «Proc.new» { 1 }\nb = proc { 1 }\n", "Use `proc` instead of `Proc.new`."),
    ("Style/RaiseArgs", "«raise A.new('x')»\nraise A, 'x'\n", "Provide an exception class and message as arguments to `raise`."),
    ("Style/RedundantArrayConstructor", "a = «Array.new»([1, 2])\nb = [1, 2]\n", "Remove the redundant `Array` constructor."),
    ("Style/RedundantArrayFlatten", "a«.flatten».join\na.flatten(2, 3).first\n", "Remove the redundant `flatten`."),
    ("Style/RedundantBegin", "def a\n  «begin»\n    b\n  rescue C\n    d\n  end\nend\n", "Redundant `begin` block detected."),
    ("Style/RedundantCapitalW", "a = «%W[x y]»\nb = %W[x #{y}]\n", "Do not use `%W` unless interpolation is needed. If not, use `%w`."),
    ("Style/RedundantConditional", "a = «b == c ? true : false»\nd = «b == c ? false : true»\n", "This conditional expression can just be replaced by `b == c`.", "This conditional expression can just be replaced by `!(b == c)`."),
    ("Style/RedundantCurrentDirectoryInPath", "require_relative '«./»a'\nrequire_relative 'a'\n", "Remove the redundant current directory path."),
    ("Style/RedundantException", "«raise RuntimeError, 'x'»\nraise 'x'\n«raise RuntimeError.new('x')»\n", "Redundant `RuntimeError` argument can be removed.", "Redundant `RuntimeError.new` call can be replaced with just the message."),
    ("Style/RedundantFetchBlock", "a.«fetch(:b) { 1 }»\na.fetch(:b) { c }\n", "Use `fetch(:b, 1)` instead of `fetch(:b) { 1 }`."),
    ("Style/RedundantFileExtensionInRequire", "require 'a«.rb»'\nrequire 'a'\n", "Redundant `.rb` file extension detected."),
    ("Style/RedundantFreeze", "A = «1.freeze»\nB = «:a.freeze»\nC = 'a'.freeze\n", "Do not freeze immutable objects, as freezing them has no effect."),
    ("Style/RedundantInterpolation", "a = «\"#{b}\"»\nc = \"x#{b}\"\n", "Prefer `to_s` over string interpolation."),
    ("Style/RedundantReturn", "def a\n  b\n  «return» c\nend\n\ndef d\n  «return» 1, 2\nend\n", "Redundant `return` detected.", "Redundant `return` detected. To return multiple values, use an array."),
    ("Style/RedundantSort", "a.«sort.first»\na.min\n", "Use `min` instead of `sort...first`."),
    ("Style/RedundantSortBy", "a.«sort_by { |x| x }»\na.sort_by { |x| -x }\n", "Use `sort` instead of `sort_by { |x| x }`."),
    ("Style/RegexpLiteral", "a = «%r{x}»\nb = %r{x/y}\nc = /x/\n", "Use `//` around regular expression."),
    ("Style/RescueModifier", "«a rescue nil»\n", "Avoid using `rescue` in its modifier form."),
    ("Style/RescueStandardError", "begin\n  a\n«rescue»\n  b\nend\nbegin\n  a\nrescue StandardError\n  b\nend\n", "Avoid rescuing without specifying an error class."),
    ("Style/ReturnNil", "def a\n  «return nil» if b\n  return if c\nend\n", "Use `return` instead of `return nil`."),
    ("Style/Sample", "a.«shuffle.first»\na.sample\n", "Use `sample` instead of `shuffle.first`."),
    ("Style/SelfAssignment", "a = 1\n«a = a + 1»\n«@b = @b || 2»\na = b + 1\n", "Use self-assignment shorthand `+=`.", "Use self-assignment shorthand `||=`."),
    ("Style/Semicolon", "a = 1«;» b = 2\nc = ';' # ;\n", "Do not use semicolons to terminate expressions."),
    ("Style/Send", "a.«send»(:b)\na.public_send(:b)\n", "Prefer `Object#__send__` or `Object#public_send` to `send`."),
    ("Style/SignalException", "«fail» 'x'\nraise 'x'\n", "Always use `raise` to signal exceptions."),
    ("Style/SingleArgumentDig", "«a.dig(:b)»\na.dig(:b, :c)\n", "Use `a[:b]` instead of `a.dig(:b)`."),
    ("Style/SlicingWithRange", "a«[1..-1]»\na[1..]\n", "Prefer `[1..]` over `[1..-1]`."),
    ("Style/SpecialGlobalVars", "p «$!»\np «$0»\n", "Prefer `$ERROR_INFO` from the stdlib 'English' module (don't forget to require it) over `$!`.", "Prefer `$PROGRAM_NAME` over `$0`."),
    ("Style/StabbyLambdaParentheses", "a = ->«x» { x }\nb = ->(x) { x }\n".replace("«x»", "«x» ").replace("«x»  {", "«x» {"), "Wrap stabby lambda arguments with parentheses."),
    ("Style/StderrPuts", "«$stderr.puts» 'x'\nwarn 'x'\n", "Use `warn` instead of `$stderr.puts` to allow such output to be disabled."),
    ("Style/StringChars", "a.«split('')»\na.«split(//)»\na.chars\n", "Use `chars` instead of `split('')`.", "Use `chars` instead of `split(//)`."),
    ("Style/StringHashKeys", "a = { «'b'» => 1 }\nc = { d: 1 }\n", "Prefer symbols instead of strings as hash keys."),
    ("Style/StringLiterals", "a = «\"x\"»\nb = \"x\\n\"\nc = \"it's\"\nd = <<~T\n  \"x\"\nT\n", "Prefer single-quoted strings when you don't need string interpolation or special symbols."),
    ("Style/StringMethods", "a.«intern»\na.to_sym\n", "Prefer `to_sym` over `intern`."),
    ("Style/Strip", "a.«lstrip.rstrip»\na.strip\n", "Use `strip` instead of `lstrip.rstrip`."),
    ("Style/StructInheritance", "class A < «Struct.new(:x)»\n  1\nend\n", "Don't extend an instance initialized by `Struct.new`. Use a block to customize the struct."),
    ("Style/SuperWithArgsParentheses", "def a(b)\n  «super b»\nend\n", "Use parentheses for `super` with arguments."),
    ("Style/SymbolArray", "a = «[:b, :c]»\nd = %i[b c]\n", "Use `%i` or `%I` for an array of symbols."),
    ("Style/SymbolLiteral", "a = «:\"b\"»\nc = :\"d e\"\n", "Do not use strings for word-like symbol literals."),
    ("Style/SymbolProc", "a.map «{ |x| x.b }»\na.map(&:b)\n", "Pass `&:b` as an argument to `map` instead of a block."),
    ("Style/TernaryParentheses", "a = «(b) ? 1 : 2»\nc = b ? 1 : 2\n", "Omit parentheses for ternary conditions."),
    ("Style/TopLevelMethodDefinition", "«def a\n  1\nend»\n\nclass B\n  def c\n    1\n  end\nend\n", "Do not define methods at the top-level."),
    ("Style/TrailingCommaInArrayLiteral", "a = [1, 2«,»]\nb = [1, 2]\n", "Avoid comma after the last item of an array."),
    ("Style/TrailingCommaInHashLiteral", "a = { b: 1«,» }\nc = { b: 1 }\n", "Avoid comma after the last item of a hash."),
    ("Style/TrailingCommaInArguments", "a(1, 2«,»)\na(1, 2)\n", "Avoid comma after the last parameter of a method call."),
    ("Style/TrivialAccessors", "class A\n  «def» b\n    @b\n  end\n\n  «def» c=(v)\n    @c = v\n  end\nend\n", "Use `attr_reader` to define trivial reader methods.", "Use `attr_writer` to define trivial writer methods."),
    ("Style/UnlessElse", "«unless a\n  b\nelse\n  c\nend»\nunless a\n  b\nend\n", "Do not use `unless` with `else`. Rewrite these with the positive case first."),
    ("Style/UnpackFirst", "a.«unpack('h').first»\na.unpack1('h')\n", "Use `unpack1('h')` instead of `unpack('h').first`."),
    ("Style/VariableInterpolation", "a = \"x#«@b»\"\nc = \"x#{@b}\"\n", "Replace interpolated variable `@b` with expression `#{@b}`."),
    ("Style/WhenThen", "case a\nwhen 1«;» b\nwhen 2 then c\nend\n", "Do not use `when 1;`. Use `when 1 then` instead."),
    ("Style/WhileUntilDo", "while a «do»\n  b\nend\nwhile a\n  b\nend\n", "Do not use `do` with multi-line `while`."),
    ("Style/WordArray", "a = «['b', 'c']»\nd = ['e f', 'g']\nh = %w[i j]\n", "Use `%w` or `%W` for an array of words."),
    ("Style/YodaCondition", "p 1 if «1 == a»\np 1 if a == 1\n", "Reverse the order of the operands `1 == a`."),
    ("Style/ZeroLengthPredicate", "a.«size == 0»\n«a.length > 0»\na.empty?\n", "Use `empty?` instead of `size == 0`.", "Use `!empty?` instead of `length > 0`."),
    ("Naming/AccessorMethodName", "def «get_a»\n  1\nend\n\ndef «set_b»(c)\n  c\nend\n", "Do not prefix reader method names with `get_`.", "Do not prefix writer method names with `set_`."),
    ("Naming/BinaryOperatorParameterName", "class A\n  def +(«value»)\n    1\n  end\n\n  def -(other)\n    1\n  end\nend\n", "When defining the `+` operator, name its argument `other`."),
    ("Naming/ClassAndModuleCamelCase", "class «My_Class»\nend\nmodule Other\nend\n", "Use CamelCase for classes and modules."),
    ("Naming/ConstantName", "«Limit» = 5\nMAX = 5\nFoo = Class.new\n", "Use SCREAMING_SNAKE_CASE for constants."),
    ("Naming/HeredocDelimiterCase", "a = <<~text\n  x\n«text»\n", "Use uppercase heredoc delimiters."),
    ("Naming/HeredocDelimiterNaming", "a = <<~EOS\n  x\n«EOS»\nb = <<~SQL\n  x\nSQL\n", "Use meaningful heredoc delimiters."),
    ("Naming/MethodName", "def «fooBar»\n  1\nend\n\ndef self.«getIt»\n  1\nend\n\ndef foo_bar\n  1\nend\n", "Use snake_case for method names."),
    ("Naming/MethodParameterName", "def a(«x», id, name)\n  x\nend\n", "Method parameter must be at least 3 characters long."),
    ("Naming/PredicatePrefix", "def «is_open»\n  1\nend\n\ndef «has_key»\n  1\nend\n\ndef open?\n  1\nend\n", "Rename `is_open` to `open?`.", "Rename `has_key` to `key?`."),
    ("Naming/RescuedExceptionsVariableName", "begin\n  a\nrescue B => «exc»\n  c\nrescue D => e\n  c\nend\n", "Use `e` instead of `exc`."),
    ("Metrics/ParameterLists", "def a«(b, c, d, e, f, g)»\n  1\nend\n\ndef h(i, j)\n  1\nend\n", "Avoid parameter lists longer than 5 parameters. [6/5]"),
    ("Metrics/MethodLength", "«def a\n" + "  b\n" * 11 + "end»\n\ndef c\n  # note\n\n  d\nend\n", "Method has too many lines. [11/10]"),
    ("Metrics/BlockLength", "«a.each do |b|\n" + "  c\n" * 26 + "end»\n", "Block has too many lines. [26/25]"),
    ("Metrics/CollectionLiteralLength", "a = «[" + ", ".join(["1"] * 250) + "]»\n", "Avoid hard coding large quantities of data in code. Prefer reading the data from an external source."),
    ("Bundler/InsecureProtocolSource", "source «:gemcutter»\nsource 'https://rubygems.org'\n", "The source `:gemcutter` is deprecated because HTTP requests are insecure. Please change your source to 'https://rubygems.org' if possible, or 'http://rubygems.org' if not.", "path=Gemfile"),
    ("Gemspec/AddRuntimeDependency", "Gem::Specification.new do |spec|\n  spec.«add_runtime_dependency»('a')\n  spec.add_dependency('b')\nend\n", "Use `add_dependency` instead of `add_runtime_dependency`.", "path=a.gemspec"),
    ("Gemspec/RubyVersionGlobalsUsage", "Gem::Specification.new do |spec|\n  spec.x = «RUBY_VERSION»\nend\n", "Do not use `RUBY_VERSION` in gemspec file.", "path=a.gemspec"),
    ("Gemspec/DeprecatedAttributeAssignment", "Gem::Specification.new do |spec|\n  «spec.test_files = []»\n  spec.name = 'a'\nend\n", "Do not set `test_files` in gemspec.", "path=a.gemspec"),
    ("Lint/ConstantDefinitionInBlock", "a do\n  «B = 1»\nend\nC = 1\n", "Do not define constants this way within a block."),
    ("Lint/RedundantWithObject", "a.«each_with_object([])» { |v| p v }\na.each_with_object([]) { |v, o| o << v }\n", "Use `each` instead of `each_with_object`."),
    ("Lint/TrailingCommaInAttributeDeclaration", "class A\n  attr_reader :b«,»\n\n  def c\n    1\n  end\nend\n", "Avoid leaving a trailing comma in attribute declarations."),
    ("Naming/AsciiIdentifiers", "caf«é» = 1\nb = 'é'\n", "Use only ascii symbols in identifiers."),
    ("Style/AutoResourceCleanup", "a = «File.open('b')»\nFile.open('b') { |f| f.read }\nFile.open('b').close\n", "Use the block version of `File.open`."),
    ("Style/BitwisePredicate", "«(a & b) != 0»\n(a & b) == c\n", "Replace with `a.anybits?(b)` for comparison with bit flags."),
    ("Style/CommandLiteral", "a = «%x(ls)»\nb = `ls`\n", "Use backticks around command string."),
    ("Style/ExponentialNotation", "a = «10e6»\nb = 1.5e7\n", "Use a mantissa >= 1 and < 10."),
    ("Style/IfUnlessModifierOfIfUnless", "if a\n  b\nend «unless» c\n", "Avoid modifier `unless` after another conditional."),
    ("Style/NumberedParameters", "«a.map do\n  _1 + 1\nend»\nb.map { _1 + 1 }\n".replace("«a.map do", "a.map «do"), "Only use numbered parameters for single-line blocks."),
    ("Lint/UselessElseWithoutRescue", "def a\n  b\n«else»\n  c\nend\n", "`else` without `rescue` is useless."),
    ("Layout/EmptyLinesAroundMethodBody", "def a\n«\n»  b\n«\n»end\n\ndef c\n  d\nend\n", "Extra empty line detected at method body beginning.", "Extra empty line detected at method body end."),
    ("Layout/EmptyLinesAroundClassBody", "class A < B\n«\n»  c\nend\n\nclass D\n  e\nend\n", "Extra empty line detected at class body beginning."),
    ("Layout/EmptyLinesAroundModuleBody", "module A\n  b\n«\n»end\n", "Extra empty line detected at module body end."),
    ("Layout/EmptyLinesAroundBlockBody", "a.each do |b|\n«\n»  c\nend\n", "Extra empty line detected at block body beginning."),
    ("Layout/EmptyLinesAroundBeginBody", "begin\n«\n»  a\nrescue B\n  c\nend\n", "Extra empty line detected at `begin` body beginning."),
    ("Layout/DefEndAlignment", "class A\n  def b\n    c\n«end»\nend\n".replace("«end»", "    «end»"), "`end` at 4, 4 is not aligned with `def` at 2, 2."),
    ("Layout/EndAlignment", "if a\n  b\n  «end»\nmodule C\n  d\nend\n", "`end` at 3, 2 is not aligned with `if` at 1, 0."),
    ("Layout/BeginEndAlignment", "begin\n  a\n  «end»\n", "`end` at 3, 2 is not aligned with `begin` at 1, 0."),
    ("Layout/AccessModifierIndentation", "class A\n«private»\n\n  def b\n    1\n  end\nend\n", "Indent access modifiers like `private`."),
    ("Layout/BlockEndNewline", "a do\n  b «end»\nc do\n  d\nend\n", "Expression at 2, 5 should be on its own line."),
    ("Layout/CaseIndentation", "case a\n  «when» 1\n  b\nend\ncase c\nwhen 1\n  d\nend\n", "Indent `when` as deep as `case`."),
    ("Layout/ConditionPosition", "if\n  «a»\n  b\nend\nif c\n  d\nend\n", "Place the condition on the same line as `if`."),
    ("Layout/DotPosition", "a«.»\n  b\nc\n  .d\n", "Place the . on the next line, together with the method name."),
    ("Layout/ElseAlignment", "if a\n  b\n  «else»\n  c\nend\n", "Align `else` with `if`."),
    ("Layout/EmptyComment", "a\n«#»\nb\n# c\n#\n# d\n", "Source code comment is empty."),
    ("Layout/EmptyLineAfterGuardClause", "def a\n  «return if b»\n  c\nend\n\ndef d\n  return if e\n\n  f\nend\n", "Add empty line after guard clause."),
    ("Layout/EmptyLineAfterMultilineCondition", "if «a &&\n   b»\n  c\nend\n", "Use empty line after multiline condition."),
    ("Layout/EmptyLineBetweenDefs", "class A\n  def b\n    1\n  end\n  «def c»\n    1\n  end\n\n  def d\n    1\n  end\nend\n", "Expected 1 empty line between method definitions; found 0."),
    ("Layout/EmptyLinesAfterModuleInclusion", "class A\n  «include B»\n  c\nend\n", "Add an empty line after module inclusion."),
    ("Layout/EmptyLinesAroundAccessModifier", "class A\n  b\n\n  «private»\n  def c\n    1\n  end\nend\n", "Keep a blank line after `private`."),
    ("Layout/EmptyLinesAroundAttributeAccessor", "class A\n  «attr_reader :b»\n  def c\n    1\n  end\nend\n", "Add an empty line after attribute accessor."),
    ("Layout/EmptyLinesAroundExceptionHandlingKeywords", "begin\n  a\n«\n»rescue B\n  c\nend\n", "Extra empty line detected before the `rescue`."),
    ("Layout/ExtraSpacing", "a =« » 1\nbc  = 2\nd   = 3\ne = 'x  y' # z\n".replace("a =« » 1\nbc  = 2\nd   = 3\n", "a =« » 1\n\nbc  = 2\nd   = 3\n"), "Unnecessary spacing detected."),
    ("Layout/HeredocIndentation", "a = <<~TEXT\n«b\nTEXT»\n", "Use 2 spaces for indentation in a heredoc."),
    ("Layout/LeadingCommentSpace", "#!/usr/bin/env ruby\n«#a»\n# b\n#: c\n", "Missing space after `#`."),
    ("Layout/LineContinuationSpacing", "a = b«\\»\n  + 1\nc = d \\\n  + 1\n", "Use one space in front of backslash."),
    ("Layout/MultilineArrayLineBreaks", "a = [\n  1, «2»,\n  3\n]\n", "Each item in a multi-line array must start on a separate line."),
    ("Layout/MultilineMethodArgumentLineBreaks", "a(b, «c»,\n  d: 1)\ne(f,\n  g)\n", "Each argument in a multi-line method call must start on a separate line."),
    ("Layout/MultilineMethodParameterLineBreaks", "def a(b, «c»,\n      d)\n  1\nend\n", "Each parameter in a multi-line method definition must start on a separate line."),
    ("Layout/MultilineMethodDefinitionBraceLayout", "def a(b,\n      c\n«)»\n  1\nend\n", "Closing method definition brace must be on the same line as the last parameter when opening brace is on the same line as the first parameter."),
    ("Layout/ParameterAlignment", "def a(b,\n  «c»)\n  1\nend\n", "Align the parameters of a method definition if they span more than one line."),
    ("Layout/RescueEnsureAlignment", "begin\n  a\n  «rescue» B\n  c\nend\n", "`rescue` at 3, 2 is not aligned with `begin` at 1, 0."),
    ("Layout/SpaceAfterColon", "a = { b«:»1, c: 2 }\ndef d(e«:»1)\n  e\nend\n", "Space missing after colon."),
    ("Layout/SpaceAfterMethodName", "def a« »(b)\n  b\nend\n", "Do not put a space between a method name and the opening parenthesis."),
    ("Layout/SpaceAroundEqualsInParameterDefault", "def a(b«=»1, c = 2)\n  b + c\nend\n", "Surrounding space missing in default value assignment."),
    ("Layout/SpaceAroundKeyword", "a «if»(b)\n«while»(c)\n  d\nend\ne.if(1)\n", "Space after keyword `if` is missing.", "Space after keyword `while` is missing."),
    ("Layout/SpaceAroundMethodCallOperator", "a« .»b\nc.d\n", "Avoid using spaces around a method call operator."),
    ("Layout/SpaceAroundOperators", "a = b«+»c\nd«=»1\ne = f «&&»g\nh = i ** j\nk = i**j\n", "Surrounding space missing for operator."),
    ("Layout/SpaceBeforeBlockBraces", "a.b«{» c }\na.b { c }\n", "Space missing to the left of {."),
    ("Layout/SpaceBeforeFirstArg", "a«  »b\nc d\n", "Put one space between the method name and the first argument."),
    ("Layout/SpaceInLambdaLiteral", "a = «-> (b)» { b }\nc = ->(d) { d }\n", "Do not use spaces between `->` and `(` in lambda literals."),
    ("Layout/SpaceInsideArrayLiteralBrackets", "a = [« »1, 2« »]\nb = [1, 2]\nc = [\n  1\n]\n", "Space inside array brackets detected."),
    ("Layout/SpaceInsideArrayPercentLiteral", "a = %w[b«  »c d]\n", "Use only a single space inside array percent literal."),
    ("Layout/SpaceInsideBlockBraces", "a {«b» }\na { b«}»\na «{|»b| b }\na {« »}\na { b }\na {}\n", "Space missing inside {.", "Space missing inside }.", "Space between { and | missing.", "Space inside empty braces detected."),
    ("Layout/SpaceInsideParens", "a = («  »b + c« »)\nd(« »e)\nf(g)\n", "Space inside parentheses detected."),
    ("Layout/SpaceInsidePercentLiteralDelimiters", "a = %w[« »b c« »]\nd = %w[b c]\n", "Do not use spaces inside percent literal delimiters."),
    ("Layout/SpaceInsideRangeLiteral", "a = «1 .. 2»\nb = 1..2\n", "Space inside range literal."),
    ("Layout/SpaceInsideReferenceBrackets", "a[« »1« »]\nb[1]\n", "Space inside reference brackets detected."),
    ("Layout/SpaceInsideStringInterpolation", "a = \"#{« »b« »}\"\nc = \"#{d}\"\n", "Do not use space inside string interpolation."),
    ("Layout/EmptyLineAfterMagicComment", "# frozen_string_literal: true\n«a»\n", "Add an empty line after magic comments."),
    ("Lint/AmbiguousAssignment", "a «=-» 1\nb = -1\nc -= 1\n", "Suspicious assignment detected. Did you mean `-=`?"),
    ("Lint/AmbiguousBlockAssociation", "«a b { |c| c }»\na(b { |c| c })\n", "Parenthesize the param `b { |c| c }` to make sure that the block will be associated with the `b` method call."),
    ("Lint/AmbiguousOperator", "a «*»b\na «&»b\na «-»1\na(*b)\na - 1\n", "Ambiguous splat operator. Parenthesize the method arguments if it's surely a splat operator, or add a whitespace to the right of the `*` if it should be a multiplication.", "Ambiguous block operator. Parenthesize the method arguments if it's surely a block operator, or add a whitespace to the right of the `&` if it should be a binary AND.", "Ambiguous negative number operator. Parenthesize the method arguments if it's surely a negative number operator, or add a whitespace to the right of the `-` if it should be a subtraction."),
    ("Lint/AmbiguousOperatorPrecedence", "a + «b * c»\nd || «e && f»\ng + (h * i)\nj + k - l\n", "Wrap expressions with varying precedence with parentheses to avoid ambiguity."),
    ("Lint/ConstantOverwrittenInRescue", "begin\n  a\nrescue «=>» StandardError\n  b\nend\n", "`StandardError` is overwritten by `rescue =>`."),
    ("Lint/ConstantReassignment", "A = 1\nB = 2\n«A = 3»\n", "Constant is already assigned."),
    ("Lint/DataDefineOverride", "A = Data.define(«:hash», :b)\n", "`:hash` member overrides `Data#hash` and it may be unexpected."),
    ("Lint/StructNewOverride", "A = Struct.new(:b, «:count»)\n", "`:count` member overrides `Struct#count` and it may be unexpected."),
    ("Lint/DeprecatedConstants", "a = «NIL»\nb = nil\nc = X::TRUE\n", "Use `nil` instead of `NIL`, deprecated since Ruby 2.4."),
    ("Lint/DeprecatedOpenSSLConstant", "«OpenSSL::Digest::SHA256.new»\nOpenSSL::Digest.new('SHA256')\n", "Use `OpenSSL::Digest.new('SHA256')` instead of `OpenSSL::Digest::SHA256.new`."),
    ("Lint/DisjunctiveAssignmentInConstructor", "class A\n  def initialize\n    @b «||=» 1\n    c\n    @d ||= 2\n  end\nend\n", "Unnecessary disjunctive assignment. Use plain assignment."),
    ("Lint/DuplicateBranch", "if a\n  b\n«else»\n  b\nend\ncase c\nwhen 1\n  d\n«when 2\n  d»\nwhen 3\n  e\nend\n", "Duplicate branch body detected."),
    ("Lint/DuplicateElsifCondition", "if a\n  1\nelsif b\n  2\nelsif «a»\n  3\nend\n", "Duplicate `elsif` condition detected."),
    ("Lint/DuplicateMatchPattern", "case a\nin 1\n  b\nin «1»\n  c\nend\n", "Duplicate `in` pattern detected."),
    ("Lint/DuplicateMethods", "class A\n  def b\n    1\n  end\n\n  «def b»\n    2\n  end\n\n  def self.b\n    3\n  end\nend\n", "Method `A#b` is defined at both {path}:2 and {path}:6."),
    ("Lint/DuplicateRequire", "require 'a'\nrequire 'b'\n«require 'a'»\n", "Duplicate `require` detected."),
    ("Lint/FormatParameterMismatch", "«format»('%s %s', a)\nformat('%s %d%%', a, b)\n", "Number of arguments (1) to format string differs from number of fields (2)."),
    ("Lint/HashNewWithKeywordArgumentsAsDefault", "a = Hash.new(«b: 1»)\nc = Hash.new({ b: 1 })\n", "Use a hash literal instead of keyword arguments."),
    ("Lint/IneffectiveAccessModifier", "class A\n  private\n\n  «def» self.b\n    1\n  end\nend\n", "`private` (on line 2) does not make singleton methods private. Use `private_class_method` or `private` inside a `class << self` block instead."),
    ("Lint/LambdaWithoutLiteralBlock", "«lambda(&a)»\nlambda { 1 }\n", "lambda without a literal block is deprecated; use the proc without lambda instead."),
    ("Lint/MissingSuper", "class A < B\n  «def initialize\n    1\n  end»\nend\n\nclass C < D\n  def initialize\n    super\n  end\nend\n", "Call `super` to initialize state of the parent class."),
    ("Lint/MixedRegexpCaptureTypes", "a = «/(?<b>c)(d)/»\ne = /(f)(?:g)/\n", "Do not mix named captures and numbered captures in a Regexp literal."),
    ("Lint/NestedPercentLiteral", "a = «%w[%w(b) c]»\nd = %w[e f]\n", "Within percent literals, nested percent literals do not function and may be unwanted in the result."),
    ("Lint/NextWithoutAccumulator", "a.reduce(0) do |b, c|\n  «next» if c\n  b + c\nend\n", "Use `next` with an accumulator argument in a `reduce`."),
    ("Lint/NonDeterministicRequireOrder", "«Dir['*.rb'].each» { |a| require a }\nDir['*.rb'].sort.each { |a| require a }\n", "Sort files before requiring them."),
    ("Lint/NumericOperationWithConstantResult", "«a * 0»\na * 2\n", "Numeric operation with a constant result detected."),
    ("Lint/RedundantSafeNavigation", "A«&.»b\nc&.d\n", "Redundant safe navigation detected."),
    ("Lint/RedundantSplatExpansion", "a(«*[1, 2]»)\na(*b)\n", "Redundant splat expansion."),
    ("Lint/RedundantTypeConversion", "'a'.«to_s»\nb.to_s.«to_s»\nb.to_i\n", "Redundant `to_s` detected."),
    ("Lint/RequireParentheses", "«a? b && c»\na?(b) && c\n", "Use parentheses in the method call to avoid confusion about precedence."),
    ("Lint/RequireRelativeSelfPath", "«require_relative 'a'»\nrequire_relative 'b'\n", "Remove the `require_relative` that requires itself."),
    ("Lint/ShadowingOuterLocalVariable", "a = 1\nb.each { |«a»| p a }\nb.each { |c| p c }\n", "Shadowing outer local variable."),
    ("Lint/TripleQuotes", "a = «\"\"\"b\"\"\"»\nc = \"d\"\n", "Delimiting a string with multiple quotes has no effect, use a single quote instead."),
    ("Lint/UnderscorePrefixedVariableName", "a { |«_b»| p _b }\nc { |_d| p 1 }\n", "Do not use prefix `_` for a variable that is used."),
    ("Lint/UnescapedBracketInRegexp", "a = /b«]»/\nc = /[d]/\n", "Regular expression has `]` without escape."),
    ("Lint/UnexpectedBlockArity", "«a.reduce { |b| b }»\na.reduce { |b, c| b + c }\n", "`reduce` expects at least 2 positional arguments, got 1."),
    ("Lint/UnreachableLoop", "«while a\n  b\n  break\nend»\nwhile a\n  break if b\nend\n«loop { return 1 }»\n", "This loop will have at most one iteration."),
    ("Lint/UnusedBlockArgument", "a { |«b»| c }\nd { |e, «f»| e }\ng { |_h| i }\nj { |k| k }\n", "Unused block argument - `b`. You can omit the argument if you don't care about it.", "Unused block argument - `f`. If it's necessary, use `_` or `_f` as an argument name to indicate that it won't be used."),
    ("Lint/UselessAccessModifier", "class A\n  def b\n    1\n  end\n\n  «private»\nend\n", "Useless access modifier."),
    ("Lint/UselessConstantScoping", "class A\n  private\n\n  «B = 1»\n\n  def c\n    2\n  end\nend\n", "Useless `private` access modifier for constant scope."),
    ("Lint/UselessDefaultValueArgument", "a.fetch(:b, «c») { d }\na.fetch(:b) { d }\n", "Block supersedes default value argument."),
    ("Lint/UselessDefined", "p «defined?('A')»\np defined?(A)\n", "Calling `defined?` with a string argument will always return a truthy value."),
    ("Lint/UselessMethodDefinition", "class A\n  «def b\n    super\n  end»\n\n  def c\n    super\n    1\n  end\nend\n", "Useless method definition detected."),
    ("Lint/UselessNumericOperation", "p «a + 0»\np «a * 1»\np a + 1\n", "Do not apply inconsequential numeric operations to variables."),
    ("Lint/UselessOr", "a = b.to_s «|| c»\nd = b || c\n", "`c` will never evaluate because `b.to_s` always returns a truthy value."),
    ("Lint/UselessRescue", "begin\n  a\n«rescue B => e\n  raise e»\nend\nbegin\n  a\nrescue B\n  raise C\nend\n", "Useless `rescue` detected."),
    ("Lint/UselessSetterCall", "def a\n  b = C.new\n  «b».d = 1\nend\n", "Useless setter call to local variable `b`."),
    ("Lint/Void", "def a\n  b «==» c\n  «1»\n  d\nend\n", "Operator `==` used in void context.", "Literal `1` used in void context."),
    ("Naming/BlockParameterName", "a { |«bC», d| bC + d }\n", "Only use lowercase characters for block parameter."),
    ("Naming/MemoizedInstanceVariableName", "def a\n  «@b» ||= 1\nend\n\ndef c\n  @c ||= 1\nend\n", "Memoized variable `@b` does not match method name `a`. Use `@a` instead."),
    ("Bundler/DuplicatedGem", "gem 'a'\ngem 'b'\n«gem 'a', '1'»\n", "Gem `a` requirements already given on line 1 of the Gemfile.", "path=Gemfile"),
    ("Bundler/OrderedGems", "gem 'b'\n«gem 'a'»\n\ngem '0'\n", "Gems should be sorted in an alphabetical order within their section of the Gemfile. Gem `a` should appear before `b`.", "path=Gemfile"),
    ("Gemspec/OrderedDependencies", "Gem::Specification.new do |spec|\n  spec.add_dependency 'b'\n  «spec.add_dependency 'a'»\nend\n", "Dependencies should be sorted in an alphabetical order within their section of the gemspec. Dependency `a` should appear before `b`.", "path=a.gemspec"),
    ("Gemspec/DuplicatedAssignment", "Gem::Specification.new do |spec|\n  spec.name = 'a'\n  spec.x = 1\n  «spec.name = 'b'»\nend\n", "`name=` method calls already given on line 2 of the gemspec.", "path=a.gemspec"),
    ("Gemspec/DevelopmentDependencies", "Gem::Specification.new do |spec|\n  «spec.add_development_dependency 'a'»\n  spec.add_dependency 'b'\nend\n", "Specify development dependencies in Gemfile.", "path=a.gemspec"),
    ("Style/AccessModifierDeclarations", "class A\n  «private» def b\n    1\n  end\n\n  private :c\nend\n", "`private` should not be inlined in method definitions."),
    ("Style/Alias", "class A\n  «alias_method» :b, :c\n  alias d e\nend\n", "Use `alias` instead of `alias_method`."),
    ("Style/AmbiguousEndlessMethodDefinition", "«def a = 1 if b»\ndef c = 2\n", "Avoid using `if` statements with endless methods."),
    ("Style/ArrayCoercion", "a = «[*b]»\nc = [*b, 1]\n", "Use `Array(b)` instead of `[*b]`."),
    ("Style/BisectedAttrAccessor", "class A\n  attr_reader «:b», :c\n  attr_writer «:b»\nend\n", "Combine both accessors into `attr_accessor :b`."),
    ("Style/BlockDelimiters", "a.b «do» |c| d(c) end\ne.f { |g| g }\n", "Prefer `{...}` over `do...end` for single-line blocks."),
    ("Style/CollectionCompact", "a.«reject(&:nil?)»\na.compact\n", "Use `compact` instead of `reject(&:nil?)`."),
    ("Style/CollectionQuerying", "a.«count.positive?»\na.«count.zero?»\na.«count == 1»\na.count(1) == 1\n", "Use `any?` instead.", "Use `none?` instead.", "Use `one?` instead."),
    ("Style/ComparableBetween", "p «a >= 1 && a <= 9»\np a >= 1 && b <= 9\n", "Prefer `a.between?(1, 9)` over logical comparison."),
    ("Style/DigChain", "a.«dig(:b).dig(:c)»\na.dig(:b, :c)\n", "Use `dig(:b, :c)` instead of chaining."),
    ("Style/EachWithObject", "a.«inject»({}) { |b, c| b[c] = 1; b }\na.inject(0) { |b, c| b + c }\n", "Use `each_with_object` instead of `inject`."),
    ("Style/ExactRegexpMatch", "p «a =~ /\\Abc\\z/»\np a =~ /bc/\n", "Use `a == 'bc'`."),
    ("Style/ExpandPathArguments", "File.«expand_path»('..', __FILE__)\nFile.expand_path('a')\n", "Use `expand_path(__dir__)` instead of `expand_path('..', __FILE__)`."),
    ("Style/FileEmpty", "«File.zero?('a')»\nFile.empty?('a')\n", "Use `File.empty?('a')` instead."),
    ("Style/FileNull", "a = «'/dev/null'»\nb = '/dev/tty'\n", "Use `File::NULL` instead of `/dev/null`."),
    ("Style/FileRead", "File.«open('a').read»\nFile.read('a')\n", "Use `File.read`."),
    ("Style/FileWrite", "File.«open('a', 'w').write(b)»\nFile.write('a', b)\n", "Use `File.write`."),
    ("Style/FileTouch", "«File.open('a', 'a') {}»\nFile.open('a', 'a') { |f| f.write(1) }\n", "Use `FileUtils.touch('a')` instead of `File.open` in append mode with empty block."),
    ("Style/FloatDivision", "p «a.to_f / b.to_f»\np a.to_f / b\n", "Prefer using `.to_f` on one side only."),
    ("Style/GuardClause", "def a\n  «if» b\n    c\n    d\n  end\nend\n\ndef e\n  return unless b\n\n  c\nend\n", "Use a guard clause (`return unless b`) instead of wrapping the code inside a conditional expression."),
    ("Style/HashAsLastArrayItem", "a = [1, «b: 2»]\nc = [1, { b: 2 }]\n", "Wrap hash in `{` and `}`."),
    ("Style/HashConversion", "«Hash[a]»\n«Hash[1, 2]»\na.to_h\n", "Prefer `ary.to_h` to `Hash[ary]`.", "Prefer literal hash to `Hash[arg1, arg2, ...]`."),
    ("Style/HashLikeCase", "«case a\nwhen 'b'\n  1\nwhen 'c'\n  2\nwhen 'd'\n  3\nend»\ncase e\nwhen 'b'\n  1\nwhen 'c'\n  f\nwhen 'd'\n  3\nend\n", "Consider replacing `case-when` with a hash lookup."),
    ("Style/IfUnlessModifier", "«if» a\n  b\nend\nif c\n  d\nelse\n  e\nend\n", "Favor modifier `if` usage when having a single-line body. Another good alternative is the usage of control flow `&&`/`||`."),
    ("Style/IfWithBooleanLiteralBranches", "«if» a == b\n  true\nelse\n  false\nend\nif a\n  true\nelse\n  false\nend\n", "Remove redundant `if` with boolean literal branches."),
    ("Style/IfWithSemicolon", "«if a; b else c end»\nif a then b else c end\n", "Do not use `if a;` - use a ternary operator instead."),
    ("Style/ItAssignment", "«it» = 1\nb = it\n", "`it` is the default block parameter; consider another name."),
    ("Style/KeywordArgumentsMerging", "a(**«b.merge(c: 1)»)\na(**b, c: 1)\n", "Provide additional arguments directly rather than using `merge`."),
    ("Style/MapJoin", "a.«map(&:to_s)».join\na.join\n", "Remove redundant `map(&:to_s)` before `join`."),
    ("Style/MethodCallWithArgsParentheses", "def a\n  «b 1»\n  c(1)\nend\nd 2\n", "Use parentheses for method calls with arguments."),
    ("Style/MethodCalledOnDoEndBlock", "a do\n  b\n«end.c»\nd { e }.f\n", "Avoid chaining a method call on a do...end block."),
    ("Style/MinMaxComparison", "a = «b > c ? b : c»\nd = «b < c ? b : c»\n", "Use `[b, c].max` instead.", "Use `[b, c].min` instead."),
    ("Style/MixinGrouping", "class A\n  «include B, C»\n  include D\nend\n", "Put `include` mixins in separate statements."),
    ("Style/MultilineMemoization", "«a ||= (\n  b\n)»\nc ||= (d)\n", "Wrap multiline memoization blocks in `begin` and `end`."),
    ("Style/MultipleComparison", "a = 1\np «a == 1 || a == 2»\np a == 1 || b == 2\n", "Avoid comparing a variable with multiple items in a conditional, use `Array#include?` instead."),
    ("Style/NegativeArrayIndex", "«a[a.length - 2]»\na[b.length - 2]\n", "Use `a[-2]` instead of `a[a.length - 2]`."),
    ("Style/NestedParenthesizedCalls", "a(«b c»)\na(b(c))\n", "Add parentheses to nested method call `b c`."),
    ("Style/Next", "a.each do |b|\n  «if b»\n    c\n    d\n    e\n  end\nend\na.each do |b|\n  if b\n    c\n  end\nend\n", "Use `next` to skip iteration."),
    ("Style/OperatorMethodCall", "a«.»+ b\na + b\n", "Redundant dot detected."),
    ("Style/QuotedSymbols", "a = «:\"b c\"»\nd = :'e f'\n", "Prefer single-quoted symbols when you don't need string interpolation or special symbols."),
    ("Style/RedundantArgument", "a.join«('')»\na.join(',')\nb.split«(' ')»\n", "Argument '' is redundant because it is implied by default.", "Argument ' ' is redundant because it is implied by default."),
    ("Style/RedundantCondition", "«if a\n  a\nelse\n  b\nend»\n", "Use double pipes `||` instead."),
    ("Style/RedundantConstantBase", "a = «::»B\nmodule C\n  d = ::B\nend\n", "Remove redundant `::`."),
    ("Style/RedundantDoubleSplatHashBraces", "a(«**{ b: 1 }»)\na(**c)\n", "Remove the redundant double splat and braces, use keyword arguments directly."),
    ("Style/RedundantEach", "a.«each».each_with_index { |b, c| p b, c }\na.each_with_index { |b, c| p b, c }\n", "Remove redundant `each`."),
    ("Style/RedundantFilterChain", "a.«select { |b| b }.any?»\na.any? { |b| b }\n", "Use `any?` instead of `select.any?`."),
    ("Style/RedundantFormat", "a = «format('b')»\nc = format('%d', 1)\n", "Use `'b'` directly instead of `format`."),
    ("Style/RedundantHeredocDelimiterQuotes", "a = «<<~'TEXT'»\n  b\nTEXT\nc = <<~'TEXT'\n  #{d}\nTEXT\n", "Remove the redundant heredoc delimiter quotes, use `<<~TEXT` instead."),
    ("Style/RedundantInitialize", "class A\n  «def initialize\n  end»\nend\n\nclass B\n  def initialize\n    @c = 1\n  end\nend\n", "Remove unnecessary empty `initialize` method."),
    ("Style/RedundantMinMaxBy", "a.«max_by { |b| b }»\na.max_by { |b| -b }\n", "Use `max` instead of `max_by { |b| b }`."),
    ("Style/RedundantParentheses", "a = «(1)»\nb = (c + d)\n", "Don't use parentheses around a literal."),
    ("Style/RedundantPercentQ", "a = «%q(b)»\nc = %q('d' \"e\")\n", "Use `%q` only for strings that contain both single quotes and double quotes."),
    ("Style/RedundantRegexpArgument", "a.gsub(«/,/», '')\na.gsub(/[,;]/, '')\n", "Use string `','` as argument instead of regexp `/,/`."),
    ("Style/RedundantRegexpCharacterClass", "a = /b«[c]»/\nd = /[ef]/\n", "Redundant single-element character class, `[c]` can be replaced with `c`."),
    ("Style/RedundantRegexpConstructor", "a = «Regexp.new(/b/)»\nc = Regexp.new('d')\n", "Remove the redundant `Regexp.new`."),
    ("Style/SafeNavigationChainLength", "«a&.b&.c&.d»\na&.b&.c\n", "Avoid safe navigation chains longer than 2 calls."),
    ("Style/SelectByRegexp", "«a.select { |b| b =~ /c/ }»\na.grep(/c/)\n", "Prefer `grep` to `select` with a regexp match."),
    ("Style/SendWithLiteralMethodName", "a.«public_send(:b)»\na.public_send(c)\n", "Use `b` method call directly instead."),
    ("Style/TrailingBodyOnClass", "class A; «b»\nend\n", "Place the first line of class body on its own line."),
    ("Style/TrailingBodyOnModule", "module A; «b»\nend\n", "Place the first line of module body on its own line."),
    ("Style/TrailingBodyOnMethodDefinition", "def a; «b»\nend\n", "Place the first line of a multi-line method definition's body on its own line."),
    ("Style/TrailingCommaInBlockArgs", "a { |b, c«,»| b + c }\na { |b,| b }\n", "Useless trailing comma present in block arguments."),
    ("Style/TrailingMethodEndStatement", "def a\n  b «end»\n", "Place the end statement of a multi-line method on its own line."),
    ("Style/TrailingUnderscoreVariable", "a, «_» = b\n_, c = b\n", "Do not use trailing `_`s in parallel assignment. Prefer `a, = b`."),
    ("Style/YAMLFileRead", "YAML.«load(File.read(a))»\nYAML.load(b)\n", "Use `load_file(a)` instead."),
    ("Style/YodaExpression", "p «1 + a»\np a + 1\n", "Non-literal operand (`a`) should be first."),
    ("RSpec/EmptyExampleGroup", "«describe A do»\n  b\nend\ndescribe C do\n  it { d }\nend\n", "Empty example group detected.", "path=a_spec.rb"),
    ("RSpec/ExampleLength", "describe A do\n  «it 'b' do»\n" + "    c\n" * 16 + "  end\nend\n", "Example has too many lines. [16/15]", "path=a_spec.rb"),
    ("RSpec/MultipleExpectations", "describe A do\n  «it 'b' do»\n    expect(c).to d\n    expect(e).to f\n  end\nend\n", "Example has too many expectations.", "path=a_spec.rb"),
    ("RSpec/MultipleMemoizedHelpers", "«describe A do»\n" + "".join(f"  let(:b{k}) {{ {k} }}\n" for k in range(11)) + "  it { c }\nend\n", "Example group has too many memoized helpers.", "path=a_spec.rb"),
    ("RSpec/NestedGroups", "describe A do\n  context 'b' do\n    context 'c' do\n      context 'd' do\n        «context 'e' do»\n          it { f }\n        end\n      end\n    end\n  end\nend\n", "Maximum example group nesting exceeded.", "path=a_spec.rb"),
    ("RSpec/ScatteredSetup", "describe A do\n  before { b }\n  «before { c }»\n  it { d }\nend\n", "Do not scatter setup blocks throughout an example group.", "path=a_spec.rb"),
    ("Layout/CommentIndentation", "def a\n«# b»\n  c\n  # d\n  e\nend\n", "Incorrect indentation detected (column 0 instead of 2)."),
    ("Lint/CopDirectiveSyntax", "a «# rubocop:disable»\nb «# rubocop:disble Layout/LineLength»\nc # rubocop:disable Layout/LineLength, Style/Not -- why\n", "Malformed directive comment detected. The cop name is missing.", "Malformed directive comment detected. The mode name must be one of `enable`, `disable`, `todo`, `push`, or `pop`."),
    ("Lint/ElseLayout", "if a\n  b\nelse «c»\n  d\nend\n", "Odd `else` layout detected. Did you mean to use `elsif`?"),
    ("Lint/NumberConversion", "«a.to_i»\n«a.to_f»\nInteger(a, 10)\n", "Replace unsafe number conversion with number class parsing, instead of using `a.to_i`, use stricter `Integer(a, 10)`.", "Replace unsafe number conversion with number class parsing, instead of using `a.to_f`, use stricter `Float(a)`."),
    ("Lint/ParenthesesAsGroupedExpression", "a« »(b)\nc(d)\n", "`(b)` interpreted as grouped expression."),
    ("Metrics/ModuleLength", "«module A\n" + "  b\n" * 101 + "end»\n", "Module has too many lines. [101/100]"),
    ("Style/AccessorGrouping", "class A\n  «attr_reader :b»\n  «attr_reader :c»\n  attr_writer :d\nend\n", "Group together all `attr_reader` attributes."),
    ("Style/ClassMethodsDefinitions", "class A\n  «class << self\n    def b\n      1\n    end\n  end»\nend\n", "Do not define public methods within class << self."),
    ("Style/CombinableLoops", "a.each { |b| c(b) }\n«a.each { |b| d(b) }»\ne.each { |b| d(b) }\n", "Combine this loop with the previous loop."),
    ("Style/CommentAnnotation", "# «todo: »a\n# TODO: b\n# «FIXME »c\n# Note that d\n", "Annotation keywords like `todo` should be all upper case, followed by a colon, and a space, then a note describing the problem.", "Annotation keywords like `FIXME` should be all upper case, followed by a colon, and a space, then a note describing the problem."),
    ("Style/ConstantVisibility", "class A\n  «B = 1»\nend\n\nclass C\n  D = 1\n  private_constant :D\nend\n", "Explicitly make `B` public or private using either `#public_constant` or `#private_constant`."),
    ("Style/DirEmpty", "«Dir.children('a').empty?»\nDir.empty?('a')\n", "Use `Dir.empty?('a')` instead."),
    ("Style/Documentation", "«class A»\n  def b\n    1\n  end\nend\n\n# Told.\nclass C\n  def d\n    1\n  end\nend\n", "Missing top-level documentation comment for `class A`."),
    ("Style/EmptyHeredoc", "a = «<<~TEXT»\nTEXT\nb = ''\n", "Use an empty string literal instead of heredoc."),
    ("Style/Encoding", "«# encoding: utf-8»\na\n", "Unnecessary utf-8 encoding comment."),
    ("Style/EndlessMethod", "«def a = [\n  1\n]»\ndef b = 2\n", "Avoid endless method definitions with multiple lines."),
    ("Style/IdenticalConditionalBranches", "if a\n  b\n  «c»\nelse\n  d\n  «c»\nend\n", "Move `c` out of the conditional."),
    ("Style/IfInsideElse", "if a\n  1\nelse\n  «if» b\n    2\n  end\nend\n", "Convert `if` nested inside `else` to `elsif`."),
    ("Style/InvertibleUnlessCondition", "«p 1 unless a != b»\n«p 1 unless c.zero?»\np 1 unless d\n", "Prefer `if a == b` over `unless a != b`.", "Prefer `if c.nonzero?` over `unless c.zero?`."),
    ("Style/KeywordParametersOrder", "def a(«b: 1», c:)\n  b + c\nend\n\ndef d(e:, f: 1)\n  e + f\nend\n", "Place optional keyword parameters at the end of the parameters list."),
    ("Style/LineEndConcatenation", "a = 'b' «+»\n    'c'\nd = 'e' + f\n", "Use `\\` instead of `+` to concatenate multiline strings."),
    ("Style/MissingRespondToMissing", "class A\n  «def method_missing(name)\n    name\n  end»\nend\n", "When using `method_missing`, define `respond_to_missing?`."),
    ("Style/ModuleMemberExistenceCheck", "A.«instance_methods.include?(:b)»\nA.method_defined?(:b)\n", "Use `method_defined?(:b)` instead."),
    ("Style/MultilineBlockChain", "a.b do |c|\n  c\n«end.d» do |e|\n  e\nend\n", "Avoid multi-line chains of blocks."),
    ("Style/MultilineIfModifier", "«{\n  a: 1\n} if b»\n".replace("«{", "«c(\n  {").replace("} if", "  }\n) if"), "Favor a normal if-statement over a modifier clause in a multiline statement."),
    ("Style/MultilineWhenThen", "case a\nwhen 1 «then»\n  b\nwhen 2 then c\nend\n", "Do not use `then` for multiline `when` statement."),
    ("Style/MultilineInPatternThen", "case a\nin 1 «then»\n  b\nin 2 then c\nend\n", "Do not use `then` for multiline `in` statement."),
    ("Style/MultilineMethodSignature", "«def a(b,\n      c)»\n  b + c\nend\n", "Avoid multi-line method signatures."),
    ("Style/NegatedIfElseCondition", "a = «!b ? 1 : 2»\nif c\n  1\nelse\n  2\nend\n", "Invert the negated condition and swap the ternary branches."),
    ("Style/OneLineConditional", "«if a then b else c end»\na ? b : c\n", "Favor the ternary operator (`?:`) over single-line `if/then/else/end` constructs."),
    ("Style/PredicateWithKind", "«a.any? { |b| b.is_a?(C) }»\na.any?(C)\n", "Prefer `any?(C)` to `any? { ... }` with a kind check."),
    ("Style/RandomWithOffset", "«rand(6) + 1»\nrand(1..6)\n", "Prefer ranges when generating random numbers instead of integers with offsets."),
    ("Style/RedundantAssignment", "def a\n  «b = c»\n  b\nend\n", "Redundant assignment before returning detected."),
    ("Style/RedundantSelfAssignment", "a = []\na «=» a.concat(b)\na = b.concat(a)\n", "Redundant self assignment detected. Method `concat` modifies its receiver in place."),
    ("Style/RequireOrder", "require 'b'\n«require 'a'»\n\nrequire '0'\n", "Sort `require` in alphabetical order."),
    ("Style/ReturnNilInPredicateMethodDefinition", "def a?\n  «return» if b\n\n  true\nend\n", "Return `false` instead of `nil` in predicate methods."),
    ("Style/SingleLineBlockParams", "a.reduce { «|b, c|» b + c }\na.reduce { |acc, elem| acc + elem }\n", "Name `reduce` block params `|acc, elem|`."),
    ("Style/SingleLineDoEndBlock", "«a do |b| c(b) end»\nd { |e| f(e) }\n", "Prefer multiline `do`...`end` block."),
    ("Style/SingleLineMethods", "«def a; b; end»\ndef c; end\n", "Avoid single-line method definitions."),
    ("Style/SoleNestedConditional", "if a\n  «if» b\n    c\n  end\nend\n", "Consider merging nested conditions into outer `if` conditions."),
    ("Style/StaticClass", "«class A\n  def self.b\n    1\n  end\nend»\n\nclass C\n  def d\n    1\n  end\nend\n", "Prefer modules to classes with only class methods."),
    ("Style/StringConcatenation", "a = «'b' + c»\nd = 'e' + 'f'\n", "Prefer string interpolation to string concatenation."),
    ("Style/StringLiteralsInInterpolation", "a = \"#{b[«\"c\"»]}\"\nd = \"#{e['f']}\"\n", "Prefer single-quoted strings inside interpolations."),
    ("Style/UnlessLogicalOperators", "«p 1 unless a && b || c»\np 1 unless a && b\n", "Do not use mixed logical operators in an `unless`."),
    ("Style/WhileUntilModifier", "«while» a\n  b\nend\nc while d\n", "Favor modifier `while` usage when having a single-line body."),
    ("Lint/ErbNewArguments", "ERB.new(a, nil, «'-'»)\nERB.new(a, trim_mode: '-')\n", "Passing trim_mode with the 3rd argument of `ERB.new` is deprecated. Use keyword argument like `ERB.new(str, trim_mode: '-')` instead."),
    ("Lint/ItWithoutArgumentsInBlock", "a { «it» }\nb { it(1) }\n", "`it` calls without arguments will refer to the first block param in Ruby 3.4; use `it()` or `self.it`."),
    ("Bundler/GemComment", "# Told.\ngem 'a'\n«gem 'b'»\n", "Missing gem description comment.", "path=Gemfile"),
    ("Bundler/GemVersion", "«gem 'a'»\ngem 'b', '1'\n", "Gem version specification is required.", "path=Gemfile"),
    ("Bundler/DuplicatedGroup", "group :a do\n  gem 'b'\nend\n«group :a» do\n  gem 'c'\nend\n", "Gem group `:a` already defined on line 1 of the Gemfile.", "path=Gemfile"),
    ("Gemspec/DependencyVersion", "Gem::Specification.new do |spec|\n  «spec.add_dependency 'a'»\n  spec.add_dependency 'b', '1'\nend\n", "Dependency version specification is required.", "path=a.gemspec"),
    ("Style/SwapValues", "a = 1\nb = 2\n«c = a»\na = b\nb = c\n", "Replace this and assignments at lines 4 and 5 with `a, b = b, a`."),
    ("Style/SafeNavigation", "p «a && a.b»\n@c = 1\n«@c.d if @c»\np a && b.c\n", "Use safe navigation (`&.`) instead of checking if an object exists before calling the method."),
    ("Style/EvalWithLocation", "«A.class_eval 'b'»\n«eval 'c'»\nA.class_eval { d }\n", "Pass `__FILE__` and `__LINE__` to `class_eval`.", "Pass a binding, `__FILE__`, and `__LINE__` to `eval`."),
    ("Style/MagicCommentFormat", "# «frozen-string-literal»: true\n\na\n", "Prefer snake case for magic comments."),
    ("Style/HashTransformValues", "«a.map { |b, c| [b, c.d] }.to_h»\na.map { |b, c| [b, b.d(c)] }.to_h\n", "Prefer `transform_values` over `map {...}.to_h`."),
    ("Style/HashTransformKeys", "«a.map { |b, c| [b.d, c] }.to_h»\na.map { |b, c| [c, b] }.to_h\n", "Prefer `transform_keys` over `map {...}.to_h`."),
    ("Style/HashSlice", "a.«select { |b, c| b == :d }»\na.select { |b, c| c == :d }\n", "Use `slice(:d)` instead."),
    ("Style/ComparableClamp", "p «[[a, b].max, c].min»\np [a, b].max\n", "Use `Comparable#clamp` instead."),
    ("Style/ZeroLengthPredicate", "File.stat(a).size == 0\nStringIO.new('b').size.zero?\nc&.length > 0\nsize == 0\n«d&.size == 0»\n".replace("«d&.", "d&.«"), "Use `empty?` instead of `size == 0`."),
    ("Style/ZeroLengthPredicate", "Tempfile.new('a').length > 0\n::File.new('b').size != 0\nlength != 0\n"),
    ("Style/EmptyCaseCondition", "a = case\n    when b then 1\n    else return 2\n    end\nputs case\n     when c then 1\n     end\n"),
    ("Style/OperatorMethodCall", "a.+(@b).to_s\nA.+(b)\na.==(*c)\na.+(b, c)\n!a\n"),
    ("Style/DigChain", "a.dig.dig(:b, :c)\na.dig(b: 1).dig(c: 2)\na.dig({ b: 1 }).dig({ c: 2 })\na.dig(:b).first.dig(:c)\n"),
    ("Style/WhileUntilModifier", "while a\n  b if c\nend\nuntil a\n  b ? c : d\nend\nwhile (e = f)\n  g\nend\nwhile h\n  i while j\nend\n"),
    ("Style/WhileUntilModifier", "«until» a\n  b.c(1)\nend\nwhile a\n  # why\n  b\nend\n", "Favor modifier `until` usage when having a single-line body."),
    ("Naming/InclusiveLanguage", "«whitelist» = 1\nA_«BLACK_LIST» = :a_«slave»\n# a «white list», and a «whitelist»\nb = 'whitelist'\nenslaved = 1\n", "Consider replacing 'whitelist' with 'allowlist' or 'permit'.", "Consider replacing 'black_list' with 'denylist' or 'block'.", "Consider replacing 'slave' with 'replica', 'secondary', or 'follower'.", "Consider replacing 'white list' with 'allowlist' or 'permit'.", "Consider replacing 'whitelist' with 'allowlist' or 'permit'."),
    ("Layout/ArrayAlignment", "a = [1,\n  «2»,\n     3]\nb = [\n  1,\n  2\n]\nc = [1, 2,\n     3]\nd = [1,\n     2]\n", "Align the elements of an array literal if they span more than one line."),
    ("Layout/AssignmentIndentation", "a =\n«b + c»\nd =\n  e\n@f =\n    «g»\nh = [\n  1\n]\n", "Indent the first line of the right-hand-side of a multi-line assignment."),
    ("Layout/FirstArgumentIndentation", "a(\n«1»,\n2\n)\nb(\n  1,\n  2\n)\nc(1,\n  2)\nd e(\n    «f»\n  )\n".replace("d e(\n    «f»\n  )\n", ""), "Indent the first argument one step more than the start of the previous line."),
    ("Layout/FirstHashElementIndentation", "a = {\n    «b: 1»,\n    c: 2\n  «}»\nd = {\n  e: 1\n}\nf(g, {\n    h: 1\n  })\n", "Use 2 spaces for indentation in a hash, relative to the start of the line where the left curly brace is.", "Indent the right brace the same as the start of the line where the left brace is."),
    ("Layout/FirstParameterIndentation", "def a(\n«b»,\n  c\n)\n  1\nend\n\ndef d(\n  e\n)\n  1\nend\n", "Use 2 spaces for indentation in method args, relative to the start of the line where the left parenthesis is."),
    ("Layout/ClosingParenthesisIndentation", "a(\n  b\n  «)»\nc(\n  d\n)\ndef e(\n  f\n    «)»\n  1\nend\n", "Indent `)` to column 0 (not 2)", "Indent `)` to column 0 (not 4)"),
    ("Layout/BlockAlignment", "a.each do |b|\n  c(b)\n  «end»\nd { |e|\n  f(e)\n    «}»\ng.map do |h|\n  h\nend\ni = j do\n  k\nend\n", "`end` at 3, 2 is not aligned with `a.each do |b|` at 1, 0.", "`}` at 6, 4 is not aligned with `d { |e|` at 4, 0."),
    ("Layout/EmptyLineAfterGuardClause", "def a(b)\n  raise C, <<~TEXT unless b\n    text\n  TEXT\n  d\nend\n"),
]


def read(marked: str) -> tuple[str, list[tuple[int, int]]]:
    """The source and the offsets of its marked spans."""
    out, spans, opened = [], [], []
    at = 0
    for c in marked:
        if c == "«":
            opened.append(at)
        elif c == "»":
            spans.append((opened.pop(), at))
        else:
            out.append(c)
            at += 1
    return "".join(out), sorted(spans)


def expected() -> list[tuple[int, str, str, str, list[tuple[int, int, int, int, int, str]]]]:
    """(number, rule, path, source, [(line, column, last line, last column, length,
    message)]) of each example."""
    found = []
    for k, (rule, marked, *rest) in enumerate(EXAMPLES):
        path = next((r[5:] for r in rest if r.startswith("path=")), "a.rb")
        messages = [r for r in rest if not r.startswith("path=")]
        source, spans = read(marked)

        def place(at: int, source=source) -> tuple[int, int]:
            return source.count("\n", 0, at) + 1, at - source.rfind("\n", 0, at)

        def last(b: int, source=source) -> tuple[int, int]:
            """Where a span ends; one that takes a line's end along ends on the next."""
            return (place(b - 1)[0] + 1, 1) if source[b - 1] == "\n" else place(b - 1)

        rows = [(*place(a), *last(b), b - a, messages[min(i, len(messages) - 1)]) for i, (a, b) in enumerate(spans)]
        found.append((k, rule, path, source, rows))
    return found
