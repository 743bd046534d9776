"""Rules of the Lint department. Names and messages are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import span, tail, thru

#: Kinds of literals whose value never changes.
LITERAL = "'integer', 'float', 'rational', 'imaginary', 'string', 'symbol', 'true', 'false', 'nil', 'regular_expression', 'array', 'hash'"
BASIC = "'integer', 'float', 'rational', 'imaginary', 'symbol', 'true', 'false', 'nil'"
FLOATY = "({x}.kind = 'float' AND NOT {x}.src rlike '^-?0+(\\\\.0+)?$')"


def root(column: str, *names: str) -> str:
    """Whether a node is one of these constants, with or without ::."""
    return f"({column}.kind IN ('constant_read', 'constant_path') AND regexp_replace({column}.src, '^::', '') IN ({', '.join(repr(n) for n in names)}))"


STOPS = "b.kind IN ('return', 'break', 'next', 'redo', 'retry') AND coalesce(b.form, '') <> 'modifier' OR b.kind = 'call' AND b.name IN ('raise', 'fail', 'throw', 'exit', 'exit!', 'abort') AND NOT b.src rlike '[.]'"
COMPARE = "'==', '!=', '===', '<=>', '=~', '<', '>', '<=', '>=', '-', '/', '%', '&', '|', '^'"

RULES = (
    R("Lint/Syntax", "error", "true", "=concat('Syntax error: ', name, '.')"),
    R("Lint/BigDecimalNew", "call", f"name = 'new' AND {root('recv', 'BigDecimal')}", "`BigDecimal.new()` is deprecated. Use `BigDecimal()` instead.", "sel"),
    R("Lint/BinaryOperatorWithIdenticalOperands", "call and or", f"(kind IN ('and', 'or') AND get(kids, 0).src = get(kids, 1).src) OR (kind = 'call' AND form = 'binary' AND name IN ({COMPARE}) AND recv.src = a0.src AND recv.kind NOT IN ({BASIC}))", "=concat('Binary operator `', name, '` has identical operands.')"),
    R("Lint/BooleanSymbol", "symbol", "name IN ('true', 'false') AND open <> '%'", "=concat('Symbol with a boolean name - you probably meant to use `', name, '`.')", "if(open = 'label', sel, at)"),
    R("Lint/CircularArgumentReference", "optional_parameter optional_keyword_parameter", "val.name = name AND val.kind IN ('local_variable_read', 'call') AND val.src = name", "=concat('Circular argument reference - `', name, '`.')", "val.at"),
    R("Lint/ConstantDefinitionInBlock", "constant_write class module", "p.kind IN ('block', 'lambda') AND role = 'body' AND (pp.kind <> 'call' OR pp.name NOT IN ('enums')) OR p.kind = 'begin' AND pp.kind = 'block' AND role = 'body'", "Do not define constants this way within a block.", "CASE kind WHEN 'constant_write' THEN at ELSE at END"),
    R("Lint/Debugger", "call", "recv IS NULL AND name IN ('byebug', 'debugger', 'remote_byebug', 'save_and_open_page', 'save_and_open_screenshot', 'page!', 'jard') AND blk IS NULL OR recv.src IN ('binding', 'Kernel.binding') AND name IN ('pry', 'irb', 'break', 'b', 'remote_pry', 'pry_remote', 'console') OR recv.src IN ('Pry') AND name = 'rescue' OR recv IS NULL AND name = 'require' AND a0.kind = 'string' AND a0.name IN ('debug/open', 'debug/start')", "=concat('Remove debugger entry point `', src, '`.')"),
    R("Lint/DeprecatedClassMethods", "call", f"{root('recv', 'File', 'Dir')} AND name = 'exists?'", "=concat('`', recv.src, '.exists?` is deprecated in favor of `', recv.src, '.exist?`.')", thru("recv.at", "sel")),
    R("Lint/DeprecatedClassMethods", "call", "recv IS NULL AND name = 'iterator?' AND argc = 0", "`iterator?` is deprecated in favor of `block_given?`.", "sel"),
    R("Lint/DeprecatedClassMethods", "call", "recv.src IN ('ENV', '::ENV') AND name = 'freeze'", "=concat('`', recv.src, '.freeze` is deprecated in favor of `', recv.src, '`.')"),
    R("Lint/DeprecatedClassMethods", "call", "recv.src IN ('ENV', '::ENV') AND name IN ('clone', 'dup')", "=concat('`', recv.src, '.', name, '` is deprecated in favor of `', recv.src, '.to_h`.')"),
    R("Lint/DuplicateCaseCondition", "case", "exists(filter(kids2, k -> k.role = 'cond'), k -> size(filter(filter(kids2, k2 -> k2.role = 'cond'), k2 -> k2.src = k.src)) > 1)", "Duplicate `when` condition detected.", "transform(filter(transform(filter(kids2, k -> k.role = 'cond'), (k, i) -> named_struct('k', k, 'i', i)), x -> exists(slice(filter(kids2, k -> k.role = 'cond'), 1, x.i), y -> y.src = x.k.src)), x -> x.k.at)", many=True),
    R("Lint/DuplicateHashKey", "hash keyword_hash", "exists(filter(kids2, k -> k.role = 'key' AND k.kind IN ('symbol', 'string', 'integer', 'float', 'true', 'false', 'nil', 'constant_read')), k -> size(filter(kids2, k2 -> k2.role = 'key' AND k2.kind = k.kind AND coalesce(k2.name, k2.src) = coalesce(k.name, k.src))) > 1)", "Duplicated key in hash literal.", "transform(filter(transform(filter(kids2, k -> k.role = 'key'), (k, i) -> named_struct('k', k, 'i', i)), x -> x.k.kind IN ('symbol', 'string', 'integer', 'float', 'true', 'false', 'nil', 'constant_read') AND exists(slice(filter(kids2, k -> k.role = 'key'), 1, x.i), y -> y.kind = x.k.kind AND coalesce(y.name, y.src) = coalesce(x.k.name, x.k.src))), x -> if(x.k.open like 'label%', x.k.sel, x.k.at))", many=True),
    R("Lint/DuplicateSetElement", "call", "name = '[]' AND recv.src IN ('Set', '::Set', 'SortedSet', '::SortedSet')", "=concat('Remove the duplicate element in ', regexp_replace(recv.src, '^::', ''), '.')", f"transform(filter(transform(args, (k, i) -> named_struct('k', k, 'i', i)), x -> x.k.kind IN ({BASIC}, 'string', 'constant_read', 'local_variable_read') AND exists(slice(args, 1, x.i), y -> y.src = x.k.src)), x -> x.k.at)", many=True),
    R("Lint/DuplicateSetElement", "call", "name = 'new' AND recv.src IN ('Set', '::Set', 'SortedSet', '::SortedSet') AND a0.kind = 'array' OR name = 'to_set' AND recv.kind = 'array'", "=concat('Remove the duplicate element in ', if(name = 'new', regexp_replace(recv.src, '^::', ''), 'Set'), '.')", f"transform(filter(transform(filter(kids2, k -> k.role = 'element'), (k, i) -> named_struct('k', k, 'i', i)), x -> x.k.kind IN ({BASIC}, 'string', 'constant_read', 'local_variable_read') AND exists(slice(filter(kids2, k -> k.role = 'element'), 1, x.i), y -> y.src = x.k.src)), x -> x.k.at)", many=True),
    R("Lint/SymbolConversion", "call", "name IN ('to_sym', 'intern') AND argc = 0 AND recv.kind IN ('symbol', 'string', 'interpolated_string') AND recv.open IN (':', '\\'', '\"') AND recv.form IS NULL", "=concat('Unnecessary symbol conversion; use `', if(recv.kind = 'interpolated_string' OR NOT recv.name rlike '^[a-zA-Z_][a-zA-Z0-9_]*[?!=]?$', concat(':\"', if(recv.kind = 'symbol', recv.name, substr(recv.src, 2, length(recv.src) - 2)), '\"'), concat(':', recv.name)), '` instead.')"),
    R("Lint/SymbolConversion", "symbol", "open IN (':\"', ':\\'') AND name rlike '^[a-zA-Z_][a-zA-Z0-9_]*[?!]?$'", "=concat('Unnecessary symbol conversion; use `:', name, '` instead.')"),
    R("Lint/SymbolConversion", "symbol", "open IN ('label\"', 'label\\'') AND name rlike '^[a-zA-Z_][a-zA-Z0-9_]*[?!]?$'", "=concat('Unnecessary symbol conversion; use `', name, ':` instead.')", "sel"),
    R("Lint/EachWithObjectArgument", "call", f"name = 'each_with_object' AND argc = 1 AND a0.kind IN ({BASIC})", "The argument to each_with_object cannot be immutable."),
    R("Lint/EmptyBlock", "call super forwarding_super", r"blk.kind = 'block' AND blk.src rlike '^([{]|do)\\s*([|][^|]*[|])?\\s*([}]|end)$'", "Empty block detected."),
    R("Lint/EmptyClass", "class", r"nbody = 0 AND get(filter(kids, k -> k.role = 'superclass'), 0) IS NULL AND src rlike '^class\\s+[\\w:]+\\s*;?\\s*end$'", "Empty class detected."),
    R("Lint/EmptyConditionalBody", "if unless", r"coalesce(form, '') NOT IN ('modifier', 'ternary') AND nbody = 0 AND els IS NULL AND src rlike '^(if|unless|elsif)[ (][^#]*$'", "=concat('Avoid `', open, '` branches without a body.')"),
    R("Lint/EmptyEnsure", "ensure", "nbody = 0 AND form IS NULL", "Empty `ensure` block detected.", "sel"),
    R("Lint/EmptyExpression", "parentheses", "size(kids) = 0", "Avoid empty expressions."),
    R("Lint/EmptyInPattern", "in", "nbody = 0 AND form IS NULL", "Avoid `in` branches without a body."),
    R("Lint/EmptyInterpolation", "embedded_statements", "size(kids) = 0", "Empty interpolation detected."),
    R("Lint/EmptyWhen", "when", "nbody = 0 AND form IS NULL", "Avoid `when` branches without a body."),
    R("Lint/EnsureReturn", "return", "exists(up, u -> u.kind = 'ensure') AND NOT exists(slice(up, 1, array_position(transform(up, u -> u.kind), 'ensure')), u -> u.kind IN ('def', 'lambda', 'block'))", "Do not return from an `ensure` block."),
    R("Lint/FlipFlop", "range", f"role = 'cond' AND p.kind IN ('if', 'unless') AND get(kids, 0).kind NOT IN ({BASIC}) AND get(kids, 1).kind NOT IN ({BASIC})", "Avoid the use of flip-flop operators."),
    R("Lint/FloatComparison", "call", f"name IN ('==', '!=', 'eql?', 'equal?') AND argc = 1 AND recv IS NOT NULL AND recv.kind <> 'nil' AND a0.kind <> 'nil' AND NOT coalesce(recv.src rlike '^-?0+([.]0+)?$', false) AND NOT a0.src rlike '^-?0+([.]0+)?$' AND ({FLOATY.format(x='recv')} OR {FLOATY.format(x='a0')} OR recv.name IN ('to_f', 'Float', 'fdiv') AND recv.kind = 'call' OR a0.name IN ('to_f', 'Float', 'fdiv') AND a0.kind = 'call' OR recv.form = 'binary' AND recv.name IN ('+', '-', '*', '/', '**', '%') AND exists(rk, k -> k.kind = 'float') OR a0.form = 'binary' AND a0.name IN ('+', '-', '*', '/', '**', '%') AND exists(filter(kids2, k -> k.of = 1), k -> k.kind = 'float'))", "=concat('Avoid ', if(name = '!=', 'inequality', 'equality'), ' comparisons of floats as they are unreliable.')"),
    R("Lint/FloatComparison", "when", f"exists(kids, k -> k.role = 'cond' AND {FLOATY.format(x='k')})", "Avoid float literal comparisons in case statements as they are unreliable.", f"transform(filter(kids, k -> k.role = 'cond' AND {FLOATY.format(x='k')}), k -> k.at)", many=True),
    R("Lint/FloatOutOfRange", "float", "try_cast(replace(name, '_', '') AS double) = double('Infinity') OR try_cast(replace(name, '_', '') AS double) = 0 AND regexp_extract(name, '^[^eE]*', 0) rlike '[1-9]'", "Float out of range."),
    R("Lint/HashCompareByIdentity", "call", "name IN ('key?', 'has_key?', 'fetch', '[]', '[]=') AND recv IS NOT NULL AND a0.kind = 'call' AND a0.name = 'object_id'", "Use `Hash#compare_by_identity` instead of using `object_id` for keys."),
    R("Lint/IdentityComparison", "call", "name IN ('==', '!=') AND recv.kind = 'call' AND recv.name = 'object_id' AND a0.kind = 'call' AND a0.name = 'object_id' AND recv.n > 0 AND a0.n > 0", "=concat('Use `', if(name = '!=', '!', ''), 'equal?` instead of `', name, '` when comparing `object_id`.')"),
    R("Lint/ImplicitStringConcatenation", "interpolated_string", "form = 'adjacent' AND size(kids) = 2 AND get(kids, 0).at.last_line = get(kids, 1).at.line", "=concat('Combine ', get(kids, 0).src, ' and ', get(kids, 1).src, ' into a single string literal, rather than using implicit string concatenation.')", thru("get(kids, 0).at", "get(kids, 1).at")),
    R("Lint/InheritException", "class", f"exists(kids, k -> k.role = 'superclass' AND {root('k', 'Exception')})", "Inherit from `StandardError` instead of `Exception`.", "get(filter(kids, k -> k.role = 'superclass'), 0).at"),
    R("Lint/InheritException", "call", f"name = 'new' AND {root('recv', 'Class')} AND {root('a0', 'Exception')}", "Inherit from `StandardError` instead of `Exception`.", "a0.at"),
    R("Lint/InterpolationCheck", "string", r"open = '\'' AND name rlike '[#][{][^}]+[}]'", "Interpolation in single quoted string detected. Use double quoted strings if you need interpolation."),
    R("Lint/LiteralAsCondition", "if unless while until", f"cond.kind IN ({LITERAL}) AND NOT (kind IN ('while') AND cond.kind = 'true') AND NOT (kind = 'until' AND cond.kind = 'false') AND cond.kind <> 'regular_expression'", "=concat('Literal `', cond.src, '` appeared as a condition.')", "cond.at"),
    R("Lint/LiteralInInterpolation", "embedded_statements", f"size(kids) = 1 AND get(kids, 0).kind IN ({BASIC}, 'string') AND get(kids, 0).src <> '\"\"' AND NOT (get(kids, 0).kind = 'string' AND trim(get(kids, 0).name) = '')", "Literal interpolation detected.", "get(kids, 0).at"),
    R("Lint/Loop", "while until", "form = 'modifier' AND b0.kind = 'begin'", "Use `Kernel#loop` with `break` rather than `begin/end/until`(or `while`).", "sel"),
    R("Lint/MixedCaseRange", "range", "get(kids, 0).kind = 'string' AND get(kids, 1).kind = 'string' AND (get(kids, 0).name rlike '^[A-Z]$' AND get(kids, 1).name rlike '^[a-z]$')", "Ranges from upper to lower case ASCII letters may include unintended characters. Instead of `A-z` (which also includes several symbols) specify each range individually: `A-Za-z` and individually specify any symbols."),
    R("Lint/MultipleComparison", "call", "name IN ('<', '>', '<=', '>=') AND recv.kind = 'call' AND recv.name IN ('<', '>', '<=', '>=') AND recv.form = 'binary'", "Use the `&&` operator to compare multiple values."),
    R("Lint/NestedMethodDefinition", "def", "scope.kind = 'def' AND recv IS NULL AND NOT exists(slice(up, 1, array_position(transform(up, u -> u.kind), 'def')), u -> u.kind = 'call' AND u.name IN ('class_eval', 'module_eval', 'instance_eval', 'class_exec', 'module_exec', 'instance_exec', 'new', 'define') OR u.kind = 'lambda')", "Method definitions must not be nested. Use `lambda` instead."),
    R("Lint/NumberedParameterAssignment", "local_variable_write", "name rlike '^_[0-9]+$'", "=if(name rlike '^_[1-9]$', concat('`', name, '` is reserved for numbered parameter; consider another name.'), concat('`', name, '` is similar to numbered parameter; consider another name.'))"),
    R("Lint/OrAssignmentToConstant", "constant_or_write constant_path_or_write", "true", "Avoid using or-assignment with constants.", "oper.at"),
    R("Lint/PercentStringArray", "array", r"open rlike '^%[wW]' AND exists(kids, k -> k.name rlike '^[\'\"].*[\'\"]$|[^,],$')", "Within `%w`/`%W`, quotes and ',' are unnecessary and may be unwanted in the resulting strings."),
    R("Lint/PercentSymbolArray", "array", "open rlike '^%[iI]' AND exists(kids, k -> k.name rlike '^:.|.,$')", "Within `%i`/`%I`, ':' and ',' are unnecessary and may be unwanted in the resulting symbols."),
    R("Lint/RaiseException", "call", f"recv IS NULL AND name IN ('raise', 'fail') AND {root('a0', 'Exception')}", "Use `StandardError` over `Exception`.", "a0.at"),
    R("Lint/RaiseException", "call", f"recv IS NULL AND name IN ('raise', 'fail') AND a0.name = 'new' AND exists(kids2, k -> k.of = 0 AND k.role = 'recv' AND {root('k', 'Exception')})", "Use `StandardError` over `Exception`.", "get(filter(kids2, k -> k.of = 0 AND k.role = 'recv'), 0).at"),
    R("Lint/RandOne", "call", "name = 'rand' AND (recv IS NULL OR recv.src IN ('Kernel', '::Kernel')) AND argc = 1 AND a0.src IN ('1', '-1', '1.0', '-1.0')", "=concat('`', src, '` always returns `0`. Perhaps you meant `rand(2)` or `rand`?')"),
    R("Lint/RedundantRequireStatement", "call", "recv IS NULL AND name = 'require' AND a0.kind = 'string' AND a0.name IN ('enumerator', 'thread', 'rational', 'complex', 'ruby2_keywords')", "Remove unnecessary `require` statement."),
    R("Lint/RedundantStringCoercion", "embedded_statements", "get(kids, size(kids) - 1).kind = 'call' AND get(kids, size(kids) - 1).name = 'to_s' AND get(kids, size(kids) - 1).n = 1 AND exists(kids2, k -> k.of = size(kids) - 1 AND k.role = 'recv')", "Redundant use of `Object#to_s` in interpolation.", "get(kids, size(kids) - 1).sel"),
    R("Lint/RedundantStringCoercion", "call", "recv IS NULL AND name IN ('print', 'puts', 'warn')", "=concat('Redundant use of `Object#to_s` in `', name, '`.')", "transform(filter(args, a -> a.kind = 'call' AND a.name = 'to_s' AND a.n = 1 AND coalesce(a.form, '') <> 'name' AND a.sel.start > a.at.start), a -> a.sel)", many=True),
    R("Lint/RedundantWithIndex", "call", "name = 'each_with_index' AND recv IS NOT NULL AND blk.kind = 'block' AND exists(bk, k -> k.role = 'params' AND k.n = 1)", "Use `each` instead of `each_with_index`.", "sel"),
    R("Lint/RedundantWithObject", "call", "name = 'each_with_object' AND recv IS NOT NULL AND argc = 1 AND blk.kind = 'block' AND exists(bk, k -> k.role = 'params' AND k.n = 1)", "Use `each` instead of `each_with_object`.", thru("sel", "a0.at").replace("a0.at.end", "a0.at.end + if(open = '(', 1, 0)").replace("a0.at.last_column", "a0.at.last_column + if(open = '(', 1, 0)")),
    R("Lint/RegexpAsCondition", "regular_expression interpolated_regular_expression", "role = 'cond' AND p.kind IN ('if', 'unless', 'while', 'until')", "Do not use regexp literal as a condition. The regexp literal matches `$_` implicitly."),
    R("Lint/RescueException", "rescue", f"exists(kids, k -> k.role = 'class' AND {root('k', 'Exception')})", "Avoid rescuing the `Exception` class. Perhaps you meant to rescue `StandardError`?"),
    R("Lint/ReturnInVoidContext", "return", "size(kids) > 0 AND scope.kind = 'def' AND (scope.name = 'initialize' OR scope.name rlike '[a-z0-9_]=$')", "=concat('Do not return a value in `', scope.name, '`.')", "sel"),
    R("Lint/SafeNavigationWithEmpty", "call", "name = 'empty?' AND op = '&.' AND role = 'cond'", "Avoid calling `empty?` with the safe navigation operator in conditionals."),
    R("Lint/SelfAssignment", "local_variable_write instance_variable_write class_variable_write global_variable_write", "val.name = name AND val.kind = replace(kind, '_write', '_read')", "Self-assignment detected."),
    R("Lint/SendWithMixinArgument", "call", "name IN ('send', 'public_send', '__send__') AND recv IS NOT NULL AND argc > 1 AND a0.kind IN ('symbol', 'string') AND a0.name IN ('include', 'prepend', 'extend')", "=concat('Use `', a0.name, ' ', array_join(transform(slice(args, 2, argc), a -> a.src), ', '), '` instead of `', substr(src, sel.start - at.start + 1), '`.')", thru("sel", "at")),
    R("Lint/SharedMutableDefault", "call", f"name = 'new' AND {root('recv', 'Hash')} AND blk IS NULL AND argc = 1 AND (a0.kind IN ('array', 'hash') OR a0.src IN ('Array.new', 'Hash.new', 'String.new'))", "Do not create a Hash with a mutable default value as the default value can accidentally be changed."),
    R("Lint/SuppressedException", "rescue", "nbody = 0 AND form IS NULL", "Do not suppress exceptions."),
    R("Lint/ToJSON", "def", "name = 'to_json' AND (params IS NULL OR params.n = 0) AND recv IS NULL", "`#to_json` requires an optional argument to be parsable via JSON.generate(obj)."),
    R("Lint/TopLevelReturnWithArgument", "return", "size(kids) > 0 AND scope.kind = 'program' AND NOT exists(up, u -> u.kind IN ('block', 'lambda'))", "Top level return with argument detected."),
    R("Lint/UnifiedInteger", "constant_read constant_path", "(kind = 'constant_read' OR open = '::') AND name IN ('Fixnum', 'Bignum')", "=concat('Use `Integer` instead of `', name, '`.')"),
    R("Lint/UnreachableCode", "program def class module singleton_class block begin else if unless while until when lambda rescue ensure", f"nbody > 1 AND exists(slice(body, 1, nbody - 1), b -> {STOPS})", "Unreachable code detected.", f"transform(filter(transform(body, (b, i) -> named_struct('b', b, 'i', i)), x -> x.i > 0 AND exists(slice(body, x.i, 1), b -> {STOPS})), x -> x.b.at)", many=True),
    R("Lint/UriEscapeUnescape", "call", f"{root('recv', 'URI')} AND name IN ('escape', 'encode', 'unescape', 'decode')", "=concat('`', recv.src, '.', name, '` method is obsolete and should not be used. Instead, use `CGI.', if(name IN ('escape', 'encode'), 'escape`, `URI.encode_www_form` or `URI.encode_www_form_component`', 'unescape`, `URI.decode_www_form` or `URI.decode_www_form_component`'), ' depending on your specific use case.')"),
    R("Lint/UriRegexp", "call", f"{root('recv', 'URI')} AND name = 'regexp'", "=concat('`', recv.src, '.regexp` is obsolete and should not be used. Instead, use `', recv.src, '::DEFAULT_PARSER.make_regexp`.')", "sel"),
    R("Lint/UselessTimes", "call", "name = 'times' AND recv.kind = 'integer' AND try_cast(recv.name AS int) <= 1", "=concat('Useless call to `', recv.src, '.times` detected.')"),
    R("Lint/AssignmentInCondition", "local_variable_write instance_variable_write class_variable_write global_variable_write", "role = 'cond' AND p.kind IN ('if', 'unless', 'while', 'until') AND coalesce(p.form, '') <> 'ternary'", "Use `==` if you meant to do a comparison or wrap the expression in parentheses to indicate you meant to assign in a condition.", "oper.at"),
    R("Lint/AmbiguousRange", "range", "true", "Wrap complex range boundaries with parentheses to avoid ambiguity.", f"transform(filter(kids, k -> k.role IN ('left', 'right') AND (k.kind IN ('and', 'or') OR k.kind = 'call' AND (coalesce(k.form, '') = 'binary' OR k.src rlike '^\\\\d+[.][a-z_]') OR k.kind = 'if')), k -> k.at)", many=True),
    R("Lint/TrailingCommaInAttributeDeclaration", "call", "recv IS NULL AND name IN ('attr_reader', 'attr_writer', 'attr_accessor', 'attr') AND exists(kids, k -> k.role = 'arg' AND k.kind = 'def')", "Avoid leaving a trailing comma in attribute declarations.", tail("get(args, argc - 2).at.end", "get(args, argc - 2).at.end + 1", "get(args, argc - 2).at")),
    R("Lint/UselessElseWithoutRescue", "begin def", "els.kind = 'else' AND NOT exists(kids, k -> k.role = 'rescue')", "`else` without `rescue` is useless.", "els.sel"),
)
