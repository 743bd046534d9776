"""Rules of the Style department. Names, messages, preferred names and limits are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import span, tail, thru
from sleuthframe.rules.lint import BASIC, root

DOT = "named_struct('start', recv.at.end, 'end', sel.end, 'line', recv.at.last_line, 'column', recv.at.last_column + 1, 'last_line', sel.last_line, 'last_column', sel.last_column)"
CALL = "named_struct('start', recv.at.start, 'end', sel.end, 'line', recv.at.line, 'column', recv.at.column, 'last_line', sel.last_line, 'last_column', sel.last_column)"
#: From the selector of the receiver to the end of the call, and to its own selector.
RECV_ON, RECV_SEL = thru("recv.sel", "at"), thru("recv.sel", "sel")
FROM_SEL = thru("sel", "at")
SEL_SRC = "substr(src, sel.start - at.start + 1)"
RECV_SRC = "substr(src, recv.sel.start - at.start + 1)"
PLAIN_WRITE = "local_variable_write instance_variable_write class_variable_write global_variable_write"
GLOBALS = "'$:', '$LOAD_PATH', '$\"', '$LOADED_FEATURES', '$0', '$PROGRAM_NAME', '$!', '$ERROR_INFO', '$@', '$ERROR_POSITION', '$;', '$FS', '$FIELD_SEPARATOR', '$,', '$OFS', '$OUTPUT_FIELD_SEPARATOR', '$/', '$RS', '$INPUT_RECORD_SEPARATOR', '$\\\\', '$ORS', '$OUTPUT_RECORD_SEPARATOR', '$.', '$NR', '$INPUT_LINE_NUMBER', '$_', '$LAST_READ_LINE', '$>', '$DEFAULT_OUTPUT', '$<', '$DEFAULT_INPUT', '$$', '$PID', '$PROCESS_ID', '$?', '$CHILD_STATUS', '$~', '$LAST_MATCH_INFO', '$=', '$IGNORECASE', '$*', '$ARGV', '$&', '$MATCH', '$`', '$PREMATCH', '$\\'', '$POSTMATCH', '$+', '$LAST_PAREN_MATCH', '$stdin', '$stdout', '$stderr', '$DEBUG', '$FILENAME', '$VERBOSE', '$SAFE', '$-0', '$-a', '$-d', '$-F', '$-i', '$-I', '$-l', '$-p', '$-v', '$-w', '$CLASSPATH', '$JRUBY_VERSION', '$JRUBY_REVISION', '$ENV_JAVA'"
#: Names of global variables that the English library gives.
ENGLISH = {"$!": "$ERROR_INFO", "$@": "$ERROR_POSITION", "$;": "$FIELD_SEPARATOR", "$,": "$OUTPUT_FIELD_SEPARATOR", "$/": "$INPUT_RECORD_SEPARATOR", "$.": "$INPUT_LINE_NUMBER", "$_": "$LAST_READ_LINE", "$>": "$DEFAULT_OUTPUT", "$<": "$DEFAULT_INPUT", "$$": "$PROCESS_ID", "$?": "$CHILD_STATUS", "$~": "$LAST_MATCH_INFO"}
ENGLISH_2 = {"$;": "$FS", "$,": "$OFS", "$/": "$RS", "$.": "$NR", "$$": "$PID"}
COLLECTION = {"collect": "map", "collect!": "map!", "collect_concat": "flat_map", "inject": "reduce", "detect": "find", "find_all": "select", "member?": "include?"}
INVERSE = {"any?": "none?", "even?": "odd?", "present?": "blank?", "include?": "exclude?", "==": "!=", "=~": "!~", "<": ">=", ">": "<="}
INVERSE |= {v: k for k, v in INVERSE.items()}


#: What the terms on one side of an `and` ask for with defined?.
DEFINED = "transform(filter(concat(array(get(kids, {i})), filter(kids2, k -> k.of = {i})), k -> k.kind = 'defined'), k -> regexp_extract(k.src, '^defined[?][( ](.*?)[)]?$', 1))"


def table(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


NUMBER_SRC = "regexp_replace(name, '[-_]', '')"
WORDY = "(?U)^(\\\\w|\\\\w-\\\\w|\\\\n|\\\\t)+$"

RULES = (
    R("Style/AndOr", "and or", "name IN ('and', 'or') AND role = 'cond'", "=concat('Use `', if(name = 'and', '&&', '||'), '` instead of `', name, '`.')", "sel", fix="if(name = 'and', '&&', '||')"),
    R("Style/ArrayFirstLast", "call", "name = '[]' AND form = 'index' AND argc = 1 AND a0.src IN ('0', '-1') AND NOT (role = 'recv' AND p.kind = 'call' AND p.name = '[]') AND NOT (recv.kind = 'call' AND recv.name = '[]') AND recv.kind <> 'constant_read'", "=concat('Use `', if(a0.src = '0', 'first', 'last'), '`.')", "sel", fix="if(a0.src = '0', '.first', '.last')"),
    R("Style/ArrayIntersectWithSingleElement", "call", "name = 'intersect?' AND argc = 1 AND a0.kind = 'array' AND a0.n = 1 AND open = '('", "Use `include?(element)` instead of `intersect?([element])`.", FROM_SEL),
    R("Style/ArrayJoin", "call", "name = '*' AND recv.kind = 'array' AND a0.kind = 'string'", "Favor `Array#join` over `Array#*`.", "sel"),
    R("Style/AsciiComments", "comment", "name rlike '[^\\\\x00-\\\\x7F]'", "Use only ascii symbols in comments.", span("at.start + regexp_instr(name, '[^\\\\x00-\\\\x7F]') - 1", "at.start + regexp_instr(name, '[^\\\\x00-\\\\x7F]') - 1 + length(regexp_substr(name, '[^\\\\x00-\\\\x7F]+'))"), options={"AllowedChars": "['©']"}),
    R("Style/Attr", "call", "recv IS NULL AND name = 'attr' AND argc > 0", "=concat('Do not use `attr`. Use `', if(a1.kind = 'true', 'attr_accessor', 'attr_reader'), '` instead.')", "sel"),
    R("Style/AutoResourceCleanup", "call", "name IN ('open', 'new') AND op = '.' AND recv.src IN ('File', '::File', 'Tempfile', '::Tempfile') AND blk IS NULL AND (name = 'open') AND NOT (role = 'recv' AND p.kind = 'call' AND p.name IN ('close', 'close!'))", "=concat('Use the block version of `', recv.src, '.open`.')"),
    R("Style/BarePercentLiterals", "string interpolated_string", "open like '%Q_'", "Use `%` instead of `%Q`.", span("at.start", "at.start + length(open)")),
    R("Style/BeginBlock", "pre_execution", "true", "Avoid the use of `BEGIN` blocks.", "sel"),
    R("Style/BitwisePredicate", "call", "name IN ('>', '!=') AND a0.src = '0' AND recv.kind = 'parentheses' AND exists(rk, k -> k.kind = 'call' AND k.name = '&' AND k.n = 2)", "=concat('Replace with `', regexp_replace(substr(recv.src, 2, length(recv.src) - 2), '^(.*) & (.*)$', '$1.anybits?($2)'), '` for comparison with bit flags.')"),
    R("Style/BlockComments", "comment", "form = 'block'", "Do not use block comments."),
    R("Style/CaseEquality", "call", "name = '===' AND recv IS NOT NULL AND recv.kind <> 'regular_expression'", "Avoid the use of the case equality operator `===`.", "sel"),
    R("Style/CharacterLiteral", "string", "open = '?' AND length(src) = 2", "Do not use the character literal - use string literal instead.", fix="concat('\\'', name, '\\'')"),
    R("Style/ClassAndModuleChildren", "class module", "get(kids, 0).kind = 'constant_path' AND coalesce(get(kids, 0).open, '') <> '::'", "Use nested module/class definitions instead of compact style.", "get(kids, 0).at"),
    R("Style/ClassCheck", "call", "name = 'kind_of?' AND argc = 1", "Prefer `Object#is_a?` over `Object#kind_of?`.", "sel", fix="'is_a?'"),
    R("Style/ClassEqualityComparison", "call", "name IN ('==', 'equal?', 'eql?') AND recv.kind = 'call' AND recv.name = 'class' AND recv.n = 1 AND argc = 1 AND NOT (scope.kind = 'def' AND scope.name IN ('==', 'equal?', 'eql?'))", "=concat('Use `instance_of?(', a0.src, ')` instead of comparing classes.')", RECV_ON),
    R("Style/ClassMethods", "def", "recv.kind = 'constant_read' AND p.kind IN ('class', 'module') AND p.name = recv.name", "=concat('Use `self.', name, '` instead of `', recv.name, '.', name, '`.')", "recv.at"),
    R("Style/ClassVars", "class_variable_write class_variable_or_write class_variable_operator_write class_variable_and_write class_variable_target", "true", "=concat('Replace class var ', name, ' with a class instance var.')", "sel"),
    R("Style/CollectionMethods", "call", f"recv IS NOT NULL AND name IN ({names(COLLECTION)}) AND (blk IS NOT NULL OR name IN ('inject', 'member?') AND argc > 0)", f"=concat('Prefer `', {table('name', COLLECTION)}, '` over `', name, '`.')", "sel", fix=table("name", COLLECTION)),
    R("Style/ColonMethodCall", "call", "op = '::' AND name rlike '^[a-z_]' AND NOT coalesce(recv.src like 'Java%', false)", "Do not use `::` for method calls.", span("sel.start - 2", "sel.start", "sel"), fix="'.'"),
    R("Style/ColonMethodDefinition", "def", "op = '::'", "Do not use `::` for defining class methods.", span("sel.start - 2", "sel.start", "sel"), fix="'.'"),
    R("Style/CombinableDefined", "and", f"exists({DEFINED.format(i=0)}, a -> exists({DEFINED.format(i=1)}, b -> regexp_replace(a, '::\\\\w+$', '') = b AND a <> b OR regexp_replace(b, '::\\\\w+$', '') = a AND a <> b))", "Combine nested `defined?` calls."),
    R("Style/CommandLiteral", "x_string", "open like '%x%' AND NOT contains(name, '`')", "Use backticks around command string."),
    R("Style/CommentedKeyword", "line", "name rlike '^\\\\s*(def|class|module|begin|end)\\\\b' AND src rlike '#' AND length(rtrim(name)) < length(rtrim(src)) AND substr(src, length(rtrim(name)) + 1) rlike '^\\\\s*#' AND NOT substr(src, length(rtrim(name)) + 1) rlike '#\\\\s*(rubocop:|:nodoc:|:yields:|steep:ignore|@rbs|:)'", "=concat('Do not place comments on the same line as the `', regexp_extract(name, '^\\\\s*(\\\\w+)', 1), '` keyword.')", span("at.start + locate('#', src, length(rtrim(name)) + 1) - 1", "at.end")),
    R("Style/ConcatArrayLiterals", "call", "name = 'concat' AND argc > 0 AND forall(args, a -> a.kind = 'array' AND a.open = '[')", f"=concat('Use `push(', array_join(transform(args, a -> trim(substr(a.src, 2, length(a.src) - 2))), ', '), ')` instead of `', {SEL_SRC}, '`.')", FROM_SEL),
    R("Style/DataInheritance", "class", "get(filter(kids, k -> k.role = 'superclass'), 0).src rlike '^(::)?Data[.]define'", "Don't extend an instance initialized by `Data.define`. Use a block to customize the class.", "get(filter(kids, k -> k.role = 'superclass'), 0).at"),
    R("Style/DateTime", "call", "recv.src IN ('DateTime', '::DateTime')", "Prefer `Time` over `DateTime`."),
    R("Style/DateTime", "call", "name = 'to_datetime' AND argc = 0 AND recv IS NOT NULL", "Do not use `#to_datetime`."),
    R("Style/DefWithParentheses", "def", "params.open = '(' AND params.n = 0 AND coalesce(form, '') <> 'endless' AND NOT (at.line = at.last_line AND NOT src rlike '[)]\\\\s*;')", "Omit the parentheses in defs when the method doesn't accept any arguments.", "params.at", fix="''"),
    R("Style/Dir", "call", "name IN ('expand_path', 'dirname') AND recv.src IN ('File', '::File') AND (name = 'expand_path' AND a0.src rlike '^(::)?File[.]dirname[(]__FILE__[)]$' OR name = 'dirname' AND a0.src rlike '^(::)?File[.]realpath[(]__FILE__[)]$') AND argc = 1", "Use `__dir__` to get an absolute path to the current file's directory.", fix="'__dir__'"),
    R("Style/DoubleNegation", "call", "name = '!' AND open = '!' AND recv.kind = 'call' AND recv.name = '!' AND recv.open = '!' AND NOT (role IN ('cond') ) AND NOT (role = 'body' AND p.kind = 'def')", "Avoid the use of double negation (`!!`).", "sel"),
    R("Style/EachForSimpleLoop", "call", "name = 'each' AND recv.kind = 'parentheses' AND exists(rk, k -> k.kind = 'range') AND recv.src rlike '^[(]\\\\s*\\\\d+\\\\s*[.]{2,3}\\\\s*\\\\d+\\\\s*[)]$' AND blk.kind = 'block' AND NOT exists(bk, k -> k.role = 'params' AND k.n > 0)", "Use `Integer#times` for a simple loop which iterates a fixed number of times.", CALL),
    R("Style/EmptyBlockParameter", "block_parameters", "open = '|' AND size(kids) = 0 AND p.kind = 'block'", "Omit pipes for the empty block parameters."),
    R("Style/EmptyCaseCondition", "case", "NOT exists(kids, k -> k.role = 'value') AND p.kind NOT IN ('return', 'break', 'next', 'call') AND NOT coalesce(src rlike '\\\\breturn\\\\b', false)", "Do not use empty `case` condition, instead use an `if` expression.", "sel"),
    R("Style/EmptyElse", "else", "p.kind IN ('if', 'unless', 'case') AND form IS NULL AND (nbody = 0 OR nbody = 1 AND b0.kind = 'nil')", "Redundant `else`-clause.", "sel"),
    R("Style/EmptyLambdaParameter", "block_parameters", "open = '(' AND size(kids) = 0 AND p.kind = 'lambda'", "Omit parentheses for the empty lambda parameters."),
    R("Style/EmptyLiteral", "call", f"name = 'new' AND argc = 0 AND blk IS NULL AND {root('recv', 'Array', 'Hash')}", "=if(recv.src like '%Array', 'Use array literal `[]` instead of `Array.new`.', 'Use hash literal `{}` instead of `Hash.new`.')", fix="if(recv.src like '%Array', '[]', '{}')"),
    R("Style/EmptyMethod", "def", "nbody = 0 AND coalesce(form, '') <> 'endless' AND src rlike '^def [^\\\\n]*\\\\n\\\\s*end$'", "Put empty method definitions on a single line."),
    R("Style/EndBlock", "post_execution", "true", "Avoid the use of `END` blocks. Use `Kernel#at_exit` instead.", "sel", fix="'at_exit'"),
    R("Style/EnvHome", "call", "recv.src IN ('ENV', '::ENV') AND name IN ('[]', 'fetch') AND a0.kind = 'string' AND a0.name = 'HOME' AND (argc = 1 OR argc = 2 AND a1.kind = 'nil')", "Use `Dir.home` instead.", fix="'Dir.home'"),
    R("Style/EvenOdd", "call", "name IN ('==', '!=') AND a0.src IN ('0', '1') AND (recv.kind = 'call' AND recv.name = '%' AND exists(rk, k -> k.role = 'arg' AND k.src = '2') OR recv.kind = 'parentheses' AND recv.src rlike '^[(][\\\\w.@]+ % 2[)]$')", "=concat('Replace with `Integer#', if((name = '==') = (a0.src = '0'), 'even', 'odd'), '?`.')"),
    R("Style/ExponentialNotation", "float", "name rlike '[eE]' AND NOT name rlike '^-?[1-9]([.]\\\\d*[0-9])?[eE]'", "Use a mantissa >= 1 and < 10."),
    R("Style/FetchEnvVar", "call", "recv.src IN ('ENV', '::ENV') AND name = '[]' AND argc = 1 AND NOT role IN ('cond') AND p.kind NOT IN ('and', 'or', 'index_write') AND NOT (p.kind = 'call' AND role = 'recv') AND NOT p.kind like '%_or_write'", "=concat('Use `ENV.fetch(', a0.src, ', nil)` instead of `', src, '`.')", fix="concat('ENV.fetch(', a0.src, ', nil)')"),
    R("Style/For", "for", "true", "Prefer `each` over `for`."),
    R("Style/FormatString", "call", "name = 'sprintf' AND (recv IS NULL OR recv.src IN ('Kernel', '::Kernel')) AND argc > 1 OR name = '%' AND form = 'binary' AND recv.kind IN ('string', 'interpolated_string')", "=concat('Favor `format` over `', if(name = '%', 'String#%', name), '`.')", "sel"),
    R("Style/GlobalStdStream", "constant_read", "name IN ('STDIN', 'STDOUT', 'STDERR') AND role <> 'parent'", "=concat('Use `$', lower(name), '` instead of `', name, '`.')", fix="concat('$', lower(name))"),
    R("Style/GlobalVars", "global_variable_read global_variable_write global_variable_or_write global_variable_and_write global_variable_operator_write global_variable_target", f"name NOT IN ({GLOBALS})", "Do not introduce global variables.", "sel"),
    R("Style/HashEachMethods", "call", "name = 'each' AND recv.kind = 'call' AND recv.name IN ('keys', 'values') AND recv.n = 1 AND blk IS NOT NULL AND argc = 0", "=concat('Use `each_', if(recv.name = 'keys', 'key', 'value'), '` instead of `', recv.name, '.each`.')", RECV_SEL, fix="if(recv.name = 'keys', 'each_key', 'each_value')"),
    R("Style/HashSyntax", "hash keyword_hash", "size(kids) > 0 AND forall(kids, k -> k.kind = 'assoc_splat' OR k.open = 'label' OR k.src rlike '^:[a-zA-Z_][a-zA-Z0-9_]*[?!]?\\\\s*=>')", "Use the new Ruby 1.9 hash syntax.", "transform(filter(kids, k -> k.open = '=>'), k -> named_struct('start', k.at.start, 'end', k.sel.end, 'line', k.at.line, 'column', k.at.column, 'last_line', k.sel.last_line, 'last_column', k.sel.last_column))", many=True),
    R("Style/IfUnlessModifierOfIfUnless", "if unless", "form = 'modifier' AND b0.kind IN ('if', 'unless')", "=concat('Avoid modifier `', substr(src, sel.start - at.start + 1, sel.end - sel.start), '` after another conditional.')", "sel"),
    R("Style/ImplicitRuntimeError", "call", "recv IS NULL AND name IN ('raise', 'fail') AND argc = 1 AND a0.kind IN ('string', 'interpolated_string')", "=concat('Use `', name, '` with an explicit exception class and message, rather than just a message.')"),
    R("Style/InfiniteLoop", "while until", "coalesce(form, '') <> 'modifier' AND (kind = 'while' AND cond.kind IN ('true', 'integer', 'float', 'array', 'hash') OR kind = 'until' AND cond.kind IN ('false', 'nil'))", "Use `Kernel#loop` for infinite loops.", "sel"),
    R("Style/InlineComment", "comment", "open = 'trailing' AND NOT name rlike '#\\\\s*rubocop:'", "Avoid trailing inline comments."),
    R("Style/InPatternThen", "in", "oper.name = ';'", "=concat('Do not use `in ', get(kids, 0).src, ';`. Use `in ', get(kids, 0).src, ' then` instead.')", "oper.at", fix="' then'"),
    R("Style/InverseMethods", "call", f"name = '!' AND open = '!' AND recv.kind IN ('call', 'parentheses') AND (recv.kind = 'call' AND recv.form IS NULL AND recv.name IN ('any?', 'none?', 'even?', 'odd?') AND recv.n < 3)", f"=concat('Use `', {table('recv.name', INVERSE)}, '` instead of inverting `', recv.name, '`.')"),
    R("Style/IpAddresses", "string", "name <> '::' AND (name rlike '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$' OR name rlike '^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$')", "Do not hardcode IP addresses."),
    R("Style/Lambda", "call", "recv IS NULL AND name = 'lambda' AND blk.kind = 'block' AND at.line = at.last_line", "Use the `-> { ... }` lambda literal syntax for single line lambdas.", "sel"),
    R("Style/Lambda", "lambda", "at.line <> at.last_line", "Use the `lambda` method for multiline lambdas.", "sel"),
    R("Style/LambdaCall", "call", "name = 'call' AND recv IS NOT NULL AND sel.start = sel.end AND open = '('", f"=concat('Prefer the use of `', recv.src, op, 'call(', array_join(transform(args, a -> a.src), ', '), ')` over `', src, '`.')"),
    R("Style/MapToHash", "call", "name = 'to_h' AND argc = 0 AND blk IS NULL AND recv.kind = 'call' AND recv.name IN ('map', 'collect') AND exists(rk, k -> k.role = 'block')", "=concat('Pass a block to `to_h` instead of calling `', recv.name, '.to_h`.')", "recv.sel"),
    R("Style/MapToSet", "call", "name = 'to_set' AND argc = 0 AND blk IS NULL AND recv.kind = 'call' AND recv.name IN ('map', 'collect') AND exists(rk, k -> k.role = 'block')", "=concat('Pass a block to `to_set` instead of calling `', recv.name, '.to_set`.')", "recv.sel"),
    R("Style/MethodCallWithoutArgsParentheses", "call", "open = '(' AND argc = 0 AND NOT coalesce(blk.kind = 'block_argument', false) AND NOT name rlike '^[A-Z]' AND sel.end > sel.start AND NOT (recv IS NULL AND name = 'it') AND NOT (p.kind = 'local_variable_write' AND p.name = name AND recv IS NULL)", "Do not use parentheses for method calls with no arguments.", span("sel.end", "sel.end + 2", "sel"), fix="''"),
    R("Style/MethodDefParentheses", "def", "params IS NOT NULL AND params.open IS NULL AND params.n > 0", "Use def with parentheses when there are parameters.", "params.at"),
    R("Style/MinMax", "array", "open = '[' AND size(kids) = 2 AND get(kids, 0).name = 'min' AND get(kids, 1).name = 'max' AND get(kids, 0).n = 1 AND get(kids, 1).n = 1 AND get(kids2, 0).src = get(kids2, 1).src", "=concat('Use `', get(kids2, 0).src, '.minmax` instead of `', src, '`.')"),
    R("Style/MixinUsage", "call", "recv IS NULL AND name IN ('include', 'extend', 'prepend') AND p.kind = 'program' AND argc > 0 AND forall(args, a -> a.kind IN ('constant_read', 'constant_path'))", "=concat('`', name, '` is used at the top level. Use inside `class` or `module`.')"),
    R("Style/ModuleFunction", "call", "recv IS NULL AND name = 'extend' AND argc = 1 AND a0.kind = 'self' AND p.kind = 'module'", "Use `module_function` instead of `extend self`."),
    R("Style/MultilineIfThen", "if unless", "oper.name = 'then' AND coalesce(form, '') NOT IN ('modifier', 'ternary') AND at.line <> at.last_line AND (nbody = 0 OR b0.at.line > oper.at.line)", "=concat('Do not use `then` for multi-line `', open, '`.')", "oper.at"),
    R("Style/MultilineTernaryOperator", "if", "form = 'ternary' AND at.line <> at.last_line", "Avoid multi-line ternary operators, use `if` or `unless` instead."),
    R("Style/MutableConstant", "constant_write constant_path_write", "val.kind IN ('array', 'hash', 'interpolated_string') OR val.kind = 'string' AND coalesce(val.form, '') <> 'never'", "Freeze mutable objects assigned to constants.", "val.at", fix="concat(val.src, '.freeze')"),
    R("Style/NegatedIf", "if", "coalesce(form, '') IN ('', 'modifier') AND open IS DISTINCT FROM 'elsif' AND els IS NULL AND cond.kind = 'call' AND cond.name = '!' AND NOT exists(kids2, k -> k.of = array_position(transform(kids, x -> x.role), 'cond') - 1 AND k.kind = 'call' AND k.name = '!')", "Favor `unless` over `if` for negative conditions."),
    R("Style/NegatedUnless", "unless", "els IS NULL AND cond.kind = 'call' AND cond.name = '!'", "Favor `if` over `unless` for negative conditions."),
    R("Style/NegatedWhile", "while until", "cond.kind = 'call' AND cond.name = '!'", "=concat('Favor `', if(kind = 'while', 'until', 'while'), '` over `', kind, '` for negative conditions.')"),
    R("Style/NestedModifier", "if unless while until", "form = 'modifier' AND role = 'body' AND p.kind IN ('if', 'unless', 'while', 'until') AND p.form = 'modifier'", "Avoid using nested modifiers.", "sel"),
    R("Style/NestedTernaryOperator", "if", "form = 'ternary' AND exists(up, u -> u.form = 'ternary' AND u.kind = 'if')", "Ternary operators must not be nested. Prefer `if` or `else` constructs instead."),
    R("Style/NilComparison", "call", "name IN ('==', '===') AND a0.kind = 'nil' AND argc = 1", "Prefer the use of the `nil?` predicate.", "sel"),
    R("Style/NilLambda", "lambda", "nbody = 1 AND (b0.kind = 'nil' OR b0.src IN ('return nil', 'next nil', 'break nil'))", "Use an empty lambda instead of always returning nil."),
    R("Style/NilLambda", "call", f"(recv IS NULL AND name IN ('lambda', 'proc') OR {root('recv', 'Proc')} AND name = 'new') AND blk.kind = 'block' AND size(filter(bk, k -> k.role = 'body')) = 1 AND exists(bk, k -> k.role = 'body' AND k.src IN ('nil', 'return nil', 'next nil', 'break nil'))", "=concat('Use an empty ', if(name = 'lambda', 'lambda', 'proc'), ' instead of always returning nil.')"),
    R("Style/NonNilCheck", "call", "name = '!=' AND a0.kind = 'nil' AND NOT (role = 'body' AND p.kind = 'def' AND p.name like '%?')", "=concat('Prefer `!', recv.src, '.nil?` over `', src, '`.')"),
    R("Style/Not", "call", "name = '!' AND open = 'not'", "Use `!` instead of `not`.", "sel"),
    R("Style/NumberedParameters", "block", "at.line <> at.last_line AND src rlike '(?<![\\\\w@$:.])_[1-9](?![\\\\w])' AND NOT exists(kids, k -> k.role = 'params')", "Only use numbered parameters for single-line blocks."),
    R("Style/NumericLiteralPrefix", "integer", "name rlike '^-?(0[0-7]|0O|0X|0B|0[dD])'", "=CASE WHEN name rlike '^-?0X' THEN 'Use 0x for hexadecimal literals.' WHEN name rlike '^-?0B' THEN 'Use 0b for binary literals.' WHEN name rlike '^-?0[dD]' THEN 'Do not use prefixes for decimal literals.' ELSE 'Use 0o for octal literals.' END"),
    R("Style/NumericLiterals", "integer float", "NOT name rlike '^-?0[xXbBoOdD0-7]' AND length(regexp_replace(regexp_extract(name, '^-?([0-9_]+)', 1), '_', '')) >= {MinDigits} AND (NOT contains(regexp_extract(name, '^-?([0-9_]+)', 1), '_') OR NOT regexp_extract(name, '^-?([0-9_]+)', 1) rlike '^\\\\d{1,3}(_\\\\d{3})*$')", "Use underscores(_) as thousands separator and separate every 3 digits with them.", options={"MinDigits": "5"}),
    R("Style/NumericPredicate", "call", "form = 'binary' AND name IN ('==', '>', '<') AND (a0.src = '0' AND recv.kind NOT IN ('global_variable_read', 'integer') OR recv.src = '0' AND a0.kind NOT IN ('integer', 'global_variable_read') AND a0 IS NOT NULL)", "=if(a0.src = '0', concat('Use `', if(recv.kind IN ('call') AND recv.form IN ('binary', 'index'), concat('(', recv.src, ')'), recv.src), '.', CASE name WHEN '==' THEN 'zero?' WHEN '>' THEN 'positive?' ELSE 'negative?' END, '` instead of `', src, '`.'), concat('Use `', if(a0.kind IN ('call') AND a0.form = 'binary', concat('(', a0.src, ')'), a0.src), '.', CASE name WHEN '==' THEN 'zero?' WHEN '>' THEN 'negative?' ELSE 'positive?' END, '` instead of `', src, '`.'))"),
    R("Style/ObjectThen", "call", "name = 'yield_self' AND (blk IS NOT NULL)", "Prefer `then` over `yield_self`.", "sel", fix="'then'"),
    R("Style/OneClassPerFile", "program", "size(filter(kids, k -> k.kind IN ('class', 'module'))) > 1", "Do not define multiple classes/modules at the top level in a single file.", "transform(slice(filter(transform(kids, (k, i) -> named_struct('k', k, 'g', array(named_struct('at', named_struct('end', k.sel.end + length(regexp_extract(substr(k.src, k.sel.end - k.at.start + 1), '^\\\\s*[\\\\w:]+', 0)), 'last_line', k.sel.last_line, 'last_column', k.sel.last_column + length(regexp_extract(substr(k.src, k.sel.end - k.at.start + 1), '^\\\\s*[\\\\w:]+', 0))))))), x -> x.k.kind IN ('class', 'module')), 2, 1000000), x -> named_struct('start', x.k.at.start, 'end', get(x.g, 0).at.end, 'line', x.k.at.line, 'column', x.k.at.column, 'last_line', get(x.g, 0).at.last_line, 'last_column', get(x.g, 0).at.last_column))", many=True),
    R("Style/OpenStructUse", "constant_read constant_path", "name = 'OpenStruct' AND (kind = 'constant_read' OR open = '::') AND NOT (role = 'path')", "Avoid using `OpenStruct`; use `Struct`, `Hash`, a class or test doubles instead."),
    R("Style/OptionalArguments", "parameters", "p.kind = 'def'", "Optional arguments should appear at the end of the argument list.", "transform(filter(transform(kids, (k, i) -> named_struct('k', k, 'i', i)), x -> x.k.kind = 'optional_parameter' AND exists(slice(kids, x.i + 2, 1000), y -> y.kind = 'required_parameter') AND NOT exists(kids, y -> y.kind = 'rest_parameter')), x -> x.k.at)", many=True),
    R("Style/OptionalBooleanParameter", "optional_parameter", "val.kind IN ('true', 'false') AND p.kind = 'parameters' AND pp.name NOT IN ('respond_to_missing?')", "=concat('Prefer keyword arguments for arguments with a boolean default value; use `', name, ': ', val.src, '` instead of `', src, '`.')"),
    R("Style/OptionHash", "parameters block_parameters", "get(kids, size(kids) - 1).kind = 'optional_parameter' AND get(kids, size(kids) - 1).name IN ('options', 'opts', 'args', 'params', 'parameters') AND exists(kids2, k -> k.of = size(kids) - 1 AND k.kind = 'hash' AND k.n = 0)", "Prefer keyword arguments to options hashes.", "get(kids, size(kids) - 1).at"),
    R("Style/OrAssignment", PLAIN_WRITE, "val.kind = 'if' AND val.form = 'ternary' AND exists(kids2, k -> k.of = 0 AND k.role = 'cond' AND k.name = name) AND exists(kids2, k -> k.of = 0 AND k.role = 'body' AND k.name = name)", "Use the double pipe equals operator `||=` instead."),
    R("Style/ParallelAssignment", "multi_write", "size(filter(kids, k -> k.role = 'value')) > 1 AND size(filter(kids, k -> k.role = 'value')) = size(filter(kids, k -> k.role = 'target')) AND NOT exists(kids, k -> k.kind IN ('splat', 'mlhs')) AND NOT (size(kids) = 4 AND get(kids, 0).src = get(kids, 3).src AND get(kids, 1).src = get(kids, 2).src)", "Do not use parallel assignment."),
    R("Style/ParenthesesAroundCondition", "if unless while until", "cond.kind = 'parentheses' AND cond.n = 1 AND coalesce(form, '') <> 'ternary' AND NOT exists(kids2, k -> k.of = array_position(transform(kids, x -> x.role), 'cond') - 1 AND (k.kind like '%_write' OR k.kind IN ('if', 'rescue_modifier') OR k.name IN ('and', 'or')))", "=concat('Don\\'t use parentheses around the condition of ', if(kind IN ('until', 'while'), 'a', 'an'), ' `', coalesce(if(form = 'modifier', kind, open), kind), '`.')", "cond.at"),
    R("Style/PercentLiteralDelimiters", "array", "open rlike '^%[wWiI]' AND right(open, 1) <> '[' AND NOT exists(kids, k -> k.kind IN ('string', 'symbol') AND k.name rlike '[\\\\[\\\\]]')", "=concat('`', substr(open, 1, 2), '`-literals should be delimited by `[` and `]`.')"),
    R("Style/PercentLiteralDelimiters", "string interpolated_string x_string", "(open rlike '^%[qQx]?[^\\\\w\\\\s]$') AND right(open, 1) <> '(' AND NOT rlike(name, '[()]')", "=concat('`', substr(open, 1, length(open) - 1), '`-literals should be delimited by `(` and `)`.')"),
    R("Style/PercentQLiterals", "string", "open like '%Q_' AND NOT rlike(name, '[\\\\\\\\]')", "Do not use `%Q` unless interpolation is needed. Use `%q`.", span("at.start", "at.start + length(open)")),
    R("Style/PerlBackrefs", "numbered_reference_read back_reference_read", "true", "=concat('Prefer `', if(exists(up, u -> u.kind IN ('class', 'module')), '::', ''), 'Regexp.last_match', CASE WHEN kind = 'numbered_reference_read' THEN concat('(', substr(name, 2), ')') WHEN name = '$&' THEN '(0)' WHEN name = '$`' THEN '.pre_match' WHEN name = '$+' THEN '(-1)' ELSE '.post_match' END, '` over `', name, '`.')"),
    R("Style/PreferredHashMethods", "call", "name IN ('has_key?', 'has_value?') AND argc = 1 AND recv IS NOT NULL", "=concat('Use `Hash#', substr(name, 5), '` instead of `Hash#', name, '`.')", "sel", fix="substr(name, 5)"),
    R("Style/Proc", "call", f"name = 'new' AND {root('recv', 'Proc')} AND argc = 0 AND blk.kind = 'block'", "Use `proc` instead of `Proc.new`.", CALL, fix="'proc'"),
    R("Style/RaiseArgs", "call", "recv IS NULL AND name IN ('raise', 'fail') AND argc = 1 AND a0.kind = 'call' AND a0.name = 'new' AND a0.n <= 2 AND exists(kids2, k -> k.of = 0 AND k.role = 'recv' AND k.kind IN ('constant_read', 'constant_path')) AND NOT exists(kids2, k -> k.of = 0 AND k.role = 'arg' AND k.kind IN ('keyword_hash', 'hash', 'splat', 'forwarding_arguments'))", "=concat('Provide an exception class and message as arguments to `', name, '`.')"),
    R("Style/RedundantArrayConstructor", "call", f"(name = 'new' AND {root('recv', 'Array')} OR recv IS NULL AND name = 'Array') AND argc = 1 AND a0.kind = 'array' AND a0.open = '['", "Remove the redundant `Array` constructor.", f"if(recv IS NULL, sel, {CALL})"),
    R("Style/RedundantArrayConstructor", "call", f"name = '[]' AND {root('recv', 'Array')}", "Remove the redundant `Array` constructor.", "recv.at"),
    R("Style/RedundantArrayFlatten", "call", "name = 'join' AND recv.kind = 'call' AND recv.name = 'flatten' AND recv.n < 3 AND (argc = 0 OR argc = 1 AND a0.kind <> 'nil' OR a0.kind = 'nil') AND exists(rk, k -> k.role = 'recv')", "Remove the redundant `flatten`.", "named_struct('start', get(rk, 0).at.end, 'end', recv.at.end, 'line', get(rk, 0).at.last_line, 'column', get(rk, 0).at.last_column + 1, 'last_line', recv.at.last_line, 'last_column', recv.at.last_column)"),
    R("Style/RedundantBegin", "def", "nbody = 1 AND b0.kind = 'begin' AND coalesce(form, '') <> 'endless' AND NOT exists(kids, k -> k.role IN ('rescue', 'ensure'))", "Redundant `begin` block detected.", "b0.sel"),
    R("Style/RedundantCapitalW", "array", "open like '%W_' AND NOT exists(kids, k -> k.kind like 'interpolated%' OR k.name rlike '[\\\\\\\\]')", "Do not use `%W` unless interpolation is needed. If not, use `%w`."),
    R("Style/RedundantConditional", "if", "open IS DISTINCT FROM 'elsif' AND nbody = 1 AND els IS NOT NULL AND cond.kind = 'call' AND cond.name IN ('==', '===', '!=', '<', '>', '<=', '>=') AND cond.form = 'binary' AND (form = 'ternary' AND concat(b0.kind, els.kind) IN ('truefalse', 'falsetrue') OR form IS NULL AND els.kind = 'else' AND els.n = 1 AND concat(b0.kind, get(filter(kids2, k -> k.of = array_position(transform(kids, x -> x.role), 'else') - 1), 0).kind) IN ('truefalse', 'falsetrue'))", "=concat('This conditional expression can just be replaced by `', if(b0.kind = 'true', cond.src, concat('!(', cond.src, ')')), '`.')"),
    R("Style/RedundantCurrentDirectoryInPath", "call", "recv IS NULL AND name = 'require_relative' AND a0.kind = 'string' AND a0.name like './%'", "Remove the redundant current directory path.", span("a0.at.start + 1", "a0.at.start + 1 + length(regexp_extract(a0.name, '^([.]/+)+', 0))", "a0.at"), fix="''"),
    R("Style/RedundantException", "call", f"recv IS NULL AND name IN ('raise', 'fail') AND argc = 2 AND {root('a0', 'RuntimeError')}", "Redundant `RuntimeError` argument can be removed."),
    R("Style/RedundantException", "call", f"recv IS NULL AND name IN ('raise', 'fail') AND argc = 1 AND a0.name = 'new' AND a0.n = 2 AND exists(kids2, k -> k.of = 0 AND k.role = 'recv' AND {root('k', 'RuntimeError')})", "Redundant `RuntimeError.new` call can be replaced with just the message."),
    R("Style/RedundantFetchBlock", "call", f"name = 'fetch' AND argc = 1 AND blk.kind = 'block' AND size(bk) = 1 AND get(bk, 0).kind IN ({BASIC})", f"=concat('Use `fetch(', a0.src, ', ', get(bk, 0).src, ')` instead of `fetch(', a0.src, ') {{ ', get(bk, 0).src, ' }}`.')", FROM_SEL),
    R("Style/RedundantFileExtensionInRequire", "call", "recv IS NULL AND name IN ('require', 'require_relative') AND a0.kind = 'string' AND a0.name like '%.rb'", "Redundant `.rb` file extension detected.", tail("a0.at.end - 4", "a0.at.end - 1", "a0.at"), fix="''"),
    R("Style/RedundantFreeze", "call", "name = 'freeze' AND argc = 0 AND (recv.kind IN ('integer', 'float', 'rational', 'imaginary', 'symbol', 'interpolated_symbol', 'true', 'false', 'nil') OR recv.kind = 'parentheses' AND exists(rk, k -> k.kind = 'call' AND k.form = 'binary' AND (k.name IN ('<', '>', '==', '<=', '>=', '!=') OR k.name IN ('+', '-', '*', '/', '%', '**') AND k.src rlike '^\\\\d|\\\\d$')) OR recv.kind = 'call' AND recv.name IN ('count', 'length', 'size'))", "Do not freeze immutable objects, as freezing them has no effect."),
    R("Style/RedundantInterpolation", "interpolated_string", "size(kids) = 1 AND open = '\"' AND get(kids, 0).at.start = at.start + 1 AND get(kids, 0).at.end = at.end - 1 AND get(kids, 0).kind = 'embedded_statements' AND size(kids2) = 1 AND NOT (role = 'part')", "Prefer `to_s` over string interpolation."),
    R("Style/RedundantReturn", "def", "nbody > 0 AND get(body, nbody - 1).kind = 'return' AND NOT exists(kids, k -> k.role IN ('ensure'))", "=if(get(body, nbody - 1).n > 1, 'Redundant `return` detected. To return multiple values, use an array.', 'Redundant `return` detected.')", "get(body, nbody - 1).sel"),
    R("Style/RedundantSort", "call", "recv.kind = 'call' AND recv.name IN ('sort') AND recv.n = 1 AND (name IN ('first', 'last') AND argc = 0 OR name = '[]' AND argc = 1 AND a0.src IN ('0', '-1'))", "=concat('Use `', if(name = 'first' OR a0.src = '0', 'min', 'max'), '` instead of `sort...', if(name = '[]', concat('[', a0.src, ']'), name), '`.')", RECV_SEL),
    R("Style/RedundantSortBy", "call", "name = 'sort_by' AND argc = 0 AND blk.kind = 'block' AND size(bk) = 2 AND get(bk, 0).kind = 'block_parameters' AND get(bk, 0).n = 1 AND get(bk, 1).kind = 'local_variable_read' AND get(bk, 0).src = concat('|', get(bk, 1).name, '|')", "=concat('Use `sort` instead of `sort_by { |', get(bk, 1).name, '| ', get(bk, 1).name, ' }`.')", FROM_SEL, fix="'sort'"),
    R("Style/RegexpLiteral", "regular_expression interpolated_regular_expression", "open like '%r%' AND NOT contains(name, '/') AND at.line = at.last_line AND NOT (role <> 'value' AND name rlike '^[ =]')", "Use `//` around regular expression."),
    R("Style/RescueModifier", "rescue_modifier", "true", "Avoid using `rescue` in its modifier form."),
    R("Style/RescueStandardError", "rescue", "NOT exists(kids, k -> k.role = 'class')", "Avoid rescuing without specifying an error class.", "sel"),
    R("Style/ReturnNil", "return", "size(kids) = 1 AND get(kids, 0).kind = 'nil'", "Use `return` instead of `return nil`.", fix="'return'"),
    R("Style/Sample", "call", "recv.kind = 'call' AND recv.name = 'shuffle' AND (name IN ('first', 'last') AND argc <= 1 OR name IN ('[]', 'at', 'slice') AND argc = 1 AND a0.src IN ('0', '-1'))", f"=concat('Use `sample', if(name IN ('first', 'last') AND argc = 1, concat('(', a0.src, ')'), ''), '` instead of `', {RECV_SRC}, '`.')", RECV_ON),
    R("Style/SelfAssignment", PLAIN_WRITE, "val.kind = 'call' AND val.form = 'binary' AND val.name IN ('+', '-', '*', '/', '**', '|', '&') AND get(kids2, 0).name = name AND get(kids2, 0).kind = replace(kind, '_write', '_read')", "=concat('Use self-assignment shorthand `', val.name, '=`.')"),
    R("Style/SelfAssignment", PLAIN_WRITE, "val.kind IN ('and', 'or') AND val.name IN ('&&', '||') AND get(kids2, 0).name = name AND get(kids2, 0).kind = replace(kind, '_write', '_read')", "=concat('Use self-assignment shorthand `', val.name, '=`.')"),
    R("Style/Semicolon", "semicolon", "true", "Do not use semicolons to terminate expressions."),
    R("Style/Send", "call", "name = 'send' AND argc > 0 AND recv IS NOT NULL", "Prefer `Object#__send__` or `Object#public_send` to `send`.", "sel"),
    R("Style/SignalException", "call", "name = 'fail' AND (recv IS NULL OR recv.src IN ('Kernel', '::Kernel'))", "Always use `raise` to signal exceptions.", "sel", fix="'raise'"),
    R("Style/SingleArgumentDig", "call", "name = 'dig' AND recv IS NOT NULL AND argc = 1 AND op = '.' AND a0.kind NOT IN ('splat', 'keyword_hash', 'forwarding_arguments') AND NOT (recv.kind = 'call' AND recv.name = 'dig') AND NOT (role = 'recv' AND p.name = 'dig')", "=concat('Use `', recv.src, '[', a0.src, ']` instead of `', src, '`.')", fix="concat(recv.src, '[', a0.src, ']')"),
    R("Style/SlicingWithRange", "call", "name = '[]' AND argc = 1 AND a0.kind = 'range' AND a0.name = '..' AND a0.src rlike '^[^.]+[.][.]-1$' AND a0.src <> '0..-1'", "=concat('Prefer `[', regexp_replace(a0.src, '-1$', ''), ']` over `[', a0.src, ']`.')", "sel"),
    R("Style/SpecialGlobalVars", "global_variable_read", f"name IN ({names(ENGLISH)})", f"=concat('Prefer `', {table('name', ENGLISH)}, '`', coalesce(concat(' or `', {table('name', ENGLISH_2)}, '`'), ''), ' from the stdlib \\'English\\' module (don\\'t forget to require it) over `', name, '`.')"),
    R("Style/SpecialGlobalVars", "global_variable_read", "name IN ('$:', '$\"', '$0')", "=concat('Prefer `', CASE name WHEN '$:' THEN '$LOAD_PATH' WHEN '$0' THEN '$PROGRAM_NAME' ELSE '$LOADED_FEATURES' END, '` over `', name, '`.')"),
    R("Style/StabbyLambdaParentheses", "block_parameters", "p.kind = 'lambda' AND open IS NULL AND size(kids) > 0 AND startswith(src, '|') = false", "Wrap stabby lambda arguments with parentheses."),
    R("Style/StderrPuts", "call", "name = 'puts' AND recv.src IN ('$stderr', 'STDERR', '::STDERR') AND argc > 0", "=concat('Use `warn` instead of `', recv.src, '.puts` to allow such output to be disabled.')", CALL, fix="'warn'"),
    R("Style/StringChars", "call", "name = 'split' AND recv IS NOT NULL AND argc = 1 AND a0.src IN ('//', '\\'\\'', '\"\"')", f"=concat('Use `chars` instead of `', {SEL_SRC}, '`.')", FROM_SEL, fix="'chars'"),
    R("Style/StringHashKeys", "assoc", "get(kids, 0).kind = 'string' AND open = '=>'", "Prefer symbols instead of strings as hash keys.", "get(kids, 0).at"),
    R("Style/StringLiterals", "string", "open = '\"' AND NOT name rlike '[\\\\\\\\\\'\\n]|#[{@$]' AND NOT exists(up, u -> u.kind IN ('interpolated_string', 'interpolated_symbol', 'interpolated_regular_expression')) AND role <> 'part'", "Prefer single-quoted strings when you don't need string interpolation or special symbols.", fix="concat('\\'', name, '\\'')"),
    R("Style/StringMethods", "call", "name = 'intern' AND recv IS NOT NULL AND argc = 0", "Prefer `to_sym` over `intern`.", "sel", fix="'to_sym'"),
    R("Style/Strip", "call", "name IN ('lstrip', 'rstrip') AND recv.kind = 'call' AND recv.name IN ('lstrip', 'rstrip') AND recv.name <> name", "=concat('Use `strip` instead of `', recv.name, '.', name, '`.')", RECV_SEL, fix="'strip'"),
    R("Style/StructInheritance", "class", "get(filter(kids, k -> k.role = 'superclass'), 0).src rlike '^(::)?Struct[.]new'", "Don't extend an instance initialized by `Struct.new`. Use a block to customize the struct.", "get(filter(kids, k -> k.role = 'superclass'), 0).at"),
    R("Style/SuperWithArgsParentheses", "super", "form = 'command'", "Use parentheses for `super` with arguments."),
    R("Style/SymbolArray", "array", "open = '[' AND size(kids) >= {MinSize} AND forall(kids, k -> k.kind = 'symbol' AND k.open = ':') AND NOT src rlike '#'", "Use `%i` or `%I` for an array of symbols.", options={"MinSize": "2"}),
    R("Style/SymbolLiteral", "symbol", "open IN (':\"', ':\\'') AND name rlike '^[a-zA-Z_][a-zA-Z0-9_]*$'", "Do not use strings for word-like symbol literals.", fix="concat(':', name)"),
    R("Style/SymbolProc", "call", "blk.kind = 'block' AND argc = 0 AND name NOT IN ('define_method', 'lambda', 'proc') AND NOT (name = 'new' AND recv.src IN ('Proc', '::Proc')) AND size(bk) = 2 AND get(bk, 0).kind = 'block_parameters' AND get(bk, 0).n = 1 AND get(bk, 1).kind = 'call' AND get(bk, 1).n = 1 AND get(bk, 1).op = '.' AND blk.src rlike concat('[|]', substr(get(bk, 0).src, 2, length(get(bk, 0).src) - 2), '[|]\\\\s*', substr(get(bk, 0).src, 2, length(get(bk, 0).src) - 2), '[.]\\\\w+[?!]?\\\\s*([}]|end)$')", "=concat('Pass `&:', get(bk, 1).name, '` as an argument to `', name, '` instead of a block.')", "blk.at"),
    R("Style/TernaryParentheses", "if", "form = 'ternary' AND cond.kind = 'parentheses' AND cond.n = 1 AND NOT exists(kids2, k -> k.of = 0 AND (k.kind like '%_write' OR k.kind IN ('if', 'and', 'or') AND k.name IN ('and', 'or') OR k.kind = 'call' AND k.form = 'command'))", "Omit parentheses for ternary conditions."),
    R("Style/TopLevelMethodDefinition", "def", "p.kind = 'program'", "Do not define methods at the top-level."),
    R("Style/TrailingCommaInArrayLiteral", "array", "open = '[' AND size(kids) > 0 AND src rlike ',[ \\\\t]*\\\\]$'", "Avoid comma after the last item of an array.", tail("get(kids, size(kids) - 1).at.end + length(regexp_extract(substr(src, get(kids, size(kids) - 1).at.end - at.start + 1), '^\\\\s*', 0))", "get(kids, size(kids) - 1).at.end + length(regexp_extract(substr(src, get(kids, size(kids) - 1).at.end - at.start + 1), '^\\\\s*', 0)) + 1"), fix="''"),
    R("Style/TrailingCommaInHashLiteral", "hash", "open = '{{' AND size(kids) > 0 AND src rlike ',[ \\\\t]*[}}]$'".replace("{{", "{").replace("}}", "}"), "Avoid comma after the last item of a hash.", tail("get(kids, size(kids) - 1).at.end", "get(kids, size(kids) - 1).at.end + 1"), fix="''"),
    R("Style/TrailingCommaInArguments", "call", "open = '(' AND argc > 0 AND blk IS NULL AND src rlike ',[ \\\\t]*[)]$'", "Avoid comma after the last parameter of a method call.", tail("get(args, argc - 1).at.end", "get(args, argc - 1).at.end + 1"), fix="''"),
    R("Style/TrivialAccessors", "def", "recv IS NULL AND params IS NULL AND nbody = 1 AND b0.kind = 'instance_variable_read' AND b0.name = concat('@', name) AND p.kind IN ('class', 'module', 'singleton_class')", "Use `attr_reader` to define trivial reader methods.", span("at.start", "at.start + 3")),
    R("Style/TrivialAccessors", "def", "recv IS NULL AND params.n = 1 AND nbody = 1 AND b0.kind = 'instance_variable_write' AND concat(b0.name, '=') = concat('@', name) AND p.kind IN ('class', 'module', 'singleton_class') AND exists(kids2, k -> k.of = 1 AND k.role = 'value' AND k.kind = 'local_variable_read')", "Use `attr_writer` to define trivial writer methods.", span("at.start", "at.start + 3")),
    R("Style/UnlessElse", "unless", "els IS NOT NULL", "Do not use `unless` with `else`. Rewrite these with the positive case first."),
    R("Style/UnpackFirst", "call", "recv.kind = 'call' AND recv.name = 'unpack' AND exists(rk, k -> k.role = 'recv') AND (name = 'first' AND argc = 0 OR name IN ('[]', 'slice', 'at') AND argc = 1 AND a0.src = '0') AND size(filter(rk, k -> k.role = 'arg')) = 1", f"=concat('Use `unpack1(', get(filter(rk, k -> k.role = 'arg'), 0).src, ')` instead of `', {RECV_SRC}, '`.')", RECV_ON),
    R("Style/VariableInterpolation", "embedded_variable", "true", "=concat('Replace interpolated variable `', name, '` with expression `#{', name, '}`.')", "get(kids, 0).at", fix="concat('{', name, '}')"),
    R("Style/WhenThen", "when", "oper.name = ';'", "=concat('Do not use `when ', array_join(transform(filter(kids, k -> k.role = 'cond'), k -> k.src), ', '), ';`. Use `when ', array_join(transform(filter(kids, k -> k.role = 'cond'), k -> k.src), ', '), ' then` instead.')", "oper.at", fix="' then'"),
    R("Style/WhileUntilDo", "while until", "oper.name = 'do' AND at.line <> at.last_line", "=concat('Do not use `do` with multi-line `', kind, '`.')", "oper.at"),
    R("Style/WordArray", "array", f"open = '[' AND p.kind <> 'array' AND size(kids) >= {{MinSize}} AND forall(kids, k -> k.kind = 'string' AND k.name rlike '{WORDY}')", "Use `%w` or `%W` for an array of words.", options={"MinSize": "2"}),
    R("Style/WordArray", "array", f"open = '[' AND exists(kids, k -> k.kind = 'array') AND NOT exists(kids2, k -> k.kind = 'string' AND NOT k.name rlike '{WORDY}')", "Use `%w` or `%W` for an array of words.", "transform(filter(transform(kids, (k, i) -> named_struct('k', k, 'e', filter(kids2, x -> x.of = i))), x -> x.k.kind = 'array' AND x.k.open = '[' AND size(x.e) >= {MinSize} AND forall(x.e, y -> y.kind = 'string')), x -> x.k.at)", many=True, options={"MinSize": "2"}),
    R("Style/YodaCondition", "call", "form = 'binary' AND name IN ('==', '!=', '<', '>', '<=', '>=') AND recv.kind IN ('integer', 'float', 'string', 'symbol', 'true', 'false', 'nil', 'array', 'hash', 'rational') AND a0.kind NOT IN ('integer', 'float', 'string', 'symbol', 'true', 'false', 'nil', 'array', 'hash', 'rational', 'interpolated_string') AND NOT (name IN ('==') AND false)", "=concat('Reverse the order of the operands `', src, '`.')"),
    R("Style/ZeroLengthPredicate", "call", "form = 'binary' AND recv.kind = 'call' AND recv.name IN ('length', 'size') AND recv.n = 1 AND exists(rk, k -> k.role = 'recv') AND NOT get(rk, 0).src rlike '^(::)?(File[.](stat|new|open)|(Tempfile|StringIO)[.](new|open))\\\\b' AND (name = '==' AND a0.src = '0' OR name = '<' AND a0.src = '1')", f"=concat('Use `empty?` instead of `', {RECV_SRC}, '`.')", RECV_ON),
    R("Style/ZeroLengthPredicate", "call", "form = 'binary' AND recv.kind = 'call' AND recv.name IN ('length', 'size') AND recv.n = 1 AND exists(rk, k -> k.role = 'recv') AND NOT get(rk, 0).src rlike '^(::)?(File[.](stat|new|open)|(Tempfile|StringIO)[.](new|open))\\\\b' AND recv.op = '.' AND (name IN ('>', '!=') AND a0.src = '0' OR name = '>=' AND a0.src = '1')", f"=concat('Use `!empty?` instead of `', {RECV_SRC}, '`.')"),
    R("Style/ZeroLengthPredicate", "call", "name = 'zero?' AND argc = 0 AND recv.kind = 'call' AND recv.name IN ('length', 'size') AND recv.n = 1 AND exists(rk, k -> k.role = 'recv') AND NOT get(rk, 0).src rlike '^(::)?(File[.](stat|new|open)|(Tempfile|StringIO)[.](new|open))\\\\b'", "=concat('Use `empty?` instead of `', recv.name, '.zero?`.')", RECV_ON),
)
