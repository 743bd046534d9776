"""More rules of the Lint, Naming, Bundler and Gemspec departments: those about
scopes, duplicates and order. Names, messages and listed names are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import span, thru
from sleuthframe.rules.lint import BASIC, COMPARE, LITERAL, root

WRITES = "local_variable_write instance_variable_write class_variable_write global_variable_write constant_write"
#: Members that Struct and Data have themselves.
STRUCT = "'all?', 'any?', 'chain', 'chunk', 'class', 'clone', 'collect', 'compact', 'count', 'cycle', 'deconstruct', 'detect', 'dig', 'display', 'drop', 'dup', 'each', 'each_pair', 'entries', 'eql?', 'extend', 'filter', 'filter_map', 'find', 'find_all', 'find_index', 'first', 'flat_map', 'freeze', 'frozen?', 'grep', 'group_by', 'hash', 'include?', 'inject', 'inspect', 'instance_of?', 'is_a?', 'itself', 'kind_of?', 'lazy', 'length', 'map', 'max', 'max_by', 'member?', 'members', 'method', 'methods', 'min', 'min_by', 'minmax', 'nil?', 'none?', 'object_id', 'one?', 'partition', 'reduce', 'reject', 'respond_to?', 'select', 'send', 'size', 'sort', 'sort_by', 'sum', 'take', 'tally', 'tap', 'then', 'to_a', 'to_enum', 'to_h', 'to_s', 'to_set', 'uniq', 'values', 'values_at', 'zip'"
DATA = "'class', 'clone', 'display', 'dup', 'eql?', 'extend', 'freeze', 'frozen?', 'hash', 'inspect', 'instance_of?', 'is_a?', 'itself', 'kind_of?', 'members', 'method', 'methods', 'nil?', 'object_id', 'respond_to?', 'send', 'tap', 'then', 'to_enum', 'to_h', 'to_s', 'with'"
#: Places of binary operators from the tightest to the loosest.
TIGHT = "CASE WHEN {x} = '**' THEN 0 WHEN {x} IN ('*', '/', '%') THEN 1 WHEN {x} IN ('+', '-') THEN 2 WHEN {x} IN ('<<', '>>') THEN 3 WHEN {x} = '&' THEN 4 WHEN {x} IN ('|', '^') THEN 5 WHEN {x} = '&&' THEN 6 WHEN {x} = '||' THEN 7 END"
MODIFIER = "b.kind = 'call' AND b.form = 'name' AND b.name IN ('private', 'protected', 'public')"


def repeated(of: str, where: str, same: str) -> str:
    """{k, f} of elements k that equal an earlier one f, among those that a
    condition on k holds for; same: SQL over {x}."""
    each = f"transform(filter({of}, k -> {where}), (k, i) -> named_struct('k', k, 'i', i))"
    pairs = f"filter(transform(e, x -> named_struct('k', x.k, 'f', get(filter(e, y -> y.i < x.i AND {same.format(x='y.k')} = {same.format(x='x.k')}), 0).k)), x -> x.f IS NOT NULL)"
    # bound once, so that the list isn't made again for each of its elements
    return f"transform(array({each}), e -> {pairs})[0]"


def sorted_wrong(names: str) -> str:
    """{k, b} of calls k that follow b on the next line, though their first arguments' order is another."""
    each = f"filter(body, k -> k.kind = 'call' AND k.name IN ({names}) AND k.a0 IS NOT NULL)"
    pairs = "filter(transform(e, (k, i) -> named_struct('k', k, 'b', get(e, i - 1))), z -> z.b.name = z.k.name AND z.b.at.last_line + 1 = z.k.at.line AND lower(z.k.a0) < lower(z.b.a0))"
    return f"transform(array({each}), e -> {pairs})[0]"


METHODS = repeated("body", "k.kind = 'def'", "concat({x}.name, regexp_extract({x}.src, '^def +(self[.])?', 1))")
GEM_PAIRS = sorted_wrong("'gem'")
GEM_AGAIN = repeated("body", "k.kind = 'call' AND k.name = 'gem' AND k.a0 IS NOT NULL", "{x}.a0")
DEPENDENCY_PAIRS = sorted_wrong("'add_dependency', 'add_runtime_dependency', 'add_development_dependency'")
ASSIGNED = repeated("body", "k.kind = 'call_write'", "{x}.name")
REQUIRED = repeated("body", "k.kind = 'call' AND k.name IN ('require', 'require_relative')", "{x}.src")
PARAMS = "filter(kids2, k -> k.role = 'param' AND k.kind IN ('required_parameter', 'optional_parameter') AND NOT k.name like '\\\\_%')"
UNUSED = f"filter({PARAMS}, k -> NOT array_contains(reads, k.name))"

RULES = (
    R("Lint/AmbiguousAssignment", WRITES, "oper.name = '=' AND oper.at.end = val.at.start AND substr(val.src, 1, 1) IN ('-', '+', '*', '!') AND oper.at.start > sel.end", "=concat('Suspicious assignment detected. Did you mean `', substr(val.src, 1, 1), '=`?')", span("oper.at.start", "oper.at.start + 2", "oper.at")),
    R("Lint/AmbiguousBlockAssociation", "call", "form = 'command' AND argc = 1 AND a0.kind = 'call' AND coalesce(a0.open, '') <> '(' AND exists(kids2, k -> k.role = 'block' AND k.kind = 'block' AND k.open = '{' AND k.at.end = a0.at.end) AND a0.name NOT IN ('lambda', 'proc') AND a0.src rlike '^[a-z_.]+[?!]? [{]'", "=concat('Parenthesize the param `', a0.src, '` to make sure that the block will be associated with the `', a0.name, '` method call.')"),
    R("Lint/AmbiguousOperator", "call", "form = 'command' AND a0.kind = 'splat'", "Ambiguous splat operator. Parenthesize the method arguments if it's surely a splat operator, or add a whitespace to the right of the `*` if it should be a multiplication.", span("a0.at.start", "a0.at.start + 1", "a0.at")),
    R("Lint/AmbiguousOperator", "call", "form = 'command' AND argc = 0 AND blk.kind = 'block_argument'", "Ambiguous block operator. Parenthesize the method arguments if it's surely a block operator, or add a whitespace to the right of the `&` if it should be a binary AND.", span("blk.at.start", "blk.at.start + 1", "blk.at")),
    R("Lint/AmbiguousOperator", "call", "form = 'command' AND a0.src like '-%' AND NOT a0.src like '->%'", "Ambiguous negative number operator. Parenthesize the method arguments if it's surely a negative number operator, or add a whitespace to the right of the `-` if it should be a subtraction.", span("a0.at.start", "a0.at.start + 1", "a0.at")),
    R("Lint/AmbiguousOperator", "call", "form = 'command' AND a0.src like '**%'", "Ambiguous keyword splat operator. Parenthesize the method arguments if it's surely a keyword splat operator, or add a whitespace to the right of the `**` if it should be an exponent.", span("a0.at.start", "a0.at.start + 2", "a0.at")),
    R("Lint/AmbiguousOperatorPrecedence", "call and", f"(kind = 'and' AND name = '&&' AND p.kind = 'or' AND p.name = '||' OR kind = 'call' AND form = 'binary' AND p.form = 'binary' AND p.kind = 'call' AND role IN ('recv', 'arg') AND {TIGHT.format(x='name')} < {TIGHT.format(x='p.name')} OR kind = 'call' AND form = 'binary' AND p.kind IN ('and', 'or') AND false)", "Wrap expressions with varying precedence with parentheses to avoid ambiguity."),
    R("Lint/ConstantOverwrittenInRescue", "rescue", "exists(kids, k -> k.role = 'target' AND k.kind = 'constant_target') AND NOT exists(kids, k -> k.role = 'class')", "=concat('`', get(filter(kids, k -> k.role = 'target'), 0).name, '` is overwritten by `rescue =>`.')", "named_struct('start', sel.end + 1, 'end', sel.end + 3, 'line', sel.line, 'column', sel.last_column + 2, 'last_line', sel.line, 'last_column', sel.last_column + 3)"),
    R("Lint/ConstantReassignment", "program class module", "nbody > 1", "Constant is already assigned.", f"transform({repeated('body', "k.kind = 'constant_write'", '{x}.name')}, x -> x.k.at)", many=True),
    R("Lint/DataDefineOverride", "call", f"name = 'define' AND {root('recv', 'Data')} AND exists(args, a -> a.kind IN ('symbol', 'string') AND a.name IN ({DATA}))", f"@transform(filter(args, a -> a.kind IN ('symbol', 'string') AND a.name IN ({DATA})), a -> concat('`', a.src, '` member overrides `Data#', a.name, '` and it may be unexpected.'))", f"transform(filter(args, a -> a.kind IN ('symbol', 'string') AND a.name IN ({DATA})), a -> a.at)", many=True),
    R("Lint/StructNewOverride", "call", f"name = 'new' AND {root('recv', 'Struct')} AND exists(args, a -> a.kind IN ('symbol', 'string') AND a.name IN ({STRUCT}))", f"@transform(filter(args, a -> a.kind IN ('symbol', 'string') AND a.name IN ({STRUCT})), a -> concat('`', a.src, '` member overrides `Struct#', a.name, '` and it may be unexpected.'))", f"transform(filter(args, a -> a.kind IN ('symbol', 'string') AND a.name IN ({STRUCT})), a -> a.at)", many=True),
    R("Lint/DeprecatedConstants", "constant_read", "name IN ('NIL', 'TRUE', 'FALSE') AND role NOT IN ('parent', 'path')", "=concat('Use `', lower(name), '` instead of `', name, '`, deprecated since Ruby 2.4.')", fix="lower(name)"),
    R("Lint/DeprecatedOpenSSLConstant", "call", "name IN ('new', 'digest') AND recv.kind = 'constant_path' AND recv.src rlike '^(::)?OpenSSL::Digest::[A-Z0-9]+$' AND recv.name <> 'Digest'", "=concat('Use `', regexp_replace(recv.src, '::[A-Z0-9]+$', ''), '.', name, '(\\'', recv.name, '\\'', if(argc > 0, concat(', ', array_join(transform(args, a -> a.src), ', ')), ''), ')` instead of `', src, '`.')"),
    R("Lint/DisjunctiveAssignmentInConstructor", "def", "name = 'initialize' AND b0.kind = 'instance_variable_or_write'", "Unnecessary disjunctive assignment. Use plain assignment.", "transform(filter(transform(body, (b, i) -> named_struct('b', b, 'i', i)), x -> forall(slice(body, 1, x.i + 1), y -> y.kind = 'instance_variable_or_write')), x -> get(filter(kids2, k -> k.role = 'operator' AND k.at.start >= x.b.at.start AND k.at.end <= x.b.at.end), 0).at)", many=True),
    R("Lint/DuplicateBranch", "if", "form IS NULL AND open = 'if' AND els.kind = 'else' AND nbody > 0 AND array_join(transform(body, b -> b.src), ';') = array_join(transform(filter(kids2, k -> k.of = array_position(transform(kids, x -> x.role), 'else') - 1), b -> b.src), ';')", "Duplicate branch body detected.", "els.sel"),
    R("Lint/DuplicateBranch", "case", "true", "Duplicate branch body detected.", "transform(filter(transform(filter(transform(kids, (k, i) -> named_struct('k', k, 's', array_join(transform(filter(kids2, x -> x.of = i AND x.role = 'body'), x -> x.src), ';'))), z -> z.k.kind = 'when' AND z.s <> ''), (z, i) -> named_struct('z', z, 'i', i)), y -> exists(slice(filter(transform(kids, (k, i) -> named_struct('k', k, 's', array_join(transform(filter(kids2, x -> x.of = i AND x.role = 'body'), x -> x.src), ';'))), z -> z.k.kind = 'when' AND z.s <> ''), 1, y.i), w -> w.s = y.z.s)), y -> y.z.k.at)", many=True),
    R("Lint/DuplicateElsifCondition", "if", "form = 'elsif' OR open = 'elsif' AND exists(transform(up, (u, i) -> named_struct('u', u, 'i', i)), x -> x.u.kind = 'if' AND x.u.cond = cond.src AND forall(slice(up, 1, x.i), w -> w.kind = 'if' AND w.role = 'else'))", "Duplicate `elsif` condition detected.", "if(exists(transform(up, (u, i) -> named_struct('u', u, 'i', i)), x -> x.u.kind = 'if' AND x.u.cond = cond.src AND forall(slice(up, 1, x.i), w -> w.kind = 'if' AND w.role = 'else')), array(cond.at), array())", many=True),
    R("Lint/DuplicateMatchPattern", "case_match", "true", "Duplicate `in` pattern detected.", f"transform({repeated('kids2', "k.role = 'pattern'", '{x}.src')}, x -> x.k.at)", many=True),
    R("Lint/DuplicateMethods", "class module", f"nbody > 1 AND size({METHODS}) > 0", f"@transform({METHODS}, x -> concat('Method `', name, if(x.k.src like 'def self.%', '.', '#'), x.k.name, '` is defined at both ', path, ':', x.f.at.line, ' and ', path, ':', x.k.at.line, '.'))", f"transform({METHODS}, x -> {thru('x.k.at', 'x.k.sel')})", many=True),
    R("Lint/DuplicateRequire", "program", "nbody > 1", f"@transform({REQUIRED}, x -> concat('Duplicate `', x.k.name, '` detected.'))", f"transform({REQUIRED}, x -> x.k.at)", many=True),
    R("Lint/FormatParameterMismatch", "call", "name IN ('format', 'sprintf') AND (recv IS NULL OR recv.src = 'Kernel') AND a0.kind = 'string' AND NOT exists(args, a -> a.kind IN ('splat', 'keyword_hash', 'hash')) AND NOT a0.name rlike '%[-+ 0#]*[<{*0-9]*[$<{*]' AND regexp_count(replace(a0.name, '%%', ''), '%[-+ 0#]*[0-9]*([.][0-9]+)?[a-zA-Z]') <> argc - 1", "=concat('Number of arguments (', argc - 1, ') to format string differs from number of fields (', regexp_count(replace(a0.name, '%%', ''), '%[-+ 0#]*[0-9]*([.][0-9]+)?[a-zA-Z]'), ').')", "sel"),
    R("Lint/HashNewWithKeywordArgumentsAsDefault", "call", f"name = 'new' AND {root('recv', 'Hash')} AND argc = 1 AND a0.kind = 'keyword_hash' AND NOT a0.src rlike '^capacity:'", "Use a hash literal instead of keyword arguments.", "a0.at", fix="concat('{', a0.src, '}')"),
    R("Lint/IneffectiveAccessModifier", "class", "exists(body, b -> b.kind = 'def' AND b.src like 'def self.%')", f"@transform(filter(transform(filter(transform(body, (b, i) -> named_struct('b', b, 'i', i)), x -> x.b.kind = 'def' AND x.b.src like 'def self.%'), x -> named_struct('x', x, 'm', get(reverse(filter(slice(body, 1, x.i), b -> {MODIFIER})), 0))), z -> z.m.name IN ('private', 'protected')), z -> concat('`', z.m.name, '` (on line ', z.m.at.line, ') does not make singleton methods ', z.m.name, '. Use `', if(z.m.name = 'private', 'private_class_method` or `private` inside a `class << self` block', 'protected` inside a `class << self` block'), ' instead.'))", f"transform(filter(transform(filter(transform(body, (b, i) -> named_struct('b', b, 'i', i)), x -> x.b.kind = 'def' AND x.b.src like 'def self.%'), x -> named_struct('x', x, 'm', get(reverse(filter(slice(body, 1, x.i), b -> {MODIFIER})), 0))), z -> z.m.name IN ('private', 'protected')), z -> {span('z.x.b.at.start', 'z.x.b.at.start + 3', 'z.x.b.at')})", many=True),
    R("Lint/LambdaWithoutLiteralBlock", "call", "recv IS NULL AND name = 'lambda' AND blk.kind = 'block_argument'", "lambda without a literal block is deprecated; use the proc without lambda instead."),
    R("Lint/MissingSuper", "def", "name = 'initialize' AND p.kind = 'class' AND p.cond IS NOT NULL AND p.cond NOT IN ('Object', 'BasicObject') AND NOT array_contains(reads, 'super')", "Call `super` to initialize state of the parent class."),
    R("Lint/MixedRegexpCaptureTypes", "regular_expression", r"name rlike '[(][?]<[a-zA-Z_]' AND name rlike '(?<!\\\\)[(](?![?])'", "Do not mix named captures and numbered captures in a Regexp literal."),
    R("Lint/NestedPercentLiteral", "array", r"open rlike '^%[wWiI]' AND exists(kids, k -> k.name rlike '^%[qQrswWxiI]?[\\[({|]')", "Within percent literals, nested percent literals do not function and may be unwanted in the result."),
    R("Lint/NextWithoutAccumulator", "next", "size(kids) = 0 AND get(filter(transform(up, (u, i) -> named_struct('u', u, 'o', get(up, i + 1))), x -> x.u.kind IN ('block', 'lambda', 'def', 'while', 'until')), 0).o.name IN ('reduce', 'inject')", "Use `next` with an accumulator argument in a `reduce`."),
    R("Lint/NonDeterministicRequireOrder", "call", "name = 'each' AND recv.kind = 'call' AND recv.name IN ('[]', 'glob') AND get(rk, 0).src IN ('Dir', '::Dir') AND blk.src rlike '\\\\brequire(_relative)?\\\\b'", "Sort files before requiring them.", "named_struct('start', recv.at.start, 'end', sel.end, 'line', recv.at.line, 'column', recv.at.column, 'last_line', sel.last_line, 'last_column', sel.last_column)"),
    R("Lint/NumericOperationWithConstantResult", "call", "form = 'binary' AND recv.kind IN ('local_variable_read', 'call') AND (name = '*' AND a0.src = '0' OR name = '/' AND a0.src = recv.src OR name = '**' AND a0.src = '0')", "Numeric operation with a constant result detected."),
    R("Lint/RedundantSafeNavigation", "call", "op = '&.' AND recv.kind IN ('constant_read', 'constant_path', 'self', 'array', 'hash', 'integer', 'string')", "Redundant safe navigation detected.", "named_struct('start', sel.start - 2, 'end', sel.start, 'line', sel.line, 'column', sel.column - 2, 'last_line', sel.line, 'last_column', sel.column - 1)", fix="'.'"),
    R("Lint/RedundantSplatExpansion", "splat", f"val.kind IN ({LITERAL}) AND p.kind IN ('call', 'array') AND NOT (p.kind = 'array' AND val.kind <> 'array')", "Redundant splat expansion."),
    R("Lint/RedundantTypeConversion", "call", "argc = 0 AND (name = 'to_s' AND recv.kind IN ('string', 'interpolated_string') OR name = 'to_sym' AND recv.kind = 'interpolated_symbol' OR name = 'to_i' AND recv.kind = 'integer' OR name = 'to_f' AND recv.kind = 'float' OR name = 'to_a' AND recv.kind = 'array' OR name = 'to_h' AND recv.kind = 'hash' AND blk IS NULL OR recv.kind = 'call' AND recv.name = name AND name IN ('to_s', 'to_sym', 'to_i', 'to_f', 'to_a', 'to_h') AND recv.n = 1)", "=concat('Redundant `', name, '` detected.')", "sel"),
    R("Lint/RequireParentheses", "call", "form = 'command' AND name like '%?' AND argc > 0 AND get(args, argc - 1).kind IN ('and', 'or') AND get(args, argc - 1).name IN ('&&', '||')", "Use parentheses in the method call to avoid confusion about precedence."),
    R("Lint/RequireRelativeSelfPath", "call", "recv IS NULL AND name = 'require_relative' AND a0.kind = 'string' AND regexp_replace(regexp_extract(path, '[^/]*$', 0), '[.]rb$', '') = regexp_replace(a0.name, '[.]rb$', '')", "Remove the `require_relative` that requires itself."),
    R("Lint/ShadowingOuterLocalVariable", "required_parameter", "form = 'shadows' AND p.kind = 'block_parameters' AND NOT name like '\\\\_%'", "Shadowing outer local variable."),
    R("Lint/TripleQuotes", "interpolated_string", "form = 'adjacent' AND size(kids) = 3 AND length(get(kids, 0).src) = 2 AND length(get(kids, 2).src) = 2 AND get(kids, 0).at.end = get(kids, 1).at.start AND get(kids, 1).at.end = get(kids, 2).at.start", "Delimiting a string with multiple quotes has no effect, use a single quote instead."),
    R("Lint/UnderscorePrefixedVariableName", "def block lambda", "size(filter(kids2, k -> k.role = 'param' AND k.name like '\\\\_%' AND k.name <> '_' AND array_contains(reads, k.name))) > 0", "Do not use prefix `_` for a variable that is used.", "transform(filter(kids2, k -> k.role = 'param' AND k.name like '\\\\_%' AND k.name <> '_' AND array_contains(reads, k.name)), k -> k.sel)", many=True),
    R("Lint/UnescapedBracketInRegexp", "regular_expression", r"name rlike '^[^\\[\\]\\\\]*\\]'", "Regular expression has `]` without escape.", span("at.start + length(open) + length(regexp_extract(name, '^[^\\\\[\\\\]]*', 0))", "at.start + length(open) + length(regexp_extract(name, '^[^\\\\[\\\\]]*', 0)) + 1")),
    R("Lint/UnexpectedBlockArity", "call", "recv IS NOT NULL AND name IN ('chunk_while', 'each_with_index', 'each_with_object', 'inject', 'max', 'min', 'minmax', 'reduce', 'slice_when', 'sort') AND blk.kind = 'block' AND size(filter(bk, k -> k.role = 'params')) = 1 AND get(filter(bk, k -> k.role = 'params'), 0).n < 2 AND NOT get(filter(bk, k -> k.role = 'params'), 0).src rlike '[*(]'", "=concat('`', name, '` expects at least 2 positional arguments, got ', get(filter(bk, k -> k.role = 'params'), 0).n, '.')"),
    R("Lint/UnreachableLoop", "while until for", "coalesce(form, '') <> 'modifier' AND exists(body, b -> b.kind IN ('break', 'return') OR b.kind = 'call' AND b.name IN ('raise', 'throw', 'exit') AND b.form = 'command') AND NOT exists(body, b -> b.src rlike '\\\\bnext\\\\b')", "This loop will have at most one iteration."),
    R("Lint/UnreachableLoop", "call", "recv IS NULL AND name = 'loop' AND blk.kind = 'block' AND exists(bk, b -> b.role = 'body' AND b.kind IN ('break', 'return'))", "This loop will have at most one iteration."),
    R("Lint/UnusedBlockArgument", "block", f"nbody > 0 AND size({UNUSED}) > 0 AND NOT array_contains(reads, 'binding') AND p.kind = 'call' AND p.name NOT IN ('lambda', 'define_method', 'proc')", f"@transform({UNUSED}, k -> concat('Unused block argument - `', k.name, '`. ', CASE WHEN size({UNUSED}) < size({PARAMS}) THEN concat('If it\\'s necessary, use `_` or `_', k.name, '` as an argument name to indicate that it won\\'t be used.') WHEN size({PARAMS}) > 1 THEN 'You can omit all the arguments if you don\\'t care about them.' ELSE 'You can omit the argument if you don\\'t care about it.' END))", f"transform({UNUSED}, k -> k.sel)", many=True),
    R("Lint/UselessAccessModifier", "class module", f"exists(body, b -> {MODIFIER})", "Useless access modifier.", f"transform(filter(transform(body, (b, i) -> named_struct('b', b, 'n', get(body, i + 1))), x -> x.b.kind = 'call' AND x.b.form = 'name' AND x.b.name IN ('private', 'protected', 'public') AND (x.n IS NULL OR x.n.kind = 'call' AND x.n.form = 'name' AND x.n.name IN ('private', 'protected', 'public'))), x -> x.b.at)", many=True),
    R("Lint/UselessConstantScoping", "class module", f"exists(body, b -> {MODIFIER}) AND NOT exists(body, b -> b.kind = 'call' AND b.name = 'private_constant')", "Useless `private` access modifier for constant scope.", f"transform(filter(transform(body, (b, i) -> named_struct('b', b, 'm', get(reverse(filter(slice(body, 1, i), b -> {MODIFIER})), 0))), x -> x.b.kind = 'constant_write' AND x.m.name = 'private'), x -> x.b.at)", many=True),
    R("Lint/UselessDefaultValueArgument", "call", f"blk.kind = 'block' AND argc = 2 AND (name = 'fetch' AND recv IS NOT NULL OR name = 'new' AND {root('recv', 'Array')})", "Block supersedes default value argument.", "a1.at"),
    R("Lint/UselessDefined", "defined", "val.kind IN ('string', 'interpolated_string', 'symbol', 'interpolated_symbol')", "=concat('Calling `defined?` with a ', if(val.kind like '%string', 'string', 'symbol'), ' argument will always return a truthy value.')"),
    R("Lint/UselessMethodDefinition", "def", "nbody = 1 AND b0.kind = 'forwarding_super' AND NOT exists(kids2, k -> k.kind IN ('optional_parameter', 'optional_keyword_parameter', 'rest_parameter'))", "Useless method definition detected."),
    R("Lint/UselessNumericOperation", "call", "form = 'binary' AND recv.kind IN ('local_variable_read', 'call') AND (name IN ('+', '-') AND a0.src = '0' OR name IN ('*', '/', '**') AND a0.src = '1') AND (recv.kind <> 'call' OR recv.form = 'name')", "Do not apply inconsequential numeric operations to variables."),
    R("Lint/UselessOr", "or", "get(kids, 0).kind = 'call' AND get(kids, 0).name IN ('to_a', 'to_c', 'to_d', 'to_i', 'to_f', 'to_h', 'to_r', 'to_s', 'to_sym', 'intern', 'inspect', 'hash', 'object_id', '__id__') AND get(kids, 0).n = 1 AND NOT get(kids, 0).src like '%&.%'", "=concat('`', get(kids, 1).src, '` will never evaluate because `', get(kids, 0).src, '` always returns a truthy value.')", thru("sel", "get(kids, 1).at")),
    R("Lint/UselessRescue", "rescue", "nbody = 1 AND b0.kind = 'call' AND b0.name = 'raise' AND (b0.n = 0 OR b0.src = concat('raise ', get(filter(kids, k -> k.role = 'target'), 0).name))", "Useless `rescue` detected."),
    R("Lint/UselessSetterCall", "def", "nbody > 1 AND get(body, nbody - 1).kind = 'call_write' AND exists(kids2, k -> k.of = size(kids) - 1 AND k.role = 'recv' AND k.kind = 'local_variable_read') AND exists(body, b -> b.kind = 'local_variable_write' AND b.name = get(filter(kids2, k -> k.of = size(kids) - 1 AND k.role = 'recv'), 0).name)", "=concat('Useless setter call to local variable `', get(filter(kids2, k -> k.of = size(kids) - 1 AND k.role = 'recv'), 0).name, '`.')", "get(filter(kids2, k -> k.of = size(kids) - 1 AND k.role = 'recv'), 0).at"),
    R("Lint/Void", "def begin block program", f"nbody > 1 AND exists(slice(body, 1, nbody - 1), b -> b.kind = 'call' AND b.form = 'binary' AND b.name IN ({COMPARE}, '+', '*', '**'))", f"@transform(filter(slice(body, 1, nbody - 1), b -> b.kind = 'call' AND b.form = 'binary' AND b.name IN ({COMPARE}, '+', '*', '**')), b -> concat('Operator `', b.name, '` used in void context.'))", f"transform(filter(slice(body, 1, nbody - 1), b -> b.kind = 'call' AND b.form = 'binary' AND b.name IN ({COMPARE}, '+', '*', '**')), b -> b.sel)", many=True),
    R("Lint/Void", "def begin block program", f"nbody > 1 AND exists(slice(body, 1, nbody - 1), b -> b.kind IN ({BASIC}, 'string', 'local_variable_read', 'instance_variable_read'))", f"@transform(filter(slice(body, 1, nbody - 1), b -> b.kind IN ({BASIC}, 'string', 'local_variable_read', 'instance_variable_read')), b -> concat(if(b.kind like '%variable_read', 'Variable', 'Literal'), ' `', b.src, '` used in void context.'))", f"transform(filter(slice(body, 1, nbody - 1), b -> b.kind IN ({BASIC}, 'string', 'local_variable_read', 'instance_variable_read')), b -> b.at)", many=True),
    R("Naming/BlockParameterName", "required_parameter optional_parameter", "p.kind = 'block_parameters' AND name rlike '[A-Z]'", "Only use lowercase characters for block parameter.", "sel"),
    R("Naming/MemoizedInstanceVariableName", "def", "nbody > 0 AND get(body, nbody - 1).kind = 'instance_variable_or_write' AND nbody = 1 AND name NOT IN ('initialize') AND regexp_replace(b0.name, '^@_?', '') <> regexp_replace(name, '[?!]$', '')", "=concat('Memoized variable `', b0.name, '` does not match method name `', name, '`. Use `@', regexp_replace(name, '[?!]$', ''), '` instead.')", "b0.sel"),
    R("Bundler/DuplicatedGem", "program", f"path rlike '(^|/)(Gemfile|gems[.]rb)$' AND size({GEM_AGAIN}) > 0", f"@transform({GEM_AGAIN}, z -> concat('Gem `', z.k.a0, '` requirements already given on line ', z.f.at.line, ' of the Gemfile.'))", f"transform({GEM_AGAIN}, z -> z.k.at)", many=True),
    R("Bundler/OrderedGems", "program", f"path rlike '(^|/)(Gemfile|gems[.]rb)$' AND size({GEM_PAIRS}) > 0", f"@transform({GEM_PAIRS}, z -> concat('Gems should be sorted in an alphabetical order within their section of the Gemfile. Gem `', z.k.a0, '` should appear before `', z.b.a0, '`.'))", f"transform({GEM_PAIRS}, z -> z.k.at)", many=True),
    R("Gemspec/OrderedDependencies", "block", f"path like '%.gemspec' AND size({DEPENDENCY_PAIRS}) > 0", f"@transform({DEPENDENCY_PAIRS}, z -> concat('Dependencies should be sorted in an alphabetical order within their section of the gemspec. Dependency `', z.k.a0, '` should appear before `', z.b.a0, '`.'))", f"transform({DEPENDENCY_PAIRS}, z -> z.k.at)", many=True),
    R("Gemspec/DuplicatedAssignment", "block", f"path like '%.gemspec' AND size({ASSIGNED}) > 0", f"@transform({ASSIGNED}, x -> concat('`', x.k.name, '=` method calls already given on line ', x.f.at.line, ' of the gemspec.'))", f"transform({ASSIGNED}, x -> x.k.at)", many=True),
    R("Gemspec/DevelopmentDependencies", "call", "name = 'add_development_dependency' AND recv IS NOT NULL AND path like '%.gemspec' AND a0.kind = 'string'", "Specify development dependencies in Gemfile."),
)
