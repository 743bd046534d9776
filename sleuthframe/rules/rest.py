"""Rules of the Style, Lint and Layout departments about branches, chains and
comments. Names, messages and listed names are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import span, thru

from sleuthframe.rules.lint_more import repeated
from sleuthframe.rules.style import FROM_SEL, RECV_ON, names, table

WRITES = "local_variable_write instance_variable_write class_variable_write global_variable_write"
#: Which of the kids the else branch is, and the statements in it.
ELSE = "filter(kids2, k -> k.of = i_else)"
LAST = "get(body, nbody - 1)"
#: Methods that change their receiver and return it.
IN_PLACE = "'append', 'clear', 'collect!', 'compare_by_identity', 'concat', 'delete_if', 'fill', 'insert', 'keep_if', 'map!', 'merge!', 'prepend', 'push', 'rehash', 'replace', 'reverse!', 'rotate!', 'shuffle!', 'sort!', 'sort_by!', 'transform_keys!', 'transform_values!', 'unshift', 'update'"
MEMBERS = {"class_variables": "class_variable_defined?", "constants": "const_defined?", "included_modules": "include?", "instance_methods": "method_defined?", "public_instance_methods": "public_method_defined?", "private_instance_methods": "private_method_defined?", "protected_instance_methods": "protected_method_defined?"}
INVERSE = {"!=": "==", ">": "<=", "<=": ">", "<": ">=", ">=": "<", "!~": "=~"}
PREDICATES = {"zero?": "nonzero?", "nonzero?": "zero?", "any?": "none?", "none?": "any?", "even?": "odd?", "odd?": "even?"}
NUMBERS = {"to_i": "Integer", "to_f": "Float", "to_c": "Complex", "to_r": "Rational"}
KEYWORDS = "(?i)^(#+ ?)(TODO|FIXME|OPTIMIZE|HACK|REVIEW|NOTE)(\\\\s*:)?(\\\\s+)?(.*)$"
LOOPS = "'each', 'each_with_index', 'each_with_object', 'reverse_each', 'each_pair', 'each_key', 'each_value'"
BODIES = "program def block begin class module if"
#: Statements beside the one before them.
NEIGHBOURS = "transform(body, (b, i) -> named_struct('b', b, 'a', get(body, i - 1)))"
LOOPED = f"filter({NEIGHBOURS}, x -> x.b.kind = 'call' AND x.a.kind = 'call' AND x.b.name IN ({LOOPS}) AND x.b.name = x.a.name AND x.b.k0 = x.a.k0 AND x.b.src rlike '([{{]|\\\\bdo\\\\b)' AND x.a.src rlike '([{{]|\\\\bdo\\\\b)')"
UNSORTED = f"filter({NEIGHBOURS}, x -> x.b.kind = 'call' AND x.b.name IN ('require', 'require_relative') AND x.a.name = x.b.name AND x.a.at.last_line + 1 = x.b.at.line AND x.b.a0 < x.a.a0)"
AGAIN = repeated("body", "k.kind = 'call' AND k.name = 'group'", "regexp_extract({x}.src, '^group +(.*?) do', 1)")
#: Three assignments that swap two variables by a third one.
SWAPS = "filter(transform(body, (a, i) -> named_struct('a', a, 'b', get(body, i + 1), 'c', get(body, i + 2))), x -> x.a.kind = 'local_variable_write' AND x.b.kind like '%_variable_write' AND x.c.kind like '%_variable_write' AND x.a.k0 = x.b.name AND x.b.k0 = x.c.name AND x.c.k0 = x.a.name)"
CLAUSE = "form IS NULL AND open IN ('if', 'unless')"

RULES = (
    R("Layout/CommentIndentation", "comment", "open = 'own' AND form IS NULL AND next IS NOT NULL AND trim(next) <> '' AND NOT next rlike '^\\\\s*(#|end\\\\b|else\\\\b|elsif\\\\b|when\\\\b|in\\\\b|rescue\\\\b|ensure\\\\b|[})\\\\]])' AND length(regexp_extract(next, '^ *', 0)) <> at.column - 1", "=concat('Incorrect indentation detected (column ', at.column - 1, ' instead of ', length(regexp_extract(next, '^ *', 0)), ').')"),
    R("Lint/CopDirectiveSyntax", "comment", "name rlike '^#\\\\s*rubocop\\\\s*:' AND NOT name rlike '^# ?rubocop ?: ?((disable|enable|todo) +([A-Z]\\\\w*(/[A-Z]\\\\w*)*|all)( *, *([A-Z]\\\\w*(/[A-Z]\\\\w*)*|all))*( *-- .*)?|push.*|pop.*)\\\\s*$'", "=concat('Malformed directive comment detected. ', CASE WHEN name rlike ':\\\\s*$' THEN 'The mode name is missing.' WHEN NOT name rlike ':\\\\s*(disable|enable|todo|push|pop)\\\\b' THEN 'The mode name must be one of `enable`, `disable`, `todo`, `push`, or `pop`.' WHEN name rlike '(disable|enable|todo)\\\\s*$' THEN 'The cop name is missing.' ELSE 'Cop names must be separated by commas. Comment in the directive must start with `--`.' END)"),
    R("Lint/ElseLayout", "if", f"{CLAUSE} AND els.kind = 'else' AND els.n > 1 AND get({ELSE}, 0).at.line = els.sel.line AND at.line <> at.last_line", "Odd `else` layout detected. Did you mean to use `elsif`?", f"get({ELSE}, 0).at"),
    R("Lint/NumberConversion", "call", f"name IN ({names(NUMBERS)}) AND recv IS NOT NULL AND argc = 0 AND op = '.' AND recv.kind NOT IN ('integer', 'float', 'rational') AND recv.src NOT IN ('Time.now', 'DateTime.now')", f"=concat('Replace unsafe number conversion with number class parsing, instead of using `', src, '`, use stricter `', {table('name', NUMBERS)}, '(', recv.src, if(name = 'to_i', ', 10', ''), ')`.')"),
    R("Lint/ParenthesesAsGroupedExpression", "call", "form = 'command' AND argc = 1 AND a0.kind = 'parentheses' AND a0.n = 1 AND a0.at.start = sel.end + 1", "=concat('`', a0.src, '` interpreted as grouped expression.')", span("sel.end", "a0.at.start", "sel"), fix="''"),
    R("Style/AccessorGrouping", "class module singleton_class", "exists(body, b -> b.kind = 'call' AND b.name IN ('attr_reader', 'attr_writer', 'attr_accessor'))", "@transform(filter(body, b -> b.kind = 'call' AND b.name IN ('attr_reader', 'attr_writer', 'attr_accessor') AND size(filter(body, o -> o.kind = 'call' AND o.name = b.name)) > 1), b -> concat('Group together all `', b.name, '` attributes.'))", "transform(filter(body, b -> b.kind = 'call' AND b.name IN ('attr_reader', 'attr_writer', 'attr_accessor') AND size(filter(body, o -> o.kind = 'call' AND o.name = b.name)) > 1), b -> b.at)", many=True),
    R("Style/ClassMethodsDefinitions", "singleton_class", "val.kind = 'self' AND nbody > 0 AND forall(body, b -> b.kind = 'def')", "Do not define public methods within class << self."),
    R("Style/CombinableLoops", BODIES, f"nbody > 1 AND exists(body, b -> b.kind = 'call' AND b.name IN ({LOOPS})) AND size({LOOPED}) > 0", "Combine this loop with the previous loop.", f"transform({LOOPED}, x -> x.b.at)", many=True),
    R("Style/CommentAnnotation", "comment", f"form IS NULL AND name rlike '{KEYWORDS}' AND (regexp_extract(name, '{KEYWORDS}', 3) <> '' OR regexp_extract(name, '{KEYWORDS}', 4) <> '') AND NOT (initcap(regexp_extract(name, '{KEYWORDS}', 2)) = regexp_extract(name, '{KEYWORDS}', 2) AND regexp_extract(name, '{KEYWORDS}', 3) = '' AND regexp_extract(name, '{KEYWORDS}', 5) <> '') AND NOT (regexp_extract(name, '{KEYWORDS}', 2) = upper(regexp_extract(name, '{KEYWORDS}', 2)) AND regexp_extract(name, '{KEYWORDS}', 3) = ':' AND regexp_extract(name, '{KEYWORDS}', 4) = ' ' AND regexp_extract(name, '{KEYWORDS}', 5) <> '') AND NOT (lower(regexp_extract(name, '{KEYWORDS}', 2)) = regexp_extract(name, '{KEYWORDS}', 2) AND regexp_extract(name, '{KEYWORDS}', 3) = '')", f"=if(regexp_extract(name, '{KEYWORDS}', 5) = '', concat('Annotation comment, with keyword `', upper(regexp_extract(name, '{KEYWORDS}', 2)), '`, is missing a note.'), concat('Annotation keywords like `', regexp_extract(name, '{KEYWORDS}', 2), '` should be all upper case, followed by a colon, and a space, then a note describing the problem.'))", span(f"at.start + length(regexp_extract(name, '{KEYWORDS}', 1))", f"at.end - length(regexp_extract(name, '{KEYWORDS}', 5))")),
    R("Style/ConstantVisibility", "class module", "exists(body, b -> b.kind = 'constant_write') AND NOT exists(body, b -> b.kind = 'call' AND b.name IN ('private_constant', 'public_constant'))", "@transform(filter(body, b -> b.kind = 'constant_write'), b -> concat('Explicitly make `', b.name, '` public or private using either `#public_constant` or `#private_constant`.'))", "transform(filter(body, b -> b.kind = 'constant_write'), b -> b.at)", many=True),
    R("Style/DirEmpty", "call", "(name = 'empty?' AND recv.name IN ('children') OR name = 'none?' AND recv.name = 'each_child') AND recv.kind = 'call' AND get(rk, 0).src IN ('Dir', '::Dir') AND size(rk) = 2 AND argc = 0", "=concat('Use `', get(rk, 0).src, '.empty?(', get(rk, 1).src, ')` instead.')"),
    R("Style/Documentation", "class", "p.kind IN ('program', 'module') AND exists(body, b -> b.kind = 'def') AND NOT coalesce(prev rlike '^\\\\s*#', false)", "=concat('Missing top-level documentation comment for `class ', get(kids, 0).src, '`.')", thru("sel", "get(kids, 0).at")),
    R("Style/EmptyHeredoc", "string", "form = 'heredoc' AND name = ''", "Use an empty string literal instead of heredoc."),
    R("Style/Encoding", "comment", "at.line <= 2 AND name rlike '(?i)^#.*coding[:=] *utf-8' AND open = 'own'", "Unnecessary utf-8 encoding comment."),
    R("Style/EndlessMethod", "def", "form = 'endless' AND at.line <> at.last_line", "Avoid endless method definitions with multiple lines."),
    R("Style/IdenticalConditionalBranches", "if", f"{CLAUSE} AND nbody > 0 AND els.kind = 'else' AND els.n > 0 AND {LAST}.src = get({ELSE}, els.n - 1).src", f"=concat('Move `', {LAST}.src, '` out of the conditional.')", f"array({LAST}.at, get({ELSE}, els.n - 1).at)", many=True),
    R("Style/IfInsideElse", "if", f"{CLAUSE} AND els.kind = 'else' AND els.n = 1 AND get({ELSE}, 0).kind = 'if' AND coalesce(get({ELSE}, 0).form, '') NOT IN ('modifier', 'ternary')", "Convert `if` nested inside `else` to `elsif`.", f"get({ELSE}, 0).sel"),
    R("Style/InvertibleUnlessCondition", "unless", f"cond.kind = 'call' AND els IS NULL AND (cond.form = 'binary' AND cond.name IN ({names(INVERSE)}) OR cond.name IN ({names(PREDICATES)}) AND cond.n = 1)", f"=concat('Prefer `if ', if(cond.form = 'binary', concat(get(filter(kids2, k -> k.of = i_cond), 0).src, ' ', {table('cond.name', INVERSE)}, ' ', get(filter(kids2, k -> k.of = i_cond), 1).src), concat(get(filter(kids2, k -> k.of = i_cond), 0).src, '.', {table('cond.name', PREDICATES)})), '` over `unless ', cond.src, '`.')"),
    R("Style/KeywordParametersOrder", "parameters block_parameters", "exists(kids, k -> k.kind = 'required_keyword_parameter')", "Place optional keyword parameters at the end of the parameters list.", "transform(filter(transform(kids, (k, i) -> named_struct('k', k, 'i', i)), x -> x.k.kind = 'optional_keyword_parameter' AND exists(slice(kids, x.i + 2, 1000), y -> y.kind = 'required_keyword_parameter')), x -> x.k.at)", many=True),
    R("Style/LineEndConcatenation", "call", "name = '+' AND form = 'binary' AND recv.kind IN ('string', 'interpolated_string') AND a0.kind IN ('string', 'interpolated_string') AND recv.at.last_line <> a0.at.line AND coalesce(recv.form, '') <> 'heredoc'", "Use `\\` instead of `+` to concatenate multiline strings.", "sel"),
    R("Style/MissingRespondToMissing", "class module", "exists(body, b -> b.kind = 'def' AND b.name = 'method_missing') AND NOT exists(body, b -> b.kind = 'def' AND b.name = 'respond_to_missing?')", "When using `method_missing`, define `respond_to_missing?`.", "get(filter(body, b -> b.kind = 'def' AND b.name = 'method_missing'), 0).at"),
    R("Style/ModuleMemberExistenceCheck", "call", f"name = 'include?' AND argc = 1 AND recv.kind = 'call' AND recv.name IN ({names(MEMBERS)}) AND recv.n = 1 AND exists(rk, k -> k.role = 'recv')", f"=concat('Use `', {table('recv.name', MEMBERS)}, '(', a0.src, ')` instead.')", RECV_ON),
    R("Style/MultilineBlockChain", "call", "blk.kind = 'block' AND recv.kind = 'call' AND exists(rk, k -> k.role = 'block' AND k.kind = 'block' AND k.at.line <> k.at.last_line AND k.at.end = recv.at.end)", "Avoid multi-line chains of blocks.", "named_struct('start', recv.at.end - if(recv.src like '%end' OR recv.src IS NULL, 3, 1), 'end', sel.end, 'line', recv.at.last_line, 'column', recv.at.last_column - if(recv.src like '%end' OR recv.src IS NULL, 2, 0), 'last_line', sel.last_line, 'last_column', sel.last_column)"),
    R("Style/MultilineIfModifier", "if unless", "form = 'modifier' AND b0.at.line <> b0.at.last_line", "=concat('Favor a normal ', kind, '-statement over a modifier clause in a multiline statement.')"),
    R("Style/MultilineWhenThen", "when", "oper.name = 'then' AND (nbody = 0 OR b0.at.line > oper.at.line)", "Do not use `then` for multiline `when` statement.", "oper.at", fix="''"),
    R("Style/MultilineInPatternThen", "in", "oper.name = 'then' AND (nbody = 0 OR b0.at.line > oper.at.line)", "Do not use `then` for multiline `in` statement.", "oper.at", fix="''"),
    R("Style/MultilineMethodSignature", "def", "params.at.line <> params.at.last_line", "Avoid multi-line method signatures.", "named_struct('start', at.start, 'end', params.at.end, 'line', at.line, 'column', at.column, 'last_line', params.at.last_line, 'last_column', params.at.last_column)"),
    R("Style/NegatedIfElseCondition", "if", "cond.kind = 'call' AND cond.name IN ('!', '!=', '!~') AND els IS NOT NULL AND els.kind <> 'if' AND nbody > 0 AND (form = 'ternary' OR form IS NULL AND open = 'if') AND NOT (cond.name = '!' AND get(filter(kids2, k -> k.of = i_cond), 0).name = '!')", "=concat('Invert the negated condition and swap the ', if(form = 'ternary', 'ternary', 'if-else'), ' branches.')"),
    R("Style/OneLineConditional", "if unless", f"{CLAUSE} AND at.line = at.last_line AND els.kind = 'else' AND nbody = 1 AND els.n = 1 AND oper.name = 'then'", "=concat('Favor the ternary operator (`?:`) over single-line `', open, '/then/else/end` constructs.')"),
    R("Style/PredicateWithKind", "call", "name IN ('any?', 'all?', 'none?', 'one?') AND argc = 0 AND blk.kind = 'block' AND size(bk) = 2 AND get(bk, 1).kind = 'call' AND get(bk, 1).name IN ('is_a?', 'kind_of?') AND get(bk, 1).src rlike concat('^', substr(get(bk, 0).src, 2, length(get(bk, 0).src) - 2), '[.](is_a|kind_of)[?][(][A-Z][A-Za-z0-9_:]*[)]$')", "=concat('Prefer `', name, '(', regexp_extract(get(bk, 1).src, '[(](.*)[)]$', 1), ')` to `', name, ' { ... }` with a kind check.')"),
    R("Style/RandomWithOffset", "call", "form = 'binary' AND name IN ('+', '-') AND (recv.kind = 'call' AND recv.name = 'rand' AND exists(rk, k -> k.role = 'arg' AND k.kind IN ('integer', 'range')) AND a0.kind = 'integer' OR recv.kind = 'integer' AND a0.kind = 'call' AND a0.name = 'rand' AND a0.n > 0)", "Prefer ranges when generating random numbers instead of integers with offsets."),
    R("Style/RedundantAssignment", "def", "nbody > 1 AND get(body, nbody - 1).kind = 'local_variable_read' AND get(body, nbody - 2).kind = 'local_variable_write' AND get(body, nbody - 1).name = get(body, nbody - 2).name", "Redundant assignment before returning detected.", "get(body, nbody - 2).at"),
    R("Style/RedundantSelfAssignment", WRITES, f"val.kind = 'call' AND val.name IN ({IN_PLACE}) AND get(filter(kids2, k -> k.of = i_value AND k.role = 'recv'), 0).src = name", "=concat('Redundant self assignment detected. Method `', val.name, '` modifies its receiver in place.')", "oper.at"),
    R("Style/RequireOrder", "program", f"nbody > 1 AND size({UNSORTED}) > 0", f"@transform({UNSORTED}, x -> concat('Sort `', x.b.name, '` in alphabetical order.'))", f"transform({UNSORTED}, x -> x.b.at)", many=True),
    R("Style/ReturnNilInPredicateMethodDefinition", "return", "scope.kind = 'def' AND scope.name like '%?' AND (size(kids) = 0 OR size(kids) = 1 AND get(kids, 0).kind = 'nil') AND NOT exists(up, u -> u.kind IN ('block', 'lambda'))", "Return `false` instead of `nil` in predicate methods."),
    R("Style/SingleLineBlockParams", "call", "name IN ('reduce', 'inject') AND recv IS NOT NULL AND blk.kind = 'block' AND blk.at.line = blk.at.last_line AND get(bk, 0).kind = 'block_parameters' AND get(bk, 0).n = 2 AND NOT get(bk, 0).src rlike '^[|]_?acc, _?elem[|]$' AND get(bk, 0).src rlike '^[|]\\\\w+, \\\\w+[|]$'", "=concat('Name `', name, '` block params `|acc, elem|`.')", "get(bk, 0).at"),
    R("Style/SingleLineDoEndBlock", "call", "blk.kind = 'block' AND blk.open = 'do' AND blk.at.line = blk.at.last_line", "Prefer multiline `do`...`end` block."),
    R("Style/SingleLineMethods", "def", "at.line = at.last_line AND coalesce(form, '') <> 'endless' AND nbody > 0", "Avoid single-line method definitions."),
    R("Style/SoleNestedConditional", "if unless", f"{CLAUSE} AND els IS NULL AND nbody = 1 AND b0.kind IN ('if', 'unless') AND coalesce(b0.form, '') NOT IN ('ternary', 'has_elsif') AND NOT exists(kids2, k -> k.of = i_body AND k.role = 'else') AND NOT cond.kind like '%_write'", "=concat('Consider merging nested conditions into outer `', open, '` conditions.')", "b0.sel"),
    R("Style/StaticClass", "class", "get(filter(kids, k -> k.role = 'superclass'), 0) IS NULL AND nbody > 0 AND forall(body, b -> b.kind = 'def' AND b.src like 'def self.%' OR b.kind = 'constant_write') AND exists(body, b -> b.kind = 'def')", "Prefer modules to classes with only class methods."),
    R("Style/StringConcatenation", "call", "name = '+' AND form = 'binary' AND (recv.kind IN ('string', 'interpolated_string') AND a0.kind NOT IN ('string', 'interpolated_string') OR a0.kind IN ('string', 'interpolated_string') AND recv.kind NOT IN ('string', 'interpolated_string')) AND NOT (p.kind = 'call' AND p.name = '+') AND at.line = at.last_line", "Prefer string interpolation to string concatenation."),
    R("Style/StringLiteralsInInterpolation", "string", "open = '\"' AND NOT name rlike '[\\\\\\\\\\'\\n]|#[{@$]' AND exists(up, u -> u.kind = 'embedded_statements') AND exists(up, u -> u.kind IN ('interpolated_string', 'interpolated_symbol', 'interpolated_regular_expression')) AND role <> 'part'", "Prefer single-quoted strings inside interpolations."),
    R("Style/UnlessLogicalOperators", "unless", "cond.kind IN ('and', 'or') AND exists(kids2, k -> k.of = i_cond AND k.kind IN ('and', 'or') AND k.kind <> cond.kind)", "Do not use mixed logical operators in an `unless`."),
    R("Style/WhileUntilModifier", "while until", "coalesce(form, '') <> 'modifier' AND nbody = 1 AND at.last_line - at.line = 2 AND b0.at.line = b0.at.last_line AND cond.at.line = cond.at.last_line AND NOT src like '%#%' AND b0.kind NOT IN ('if', 'unless', 'while', 'until', 'case', 'case_match', 'rescue_modifier') AND NOT cond.kind like '%\\\\_write' AND NOT exists(kids2, k -> k.of = i_cond AND k.kind like '%\\\\_write') AND ind + length(b0.src) + length(cond.src) + 7 <= 120", "=concat('Favor modifier `', kind, '` usage when having a single-line body.')", "sel"),
    R("Lint/ErbNewArguments", "call", "name = 'new' AND recv.src IN ('ERB', '::ERB') AND argc >= 3 AND get(args, 2).kind NOT IN ('keyword_hash', 'nil')", "=concat('Passing trim_mode with the 3rd argument of `ERB.new` is deprecated. Use keyword argument like `ERB.new(str, trim_mode: ', get(args, 2).src, ')` instead.')", "get(args, 2).at"),
    R("Lint/ItWithoutArgumentsInBlock", "call", "recv IS NULL AND name = 'it' AND form = 'name' AND p.kind IN ('block', 'call') AND exists(slice(up, 1, 3), u -> u.kind = 'block') AND NOT exists(up, u -> u.kind = 'call' AND u.name IN ('describe', 'context'))", "`it` calls without arguments will refer to the first block param in Ruby 3.4; use `it()` or `self.it`."),
    R("Bundler/GemComment", "call", "recv IS NULL AND name = 'gem' AND a0.kind = 'string' AND path rlike '(^|/)(Gemfile|gems[.]rb)$' AND NOT coalesce(prev rlike '^\\\\s*#', false) AND NOT rest rlike '^\\\\s*#'", "Missing gem description comment."),
    R("Bundler/GemVersion", "call", "recv IS NULL AND name = 'gem' AND a0.kind = 'string' AND path rlike '(^|/)(Gemfile|gems[.]rb)$' AND (argc = 1 OR a1.kind <> 'string') AND NOT src rlike '(branch|ref|tag):'", "Gem version specification is required."),
    R("Bundler/DuplicatedGroup", "program", f"path rlike '(^|/)(Gemfile|gems[.]rb)$' AND size({AGAIN}) > 0", f"@transform({AGAIN}, x -> concat('Gem group `', regexp_extract(x.k.src, '^group +(.*?) do\\\\b', 1), '` already defined on line ', x.f.at.line, ' of the Gemfile.'))", f"transform({AGAIN}, x -> {span('x.k.at.start', 'x.k.at.start + length(regexp_extract(x.k.src, ' + chr(39) + '^(group +.*?) do' + chr(39) + ', 1))', 'x.k.at')})", many=True),
    R("Gemspec/DependencyVersion", "call", "name IN ('add_dependency', 'add_runtime_dependency', 'add_development_dependency') AND recv IS NOT NULL AND a0.kind = 'string' AND argc = 1 AND path like '%.gemspec'", "Dependency version specification is required."),
    R("Style/SwapValues", BODIES, f"nbody > 2 AND exists(body, b -> b.kind = 'local_variable_write') AND size({SWAPS}) > 0", f"@transform({SWAPS}, x -> concat('Replace this and assignments at lines ', x.b.at.line, ' and ', x.c.at.line, ' with `', x.b.name, ', ', x.c.name, ' = ', x.c.name, ', ', x.b.name, '`.'))", f"transform({SWAPS}, x -> x.a.at)", many=True),
    R("Style/SafeNavigation", "and", "name = '&&' AND get(kids, 0).kind IN ('local_variable_read', 'instance_variable_read', 'call') AND get(kids, 1).kind = 'call' AND get(kids, 1).op = '.' AND get(kids, 1).name NOT IN ('nil?', '!', 'empty?') AND get(filter(kids2, k -> k.of = 1 AND k.role = 'recv'), 0).src = get(kids, 0).src AND p.kind NOT IN ('and', 'or') AND get(kids, 0).form IS DISTINCT FROM 'binary'", "Use safe navigation (`&.`) instead of checking if an object exists before calling the method."),
    R("Style/SafeNavigation", "if", "form = 'modifier' AND cond.kind IN ('local_variable_read', 'instance_variable_read') AND b0.kind = 'call' AND b0.op = '.' AND b0.name NOT IN ('nil?', '!', 'empty?') AND get(filter(kids2, k -> k.of = i_body AND k.role = 'recv'), 0).src = cond.src", "Use safe navigation (`&.`) instead of checking if an object exists before calling the method."),
    R("Style/EvalWithLocation", "call", "name IN ('class_eval', 'module_eval', 'instance_eval') AND argc = 1 AND a0.kind IN ('string', 'interpolated_string') AND blk IS NULL", "=concat('Pass `__FILE__` and `__LINE__` to `', name, '`.')"),
    R("Style/EvalWithLocation", "call", "name = 'eval' AND recv IS NULL AND argc = 1 AND a0.kind IN ('string', 'interpolated_string')", "Pass a binding, `__FILE__`, and `__LINE__` to `eval`."),
    R("Style/MagicCommentFormat", "comment", "at.line <= 3 AND name rlike '(?i)frozen-string-literal:'", "Prefer snake case for magic comments.", span("at.start + regexp_instr(name, '(?i)frozen-string-literal') - 1", "at.start + regexp_instr(name, '(?i)frozen-string-literal') + 20")),
    R("Style/HashTransformValues", "call", "name = 'to_h' AND argc = 0 AND blk IS NULL AND recv.name IN ('map', 'collect') AND src rlike '[.](map|collect) [{] [|](\\\\w+), (\\\\w+)[|] \\\\[\\\\2, (?!.*\\\\b\\\\2\\\\b).*\\\\] [}][.]to_h$'", "=concat('Prefer `transform_values` over `', recv.name, ' {...}.to_h`.')"),
    R("Style/HashTransformKeys", "call", "name = 'to_h' AND argc = 0 AND blk IS NULL AND recv.name IN ('map', 'collect') AND src rlike '[.](map|collect) [{] [|](\\\\w+), (\\\\w+)[|] \\\\[(?!.*\\\\b\\\\3\\\\b.*,).*, \\\\3\\\\] [}][.]to_h$'", "=concat('Prefer `transform_keys` over `', recv.name, ' {...}.to_h`.')"),
    R("Style/HashSlice", "call", "name IN ('select', 'filter') AND recv IS NOT NULL AND argc = 0 AND blk.kind = 'block' AND blk.src rlike '^[{] [|](\\\\w+), \\\\w+[|] \\\\1 == :\\\\w+ [}]$'", "=concat('Use `slice(', regexp_extract(blk.src, '== (.*) [}]$', 1), ')` instead.')", FROM_SEL),
    R("Style/ComparableClamp", "call", "name = 'min' AND argc = 0 AND recv.kind = 'array' AND recv.n = 2 AND get(rk, 0).src rlike '^\\\\[[^\\\\[\\\\]]+, [^\\\\[\\\\]]+\\\\][.]max$'", "Use `Comparable#clamp` instead."),
)
