"""More rules of the Style department, and those of RSpec that look at blocks.
Names, messages, preferred names and limits are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import span, tail, thru
from sleuthframe.rules.lint import BASIC, root
from sleuthframe.rules.style import FROM_SEL, RECV_ON, RECV_SEL, SEL_SRC, names, table

LINE = "named_struct('start', at.start, 'end', at.start + length(substring_index(src, '\\n', 1)), 'line', at.line, 'column', at.column, 'last_line', at.line, 'last_column', at.column + length(substring_index(src, '\\n', 1)) - 1)"
#: First name between the pipes of a block.
FIRST = "regexp_extract(get(bk, 0).src, '^[|] *(\\\\w+)', 1)"
SPEC = "path like '%\\\\_spec.rb'"
GROUPS = "'describe', 'context', 'feature'"
ENUMERATORS = "'collect', 'detect', 'downto', 'each', 'each_key', 'each_pair', 'each_value', 'each_with_index', 'each_with_object', 'find', 'find_all', 'find_index', 'inject', 'loop', 'map', 'map!', 'reduce', 'reject', 'reject!', 'reverse_each', 'select', 'select!', 'times', 'upto'"
#: Arguments that methods take by default.
IMPLIED = {"join": "\\'\\'", "sum": "0", "split": "\\' \\'", "to_i": "10", "exit": "true"}
FILTERED = {"any?": "any?", "empty?": "none?", "none?": "none?", "one?": "one?"}
CASE_OF_REGEXP = "'^[a-zA-Z0-9 ,:;_=<>@-]+$'"

RULES = (
    R("Style/AccessModifierDeclarations", "call", "recv IS NULL AND name IN ('private', 'protected', 'public', 'module_function') AND argc = 1 AND a0.kind = 'def'", "=concat('`', name, '` should not be inlined in method definitions.')", "sel"),
    R("Style/Alias", "call", "recv IS NULL AND name = 'alias_method' AND argc = 2 AND p.kind IN ('class', 'module') AND a0.kind = 'symbol' AND a1.kind = 'symbol'", "Use `alias` instead of `alias_method`.", "sel"),
    R("Style/AmbiguousEndlessMethodDefinition", "if unless while until", "form = 'modifier' AND b0.kind = 'def' AND b0.form = 'endless'", "=concat('Avoid using `', kind, '` statements with endless methods.')"),
    R("Style/ArrayCoercion", "array", "open = '[' AND size(kids) = 1 AND get(kids, 0).kind = 'splat' AND get(kids, 0).n = 1", "=concat('Use `Array(', get(kids2, 0).src, ')` instead of `', src, '`.')", fix="concat('Array(', get(kids2, 0).src, ')')"),
    R("Style/BisectedAttrAccessor", "class module singleton_class", "exists(body, b -> b.name = 'attr_reader') AND exists(body, b -> b.name = 'attr_writer')", "@transform(filter(kids2, k -> k.role = 'arg' AND get(kids, k.of).name IN ('attr_reader', 'attr_writer') AND exists(kids2, o -> o.role = 'arg' AND o.src = k.src AND get(kids, o.of).name IN ('attr_reader', 'attr_writer') AND get(kids, o.of).name <> get(kids, k.of).name)), k -> concat('Combine both accessors into `attr_accessor ', k.src, '`.'))", "transform(filter(kids2, k -> k.role = 'arg' AND get(kids, k.of).name IN ('attr_reader', 'attr_writer') AND exists(kids2, o -> o.role = 'arg' AND o.src = k.src AND get(kids, o.of).name IN ('attr_reader', 'attr_writer') AND get(kids, o.of).name <> get(kids, k.of).name)), k -> k.at)", many=True),
    R("Style/BlockDelimiters", "block", "open = 'do' AND at.line = at.last_line", "Prefer `{...}` over `do...end` for single-line blocks.", "sel"),
    R("Style/CollectionCompact", "call", "name IN ('reject', 'reject!') AND recv IS NOT NULL AND blk.kind = 'block_argument' AND blk.src = '&:nil?' AND argc = 0", f"=concat('Use `', if(name = 'reject', 'compact', 'compact!'), '` instead of `', {SEL_SRC}, '`.')", FROM_SEL, fix="if(name = 'reject', 'compact', 'compact!')"),
    R("Style/CollectionQuerying", "call", "recv.kind = 'call' AND recv.name = 'count' AND exists(rk, k -> k.role = 'recv') AND NOT exists(rk, k -> k.role = 'arg') AND (name IN ('positive?', 'zero?') AND argc = 0 OR form = 'binary' AND name = '>' AND a0.src = '0' OR form = 'binary' AND name = '==' AND a0.src IN ('0', '1'))", "=concat('Use `', CASE WHEN name IN ('positive?', '>') THEN 'any?' WHEN a0.src = '1' THEN 'one?' ELSE 'none?' END, '` instead.')", f"if(form = 'binary', {thru('recv.sel', 'at')}, {RECV_SEL})"),
    R("Style/ComparableBetween", "and", "get(kids, 0).kind = 'call' AND get(kids, 1).kind = 'call' AND get(kids, 0).name = '>=' AND get(kids, 1).name = '<=' AND get(kids2, 0).src = get(kids2, 2).src", "=concat('Prefer `', get(kids2, 0).src, '.between?(', get(kids2, 1).src, ', ', get(kids2, 3).src, ')` over logical comparison.')"),
    R("Style/DigChain", "call", "name = 'dig' AND recv.kind = 'call' AND recv.name = 'dig' AND argc > 0 AND exists(rk, k -> k.role = 'recv') AND exists(rk, k -> k.role = 'arg') AND NOT exists(concat(args, filter(rk, k -> k.role <> 'recv')), k -> k.kind IN ('hash', 'keyword_hash', 'forwarding_arguments', 'block_argument', 'block')) AND blk IS NULL AND NOT (role = 'recv' AND p.name = 'dig')", "=concat('Use `dig(', array_join(transform(filter(rk, k -> k.role = 'arg'), k -> k.src), ', '), ', ', array_join(transform(args, a -> a.src), ', '), ')` instead of chaining.')", RECV_ON),
    R("Style/EachWithObject", "call", f"name IN ('inject', 'reduce') AND argc = 1 AND a0.kind NOT IN ({BASIC}, 'string') AND blk.kind = 'block' AND size(bk) > 1 AND get(bk, 0).n = 2 AND get(bk, size(bk) - 1).kind = 'local_variable_read' AND get(bk, size(bk) - 1).name = {FIRST}", "=concat('Use `each_with_object` instead of `', name, '`.')", "sel"),
    R("Style/ExactRegexpMatch", "call", r"name IN ('=~', '===', 'match?') AND argc = 1 AND a0.kind = 'regular_expression' AND a0.name rlike '^\\\\A[\\w ]+\\\\z$' AND recv IS NOT NULL AND recv.kind <> 'regular_expression'", r"=concat('Use `', recv.src, ' == \'', regexp_replace(a0.name, '^\\\\A|\\\\z$', ''), '\'`.')"),
    R("Style/ExpandPathArguments", "call", "name = 'expand_path' AND recv.src IN ('File', '::File') AND a0.kind = 'string' AND a0.name IN ('.', '..', '../..') AND a1.src = '__FILE__'", "=concat('Use `expand_path(', CASE a0.name WHEN '.' THEN '__FILE__' WHEN '..' THEN '__dir__' ELSE '\\'..\\', __dir__' END, ')` instead of `expand_path(', a0.src, ', __FILE__)`.')", "sel"),
    R("Style/FileEmpty", "call", "name = 'zero?' AND recv.src IN ('File', '::File', 'FileTest', '::FileTest') AND argc = 1", "=concat('Use `', recv.src, '.empty?(', a0.src, ')` instead.')"),
    R("Style/FileNull", "string", "open IN ('\\'', '\"') AND lower(name) = '/dev/null'", "=concat('Use `File::NULL` instead of `', name, '`.')", fix="'File::NULL'"),
    R("Style/FileRead", "call", "name = 'read' AND argc = 0 AND recv.kind = 'call' AND recv.name = 'open' AND get(rk, 0).src IN ('File', '::File') AND size(filter(rk, k -> k.role = 'arg')) = 1", "Use `File.read`.", RECV_SEL),
    R("Style/FileWrite", "call", "name = 'write' AND argc = 1 AND recv.kind = 'call' AND recv.name = 'open' AND get(rk, 0).src IN ('File', '::File') AND get(rk, 2).name IN ('w', 'wt', 'w+', 'w+t')", "Use `File.write`.", RECV_ON),
    R("Style/FileTouch", "call", "name = 'open' AND recv.src IN ('File', '::File') AND argc = 2 AND a1.name IN ('a', 'a+', 'ab', 'a+b', 'at', 'a+t') AND blk.kind = 'block' AND blk.n = 0", "=concat('Use `FileUtils.touch(', a0.src, ')` instead of `File.open` in append mode with empty block.')"),
    R("Style/FloatDivision", "call", "form = 'binary' AND name = '/' AND recv.name = 'to_f' AND a0.name = 'to_f' AND recv.kind = 'call' AND a0.kind = 'call'", "Prefer using `.to_f` on one side only."),
    R("Style/GuardClause", "def", "nbody > 0 AND get(body, nbody - 1).kind IN ('if', 'unless') AND get(body, nbody - 1).form IS NULL AND NOT exists(kids2, k -> k.role = 'else' AND k.at.start >= get(body, nbody - 1).at.start) AND get(body, nbody - 1).at.last_line - get(body, nbody - 1).at.line > 1 AND NOT exists(kids, k -> k.role IN ('rescue', 'ensure')) AND NOT exists(kids2, k -> k.role = 'cond' AND k.at.start >= get(body, nbody - 1).at.start AND (k.kind like '%_write' OR k.kind = 'parentheses' OR k.at.line <> k.at.last_line))", "=concat('Use a guard clause (`return ', if(get(body, nbody - 1).kind = 'if', 'unless', 'if'), ' ', get(filter(kids2, k -> k.role = 'cond' AND k.at.start >= get(body, nbody - 1).at.start), 0).src, '`) instead of wrapping the code inside a conditional expression.')", "get(body, nbody - 1).sel"),
    R("Style/HashAsLastArrayItem", "array", "open = '[' AND size(kids) > 1 AND get(kids, size(kids) - 1).kind = 'keyword_hash'", "Wrap hash in `{` and `}`.", "get(kids, size(kids) - 1).at"),
    R("Style/HashConversion", "call", f"name = '[]' AND {root('recv', 'Hash')} AND argc > 0", "=CASE WHEN a0.kind = 'splat' THEN 'Prefer `array_of_pairs.to_h` to `Hash[*array]`.' WHEN argc > 1 THEN 'Prefer literal hash to `Hash[arg1, arg2, ...]`.' WHEN a0.kind = 'keyword_hash' THEN 'Prefer literal hash to `Hash[key: value, ...]`.' ELSE 'Prefer `ary.to_h` to `Hash[ary]`.' END"),
    R("Style/HashLikeCase", "case", "val IS NOT NULL AND els IS NULL AND size(filter(kids, k -> k.kind = 'when')) >= {MinBranchesCount} AND forall(filter(kids, k -> k.kind = 'when'), k -> k.n <= 3) AND forall(filter(kids2, k -> k.role = 'cond'), k -> k.kind IN ('string', 'symbol')) AND forall(filter(kids2, k -> k.role = 'body' AND get(kids, k.of).kind = 'when'), k -> k.kind IN ('string', 'symbol', 'integer', 'float', 'true', 'false', 'nil')) AND size(filter(kids2, k -> k.role = 'body')) = size(filter(kids, k -> k.kind = 'when'))", "Consider replacing `case-when` with a hash lookup.", options={"MinBranchesCount": "3"}),
    R("Style/IfUnlessModifier", "if unless", "form IS NULL AND open IN ('if', 'unless') AND els IS NULL AND nbody = 1 AND at.last_line - at.line = 2 AND b0.at.line = at.line + 1 AND b0.at.last_line = b0.at.line AND cond.at.line = cond.at.last_line AND NOT src like '%#%' AND b0.kind NOT IN ('if', 'unless', 'while', 'until', 'case', 'rescue_modifier') AND NOT cond.kind like '%_write' AND ind + length(b0.src) + length(open) + length(cond.src) + 2 <= {Max} AND role IN ('body')", "=concat('Favor modifier `', open, '` usage when having a single-line body. Another good alternative is the usage of control flow `&&`/`||`.')", "sel", options={"Max": "120"}),
    R("Style/IfWithBooleanLiteralBranches", "if unless", "open IN ('if', 'unless') AND form IS NULL AND nbody = 1 AND els.kind = 'else' AND els.n = 1 AND cond.kind = 'call' AND (cond.name IN ('==', '!=', '<', '>', '<=', '>=', '!', '===') OR cond.name like '%?') AND exists(kids2, k -> get(kids, k.of).role = 'else' AND k.kind IN ('true', 'false') AND k.kind <> b0.kind) AND b0.kind IN ('true', 'false')", "=concat('Remove redundant `', open, '` with boolean literal branches.')", "sel"),
    R("Style/IfWithSemicolon", "if unless", "form IS NULL AND open IN ('if', 'unless') AND at.line = at.last_line AND els.kind = 'else' AND src rlike '^(if|unless) [^;]+;'", "=concat('Do not use `', open, ' ', cond.src, ';` - use a ternary operator instead.')"),
    R("Style/ItAssignment", "local_variable_write", "name = 'it'", "`it` is the default block parameter; consider another name.", "sel"),
    R("Style/KeywordArgumentsMerging", "assoc_splat", "val.kind = 'call' AND val.name = 'merge' AND val.n > 1 AND p.kind = 'keyword_hash'", "Provide additional arguments directly rather than using `merge`.", "val.at"),
    R("Style/MapJoin", "call", "name = 'join' AND recv.kind = 'call' AND recv.name IN ('map', 'collect') AND exists(rk, k -> k.role = 'block' AND k.src = '&:to_s')", "=concat('Remove redundant `', recv.name, '(&:to_s)` before `join`.')", thru("recv.sel", "recv.at")),
    R("Style/MethodCallWithArgsParentheses", "call", "form = 'command' AND argc > 0 AND NOT (recv IS NULL AND (scope.kind <> 'def'))", "Use parentheses for method calls with arguments."),
    R("Style/MethodCalledOnDoEndBlock", "call", "recv.kind = 'call' AND exists(rk, k -> k.role = 'block' AND k.open = 'do' AND k.at.line <> k.at.last_line AND k.at.end = recv.at.end) AND op IN ('.', '&.')", "Avoid chaining a method call on a do...end block.", "named_struct('start', recv.at.end - 3, 'end', sel.end, 'line', recv.at.last_line, 'column', recv.at.last_column - 2, 'last_line', sel.last_line, 'last_column', sel.last_column)"),
    R("Style/MinMaxComparison", "if", "form = 'ternary' AND cond.kind = 'call' AND cond.name IN ('<', '>', '<=', '>=') AND cond.n = 2 AND (get(kids2, 0).src = b0.src AND get(kids2, 1).src = els.src OR get(kids2, 1).src = b0.src AND get(kids2, 0).src = els.src)", "=concat('Use `[', get(kids2, 0).src, ', ', get(kids2, 1).src, '].', if((cond.name like '>%') = (get(kids2, 0).src = b0.src), 'max', 'min'), '` instead.')"),
    R("Style/MixinGrouping", "call", "recv IS NULL AND name IN ('include', 'extend', 'prepend') AND argc > 1 AND p.kind IN ('class', 'module', 'singleton_class')", "=concat('Put `', name, '` mixins in separate statements.')"),
    R("Style/MultilineMemoization", "local_variable_or_write instance_variable_or_write", "val.kind = 'parentheses' AND val.at.line <> val.at.last_line", "Wrap multiline memoization blocks in `begin` and `end`."),
    R("Style/MultipleComparison", "or", "name = '||' AND p.kind <> 'or' AND get(kids, 0).kind = 'call' AND get(kids, 0).name = '==' AND get(kids, 1).kind = 'call' AND get(kids, 1).name = '==' AND get(kids2, 0).src = get(kids2, 2).src AND get(kids2, 0).kind = 'local_variable_read' AND get(kids2, 1).kind <> 'call' AND get(kids2, 3).kind <> 'call'", "Avoid comparing a variable with multiple items in a conditional, use `Array#include?` instead."),
    R("Style/NegativeArrayIndex", "call", "name = '[]' AND argc = 1 AND a0.kind = 'call' AND a0.name = '-' AND a0.src rlike concat('^\\\\Q', recv.src, '\\\\E[.](length|size|count) - \\\\d+$')", "=concat('Use `', recv.src, '[-', regexp_extract(a0.src, '(\\\\d+)$', 1), ']` instead of `', src, '`.')"),
    R("Style/NestedParenthesizedCalls", "call", "open = '(' AND exists(args, a -> a.kind = 'call' AND a.form = 'command')", "@transform(filter(args, a -> a.kind = 'call' AND a.form = 'command'), a -> concat('Add parentheses to nested method call `', a.src, '`.'))", "transform(filter(args, a -> a.kind = 'call' AND a.form = 'command'), a -> a.at)", many=True),
    R("Style/Next", "block", f"nbody > 0 AND p.kind = 'call' AND p.name IN ({ENUMERATORS}) AND get(body, nbody - 1).kind IN ('if', 'unless') AND get(body, nbody - 1).form IS NULL AND get(body, nbody - 1).at.last_line - get(body, nbody - 1).at.line > {{MinBodyLength}} AND NOT exists(kids2, k -> k.role = 'else' AND k.at.start >= get(body, nbody - 1).at.start)", "Use `next` to skip iteration.", "named_struct('start', get(body, nbody - 1).at.start, 'end', get(filter(kids2, k -> k.role = 'cond' AND k.at.start >= get(body, nbody - 1).at.start), 0).at.end, 'line', get(body, nbody - 1).at.line, 'column', get(body, nbody - 1).at.column, 'last_line', get(filter(kids2, k -> k.role = 'cond' AND k.at.start >= get(body, nbody - 1).at.start), 0).at.last_line, 'last_column', get(filter(kids2, k -> k.role = 'cond' AND k.at.start >= get(body, nbody - 1).at.start), 0).at.last_column)", options={"MinBodyLength": "3"}),
    R("Style/OperatorMethodCall", "call", "op = '.' AND argc = 1 AND a0.kind NOT IN ('splat', 'keyword_hash', 'forwarding_arguments', 'block_argument') AND recv.kind NOT IN ('constant_read', 'constant_path') AND NOT (role = 'recv' AND coalesce(open, '') = '(') AND name IN ('|', '^', '&', '<=>', '==', '===', '=~', '>', '>=', '<', '<=', '<<', '>>', '+', '-', '*', '/', '%', '**', '!=')", "Redundant dot detected.", span("sel.start - 1", "sel.start", "sel"), fix="' '"),
    R("Style/QuotedSymbols", "symbol", r"open = ':\"' AND NOT name rlike '[\\\\\'#]' AND NOT name rlike '^[a-zA-Z_][a-zA-Z0-9_]*$'", "Prefer single-quoted symbols when you don't need string interpolation or special symbols.", fix="concat(':\\'', name, '\\'')"),
    R("Style/RedundantArgument", "call", f"open = '(' AND argc = 1 AND blk IS NULL AND ({' OR '.join(f'name = {chr(39)}{k}{chr(39)} AND a0.src IN ({chr(39)}{v}{chr(39)})' for k, v in IMPLIED.items())}) AND (recv IS NOT NULL OR name = 'exit')", "=concat('Argument ', a0.src, ' is redundant because it is implied by default.')", tail("sel.end", "at.end"), fix="''"),
    R("Style/RedundantCondition", "if", "form IS NULL AND open = 'if' AND nbody = 1 AND b0.src = cond.src AND els.kind = 'else' AND els.n = 1", "Use double pipes `||` instead."),
    R("Style/RedundantConstantBase", "constant_path", "open = '::' AND NOT exists(up, u -> u.kind IN ('class', 'module', 'singleton_class'))", "Remove redundant `::`.", span("at.start", "at.start + 2"), fix="''"),
    R("Style/RedundantDoubleSplatHashBraces", "assoc_splat", "val.kind = 'hash' AND val.n > 0 AND p.kind = 'keyword_hash'", "Remove the redundant double splat and braces, use keyword arguments directly."),
    R("Style/RedundantEach", "call", "name IN ('each', 'each_with_index', 'each_with_object', 'each_entry', 'each_cons', 'each_slice', 'reverse_each') AND recv.kind = 'call' AND recv.name = 'each' AND recv.n = 1 AND exists(rk, k -> k.role = 'recv')", "Remove redundant `each`.", "recv.sel"),
    R("Style/RedundantFilterChain", "call", f"name IN ({names(FILTERED)}) AND argc = 0 AND blk IS NULL AND recv.kind = 'call' AND recv.name IN ('select', 'filter', 'find_all') AND exists(rk, k -> k.role = 'block')", f"=concat('Use `', {table('name', FILTERED)}, '` instead of `', recv.name, '.', name, '`.')", RECV_SEL),
    R("Style/RedundantFormat", "call", "recv IS NULL AND name IN ('format', 'sprintf') AND argc = 1 AND a0.kind = 'string' AND a0.open IN ('\\'', '\"') AND NOT contains(a0.name, '%')", "=concat('Use `', a0.src, '` directly instead of `', name, '`.')", fix="a0.src"),
    R("Style/RedundantHeredocDelimiterQuotes", "string", r"form = 'heredoc' AND open rlike '^<<[~-]?[\'\"]' AND op rlike '^\\w+$' AND NOT name rlike '#[{$@]|\\\\'", "=concat('Remove the redundant heredoc delimiter quotes, use `', regexp_replace(open, '[\\'\"]', ''), '` instead.')", fix="regexp_replace(open, '[\\'\"]', '')"),
    R("Style/RedundantInitialize", "def", "name = 'initialize' AND nbody = 0 AND recv IS NULL AND (params IS NULL OR params.n = 0) AND p.kind = 'class' AND NOT src like '%#%'", "Remove unnecessary empty `initialize` method."),
    R("Style/RedundantInitialize", "def", "name = 'initialize' AND nbody = 1 AND recv IS NULL AND b0.kind = 'forwarding_super' AND p.kind = 'class' AND NOT exists(kids2, k -> k.role = 'param' AND k.kind <> 'required_parameter')", "Remove unnecessary `initialize` method."),
    R("Style/RedundantMinMaxBy", "call", "name IN ('max_by', 'min_by', 'minmax_by') AND argc = 0 AND blk.kind = 'block' AND size(bk) = 2 AND get(bk, 1).kind = 'local_variable_read' AND get(bk, 0).src = concat('|', get(bk, 1).name, '|')", "=concat('Use `', replace(name, '_by', ''), '` instead of `', name, ' { |', get(bk, 1).name, '| ', get(bk, 1).name, ' }`.')", FROM_SEL, fix="replace(name, '_by', '')"),
    R("Style/RedundantParentheses", "parentheses", f"size(kids) = 1 AND role IN ('value', 'body') AND p.kind <> 'parentheses' AND (get(kids, 0).kind IN ({BASIC}, 'string', 'array', 'hash') OR get(kids, 0).kind like '%variable_read' OR get(kids, 0).kind IN ('constant_read', 'self'))", "=concat('Don\\'t use parentheses around a ', CASE WHEN get(kids, 0).kind like '%variable_read' THEN 'variable' WHEN get(kids, 0).kind = 'constant_read' THEN 'constant' WHEN get(kids, 0).kind = 'self' THEN 'keyword' ELSE 'literal' END, '.')", fix="get(kids, 0).src"),
    R("Style/RedundantPercentQ", "string", r"open like '%q_' AND NOT (name like '%\'%' AND name like '%\"%') AND NOT name rlike '\\\\'", "Use `%q` only for strings that contain both single quotes and double quotes."),
    R("Style/RedundantRegexpArgument", "call", f"name IN ('gsub', 'gsub!', 'sub', 'sub!', 'split', 'partition', 'rpartition', 'start_with?', 'index', 'rindex') AND recv IS NOT NULL AND a0.kind = 'regular_expression' AND a0.open = '/' AND a0.op = '' AND a0.name rlike {CASE_OF_REGEXP} AND a0.name <> ' '", "=concat('Use string `\\'', a0.name, '\\'` as argument instead of regexp `', a0.src, '`.')", "a0.at", fix="concat('\\'', a0.name, '\\'')"),
    R("Style/RedundantRegexpCharacterClass", "regular_expression", r"name rlike '^[^\\[\\\\]*\\[[a-zA-Z0-9]\\]'", r"=concat('Redundant single-element character class, `', regexp_substr(name, '\\[[a-zA-Z0-9]\\]'), '` can be replaced with `', substr(regexp_substr(name, '\\[[a-zA-Z0-9]\\]'), 2, 1), '`.')", span(r"at.start + length(open) + regexp_instr(name, '\\[[a-zA-Z0-9]\\]') - 1", r"at.start + length(open) + regexp_instr(name, '\\[[a-zA-Z0-9]\\]') + 2")),
    R("Style/RedundantRegexpConstructor", "call", f"name IN ('new', 'compile') AND {root('recv', 'Regexp')} AND argc = 1 AND a0.kind = 'regular_expression'", "=concat('Remove the redundant `Regexp.', name, '`.')", fix="a0.src"),
    R("Style/SafeNavigationChainLength", "call", "op = '&.' AND recv.kind = 'call' AND recv.op = '&.' AND get(rk, 0).kind = 'call' AND get(rk, 0).op = '&.'", "=concat('Avoid safe navigation chains longer than ', {Max}, ' calls.')", options={"Max": "2"}),
    R("Style/SelectByRegexp", "call", "name IN ('select', 'filter', 'find_all', 'reject') AND recv IS NOT NULL AND blk.kind = 'block' AND size(bk) = 2 AND get(bk, 1).kind = 'call' AND (get(bk, 1).name IN ('=~', 'match?') AND get(bk, 1).src rlike concat('^', substr(get(bk, 0).src, 2, length(get(bk, 0).src) - 2), '( =~ |[.]match[?][(])/[^/]+/[)]?$'))", "=concat('Prefer `', if(name = 'reject', 'grep_v', 'grep'), '` to `', name, '` with a regexp match.')"),
    R("Style/SendWithLiteralMethodName", "call", "name = 'public_send' AND recv IS NOT NULL AND a0.kind IN ('symbol', 'string') AND a0.name rlike '^[a-z_][a-zA-Z0-9_]*[?!]?$'", "=concat('Use `', a0.name, '` method call directly instead.')", FROM_SEL),
    R("Style/TrailingBodyOnClass", "class singleton_class", "at.line <> at.last_line AND nbody > 0 AND b0.at.line = at.line", "Place the first line of class body on its own line.", "b0.at"),
    R("Style/TrailingBodyOnModule", "module", "at.line <> at.last_line AND nbody > 0 AND b0.at.line = at.line", "Place the first line of module body on its own line.", "b0.at"),
    R("Style/TrailingBodyOnMethodDefinition", "def", "at.line <> at.last_line AND nbody > 0 AND b0.at.line = at.line AND coalesce(form, '') <> 'endless'", "Place the first line of a multi-line method definition's body on its own line.", "b0.at"),
    R("Style/TrailingCommaInBlockArgs", "block_parameters", "open = '|' AND size(kids) > 1 AND src rlike ',\\\\s*[|]$'", "Useless trailing comma present in block arguments.", tail("get(kids, size(kids) - 1).at.end", "get(kids, size(kids) - 1).at.end + 1"), fix="''"),
    R("Style/TrailingMethodEndStatement", "def", "at.line <> at.last_line AND NOT close AND nbody > 0 AND coalesce(form, '') <> 'endless'", "Place the end statement of a multi-line method on its own line.", tail("at.end - 3", "at.end")),
    R("Style/TrailingUnderscoreVariable", "multi_write", "size(filter(kids, k -> k.role = 'target')) > 1 AND get(reverse(filter(kids, k -> k.role = 'target')), 0).name = '_' AND NOT exists(kids, k -> k.role = 'target' AND k.kind IN ('splat', 'mlhs')) AND get(kids, 0).name <> '_'", "=concat('Do not use trailing `_`s in parallel assignment. Prefer `', array_join(transform(filter(kids, k -> k.role = 'target' AND k.name <> '_'), k -> k.src), ', '), ', = ', array_join(transform(filter(kids, k -> k.role = 'value'), k -> k.src), ', '), '`.')", "get(reverse(filter(kids, k -> k.role = 'target')), 0).at"),
    R("Style/YAMLFileRead", "call", f"name IN ('load', 'parse') AND {root('recv', 'YAML')} AND a0.kind = 'call' AND a0.name = 'read' AND a0.src rlike '^(::)?File[.]read[(]'", "=concat('Use `', name, '_file(', regexp_extract(a0.src, '^(?:::)?File[.]read[(](.*)[)]$', 1), ')` instead.')", FROM_SEL),
    R("Style/YodaExpression", "call", "form = 'binary' AND name IN ('*', '+', '&', '|') AND recv.kind IN ('integer', 'float', 'string') AND a0.kind IN ('call', 'local_variable_read', 'instance_variable_read')", "=concat('Non-literal operand (`', a0.src, '`) should be first.')"),
    R("RSpec/EmptyExampleGroup", "call", f"name IN ({GROUPS}) AND blk.kind = 'block' AND {SPEC} AND NOT blk.src rlike '\\\\b(it|specify|example|scenario|its|it_behaves_like|include_examples|it_should_behave_like|xit|fit|pending)\\\\b'", "Empty example group detected.", LINE),
    R("RSpec/ExampleLength", "call", f"name IN ('it', 'specify', 'example', 'scenario') AND blk.open = 'do' AND {SPEC} AND full > 15", "=concat('Example has too many lines. [', full, '/15]')", LINE),
    R("RSpec/MultipleExpectations", "call", f"name IN ('it', 'specify', 'example', 'scenario') AND blk.open = 'do' AND {SPEC} AND size(filter(split(blk.src, '\\n'), l -> l like '%expect(%' OR l like '%is_expected%')) > 1", "Example has too many expectations.", LINE),
    R("RSpec/MultipleMemoizedHelpers", "call", f"name IN ({GROUPS}) AND blk.kind = 'block' AND {SPEC} AND size(filter(bk, k -> k.role = 'body' AND k.name IN ('let', 'let!', 'subject'))) > 10", "Example group has too many memoized helpers.", LINE),
    R("RSpec/NestedGroups", "call", f"name IN ({GROUPS}) AND blk.kind = 'block' AND {SPEC} AND size(filter(up, u -> u.kind = 'call' AND u.name IN ({GROUPS}))) >= 4", "Maximum example group nesting exceeded.", LINE),
    R("RSpec/ScatteredSetup", "call", f"name IN ({GROUPS}) AND blk.kind = 'block' AND {SPEC} AND size(filter(bk, k -> k.role = 'body' AND k.name = 'before')) > 1", "Do not scatter setup blocks throughout an example group.", "transform(slice(filter(bk, k -> k.role = 'body' AND k.name = 'before'), 2, 1000), k -> named_struct('start', k.at.start, 'end', k.at.start + length(substring_index(k.src, '\\n', 1)), 'line', k.at.line, 'column', k.at.column, 'last_line', k.at.line, 'last_column', k.at.column + length(substring_index(k.src, '\\n', 1)) - 1))", many=True),
)
