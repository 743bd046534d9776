"""Rules of the Layout department. Names and messages are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import hits, quoted, span, tail, thru

#: Whether a call's receiver ends and its name begins on one line, and the text between.
GAP = "substr(src, recv.at.end - at.start + 1, sel.start - recv.at.end)"
INSIDE = "substr(src, 2, length(src) - 2)"
END = tail("at.end - 3", "at.end")
MAGIC = "'^#.*(frozen[_-]string[_-]literal|encoding|coding|warn[_-]indent|shareable[_-]constant[_-]value|typed):'"


def blank(line: str) -> str:
    """The blank line of this number."""
    return f"named_struct('start', 0, 'end', 1, 'line', {line}, 'column', 1, 'last_line', {line} + 1, 'last_column', 1)"


def body_rules(rule: str, kinds: str, word: str) -> tuple[R, R]:
    where = "at.line <> at.last_line AND coalesce(form, '') NOT IN ('endless', 'modifier')"
    return (
        R(rule, kinds, f"{where} AND top > 0", f"Extra empty line detected at {word} body beginning.", blank("hdr + 1")),
        R(rule, kinds, f"{where} AND bot > 0", f"Extra empty line detected at {word} body end.", blank("at.last_line - 1")),
    )


def aligned_end(rule: str, kinds: str, word: str) -> R:
    return R(rule, kinds, "at.line <> at.last_line AND lead AND close AND coalesce(form, '') NOT IN ('endless', 'modifier', 'ternary', 'elsif') AND at.last_column - 2 <> at.column", f"=concat('`end` at ', at.last_line, ', ', at.last_column - 3, ' is not aligned with `', {word}, '` at ', at.line, ', ', at.column - 1, '.')", END)


#: A space that isn't there to align with what the line before or after has.
UNALIGNED = "NOT coalesce(substr(prev, x.last_column + 1, 1) <> ' ' AND substr(prev, x.last_column, 1) = ' ', false) AND NOT coalesce(substr(next, x.last_column + 1, 1) <> ' ' AND substr(next, x.last_column, 1) = ' ', false)"
KEYWORD = r"(?<![\w.@$:?!])(?:if|unless|while|until|case|when|elsif|and|or|not|rescue)(?=[({\[\"'])"

RULES = (
    *body_rules("Layout/EmptyLinesAroundClassBody", "class singleton_class", "class"),
    *body_rules("Layout/EmptyLinesAroundModuleBody", "module", "module"),
    *body_rules("Layout/EmptyLinesAroundMethodBody", "def", "method"),
    *body_rules("Layout/EmptyLinesAroundBlockBody", "block", "block"),
    *body_rules("Layout/EmptyLinesAroundBeginBody", "begin", "`begin`"),
    aligned_end("Layout/DefEndAlignment", "def", "'def'"),
    aligned_end("Layout/EndAlignment", "class module singleton_class if unless while until case case_match", "if(kind IN ('if', 'unless'), open, CASE kind WHEN 'singleton_class' THEN 'class' WHEN 'case_match' THEN 'case' ELSE kind END)"),
    aligned_end("Layout/BeginEndAlignment", "begin", "'begin'"),
    R("Layout/AccessModifierIndentation", "class module singleton_class", "lead AND at.line <> at.last_line", "=concat('Indent access modifiers like `', get(filter(body, b -> b.kind = 'call' AND b.form = 'name' AND b.name IN ('private', 'protected', 'public', 'module_function') AND b.lead AND b.at.column <> at.column + 2), 0).name, '`.')", "transform(filter(body, b -> b.kind = 'call' AND b.form = 'name' AND b.name IN ('private', 'protected', 'public', 'module_function') AND b.lead AND b.at.column <> at.column + 2), b -> b.at)", many=True),
    R("Layout/BlockEndNewline", "block", "at.line <> at.last_line AND NOT close AND nbody > 0", "=concat('Expression at ', at.last_line, ', ', at.last_column - if(open = 'do', 2, 0), ' should be on its own line.')", tail("at.end - if(open = 'do', 3, 1)", "at.end")),
    R("Layout/CaseIndentation", "case case_match", "lead AND at.line <> at.last_line AND exists(kids, k -> k.kind IN ('when', 'in') AND k.lead AND k.at.column <> at.column)", "=concat('Indent `', if(kind = 'case', 'when', 'in'), '` as deep as `case`.')", "transform(filter(kids, k -> k.kind IN ('when', 'in') AND k.lead AND k.at.column <> at.column), k -> k.sel)", many=True),
    R("Layout/ConditionPosition", "if unless while until", "coalesce(form, '') NOT IN ('modifier', 'ternary') AND cond.at.line > sel.line", "=concat('Place the condition on the same line as `', coalesce(open, kind), '`.')", "cond.at"),
    R("Layout/DotPosition", "call", f"op IN ('.', '&.') AND recv.at.last_line < sel.line AND {GAP} rlike '^[ \\\\t]*(&?[.])\\\\s*\\\\n'", "=concat('Place the ', op, ' on the next line, together with the method name.')", f"named_struct('start', recv.at.end, 'end', recv.at.end + length(op), 'line', recv.at.last_line, 'column', recv.at.last_column + 1 + length(regexp_extract({GAP}, '^[ \\\\t]*', 0)), 'last_line', recv.at.last_line, 'last_column', recv.at.last_column + length(regexp_extract({GAP}, '^[ \\\\t]*', 0)) + length(op))"),
    R("Layout/ElseAlignment", "if unless case", "lead AND els.kind = 'else' AND els.lead AND els.at.column <> at.column AND at.line <> els.at.line", "=concat('Align `else` with `', if(kind = 'case', 'when', open), '`.')", "els.sel"),
    R("Layout/EmptyComment", "comment", "name rlike '^#\\\\s*$' AND NOT coalesce(prev rlike '^\\\\s*#', false) AND NOT coalesce(next rlike '^\\\\s*#', false)", "Source code comment is empty."),
    R("Layout/EmptyLineAfterGuardClause", "if unless", "form = 'modifier' AND role = 'body' AND p.kind <> 'if' AND b0.kind IN ('return', 'next', 'break', 'call') AND (b0.kind <> 'call' OR b0.name IN ('raise', 'fail') AND b0.src NOT LIKE '%.%') AND NOT src rlike '<<[-~]?[\\'\"A-Z]' AND next IS NOT NULL AND trim(next) <> '' AND NOT next rlike '^\\\\s*(end\\\\b|else\\\\b|elsif\\\\b|when\\\\b|in\\\\b|rescue\\\\b|ensure\\\\b|[}]|#)' AND NOT next rlike '^\\\\s*(return|next|break|raise|fail)\\\\b.*\\\\b(if|unless)\\\\b' AND at.line = at.last_line", "Add empty line after guard clause."),
    R("Layout/EmptyLineAfterMagicComment", "comment", f"name rlike {MAGIC} AND at.line <= 3 AND next IS NOT NULL AND trim(next) <> '' AND NOT next rlike '^\\\\s*#'", "Add an empty line after magic comments.", "named_struct('start', at.end + 1, 'end', at.end + 2, 'line', at.line + 1, 'column', 1, 'last_line', at.line + 1, 'last_column', 1)"),
    R("Layout/EmptyLineAfterMultilineCondition", "if unless while until", "coalesce(form, '') NOT IN ('modifier', 'ternary') AND cond.at.line <> cond.at.last_line AND hdr IS NOT NULL AND top = 0 AND nbody > 0 AND b0.at.line = cond.at.last_line + 1", "Use empty line after multiline condition.", "cond.at"),
    R("Layout/EmptyLineBetweenDefs", "def", "role = 'body' AND lead AND prev rlike '^\\\\s*end\\\\s*$' AND p.kind IN ('class', 'module', 'singleton_class', 'program', 'block')", "Expected 1 empty line between method definitions; found 0.", thru("named_struct('start', at.start, 'line', at.line, 'column', at.column)", "sel")),
    R("Layout/EmptyLinesAfterModuleInclusion", "call", "recv IS NULL AND name IN ('include', 'extend', 'prepend') AND argc > 0 AND role = 'body' AND p.kind IN ('class', 'module', 'singleton_class') AND next IS NOT NULL AND trim(next) <> '' AND NOT next rlike '^\\\\s*(include|extend|prepend|end\\\\b|#)'", "Add an empty line after module inclusion."),
    R("Layout/EmptyLinesAroundAccessModifier", "call", "recv IS NULL AND form = 'name' AND name IN ('private', 'protected', 'public', 'module_function') AND lead AND role = 'body' AND p.kind IN ('class', 'module', 'singleton_class') AND trim(rest) = '' AND (trim(next) <> '' AND NOT next rlike '^\\\\s*end\\\\b' OR trim(prev) <> '' AND NOT prev rlike '^\\\\s*(class|module|#)')", "=CASE WHEN trim(next) <> '' AND NOT next rlike '^\\\\s*end\\\\b' AND trim(prev) <> '' AND NOT prev rlike '^\\\\s*(class|module|#)' THEN concat('Keep a blank line before and after `', name, '`.') WHEN trim(next) <> '' AND NOT next rlike '^\\\\s*end\\\\b' THEN concat('Keep a blank line after `', name, '`.') ELSE concat('Keep a blank line before and after `', name, '`.') END"),
    R("Layout/EmptyLinesAroundAttributeAccessor", "call", "recv IS NULL AND name IN ('attr_reader', 'attr_writer', 'attr_accessor', 'attr') AND argc > 0 AND role = 'body' AND p.kind IN ('class', 'module', 'singleton_class') AND next IS NOT NULL AND trim(next) <> '' AND NOT next rlike '^\\\\s*(attr_reader|attr_writer|attr_accessor|attr\\\\b|end\\\\b|#|alias|alias_method|public|protected|private)'", "Add an empty line after attribute accessor."),
    R("Layout/EmptyLinesAroundExceptionHandlingKeywords", "rescue ensure else", "p.kind IN ('begin', 'def', 'block') AND lead AND trim(prev) = ''", "=concat('Extra empty line detected before the `', kind, '`.')", blank("at.line - 1")),
    R("Layout/ExtraSpacing", "line", "form IS NULL AND name rlike '\\\\S  +\\\\S' AND NOT name rlike '^\\\\s*$'", "Unnecessary spacing detected.", f"filter({hits('(?<=[^ ]) +(?= [^ ])')}, x -> {UNALIGNED.replace('x.last_column + 1', 'x.last_column + 2').replace('x.last_column,', 'x.last_column + 1,')})", many=True),
    R("Layout/HeredocIndentation", "string interpolated_string", "form = 'heredoc' AND open like '<<~%' AND name rlike '\\\\S' AND forall(filter(split(name, '\\n'), l -> trim(l) <> ''), l -> l rlike '^\\\\S') AND NOT contains(name, '#{')", "Use 2 spaces for indentation in a heredoc.", "sel"),
    R("Layout/LeadingCommentSpace", "comment", "name rlike '^#+[^#\\\\s=:+\\\\-!]' AND NOT (at.line = 1 AND name like '#!%') AND NOT name rlike '^#(ruby|encoding|coding)=?' AND form IS NULL", "Missing space after `#`."),
    R("Layout/LineContinuationSpacing", "line", "form IS NULL AND name rlike '(\\\\S|\\\\s\\\\s)\\\\\\\\$' AND NOT name rlike '\\\\x01\\\\\\\\$'", "Use one space in front of backslash.", tail("at.end - length(regexp_extract(name, '\\\\s*\\\\\\\\$', 0))", "at.end")),
    R("Layout/MultilineArrayLineBreaks", "array", "open = '[' AND size(kids) > 1 AND get(kids, 0).at.line <> get(kids, size(kids) - 1).at.last_line", "Each item in a multi-line array must start on a separate line.", "transform(filter(transform(kids, (k, i) -> named_struct('k', k, 'b', get(kids, i - 1))), x -> x.b.at.last_line = x.k.at.line), x -> x.k.at)", many=True),
    R("Layout/MultilineMethodArgumentLineBreaks", "call", "open = '(' AND name NOT IN ('[]=') AND argc > 0 AND get(args, 0).at.line <> get(args, argc - 1).at.last_line", "Each argument in a multi-line method call must start on a separate line.", "transform(filter(transform(flatten(transform(args, (a, i) -> if(a.kind = 'keyword_hash', filter(kids2, k -> k.role = 'element' AND k.at.start >= a.at.start AND k.at.end <= a.at.end AND k.kind IN ('assoc', 'assoc_splat')), array(a)))), (k, i) -> named_struct('k', k, 'b', get(flatten(transform(args, (a, j) -> if(a.kind = 'keyword_hash', filter(kids2, k2 -> k2.role = 'element' AND k2.at.start >= a.at.start AND k2.at.end <= a.at.end AND k2.kind IN ('assoc', 'assoc_splat')), array(a)))), i - 1))), x -> x.b.at.last_line = x.k.at.line), x -> x.k.at)", many=True),
    R("Layout/MultilineMethodParameterLineBreaks", "parameters", "p.kind = 'def' AND size(kids) > 1 AND get(kids, 0).at.line <> get(kids, size(kids) - 1).at.last_line", "Each parameter in a multi-line method definition must start on a separate line.", "transform(filter(transform(kids, (k, i) -> named_struct('k', k, 'b', get(kids, i - 1))), x -> x.b.at.last_line = x.k.at.line), x -> x.k.at)", many=True),
    R("Layout/MultilineMethodDefinitionBraceLayout", "parameters", "p.kind = 'def' AND open = '(' AND size(kids) > 0 AND at.line <> at.last_line AND get(kids, 0).at.line = at.line AND get(kids, size(kids) - 1).at.last_line <> at.last_line", "Closing method definition brace must be on the same line as the last parameter when opening brace is on the same line as the first parameter.", tail("at.end - 1", "at.end")),
    R("Layout/MultilineMethodDefinitionBraceLayout", "parameters", "p.kind = 'def' AND open = '(' AND size(kids) > 0 AND at.line <> at.last_line AND get(kids, 0).at.line <> at.line AND get(kids, size(kids) - 1).at.last_line = at.last_line", "Closing method definition brace must be on the line after the last parameter when opening brace is on a separate line from the first parameter.", tail("at.end - 1", "at.end")),
    R("Layout/ParameterAlignment", "parameters", "p.kind = 'def' AND size(kids) > 1 AND get(kids, 0).at.line <> get(kids, size(kids) - 1).at.line", "Align the parameters of a method definition if they span more than one line.", "transform(filter(transform(kids, (k, i) -> named_struct('k', k, 'i', i)), x -> x.i > 0 AND x.k.lead AND x.k.at.column <> get(kids, 0).at.column), x -> x.k.at)", many=True),
    R("Layout/RescueEnsureAlignment", "begin def", "lead AND exists(kids, k -> k.kind IN ('rescue', 'ensure') AND k.lead AND k.at.column <> at.column)", "=concat('`', get(filter(kids, k -> k.kind IN ('rescue', 'ensure') AND k.lead AND k.at.column <> at.column), 0).kind, '` at ', get(filter(kids, k -> k.kind IN ('rescue', 'ensure') AND k.lead AND k.at.column <> at.column), 0).at.line, ', ', get(filter(kids, k -> k.kind IN ('rescue', 'ensure') AND k.lead AND k.at.column <> at.column), 0).at.column - 1, ' is not aligned with `', kind, '` at ', at.line, ', ', at.column - 1, '.')", "get(filter(kids, k -> k.kind IN ('rescue', 'ensure') AND k.lead AND k.at.column <> at.column), 0).sel"),
    R("Layout/SpaceAfterColon", "assoc", "open = 'label' AND form IS NULL AND get(kids, 0).at.end = val.at.start", "Space missing after colon.", tail("get(kids, 0).at.end - 1", "get(kids, 0).at.end", "get(kids, 0).at")),
    R("Layout/SpaceAfterColon", "optional_keyword_parameter", "sel.end + 1 = val.at.start", "Space missing after colon.", span("sel.end", "sel.end + 1", "sel")),
    R("Layout/SpaceAfterMethodName", "def", "params.open = '(' AND params.at.start > sel.end", "Do not put a space between a method name and the opening parenthesis.", span("sel.end", "params.at.start", "sel"), fix="''"),
    R("Layout/SpaceAroundEqualsInParameterDefault", "optional_parameter", "substr(src, sel.end - at.start + 1, val.at.start - sel.end) <> ' = '", "Surrounding space missing in default value assignment.", span("sel.end", "val.at.start"), fix="' = '"),
    R("Layout/SpaceAroundKeyword", "line", f"form IS NULL AND name rlike {quoted(KEYWORD)} AND NOT name rlike '^\\s*(def|alias|undef) '", f"@transform(regexp_extract_all(name, {quoted(KEYWORD)}, 0), m -> concat('Space after keyword `', m, '` is missing.'))", hits(KEYWORD), many=True),
    R("Layout/SpaceAroundMethodCallOperator", "call", f"op IN ('.', '&.') AND recv.at.last_line = sel.line AND {GAP} rlike '\\\\s'", "Avoid using spaces around a method call operator.", "named_struct('start', recv.at.end, 'end', sel.start, 'line', sel.line, 'column', recv.at.last_column + 1, 'last_line', sel.line, 'last_column', sel.column - 1)"),
    R("Layout/SpaceAroundOperators", "call", "form = 'binary' AND name <> '**' AND recv.at.last_line = sel.line AND a0.at.line = sel.line AND (recv.at.end = sel.start OR a0.at.start = sel.end)", "Surrounding space missing for operator.", "sel"),
    R("Layout/SpaceAroundOperators", "local_variable_write instance_variable_write global_variable_write class_variable_write constant_write local_variable_operator_write instance_variable_operator_write local_variable_or_write instance_variable_or_write", "val.at.line = oper.at.line AND (oper.at.start = sel.end OR val.at.start = oper.at.end)", "Surrounding space missing for operator.", "oper.at"),
    R("Layout/SpaceAroundOperators", "and or", "name IN ('&&', '||') AND get(kids, 0).at.last_line = get(kids, 1).at.line AND (get(kids, 0).at.end = sel.start OR get(kids, 1).at.start = sel.end)", "Surrounding space missing for operator.", "sel"),
    R("Layout/SpaceBeforeBlockBraces", "call super", "blk.kind = 'block' AND blk.open = '{' AND substr(src, blk.at.start - at.start, 1) NOT IN (' ', '\\n')", "Space missing to the left of {.", span("blk.at.start", "blk.at.start + 1", "blk.at")),
    R("Layout/SpaceBeforeFirstArg", "call", "form = 'command' AND argc > 0 AND a0.at.line = sel.line AND a0.at.start - sel.end > 1 AND NOT (coalesce(substr(prev, a0.at.column - 1, 2) rlike '^ \\\\S', false)) AND NOT (coalesce(substr(next, a0.at.column - 1, 2) rlike '^ \\\\S', false))", "Put one space between the method name and the first argument.", span("sel.end", "a0.at.start", "sel"), fix="' '"),
    R("Layout/SpaceInLambdaLiteral", "lambda", "params.open = '(' AND params.at.start > sel.end", "Do not use spaces between `->` and `(` in lambda literals.", thru("sel", "params.at")),
    R("Layout/SpaceInsideArrayLiteralBrackets", "array", f"open = '[' AND size(kids) > 0 AND {INSIDE} rlike '^ +\\\\S'", "Space inside array brackets detected.", span("at.start + 1", f"at.start + 1 + length(regexp_extract({INSIDE}, '^ +', 0))"), fix="''"),
    R("Layout/SpaceInsideArrayLiteralBrackets", "array", f"open = '[' AND size(kids) > 0 AND {INSIDE} rlike '\\\\S +$'", "Space inside array brackets detected.", tail(f"at.end - 1 - length(regexp_extract({INSIDE}, ' +$', 0))", "at.end - 1"), fix="''"),
    R("Layout/SpaceInsideArrayPercentLiteral", "array", "open rlike '^%[wWiI]' AND at.line = at.last_line", "Use only a single space inside array percent literal.", "transform(filter(transform(kids, (k, i) -> named_struct('k', k, 'b', get(kids, i - 1))), x -> x.k.at.start - x.b.at.end > 1), x -> named_struct('start', x.b.at.end, 'end', x.k.at.start, 'line', x.k.at.line, 'column', x.b.at.last_column + 1, 'last_line', x.k.at.line, 'last_column', x.k.at.column - 1))", many=True),
    R("Layout/SpaceInsideBlockBraces", "block", "open = '{' AND substr(src, 2, 1) NOT IN (' ', '\\n', '|', '}')", "Space missing inside {.", span("at.start + 1", "at.start + 2")),
    R("Layout/SpaceInsideBlockBraces", "block", "open = '{' AND length(src) > 2 AND substr(src, length(src) - 1, 1) NOT IN (' ', '\\n')", "Space missing inside }.", tail("at.end - 1", "at.end")),
    R("Layout/SpaceInsideBlockBraces", "block", "open = '{' AND src like '{|%'", "Space between { and | missing.", span("at.start", "at.start + 2")),
    R("Layout/SpaceInsideBlockBraces", "block", "open = '{' AND src rlike '^[{] +[}]$'", "Space inside empty braces detected.", span("at.start + 1", "at.end - 1"), fix="''"),
    R("Layout/SpaceInsideParens", "parentheses", f"size(kids) > 0 AND {INSIDE} rlike '^ +\\\\S'", "Space inside parentheses detected.", span("at.start + 1", f"at.start + 1 + length(regexp_extract({INSIDE}, '^ +', 0))"), fix="''"),
    R("Layout/SpaceInsideParens", "parentheses", f"size(kids) > 0 AND {INSIDE} rlike '\\\\S +$'", "Space inside parentheses detected.", tail(f"at.end - 1 - length(regexp_extract({INSIDE}, ' +$', 0))", "at.end - 1"), fix="''"),
    R("Layout/SpaceInsideParens", "call", "open = '(' AND argc > 0 AND a0.at.line = sel.line AND substr(src, sel.end - at.start + 1, a0.at.start - sel.end) rlike '^[(] +$'", "Space inside parentheses detected.", span("sel.end + 1", "a0.at.start", "sel"), fix="''"),
    R("Layout/SpaceInsidePercentLiteralDelimiters", "array", "open rlike '^%[wWiI]' AND size(kids) > 0 AND get(kids, 0).at.line = at.line AND get(kids, 0).at.start > at.start + length(open)", "Do not use spaces inside percent literal delimiters.", span("at.start + length(open)", "get(kids, 0).at.start"), fix="''"),
    R("Layout/SpaceInsidePercentLiteralDelimiters", "array", "open rlike '^%[wWiI]' AND size(kids) > 0 AND get(kids, size(kids) - 1).at.last_line = at.last_line AND get(kids, size(kids) - 1).at.end < at.end - 1", "Do not use spaces inside percent literal delimiters.", tail("get(kids, size(kids) - 1).at.end", "at.end - 1"), fix="''"),
    R("Layout/SpaceInsideRangeLiteral", "range", "size(kids) = 2 AND get(kids, 0).at.last_line = get(kids, 1).at.line AND get(kids, 1).at.start - get(kids, 0).at.end > length(name)", "Space inside range literal."),
    R("Layout/SpaceInsideReferenceBrackets", "call", "form = 'index' AND argc > 0 AND substr(src, sel.start - at.start + 1) rlike '^\\\\[ +\\\\S'", "Space inside reference brackets detected.", span("sel.start + 1", "sel.start + 1 + length(regexp_extract(substr(src, sel.start - at.start + 2), '^ +', 0))", "sel"), fix="''"),
    R("Layout/SpaceInsideReferenceBrackets", "call", "form = 'index' AND argc > 0 AND src rlike '\\\\S +\\\\]$'", "Space inside reference brackets detected.", tail("at.end - 1 - length(regexp_extract(src, '( +)\\\\]$', 1))", "at.end - 1"), fix="''"),
    R("Layout/SpaceInsideStringInterpolation", "embedded_statements", "size(kids) > 0 AND at.line = at.last_line AND src rlike '^#[{] +'", "Do not use space inside string interpolation.", span("at.start + 2", "at.start + length(regexp_extract(src, '^#[{] +', 0))"), fix="''"),
    R("Layout/SpaceInsideStringInterpolation", "embedded_statements", "size(kids) > 0 AND at.line = at.last_line AND src rlike '\\\\S +[}]$'", "Do not use space inside string interpolation.", tail("at.end - 1 - length(regexp_extract(src, '( +)[}]$', 1))", "at.end - 1"), fix="''"),
)
