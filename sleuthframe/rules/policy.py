"""What configuration changes in rules: styles other than the default one, and
what is allowed.

{Key} stands for the value of a setting and {Key[]} for its list; both are looked
up in data that travels with the rows (see operators/settings.py), so that another
configuration needs no other plan. Keys, their defaults and messages are fixed values.
"""

from __future__ import annotations

from sleuthframe.rules.edits import LINE, cut, edits, insert, inside, put, replaced, wrapped
from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import span, thru

ALLOWED = {"AllowedMethods": (), "AllowedPatterns": ()}


def allows(subject: str) -> str:
    """Neither AllowedMethods nor AllowedPatterns has the subject."""
    return f"NOT coalesce(array_contains({{AllowedMethods[]}}, {subject}) OR exists({{AllowedPatterns[]}}, y -> {subject} rlike y), false)"


def outside(key: str, subject: str) -> str:
    return f"NOT coalesce(array_contains({{{key}[]}}, {subject}), false)"


def style(default: str, key: str = "EnforcedStyle") -> tuple[dict, str]:
    return {key: default}, f"{{{key}}} = '{default}'"


def unless(key: str, condition: str, default: str = "false") -> tuple[dict, str]:
    """Where a setting is true, not under this condition."""
    return {key: default}, f"NOT coalesce({{{key}}} = 'true' AND {condition}, false)"


def both(*policies: tuple[dict, str]) -> tuple[dict, str]:
    return {k: v for o, _ in policies for k, v in o.items()}, " AND ".join(f"({c})" for _, c in policies)


ROOT_NAME = "regexp_replace(recv.src, '^::', '')"
A0_RECV = "get(filter(kids2, k -> k.of = i_arg AND k.role = 'recv'), 0)"
ABOVE = "exists(up, u -> u.kind = 'call' AND (array_contains({AllowedMethods[]}, u.name) OR exists({AllowedPatterns[]}, y -> u.name rlike y)))"

#: Rule to its settings with defaults, and the condition that they put on what it reports by default.
POLICY: dict[str, tuple[dict, str]] = {
    "Bundler/GemComment": ({"IgnoredGems": ()}, outside("IgnoredGems", "a0.name")),
    "Bundler/GemVersion": both(style("required"), ({"AllowedGems": ()}, outside("AllowedGems", "a0.name"))),
    "Gemspec/DependencyVersion": both(style("required"), ({"AllowedGems": ()}, outside("AllowedGems", "a0.name"))),
    "Gemspec/DevelopmentDependencies": ({"AllowedGems": ()}, outside("AllowedGems", "a0.name")),
    "Layout/AccessModifierIndentation": style("indent"),
    "Layout/DotPosition": style("leading"),
    "Layout/EmptyLinesAroundAccessModifier": style("around"),
    "Layout/EmptyLinesAroundAttributeAccessor": ({"AllowedMethods": ("alias_method", "public", "protected", "private")}, "NOT coalesce(exists({AllowedMethods[]}, y -> ltrim(next) rlike concat('^', y, '\\\\b')), false)"),
    **{f"Layout/EmptyLinesAround{what}Body": style("no_empty_lines") for what in ("Block", "Class", "Module")},
    "Layout/LineContinuationSpacing": style("space"),
    "Layout/SpaceAroundEqualsInParameterDefault": style("space"),
    "Layout/SpaceBeforeBlockBraces": style("space"),
    "Layout/SpaceInLambdaLiteral": style("require_no_space"),
    "Layout/SpaceInsideParens": style("no_space"),
    "Layout/SpaceInsideReferenceBrackets": style("no_space"),
    "Layout/SpaceInsideStringInterpolation": style("no_space"),
    "Lint/AmbiguousBlockAssociation": (ALLOWED, allows("a0.name")),
    "Lint/ConstantDefinitionInBlock": ({"AllowedMethods": ("enums",)}, "NOT coalesce(exists(slice(up, 1, 3), u -> u.kind = 'call' AND array_contains({AllowedMethods[]}, u.name)), false)"),
    "Lint/EmptyClass": unless("AllowComments", "src like '%#%'"),
    "Lint/InheritException": style("standard_error"),
    "Lint/MissingSuper": ({"AllowedParentClasses": ()}, outside("AllowedParentClasses", "scope.cond")),
    "Lint/NestedMethodDefinition": (ALLOWED, f"NOT coalesce({ABOVE}, false)"),
    "Lint/NumberConversion": both((ALLOWED, allows("recv.name")), ({"IgnoredClasses": ("Time", "DateTime")}, outside("IgnoredClasses", "regexp_extract(recv.src, '^(?:::)?([A-Z]\\\\w*)', 1)"))),
    "Lint/RaiseException": ({"AllowedImplicitNamespaces": ("Gem",)}, "NOT coalesce(exists(up, u -> u.kind = 'module' AND array_contains({AllowedImplicitNamespaces[]}, u.name)) AND NOT a0.src like '::%', false)"),
    "Lint/RedundantSplatExpansion": unless("AllowPercentLiteralArrayArgument", "p.kind = 'call' AND val.open like '\\\\%%'", "true"),
    "Lint/UnreachableLoop": ({"AllowedPatterns": ("(exactly|at_least|at_most)\\(\\d+\\)\\.times",)}, "NOT coalesce(exists({AllowedPatterns[]}, y -> src rlike y), false)"),
    "Lint/UselessDefaultValueArgument": ({"AllowedReceivers": ()}, outside("AllowedReceivers", "recv.src")),
    "Metrics/BlockLength": ({"AllowedMethods": ("refine",), "AllowedPatterns": ()}, allows("name")),
    "Metrics/MethodLength": (ALLOWED, allows("name")),
    "Naming/ClassAndModuleCamelCase": ({"AllowedNames": ("module_parent",)}, outside("AllowedNames", "name")),
    "Naming/HeredocDelimiterCase": style("uppercase"),
    "Naming/MethodName": both(style("snake_case"), ({"AllowedPatterns": ()}, "NOT coalesce(exists({AllowedPatterns[]}, y -> name rlike y), false)")),
    "Naming/PredicatePrefix": ({"AllowedMethods": ("is_a?",)}, outside("AllowedMethods", "name")),
    "Style/Alias": style("prefer_alias"),
    "Style/AndOr": style("conditionals"),
    "Style/BarePercentLiterals": style("bare_percent"),
    "Style/CaseEquality": both(unless("AllowOnConstant", "recv.kind IN ('constant_read', 'constant_path')"), unless("AllowOnSelfClass", "recv.src = 'self.class'")),
    "Style/ClassAndModuleChildren": style("nested"),
    "Style/ClassCheck": style("is_a?"),
    "Style/ClassEqualityComparison": ({"AllowedMethods": ("==", "equal?", "eql?"), "AllowedPatterns": ()}, allows("scope.name")),
    "Style/CollectionCompact": ({"AllowedReceivers": ()}, outside("AllowedReceivers", "recv.src")),
    "Style/CommandLiteral": style("backticks"),
    "Style/DateTime": unless("AllowCoercion", "name = 'to_datetime'"),
    "Style/Documentation": ({"AllowedConstants": ()}, outside("AllowedConstants", "name")),
    "Style/DoubleNegation": style("allowed_in_returns"),
    "Style/EmptyElse": ({"EnforcedStyle": "both"}, "CASE {EnforcedStyle} WHEN 'empty' THEN nbody = 0 WHEN 'nil' THEN nbody = 1 ELSE true END"),
    "Style/EmptyMethod": style("compact"),
    "Style/FetchEnvVar": ({"AllowedVars": ()}, outside("AllowedVars", "a0.name")),
    "Style/For": style("each"),
    "Style/FormatString": style("format"),
    "Style/GlobalVars": ({"AllowedVariables": ()}, outside("AllowedVariables", "name")),
    "Style/HashAsLastArrayItem": style("braces"),
    "Style/HashConversion": unless("AllowSplatArgument", "a0.kind = 'splat'", "true"),
    "Style/HashEachMethods": ({"AllowedReceivers": ("Thread.current",)}, outside("AllowedReceivers", "get(rk, 0).src")),
    "Style/HashSyntax": style("ruby19"),
    "Style/IfWithBooleanLiteralBranches": ({"AllowedMethods": ("infinite?", "nonzero?")}, outside("AllowedMethods", "cond.name")),
    "Style/IpAddresses": ({"AllowedAddresses": ("::",)}, "NOT coalesce(exists({AllowedAddresses[]}, y -> lower(y) = lower(name)), false)"),
    "Style/Lambda": style("line_count_dependent"),
    "Style/LambdaCall": style("call"),
    "Style/MagicCommentFormat": style("snake_case"),
    "Style/MethodCallWithArgsParentheses": (ALLOWED, allows("name")),
    "Style/MethodCallWithoutArgsParentheses": (ALLOWED, allows("name")),
    "Style/MethodDefParentheses": style("require_parentheses"),
    "Style/ModuleFunction": style("module_function"),
    "Style/NegatedIf": ({"EnforcedStyle": "both"}, "CASE {EnforcedStyle} WHEN 'prefix' THEN coalesce(form, '') <> 'modifier' WHEN 'postfix' THEN coalesce(form, '') = 'modifier' ELSE true END"),
    "Style/NegatedUnless": ({"EnforcedStyle": "both"}, "CASE {EnforcedStyle} WHEN 'prefix' THEN coalesce(form, '') <> 'modifier' WHEN 'postfix' THEN coalesce(form, '') = 'modifier' ELSE true END"),
    "Style/NilComparison": style("predicate"),
    "Style/NumericLiteralPrefix": ({"EnforcedOctalStyle": "zero_with_o"}, "{EnforcedOctalStyle} = 'zero_with_o' OR NOT name rlike '^-?0[oO0-7]'"),
    "Style/NumericLiterals": ({"AllowedNumbers": (), "AllowedPatterns": ()}, "NOT coalesce(array_contains({AllowedNumbers[]}, name) OR exists({AllowedPatterns[]}, y -> name rlike y), false)"),
    "Style/NumericPredicate": both(style("predicate"), (ALLOWED, f"NOT coalesce({ABOVE}, false) AND {allows('name')}")),
    "Style/ObjectThen": style("then"),
    "Style/ParenthesesAroundCondition": unless("AllowInMultilineConditions", "cond.at.line <> cond.at.last_line"),
    "Style/PercentQLiterals": style("lower_case_q"),
    "Style/PreferredHashMethods": style("short"),
    "Style/RaiseArgs": both(style("exploded"), ({"AllowedCompactTypes": ()}, outside("AllowedCompactTypes", f"{A0_RECV}.src"))),
    "Style/RedundantCondition": ({"AllowedMethods": ("infinite?", "nonzero?")}, outside("AllowedMethods", "cond.name")),
    "Style/RedundantReturn": unless("AllowMultipleReturnValues", "get(body, nbody - 1).n > 1"),
    "Style/RegexpLiteral": both(style("slashes"), ({"AllowInnerSlashes": "false"}, "true")),
    "Style/RescueStandardError": style("explicit"),
    "Style/ReturnNil": style("return"),
    "Style/ReturnNilInPredicateMethodDefinition": (ALLOWED, allows("scope.name")),
    "Style/SafeNavigation": ({"AllowedMethods": ("present?", "blank?", "presence", "try", "try!")}, "NOT coalesce(array_contains({AllowedMethods[]}, if(kind = 'and', get(kids, 1).name, b0.name)), false)"),
    "Style/SignalException": style("only_raise"),
    "Style/SoleNestedConditional": unless("AllowModifier", "b0.form = 'modifier'"),
    "Style/SpecialGlobalVars": style("use_english_names"),
    "Style/StabbyLambdaParentheses": style("require_parentheses"),
    "Style/StringConcatenation": ({"Mode": "aggressive"}, "{Mode} = 'aggressive' OR recv.kind IN ('string', 'interpolated_string')"),
    "Style/StringLiterals": style("single_quotes"),
    "Style/StringLiteralsInInterpolation": style("single_quotes"),
    "Style/SymbolArray": style("percent"),
    "Style/SymbolProc": both(({"AllowedMethods": ("define_method",), "AllowedPatterns": ()}, allows("name")), unless("AllowComments", "blk.src like '%#%'")),
    "Style/TernaryParentheses": style("require_no_parentheses"),
    "Style/TrivialAccessors": ({"AllowedMethods": ("to_ary", "to_a", "to_c", "to_enum", "to_h", "to_hash", "to_i", "to_int", "to_io", "to_open", "to_path", "to_proc", "to_r", "to_regexp", "to_str", "to_s", "to_sym")}, outside("AllowedMethods", "name")),
    "Style/UnlessLogicalOperators": style("forbid_mixed_logical_operators"),
    "Style/WordArray": style("percent"),
    "Style/YodaCondition": ({"EnforcedStyle": "forbid_for_all_comparison_operators"}, "{EnforcedStyle} = 'forbid_for_all_comparison_operators' OR {EnforcedStyle} = 'forbid_for_equality_operators_only' AND name IN ('==', '!=')"),
    "Style/YodaExpression": ({"SupportedOperators": ("*", "+", "&", "|", "^")}, "array_contains({SupportedOperators[]}, name)"),
}


def other(name: str, value: str, kinds: str, where: str, message: str, at: str = "at", change: str | None = None, key: str = "EnforcedStyle", many: bool = False) -> R:
    """A rule under a style that isn't its default; key: the setting that asks for it."""
    return R(name, kinds, where, message, at, many=many, edits=change, only=f"{{{key}}} = '{value}'")


SEL, AT = "sel", "at"
RECV_END = "recv.at.end"
PERL_NAMES = {"$ERROR_INFO": "$!", "$ERROR_POSITION": "$@", "$FIELD_SEPARATOR": "$;", "$OUTPUT_FIELD_SEPARATOR": "$,", "$INPUT_RECORD_SEPARATOR": "$/", "$INPUT_LINE_NUMBER": "$.", "$LAST_READ_LINE": "$_", "$DEFAULT_OUTPUT": "$>", "$DEFAULT_INPUT": "$<", "$PROCESS_ID": "$$", "$CHILD_STATUS": "$?", "$LAST_MATCH_INFO": "$~", "$LOAD_PATH": "$:", "$PROGRAM_NAME": "$0", "$LOADED_FEATURES": '$"'}
PERL = "CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PERL_NAMES.items()) + " END"
NAMESPACE = "nbody = 1 AND b0.kind IN ('class', 'module')"


def lines_missing(what: str, kinds: str, name: str) -> tuple[R, R]:
    """A blank line missing at the beginning and at the end of a body."""
    where = f"at.line <> at.last_line AND nbody > 0 AND coalesce(form, '') NOT IN ('endless', 'modifier') AND kind <> '' AND "
    message = f"Empty line missing at {what} body "
    return (
        other(name, "empty_lines", kinds, f"{where}top = 0 AND b0.at.line = hdr + 1", message + "beginning.", "b0.at", edits(insert("b0.at.start - (b0.at.column - 1)", LINE))),
        other(name, "empty_lines", kinds, f"{where}bot = 0 AND close", message + "end.", span("at.end - if(open = '{', 1, 3)", "at.end").replace("at.line", "at.last_line").replace("at.column + (at.end - if(open = '{', 1, 3)) - at.start", "at.last_column - if(open = '{', 0, 2)").replace("at.column + (at.end) - at.start - 1", "at.last_column"), edits(insert("x.start - (x.column - 1)", LINE))),
    )


#: Rules under their other styles.
STYLES: tuple[R, ...] = (
    other("Bundler/GemVersion", "forbidden", "call", "recv IS NULL AND name = 'gem' AND argc > 1 AND a1.kind = 'string' AND path rlike '(^|/)(Gemfile|gems[.]rb)$'", "Gem version specification is forbidden."),
    other("Gemspec/DependencyVersion", "forbidden", "call", "name IN ('add_dependency', 'add_runtime_dependency', 'add_development_dependency') AND argc > 1 AND a1.kind = 'string' AND path like '%.gemspec'", "Dependency version specification is forbidden."),
    other("Layout/AccessModifierIndentation", "outdent", "class module singleton_class", "lead AND at.line <> at.last_line", "=concat('Outdent access modifiers like `', 'private', '`.')", "transform(filter(body, b -> b.kind = 'call' AND b.form = 'name' AND b.name IN ('private', 'protected', 'public', 'module_function') AND b.lead AND b.at.column <> at.column), b -> b.at)", edits(replaced("x.start - (x.column - 1)", "x.start", "repeat(' ', at.column - 1)")), many=True),
    other("Layout/DotPosition", "trailing", "call", "op IN ('.', '&.') AND recv.at.last_line < sel.line AND substr(src, recv.at.end - at.start + 1, sel.start - recv.at.end) rlike '^[ \\\\t]*\\n[ \\\\t]*(&?[.])$'", "=concat('Place the ', op, ' on the previous line, together with the method call receiver.')", span("sel.start - length(op)", "sel.start", "sel"), edits(insert(RECV_END, "op"), cut("sel.start - length(op)", "sel.start"))),
    other("Layout/EmptyLinesAroundAccessModifier", "only_before", "call", "recv IS NULL AND form = 'name' AND name IN ('private', 'protected', 'public', 'module_function') AND lead AND role = 'body' AND p.kind IN ('class', 'module', 'singleton_class') AND trim(rest) = '' AND next IS NOT NULL AND trim(next) = ''", "=concat('Remove a blank line after `', name, '`.')", AT, edits(cut("at.end + length(rest) + nl", "at.end + length(rest) + nl + length(next) + nl"))),
    *lines_missing("block", "block", "Layout/EmptyLinesAroundBlockBody"),
    *lines_missing("class", "class singleton_class", "Layout/EmptyLinesAroundClassBody"),
    *lines_missing("module", "module", "Layout/EmptyLinesAroundModuleBody"),
    other("Layout/LineContinuationSpacing", "no_space", "line", "form IS NULL AND name rlike '\\\\s\\\\\\\\$'", "Use zero spaces in front of backslash.", span("at.end - length(regexp_extract(name, '\\\\s*\\\\\\\\$', 0))", "at.end"), edits(put("x", "'\\\\\\\\'".replace("\\\\\\\\", "\\\\")))),
    other("Layout/SpaceAroundEqualsInParameterDefault", "no_space", "optional_parameter", "val.at.start > sel.end + 1", "Surrounding space detected in default value assignment.", f"named_struct('start', sel.end, 'end', val.at.start, 'line', sel.line, 'column', sel.last_column + 1, 'last_line', val.at.line, 'last_column', val.at.column - 1)", edits(put("x", "'='"))),
    other("Layout/SpaceBeforeBlockBraces", "no_space", "call super", "blk.kind = 'block' AND blk.open = '{' AND substr(src, blk.at.start - at.start, 1) = ' '", "Space detected to the left of {.", "named_struct('start', blk.at.start - length(regexp_extract(substr(src, 1, blk.at.start - at.start), ' *$', 0)), 'end', blk.at.start, 'line', blk.at.line, 'column', blk.at.column - length(regexp_extract(substr(src, 1, blk.at.start - at.start), ' *$', 0)), 'last_line', blk.at.line, 'last_column', blk.at.column - 1)", edits(cut("x.start", "x.end"))),
    other("Layout/SpaceInLambdaLiteral", "require_space", "lambda", "params.open = '(' AND params.at.start = sel.end", "Use a space between `->` and `(` in lambda literals.", thru(SEL, "params.at"), edits(insert("sel.end", "' '"))),
    other("Layout/SpaceInsideParens", "space", "parentheses", "at.line = at.last_line AND size(kids) > 0 AND substr(src, 2, 1) <> ' '", "No space inside parentheses detected.", span("at.start + 1", "at.start + 2"), edits(insert("x.start", "' '"))),
    other("Layout/SpaceInsideParens", "space", "parentheses", "at.line = at.last_line AND size(kids) > 0 AND substr(src, length(src) - 1, 1) <> ' '", "No space inside parentheses detected.", span("at.end - 1", "at.end"), edits(insert("x.start", "' '"))),
    other("Layout/SpaceInsideReferenceBrackets", "space", "call", "name = '[]' AND form = 'index' AND argc > 0 AND at.line = at.last_line AND a0.at.start = recv.at.end + 1", "Use space inside reference brackets.", "named_struct('start', recv.at.end, 'end', recv.at.end + 1, 'line', recv.at.last_line, 'column', recv.at.last_column + 1, 'last_line', recv.at.last_line, 'last_column', recv.at.last_column + 1)", edits(insert("x.end", "' '"))),
    other("Layout/SpaceInsideReferenceBrackets", "space", "call", "name = '[]' AND form = 'index' AND argc > 0 AND at.line = at.last_line AND get(args, argc - 1).at.end = at.end - 1", "Use space inside reference brackets.", span("at.end - 1", "at.end"), edits(insert("x.start", "' '"))),
    other("Layout/SpaceInsideStringInterpolation", "space", "embedded_statements", "at.line = at.last_line AND size(kids) > 0 AND get(kids, 0).at.start = at.start + 2", "Use space inside string interpolation.", span("at.start", "at.start + 2"), edits(insert("x.end", "' '"))),
    other("Layout/SpaceInsideStringInterpolation", "space", "embedded_statements", "at.line = at.last_line AND size(kids) > 0 AND get(kids, size(kids) - 1).at.end = at.end - 1", "Use space inside string interpolation.", span("at.end - 1", "at.end"), edits(insert("x.start", "' '"))),
    other("Lint/InheritException", "runtime_error", "class", "exists(kids, k -> k.role = 'superclass' AND regexp_replace(k.src, '^::', '') = 'Exception')", "Inherit from `RuntimeError` instead of `Exception`.", "get(filter(kids, k -> k.role = 'superclass'), 0).at", edits(put("x", "'RuntimeError'"))),
    other("Lint/InheritException", "runtime_error", "call", "name = 'new' AND recv.src IN ('Class', '::Class') AND regexp_replace(a0.src, '^::', '') = 'Exception'", "Inherit from `RuntimeError` instead of `Exception`.", "a0.at", edits(put("x", "'RuntimeError'"))),
    other("Naming/HeredocDelimiterCase", "lowercase", "string interpolated_string x_string", "form = 'heredoc' AND op <> lower(op)", "Use lowercase heredoc delimiters.", "named_struct('start', sel.end - nl + 1 - length(op), 'end', sel.end - nl + 1, 'line', sel.last_line, 'column', sel.last_column - nl + 2 - length(op), 'last_line', sel.last_line, 'last_column', sel.last_column - nl + 1)", edits(replaced("at.end - length(op)", "at.end", "if(substr(src, length(src) - length(op) + 1) = op, lower(op), null)"), put("x", "lower(op)"))),
    other("Naming/MethodName", "camelCase", "def", "name rlike '^[a-z0-9_]+[?!=]?$' AND name rlike '[a-z0-9]_' AND NOT coalesce(exists({AllowedPatterns[]}, y -> name rlike y), false)", "Use camelCase for method names.", SEL),
    other("Style/Alias", "prefer_alias_method", "alias", "size(kids) = 2 AND NOT get(kids, 0).src like '$%' AND p.kind IN ('class', 'module', 'singleton_class')", "Use `alias_method` instead of `alias`.", SEL, edits(put(AT, "concat('alias_method :', regexp_replace(get(kids, 0).src, '^:', ''), ', :', regexp_replace(get(kids, 1).src, '^:', ''))"))),
    other("Style/AndOr", "always", "and or", "name IN ('and', 'or')", "=concat('Use `', if(name = 'and', '&&', '||'), '` instead of `', name, '`.')", SEL, edits(put("x", "if(name = 'and', '&&', '||')"))),
    other("Style/BarePercentLiterals", "percent_q", "string interpolated_string", "open rlike '^%[^\\\\w\\\\s]$'", "Use `%Q` instead of `%`.", span("at.start", "at.start + length(open)"), edits(insert("at.start + 1", "'Q'"))),
    other("Style/ClassAndModuleChildren", "compact", "class module", f"{NAMESPACE} AND NOT exists(kids, k -> k.role = 'superclass') AND NOT exists(up, u -> u.kind IN ('class', 'module'))", "Use compact module/class definition instead of nested style.", "get(kids, 0).at"),
    other("Style/ClassCheck", "kind_of?", "call", "name = 'is_a?' AND argc = 1", "Prefer `Object#kind_of?` over `Object#is_a?`.", SEL, edits(put("x", "'kind_of?'"))),
    other("Style/CommandLiteral", "percent_x", "x_string", "open = '`' AND NOT rlike(name, '[()]')", "Use `%x` around command string.", AT, edits(replaced("at.start", "at.start + 1", "'%x('"), replaced("at.end - 1", "at.end", "')'"))),
    other("Style/DoubleNegation", "forbidden", "call", "name = '!' AND open = '!' AND recv.kind = 'call' AND recv.name = '!' AND recv.open = '!'", "Avoid the use of double negation (`!!`).", SEL, edits(cut("recv.sel.start", "recv.sel.end"), insert("at.end", "'.nil?'"))),
    other("Style/EmptyMethod", "expanded", "def", "nbody = 0 AND coalesce(form, '') <> 'endless' AND at.line = at.last_line AND src rlike ';\\\\s*end$'", "Put the `end` of empty method definitions on the next line.", AT, edits(put(AT, f"concat(regexp_extract(src, '^(.*?)\\\\s*;\\\\s*end$', 1), {LINE}, repeat(' ', ind), 'end')"))),
    other("Style/For", "for", "call", "name = 'each' AND argc = 0 AND recv IS NOT NULL AND blk.kind = 'block' AND at.line <> at.last_line AND get(bk, 0).kind = 'block_parameters' AND get(bk, 0).n = 1", "Prefer `for` over `each`.", AT, edits(replaced("at.start", "get(bk, 0).at.end", f"concat('for ', {inside('get(bk, 0).src')}, ' in ', recv.src, ' do')"))),
    other("Style/FormatString", "sprintf", "call", "name = 'format' AND (recv IS NULL OR recv.src IN ('Kernel', '::Kernel')) AND argc > 1", "Favor `sprintf` over `format`.", SEL, edits(put("x", "'sprintf'"))),
    other("Style/FormatString", "sprintf", "call", "name = '%' AND form = 'binary' AND recv.kind IN ('string', 'interpolated_string')", "Favor `sprintf` over `String#%`.", SEL, edits(put(AT, f"concat('sprintf(', recv.src, ', ', if(a0.kind = 'array', {inside('a0.src')}, a0.src), ')')"))),
    other("Style/FormatString", "percent", "call", "name IN ('format', 'sprintf') AND (recv IS NULL OR recv.src IN ('Kernel', '::Kernel')) AND argc > 1", "=concat('Favor `String#%` over `', name, '`.')", SEL, edits(put(AT, "concat(a0.src, ' % ', if(argc = 2, a1.src, concat('[', array_join(transform(slice(args, 2, argc - 1), k -> k.src), ', '), ']')))"))),
    other("Style/HashAsLastArrayItem", "no_braces", "array", "open = '[' AND size(kids) > 1 AND get(kids, size(kids) - 1).kind = 'hash' AND get(kids, size(kids) - 1).n > 0", "Omit the braces around the hash.", "get(kids, size(kids) - 1).at", edits(put("x", inside("get(kids, size(kids) - 1).src")))),
    other("Style/HashSyntax", "hash_rockets", "hash keyword_hash", "exists(kids, k -> k.kind = 'assoc' AND k.open = 'label' AND k.form IS NULL)", "Use hash rockets syntax.", "transform(filter(kids, k -> k.kind = 'assoc' AND k.open = 'label' AND k.form IS NULL AND k.src rlike '^\\\\w+[?!]?:'), k -> named_struct('start', k.at.start, 'end', k.at.start + length(regexp_extract(k.src, '^\\\\w+[?!]?:', 0)), 'line', k.at.line, 'column', k.at.column, 'last_line', k.at.line, 'last_column', k.at.column + length(regexp_extract(k.src, '^\\\\w+[?!]?:', 0)) - 1))", edits(put("x", "concat(':', substr(src, x.start - at.start + 1, x.end - x.start - 1), ' =>')")), many=True),
    other("Style/Lambda", "lambda", "lambda", "params IS NULL", "Use the `lambda` method for all lambdas.", SEL, edits(put("x", "'lambda'"))),
    other("Style/Lambda", "literal", "call", "recv IS NULL AND name = 'lambda' AND blk.kind = 'block'", "Use the `-> { ... }` lambda literal syntax for all lambdas.", SEL, edits(put("x", "if(get(bk, 0).kind = 'block_parameters', concat('->(', substr(get(bk, 0).src, 2, length(get(bk, 0).src) - 2), ')'), '->')"), cut("if(get(bk, 0).kind = 'block_parameters', get(bk, 0).at.start - 1, sel.end)", "if(get(bk, 0).kind = 'block_parameters', get(bk, 0).at.end, sel.end)"))),
    other("Style/LambdaCall", "braces", "call", "name = 'call' AND recv IS NOT NULL AND sel.end > sel.start AND open = '('", "=concat('Prefer the use of `', recv.src, op, '(', array_join(transform(args, a -> a.src), ', '), ')` over `', src, '`.')", AT, edits(cut("sel.start", "sel.end"))),
    other("Style/MagicCommentFormat", "kebab_case", "comment", "at.line <= 3 AND name rlike '(?i)frozen_string_literal:'", "Prefer kebab case for magic comments.", span("at.start + regexp_instr(name, '(?i)frozen_string_literal') - 1", "at.start + regexp_instr(name, '(?i)frozen_string_literal') + 20"), edits(put("x", "translate(substr(name, x.start - at.start + 1, x.end - x.start), '_', '-')"))),
    other("Style/MethodDefParentheses", "require_no_parentheses", "def", "params.open = '(' AND params.n > 0 AND coalesce(form, '') <> 'endless' AND at.line <> at.last_line", "Use def without parentheses.", "params.at", edits(replaced("params.at.start", "params.at.start + 1", "' '"), cut("params.at.end - 1", "params.at.end"))),
    other("Style/ModuleFunction", "extend_self", "call", "recv IS NULL AND name = 'module_function' AND argc = 0 AND p.kind = 'module'", "Use `extend self` instead of `module_function`.", AT, edits(put("x", "'extend self'"))),
    other("Style/NilComparison", "comparison", "call", "name = 'nil?' AND argc = 0 AND recv IS NOT NULL AND op = '.'", "Prefer the use of the `==` comparison.", SEL, edits(replaced(RECV_END, "at.end", "' == nil'"))),
    other("Style/NumericLiteralPrefix", "zero_only", "integer", "name rlike '^-?0[oO]'", "Use 0 for octal literals.", AT, edits(put(AT, "regexp_replace(name, '^(-?)0[oO]', '$10')")), key="EnforcedOctalStyle"),
    other("Style/NumericPredicate", "comparison", "call", f"name IN ('zero?', 'positive?', 'negative?') AND argc = 0 AND recv IS NOT NULL AND op = '.' AND NOT coalesce({ABOVE}, false) AND {allows('name')}", "=concat('Use `', recv.src, CASE name WHEN 'zero?' THEN ' == 0' WHEN 'positive?' THEN ' > 0' ELSE ' < 0' END, '` instead of `', src, '`.')", AT, edits(put(AT, "{told}"))),
    other("Style/ObjectThen", "yield_self", "call", "name = 'then' AND recv IS NOT NULL AND argc = 0 AND blk IS NOT NULL", "Prefer `yield_self` over `then`.", SEL, edits(put("x", "'yield_self'"))),
    other("Style/PercentQLiterals", "upper_case_q", "string", "open like '\\\\%q_'", "Use `%Q` instead of `%q`.", span("at.start", "at.start + length(open)"), edits(put("x", "concat('%Q', substr(open, 3))"))),
    other("Style/PreferredHashMethods", "verbose", "call", "name IN ('key?', 'value?') AND recv IS NOT NULL AND argc = 1", "=concat('Use `Hash#has_', name, '` instead of `Hash#', name, '`.')", SEL, edits(put("x", "concat('has_', name)"))),
    other("Style/RaiseArgs", "compact", "call", "recv IS NULL AND name IN ('raise', 'fail') AND argc = 2 AND a0.kind IN ('constant_read', 'constant_path') AND a1.kind <> 'keyword_hash'", "=concat('Provide an exception object as an argument to `', name, '`.')", AT, edits(replaced("a0.at.start", "a1.at.end", "concat(a0.src, '.new(', a1.src, ')')"))),
    other("Style/RegexpLiteral", "percent_r", "regular_expression interpolated_regular_expression", "open = '/' AND NOT rlike(name, '[{}]')", "Use `%r` around regular expression.", AT, edits(replaced("at.start", "at.start + 1", "'%r{'"), replaced("at.end - 1 - length(regexp_extract(src, '[a-z]*$', 0))", "at.end - length(regexp_extract(src, '[a-z]*$', 0))", "'}'"))),
    other("Style/RescueStandardError", "implicit", "rescue", "size(filter(kids, k -> k.role = 'class')) = 1 AND regexp_replace(get(filter(kids, k -> k.role = 'class'), 0).src, '^::', '') = 'StandardError'", "Omit the error class when rescuing `StandardError` by itself.", thru(SEL, "get(filter(kids, k -> k.role = 'class'), 0).at"), edits(cut("sel.end", "x.end"))),
    other("Style/ReturnNil", "return_nil", "return", "size(kids) = 0", "Prefer `return nil` over `return`.", AT, edits(insert("at.end", "' nil'"))),
    other("Style/SignalException", "only_fail", "call", "name = 'raise' AND recv IS NULL", "Always use `fail` to signal exceptions.", SEL, edits(put("x", "'fail'"))),
    other("Style/SpecialGlobalVars", "use_perl_names", "global_variable_read", f"({PERL}) IS NOT NULL", f"=concat('Prefer `', {PERL}, '` over `', name, '`.')", AT, edits(put(AT, "{told}"))),
    other("Style/StabbyLambdaParentheses", "require_no_parentheses", "block_parameters", "p.kind = 'lambda' AND open = '(' AND size(kids) > 0", "Do not wrap stabby lambda arguments with parentheses.", AT, edits(cut("at.start", "at.start + 1"), cut("at.end - 1", "at.end"))),
    other("Style/StringLiterals", "double_quotes", "string", "open = '\\'' AND form IS NULL AND NOT name rlike '[\"\\\\\\\\#]' AND role <> 'part'", "Prefer double-quoted strings unless you need single quotes to avoid extra backslashes for escaping.", AT, edits(replaced("at.start", "at.start + 1", "'\"'"), replaced("at.end - 1", "at.end", "'\"'"))),
    other("Style/StringLiteralsInInterpolation", "double_quotes", "string", "open = '\\'' AND NOT name rlike '[\"\\\\\\\\#]' AND exists(up, u -> u.kind = 'embedded_statements') AND role <> 'part'", "Prefer double-quoted strings inside interpolations.", AT, edits(replaced("at.start", "at.start + 1", "'\"'"), replaced("at.end - 1", "at.end", "'\"'"))),
    other("Style/SymbolArray", "brackets", "array", "open like '\\\\%i_' AND size(kids) > 0 AND forall(kids, k -> k.name rlike '^[a-zA-Z_]\\\\w*[?!]?$')", "=concat('Use `[', array_join(transform(kids, k -> concat(':', k.name)), ', '), ']` for an array of symbols.')", AT, edits(put(AT, "{told}"))),
    other("Style/TernaryParentheses", "require_parentheses", "if", "form = 'ternary' AND cond.kind <> 'parentheses'", "Use parentheses for ternary conditions.", AT, wrapped("cond.at")),
    other("Style/UnlessLogicalOperators", "forbid_logical_operators", "unless", "cond.kind IN ('and', 'or')", "Do not use any logical operator in an `unless`."),
    other("Style/WordArray", "brackets", "array", "open like '\\\\%w_' AND size(kids) > 0 AND forall(kids, k -> k.name rlike '^[\\\\w-]+$')", "=concat('Use `[', array_join(transform(kids, k -> concat('\\'', k.name, '\\'')), ', '), ']` for an array of words.')", AT, edits(put(AT, "{told}"))),
    R("Style/SendWithLiteralMethodName", "call", "name IN ('send', '__send__') AND recv IS NOT NULL AND a0.kind IN ('symbol', 'string') AND a0.name rlike '^[a-z_][a-zA-Z0-9_]*[?!]?$'", "=concat('Use `', a0.name, '` method call directly instead.')", thru(SEL, AT), only="{AllowSend} = 'false'", options={"AllowSend": "true"}, edits=edits(put("x", "concat(a0.name, if(argc > 1, concat('(', array_join(transform(slice(args, 2, argc - 1), k -> k.src), ', '), ')'), ''))"))),
)

