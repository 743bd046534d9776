"""Rules of the Naming, Metrics, Bundler and Gemspec departments that look at
nodes. Names, messages and limits are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import hits, quoted, span

OPERATORS = "'+', '-', '*', '/', '%', '**', '==', '!=', '<', '>', '<=', '>=', '<=>', '&', '|', '^', '<<', '>>', 'eql?', 'equal?'"
GEM = "recv IS NULL AND name = 'gem' AND a0.kind = 'string'"

#: Terms to be replaced, all in one pattern, and what by.
TERMS = "(?i)white[-_\\s]?list|black[-_\\s]?list|(?<![a-z0-9])slave(?![a-z0-9])"
SUGGESTED = {"white": "'allowlist' or 'permit'", "black": "'denylist' or 'block'", "slave": "'replica', 'secondary', or 'follower'"}


def _terms(kind: str, setting: str, column: str, where: str = "true") -> R:
    """The terms in one kind of text; column: SQL of the text, which begins where the node does."""
    told = " ".join(f"WHEN lower(m) like '{k}%' THEN {quoted(v)}" for k, v in SUGGESTED.items())
    message = f"@transform(regexp_extract_all({column}, {quoted(TERMS)}, 0), m -> concat('Consider replacing \\'', lower(m), '\\' with ', CASE {told} END, '.'))"
    return R("Naming/InclusiveLanguage", kind, f"{where} AND {column} rlike {quoted(TERMS)}", message, hits(TERMS, column), many=True, only=f"{{{setting}}} = 'true'", options={setting: "true"})


RULES = (
    R("Naming/AccessorMethodName", "def", "name rlike '^get_' AND (params IS NULL OR params.n = 0)", "Do not prefix reader method names with `get_`.", "sel"),
    R("Naming/AccessorMethodName", "def", "name rlike '^set_' AND params.n = 1 AND exists(kids2, k -> k.role = 'param' AND k.kind = 'required_parameter')", "Do not prefix writer method names with `set_`.", "sel"),
    R("Naming/AsciiIdentifiers", "local_variable_write def local_variable_target required_parameter", "name rlike '[^\\\\x00-\\\\x7F]'", "Use only ascii symbols in identifiers.", span("sel.start + regexp_instr(name, '[^\\\\x00-\\\\x7F]') - 1", "sel.start + regexp_instr(name, '[^\\\\x00-\\\\x7F]') - 1 + length(regexp_substr(name, '[^\\\\x00-\\\\x7F]+'))", "sel")),
    R("Naming/BinaryOperatorParameterName", "def", f"name IN ({OPERATORS}) AND params.n = 1 AND exists(kids2, k -> k.role = 'param' AND k.kind = 'required_parameter' AND k.name NOT IN ('other', '_other')) AND name NOT IN ('<<')", "=concat('When defining the `', name, '` operator, name its argument `other`.')", "get(filter(kids2, k -> k.role = 'param'), 0).at"),
    R("Naming/ClassAndModuleCamelCase", "class module", "get(kids, 0).src like '%\\\\_%'", "Use CamelCase for classes and modules.", "get(kids, 0).at"),
    R("Naming/ConstantName", "constant_write constant_or_write", "NOT name rlike '^[\\\\p{Lu}0-9_]+$' AND (val.kind IN ('integer', 'float', 'string', 'symbol', 'array', 'hash', 'regular_expression', 'interpolated_string', 'true', 'false', 'nil', 'range') OR val.kind = 'call' AND val.name = 'freeze')", "Use SCREAMING_SNAKE_CASE for constants.", "sel"),
    R("Naming/HeredocDelimiterCase", "string interpolated_string x_string", "form = 'heredoc' AND op <> upper(op)", "Use uppercase heredoc delimiters.", "named_struct('start', sel.end - nl + 1 - length(op), 'end', sel.end - nl + 1, 'line', sel.last_line, 'column', sel.last_column - nl + 2 - length(op), 'last_line', sel.last_line, 'last_column', sel.last_column - nl + 1)"),
    R("Naming/HeredocDelimiterNaming", "string interpolated_string x_string", "form = 'heredoc' AND (op rlike '^(EO[A-Z]|END|EOS|EOF)$' OR NOT op rlike '\\\\w')", "Use meaningful heredoc delimiters.", "named_struct('start', sel.end - nl + 1 - length(op), 'end', sel.end - nl + 1, 'line', sel.last_line, 'column', sel.last_column - nl + 2 - length(op), 'last_line', sel.last_line, 'last_column', sel.last_column - nl + 1)"),
    R("Naming/MethodName", "def", "name rlike '[A-Z]' AND name rlike '^[A-Za-z_]' AND NOT (name rlike '^[A-Z]' AND recv IS NULL AND false)", "Use snake_case for method names.", "sel"),
    R("Naming/MethodParameterName", "required_parameter optional_parameter required_keyword_parameter optional_keyword_parameter rest_parameter keyword_rest_parameter block_parameter", "p.kind = 'parameters' AND name IS NOT NULL AND length(ltrim('_', name)) < {MinNameLength} AND name NOT IN ('as', 'at', 'by', 'cc', 'db', 'id', 'if', 'in', 'io', 'ip', 'of', 'on', 'os', 'pp', 'to', '_') AND NOT name rlike '^_+$'", "=concat('Method parameter must be at least ', {MinNameLength}, ' characters long.')", "sel", options={"MinNameLength": "3"}),
    R("Naming/MethodParameterName", "required_parameter optional_parameter required_keyword_parameter optional_keyword_parameter", "p.kind = 'parameters' AND name rlike '[A-Z]'", "Only use lowercase characters for method parameter.", "sel"),
    R("Naming/PredicatePrefix", "def", "name rlike '^(is|has|have|does)_[a-z]' AND name NOT like '%=' AND name NOT IN ('is_a?')", "=concat('Rename `', name, '` to `', if(name like 'is\\\\_%', concat(regexp_replace(regexp_replace(name, '^is_', ''), '[?]$', ''), '?'), concat(regexp_replace(regexp_replace(name, '^(has|have|does)_', ''), '[?]$', ''), '?')), '`.')", "sel"),
    R("Naming/RescuedExceptionsVariableName", "rescue", "exists(kids, k -> k.role = 'target' AND k.kind = 'local_variable_target' AND k.name NOT IN ({PreferredName}, concat('_', {PreferredName})))", "=concat('Use `', {PreferredName}, '` instead of `', get(filter(kids, k -> k.role = 'target'), 0).name, '`.')", "get(filter(kids, k -> k.role = 'target'), 0).at", options={"PreferredName": "e"}),
    R("Metrics/ParameterLists", "parameters", "p.kind = 'def' AND pp.kind IS NOT NULL AND size(filter(kids, k -> k.kind <> 'block_parameter')) > {Max} AND NOT (p.name = 'initialize' AND pp.kind = 'block')", "=concat('Avoid parameter lists longer than ', {Max}, ' parameters. [', size(filter(kids, k -> k.kind <> 'block_parameter')), '/', {Max}, ']')", options={"Max": "5"}),
    R("Metrics/MethodLength", "def", "coalesce(form, '') <> 'endless' AND code > {Max}", "=concat('Method has too many lines. [', code, '/', {Max}, ']')", options={"Max": "10"}),
    R("Metrics/ModuleLength", "module", "code > {Max}", "=concat('Module has too many lines. [', code, '/', {Max}, ']')", options={"Max": "100"}),
    R("Metrics/BlockLength", "call", "blk.kind = 'block' AND name NOT IN ('refine', 'class_eval', 'new') AND code > {Max}", "=concat('Block has too many lines. [', code, '/', {Max}, ']')", options={"Max": "25"}),
    R("Metrics/CollectionLiteralLength", "array hash", "size(kids) >= {LengthThreshold}", "Avoid hard coding large quantities of data in code. Prefer reading the data from an external source.", options={"LengthThreshold": "250"}),
    R("Bundler/InsecureProtocolSource", "call", "recv IS NULL AND name = 'source' AND a0.kind = 'symbol' AND a0.name IN ('gemcutter', 'rubygems', 'rubyforge')", "=concat('The source `:', a0.name, '` is deprecated because HTTP requests are insecure. Please change your source to \\'https://rubygems.org\\' if possible, or \\'http://rubygems.org\\' if not.')", "a0.at", fix="'\\'https://rubygems.org\\''"),
    R("Gemspec/AddRuntimeDependency", "call", "name = 'add_runtime_dependency' AND recv IS NOT NULL AND path like '%.gemspec'", "Use `add_dependency` instead of `add_runtime_dependency`.", "sel", fix="'add_dependency'"),
    R("Gemspec/RubyVersionGlobalsUsage", "constant_read", "name = 'RUBY_VERSION' AND path like '%.gemspec'", "Do not use `RUBY_VERSION` in gemspec file."),
    R("Gemspec/DeprecatedAttributeAssignment", "call_write", "name IN ('test_files', 'date', 'specification_version', 'rubygems_version') AND path like '%.gemspec'", "=concat('Do not set `', name, '` in gemspec.')"),
    _terms("line", "CheckIdentifiers", "name", "form IS NULL"),
    _terms("comment", "CheckComments", "name", "coalesce(form, '') <> 'block'"),
)
