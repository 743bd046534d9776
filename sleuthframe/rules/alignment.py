"""Rules about where lines begin that belong to something begun above them: each
compares the column of what leads a line with that of its anchor, the first
sibling or the beginning of the anchor's line. Names and messages are fixed values."""

from sleuthframe.rules.edits import edits, replaced
from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.engine import tail

LATER = "transform(filter(transform({of}, (k, i) -> named_struct('k', k, 'i', i)), x -> x.i > 0 AND x.k.lead AND x.k.at.line > get({of}, x.i - 1).at.last_line AND x.k.at.column <> {column}), x -> x.k.at)"
WRITES = "local_variable_write instance_variable_write class_variable_write global_variable_write constant_write local_variable_or_write instance_variable_or_write local_variable_operator_write instance_variable_operator_write"
#: The last line of a node's text, if it is a closing mark alone.
ENDS = "src rlike '\\\\n[ \\\\t]*{mark}$'"


def moved(column: str) -> str:
    """The reported span's line begun at a column (from 1); what has several lines
    isn't moved, for they would have to go along."""
    return edits(replaced("if(x.line = x.last_line, x.start - (x.column - 1), null)", "x.start", f"repeat(' ', {column} - 1)"))


def array_style(style: str, column: str, message: str) -> R:
    at = LATER.format(of="kids", column=column)
    return R("Layout/ArrayAlignment", "array", f"open = '[' AND size(kids) > 1 AND at.line <> at.last_line AND size({at}) > 0", message, at, many=True, edits=moved(column), only=f"{{EnforcedStyle}} = '{style}'", options={"EnforcedStyle": "with_first_element"})


RULES = (
    array_style("with_first_element", "get(kids, 0).at.column", "Align the elements of an array literal if they span more than one line."),
    array_style("with_fixed_indentation", "(ind + 3)", "Use one level of indentation for elements following the first line of a multi-line array."),
    R("Layout/AssignmentIndentation", WRITES, "val.lead AND val.at.line = at.line + 1 AND val.at.column <> ind + 1 + {IndentationWidth}", "Indent the first line of the right-hand-side of a multi-line assignment.", "val.at", edits=moved("(ind + 1 + {IndentationWidth})"), options={"IndentationWidth": "2"}),
    R("Layout/FirstArgumentIndentation", "call super", "open = '(' AND a0.lead AND sel.line = at.line AND a0.at.line = at.line + 1 AND NOT (role = 'arg' AND p.kind IN ('call', 'super')) AND a0.at.column <> ind + 1 + {IndentationWidth}", "Indent the first argument one step more than the start of the previous line.", "a0.at", edits=moved("(ind + 1 + {IndentationWidth})"), options={"IndentationWidth": "2"}),
    R("Layout/FirstHashElementIndentation", "hash", "open = '{' AND get(kids, 0).lead AND get(kids, 0).at.line = at.line + 1 AND role <> 'arg' AND get(kids, 0).at.column <> ind + 1 + {IndentationWidth}", "=concat('Use ', {IndentationWidth}, ' spaces for indentation in a hash, relative to the start of the line where the left curly brace is.')", "get(kids, 0).at", edits=moved("(ind + 1 + {IndentationWidth})"), options={"IndentationWidth": "2"}),
    R("Layout/FirstHashElementIndentation", "hash", f"open = '{{' AND get(kids, 0).at.line > at.line AND role <> 'arg' AND {ENDS.format(mark='[}]')} AND at.last_column <> ind + 1", "Indent the right brace the same as the start of the line where the left brace is.", tail("at.end - 1", "at.end"), edits=moved("(ind + 1)")),
    R("Layout/FirstParameterIndentation", "parameters", "open = '(' AND p.kind = 'def' AND get(kids, 0).lead AND get(kids, 0).at.line = at.line + 1 AND get(kids, 0).at.column <> ind + 1 + {IndentationWidth}", "=concat('Use ', {IndentationWidth}, ' spaces for indentation in method args, relative to the start of the line where the left parenthesis is.')", "get(kids, 0).at", edits=moved("(ind + 1 + {IndentationWidth})"), options={"IndentationWidth": "2"}),
    R("Layout/ClosingParenthesisIndentation", "call super", f"open = '(' AND blk IS NULL AND argc > 0 AND sel.line = at.line AND a0.at.line > at.line AND {ENDS.format(mark='[)]')} AND at.last_column <> ind + 1", "=concat('Indent `)` to column ', ind, ' (not ', at.last_column - 1, ')')", tail("at.end - 1", "at.end"), edits=moved("(ind + 1)")),
    R("Layout/ClosingParenthesisIndentation", "parameters", f"open = '(' AND p.kind = 'def' AND size(kids) > 0 AND get(kids, 0).at.line > at.line AND {ENDS.format(mark='[)]')} AND at.last_column <> ind + 1", "=concat('Indent `)` to column ', ind, ' (not ', at.last_column - 1, ')')", tail("at.end - 1", "at.end"), edits=moved("(ind + 1)")),
    R(
        "Layout/BlockAlignment", "call super", f"lead AND role <> 'recv' AND blk.kind = 'block' AND blk.at.line = at.line AND blk.at.last_line > at.line AND blk.at.end = at.end AND {ENDS.format(mark='(end|[}])')} AND at.last_column <> at.column + if(blk.open = 'do', 2, 0)",
        "=concat('`', if(blk.open = 'do', 'end', '}'), '` at ', at.last_line, ', ', at.last_column - if(blk.open = 'do', 3, 1), ' is not aligned with `', rtrim(regexp_extract(src, '^[^\\n]*', 0)), '` at ', at.line, ', ', at.column - 1, '.')", tail("at.end - if(blk.open = 'do', 3, 1)", "at.end"), edits=moved("at.column"),
    ),
)
