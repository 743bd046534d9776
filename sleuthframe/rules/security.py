"""Rules of the Security department. Names and messages are fixed values."""

from sleuthframe.rules.engine import NodeRule as R
from sleuthframe.rules.lint import root

RULES = (
    R("Security/CompoundHash", "call", "name IN ('^', '+', '*', '|') AND argc > 0 AND scope.kind = 'def' AND scope.name = 'hash' AND NOT exists(up, u -> u.kind = 'call' AND u.name IN ('^', '+', '*', '|'))", "Use `[...].hash` instead of combining hash values manually."),
    R("Security/CompoundHash", "call", "name = 'hash' AND scope.kind = 'def' AND scope.name = 'hash' AND recv.kind = 'array' AND recv.n = 1", "Delegate hash directly without wrapping in an array when only using a single value."),
    R("Security/CompoundHash", "call", "name = 'hash' AND exists(up, u -> u.kind = 'array') AND exists(up, u -> u.kind = 'call' AND u.name = 'hash')", "Calling .hash on elements of a hashed array is redundant."),
    R("Security/Eval", "call", "name = 'eval' AND (recv IS NULL OR recv.src IN ('Kernel', '::Kernel', 'binding') OR recv.name = 'binding') AND argc > 0 AND NOT (a0.kind = 'string') AND NOT (recv.name = 'binding' AND argc > 1)", "The use of `eval` is a serious security risk.", "sel"),
    R("Security/IoMethods", "call", "recv.src IN ('IO', '::IO') AND name IN ('read', 'binread', 'write', 'binwrite', 'foreach', 'readlines') AND argc > 0 AND NOT (a0.kind = 'string' AND ltrim(a0.name) like '|%')", "=concat('`File.', name, '` is safer than `IO.', name, '`.')", "named_struct('start', recv.at.start, 'end', at.end, 'line', recv.at.line, 'column', recv.at.column, 'last_line', at.last_line, 'last_column', at.last_column)"),
    R("Security/JSONLoad", "call", f"{root('recv', 'JSON')} AND name IN ('load', 'restore') AND argc > 0 AND NOT exists(kids2, k -> k.kind = 'assoc' AND k.name = 'create_additions')", "=concat('Prefer `JSON.parse` over `JSON.', name, '`.')", "sel"),
    R("Security/MarshalLoad", "call", f"{root('recv', 'Marshal')} AND name IN ('load', 'restore') AND argc > 0 AND NOT (a0.name = 'dump' AND a0.kind = 'call' AND a0.src like '%Marshal.dump%')", "=concat('Avoid using `Marshal.', name, '`.')", "sel"),
    R("Security/Open", "call", "name = 'open' AND argc > 0 AND (recv IS NULL OR recv.src IN ('Kernel', '::Kernel', 'URI', '::URI')) AND NOT (a0.kind = 'string' AND a0.name <> '' AND NOT a0.name like '|%') AND NOT (a0.kind = 'interpolated_string' AND a0.src rlike '^\"[^#|]')", "=concat('The use of `', if(recv IS NULL, 'Kernel#', concat(recv.src, '.')), 'open` is a serious security risk.')", "sel"),
    R("Security/YAMLLoad", "call", f"{root('recv', 'YAML', 'Psych')} AND name = 'load' AND argc > 0", "=concat('Prefer using `YAML.safe_load` over `YAML.load`.')", "sel"),
)
