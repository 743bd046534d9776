"""Syntax trees of source files as a table: one pass over the files, one row per
node, comment, line and parse error.

A row holds what predicates ask for, so that rules need no joins: the node's
kids and theirs (`kids`, `kids2`, whose `of` is the index of the parent among
`kids`), and what it stands in (`up`, nearest first). Spans are offsets in code
points from 0 and lines and columns from 1, the last ones inclusive. `src` is the
text of nodes up to SOURCE characters, of kids `k0`
that of their own first kid and `a0` the name of their first argument; rules that compare texts pass longer ones by.

Rows of kind `line` have the line as it is in `src`, with the insides of literals
and comments masked in `name`, its number of lines in `depth`, its carriage
return in `op`, `final` in `open` if the file ends with a newline, and the lines
before and after as `kids`. `i_recv` and the like say which of
the kids has a role first, `n_arg` and `n_body` how many there are, one after
another, and `i_scope` which of `up` is the nearest definition or program. `reads`
are the local variables read within a block, lambda or method, and `super` where
it calls that. `prev` and `next` are the lines
before a row's first and after its last line, `rest` what follows it on that line,
`ind` the indentation of its first line, `lead` whether it begins that line, `close`
whether its closing word or bracket begins the last one; `top` and `bot` count the
blank lines after its heading, which ends on line `hdr`, and before its closing
line, `top_at` to `top_to` and `bot_at` to `bot_to` the offsets of these; `nl` is the
length of the file's line ends; `code` and `full` its lines between that aren't blank, without and with those
of comments alone (of a call: its block's). `dirs` are the file's comments that suppress rules, as far as they can matter there;
`told` is what the caller carries along, on the row of kind `file`, and `skip`, on
all rows, the rules that pass the file by.

A file that can't be parsed gives its lines, without `name`, and one row of kind
`error`, and no nodes or comments. A null content counts as empty; a null path stays null.
Repeated paths give repeated rows; no files give no rows. Only path and content
are read, so other columns may have any names.

A caller that says what it will look at (see Asked) gets only such rows, and null in
columns that it doesn't read; ids count all rows. Equal contents that come together
are parsed once and share their rows, until these are dealt out to their paths.
Files of shapes that come together often are made into rows by columns (see Tables).
"""

from __future__ import annotations

import collections
import functools
import gc
import itertools
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.parser.ruby import KEPT, MOST_SHAPES, SHAPES, TRIED, UNFIT, WORD, Node, ParseError, Parser, Shape, keyed, parse, same

SOURCE = 1000
#: The text of a kid's first kid is told up to so many characters.
NEAR = 200
MASK = "\x01"
#: Kinds with a heading and a closing word.
HEADED = frozenset("class module singleton_class def block lambda begin if unless while until for case case_match".split())
COMMENT = re.compile(r"# rubocop:\s*(disable|todo|enable)(.*)$", re.M)
#: Rows that go to Spark at once.
ROWS = 4000
#: Paths that the rows of one file carry at once, together.
COPIES = 100_000

SPAN_SQL = "struct<start:int,end:int,line:int,column:int,last_line:int,last_column:int>"
KID_SQL = f"struct<role:string,kind:string,name:string,form:string,op:string,open:string,src:string,k0:string,a0:string,n:int,of:int,lead:boolean,at:{SPAN_SQL},sel:{SPAN_SQL}>"
#: Where a row's kids of each role are: the index of the first, and how many.
INDEX = ["recv", "block", "cond", "value", "else", "params", "operator", "arg", "body", "scope"]
INDEX_SQL = ", ".join([*(f"i_{n} int" for n in INDEX), "n_arg int", "n_body int"])
SCHEMA_SQL = f"paths array<string>, id int, parent int, ord int, depth int, role string, kind string, name string, form string, op string, open string, src string, at {SPAN_SQL}, sel {SPAN_SQL}, kids array<{KID_SQL}>, kids2 array<{KID_SQL}>, up array<struct<kind:string,name:string,role:string,form:string,cond:string>>, reads array<string>, prev string, next string, rest string, ind int, lead boolean, close boolean, hdr int, top int, bot int, code int, full int, top_at int, top_to int, bot_at int, bot_to int, nl int, {INDEX_SQL}, dirs array<struct<line:int,disabled:boolean,own:boolean,names:array<string>>>, told array<struct<rule:string,severity:string,message:string>>, skip array<string>"

SPAN = pa.struct([(n, pa.int32()) for n in ("start", "end", "line", "column", "last_line", "last_column")])
_STRINGS = [(n, pa.string()) for n in ("role", "kind", "name", "form", "op", "open", "src")]
KID = pa.struct([*_STRINGS, ("k0", pa.string()), ("a0", pa.string()), ("n", pa.int32()), ("of", pa.int32()), ("lead", pa.bool_()), ("at", SPAN), ("sel", SPAN)])
UP = pa.struct([(n, pa.string()) for n in ("kind", "name", "role", "form", "cond")])
DIRECTIVE = pa.struct([("line", pa.int32()), ("disabled", pa.bool_()), ("own", pa.bool_()), ("names", pa.list_(pa.string()))])
TOLD = pa.struct([(n, pa.string()) for n in ("rule", "severity", "message")])
SCHEMA = pa.schema([("paths", pa.list_(pa.string())), *[(n, pa.int32()) for n in ("id", "parent", "ord", "depth")], *_STRINGS, ("at", SPAN), ("sel", SPAN), ("kids", pa.list_(KID)), ("kids2", pa.list_(KID)), ("up", pa.list_(UP)), ("reads", pa.list_(pa.string())), *[(n, pa.string()) for n in ("prev", "next", "rest")], ("ind", pa.int32()), ("lead", pa.bool_()), ("close", pa.bool_()), *[(n, pa.int32()) for n in ("hdr", "top", "bot", "code", "full", "top_at", "top_to", "bot_at", "bot_to", "nl", *(f"i_{n}" for n in INDEX), "n_arg", "n_body")], ("dirs", pa.list_(DIRECTIVE)), ("told", pa.list_(TOLD)), ("skip", pa.list_(pa.string()))])


class Places:
    """Lines and columns of a text's offsets."""

    def __init__(self, text: str):
        self.text, self.starts = text, [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def of(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def span(self, start: int, end: int) -> tuple:
        """(start, end, line, column, last line, last column)."""
        line = bisect_right(self.starts, start)
        begin = self.starts[line - 1]
        if start < end and (line == len(self.starts) or end < self.starts[line]):
            return start, end, line, start - begin + 1, line, end - begin
        column = start - begin + 1
        if end <= start:
            last = (line, column if self.text else 0)
            if start == end == len(self.text) and self.text.endswith("\n"):
                last = (line, 0)
        else:
            last = (self.of(end - 1)[0] + 1, 1) if self.text[end - 1] == "\n" else self.of(end - 1)
        return start, end, line, column, *last


def masked(text: str, literal: list[tuple[int, int]], comments: list[Node]) -> str:
    """The text with the insides of literals replaced by MASK, comments blanked and line ends kept."""
    out = list(text)
    for ranges, mark in ((literal, MASK), ([(c.start, c.end) for c in comments], " ")):
        for a, b in ranges:
            for k in range(a, min(b, len(out))):
                if out[k] not in "\r\n":
                    out[k] = mark
    return "".join(out)


def directive(line: int, comment: str, own: bool) -> dict | None:
    """What a comment says about rules, if it does."""
    told = _directive(comment)
    return {"line": line, "disabled": told[0], "own": own, "names": list(told[1])} if told else None


@functools.lru_cache(4096)
def _directive(comment: str) -> tuple[bool, tuple[str, ...]] | None:
    m = COMMENT.search(comment)
    return (m[1] != "enable", tuple("all" if n.lower() == "all" else n for n in re.split(r"[,\s]+", m[2].split("--")[0]) if n)) if m else None


def names_read(tree: Node) -> dict[Node, set[str]]:
    """The local variables that are read within each block, lambda and method, and
    `super` where it calls that."""
    out: dict[Node, set[str]] = {}
    todo: list[tuple[Node, tuple[Node, ...]]] = [(tree, ())]
    while todo:
        node, inside = todo.pop()
        name = node.name if node.kind == "local_variable_read" or node.kind.startswith("local_variable_") and node.kind not in ("local_variable_write", "local_variable_target") else None
        name = node.name if node.form == "shorthand" else "super" if node.kind in ("super", "forwarding_super") else name
        if name:
            for n in inside:
                out[n].add(name)
        if node.kind in ("block", "lambda", "def"):
            inside = (node,) if node.kind == "def" else (*inside, node)
            out[node] = set()
        todo += [(k, inside) for _, k in node.kids]
    return out


#: Fields of a node as a kid, but for its role and the index of its parent.
Info = tuple


class Near:
    """Of a file's directives, those that can matter for some lines: those on them
    or beside them, and before them the last ones on lines of their own that name
    something. So a row carries few, however many the file has."""

    #: Lines beside a node in which its rules may report.
    BESIDE = 2

    def __init__(self, dirs: list[dict]):
        self.dirs, self.lines = dirs, [d["line"] for d in dirs]
        self.known: dict[tuple[int, int], list[dict]] = {}
        self.last: list[tuple[dict, ...]] = [()]
        held: dict[str, int] = {}
        for i, d in enumerate(dirs):
            if d["own"]:
                held.update((n, i) for n in d["names"])
            self.last.append(tuple(dirs[k] for k in sorted(set(held.values()))) if len(dirs) > self.FEW else ())

    #: So many are carried as they are.
    FEW = 8

    def of(self, first: int, last: int) -> list[dict]:
        if len(self.dirs) <= self.FEW:
            return self.dirs
        at = bisect_left(self.lines, first - self.BESIDE), bisect_right(self.lines, last + self.BESIDE)
        if at not in self.known:
            self.known[at] = [*self.last[at[0]], *self.dirs[at[0] : at[1]]]
        return self.known[at]


class Rows:
    """Rows of the table, held by column until they are enough for a batch."""

    def __init__(self, columns: frozenset[str] | None = None) -> None:
        self.columns = columns
        #: The paths of each file; rows name files by their number.
        self.files: list[list[str | None]] = []
        self.plain: list[tuple] = []
        self.at: list[tuple] = []
        self.sel: list[tuple | None] = []
        self.lists: dict[str, tuple[list[int], list[tuple]]] = {n: ([0], []) for n in ("kids", "kids2", "up")}

    def __len__(self) -> int:
        return len(self.plain)

    def add(self, plain: tuple, at: tuple, sel: tuple | None = None, kids: list | tuple = (), kids2: list | tuple = (), up: tuple = ()) -> None:
        """plain: the other columns in the order of PLAIN."""
        self.plain.append(plain)
        self.at.append(at)
        self.sel.append(sel)
        for name, some in (("kids", kids), ("kids2", kids2), ("up", up)):
            offsets, flat = self.lists[name]
            flat.extend(some)
            offsets.append(len(flat))

    @staticmethod
    def spans(found: list[tuple | None]) -> pa.StructArray:
        none = np.array([f is None for f in found], bool)
        values = np.array([f or (0, 0, 0, 0, 0, 0) for f in found], np.int32).reshape(-1, 6)
        return pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(6)], fields=list(SPAN), mask=pa.array(none))

    def kids(self, name: str) -> pa.ListArray:
        offsets, flat = self.lists[name]
        if name == "up":
            columns = [pa.array([f[k] for f in flat], pa.string()) for k in range(len(UP))]
            items = pa.StructArray.from_arrays(columns, fields=list(UP))
        else:
            # (role, info, of)
            info = [f[1] for f in flat]
            columns = [pa.array([f[0] for f in flat], pa.string()), *(pa.array([i[k] for i in info], pa.string()) for k in (*range(6), 10, 11)), pa.array([i[6] for i in info], pa.int32()), pa.array([f[2] for f in flat], pa.int32()), pa.array([i[7] for i in info], pa.bool_())]
            items = pa.StructArray.from_arrays([*columns, self.spans([i[8] for i in info]), self.spans([i[9] for i in info])], fields=list(KID))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    def batch(self) -> pa.RecordBatch:
        columns = dict(zip(PLAIN, zip(*self.plain, strict=True), strict=True))
        made = {"paths": lambda: pa.array(self.files, SCHEMA.field("paths").type).take(pa.array(columns["paths"], pa.int32())), "at": lambda: self.spans(self.at), "sel": lambda: self.spans(self.sel), **{n: functools.partial(self.kids, n) for n in self.lists}}
        return pa.record_batch([pa.nulls(len(self), f.type) if self.columns is not None and f.name not in self.columns | {"paths"} else made[f.name]() if f.name in made else pa.array(columns[f.name], f.type) for f in SCHEMA], schema=SCHEMA)


NOWHERE = (*[None] * len(INDEX), 0, 0)
#: Roles that count as another one's in INDEX.
AS = {"then": "operator", "do": "operator"}
SCOPES = frozenset(["def", "class", "module", "singleton_class", "program"])


PLACE = {**{n: k for k, n in enumerate(INDEX[:-1])}, **{a: INDEX.index(n) for a, n in AS.items()}}


def indexed(node: Node, up: tuple, scoped: bool = True) -> tuple:
    """Values of the columns of INDEX, and how many arguments and statements there are."""
    if not node.kids and not scoped:
        return NOWHERE
    found: list = [*NOWHERE]
    for i, (role, _) in enumerate(node.kids):
        k = PLACE.get(role)
        if k is not None and found[k] is None:
            found[k] = i
        if role == "arg":
            found[-2] += 1
        elif role == "body":
            found[-1] += 1
    if scoped:
        found[-3] = next((i for i, u in enumerate(up) if u[0] in SCOPES), None)
    return tuple(found)


PLAIN = [f.name for f in SCHEMA if f.name not in ("at", "sel", "kids", "kids2", "up")]


@dataclass(frozen=True)
class Asked:
    """What will be looked at: kinds of rows (rows of kind `file` only if they carry
    something), of some kinds those with certain names or forms only, and columns; None: all."""

    kinds: frozenset[str] | None = None
    names: tuple[tuple[str, tuple[frozenset[str], frozenset[str]]], ...] = ()
    columns: frozenset[str] | None = None

    def reads(self, *columns: str) -> bool:
        return self.columns is None or not self.columns.isdisjoint(columns)


#: Columns that all readers have.
ALWAYS = frozenset(["path", "paths", "id", "parent", "ord", "depth", "role", "kind", "name", "at", "dirs", "told", "skip"])


def fill(rows: Rows, paths: list[str | None], text: str | None, told: list[dict] | None = None, skip: list[str] | None = None, asked: Asked = Asked()) -> None:
    """Add the rows of a file that these paths share."""
    rows.files.append(paths)
    file = len(rows.files) - 1
    kinds, named = asked.kinds, dict(asked.names)
    has_kids, has_kids2, has_up, has_around = asked.reads("kids"), asked.reads("kids2"), asked.reads("up", "i_scope"), asked.reads("code", "full", "top_at", "top_to", "bot_at", "bot_to", "hdr", "top", "bot", "close")
    has_scope, has_rest = asked.reads("i_scope"), asked.reads("rest")
    has_reads, has_index, has_src = asked.reads("reads"), asked.reads("n_arg", "n_body", *(f"i_{n}" for n in INDEX)), asked.reads("src")
    text = text or ""
    places = Places(text)
    starts, of, span = places.starts, places.of, places.span
    count, dirs = 0, []
    whole = [line.removesuffix("\r") for line in text.split("\n")]
    n_lines = len(whole) - (whole[-1] == "")
    line_end = 2 if "\r\n" in text else 1
    indents = [len(w) - len(w.lstrip(" \t")) for w in whole]

    def put(at: tuple, sel: tuple | None = None, kids=(), kids2=(), up=(), *, parent=None, ord=None, depth=None, role="", kind, name=None, form=None, op=None, open=None, src=None, reads=None, rest=None, close=None, hdr=None, top=None, bot=None, code_lines=None, full=None, blank=(None,) * 4, told=(), index=NOWHERE) -> int:
        nonlocal count
        first, last = at[2], at[4]
        ind = indents[first - 1]
        rows.add((file, count, parent, ord, depth, role, kind, name, form, op, open, src, reads, whole[first - 2][:SOURCE] if first > 1 else None, whole[last][:SOURCE] if last < n_lines else None, rest, ind, at[3] - 1 <= ind, close, hdr, top, bot, code_lines, full, *blank, line_end, *index, near.of(first, last), told, skip), at, sel, kids, kids2, up)
        count += 1
        return count - 1

    tree, failure = None, None
    try:
        tree, parser = parse(text)
    except ParseError as e:
        failure = e
    literal, comments = (parser.literal, parser.comments) if tree else ([], [])
    if "# rubocop:" in text:
        if tree:
            seen = [(of(c.start)[0], c.name, not text[starts[of(c.start)[0] - 1] : c.start].strip()) for c in comments]
        else:
            seen = [(k, line[line.index("# rubocop:") :], not line.split("# rubocop:")[0].strip()) for k, line in enumerate(whole, 1) if "# rubocop:" in line]
        dirs += [d for d in (directive(*c) for c in sorted(seen)) if d]
    if tree and kinds is not None and len(text) <= SMALL:
        shaped = file_keyed(text)
        if shaped and len(dirs) <= Near.FEW:
            learned(*shaped, tree, parser, dirs)
    near = Near(dirs)
    if kinds is None or told:
        put(span(0, min(1, len(text))), kind="file", told=told or ())
    else:
        count += 1
    if failure and (kinds is None or "error" in kinds):
        at = min(failure.at, len(text))
        put(span(at, min(at + 1, len(text))), kind="error", name=failure.message)
    lines_asked = kinds is None or "line" in kinds
    code = masked(text, literal, comments) if tree and lines_asked else ""
    heredocs: list[tuple[int, int]] = []
    infos: dict[Node, Info] = {}

    def info(node: Node) -> Info:
        found = infos.get(node)
        if found is None:
            at = span(node.start, node.end)
            lead = at[3] - 1 <= indents[at[2] - 1]
            first = node.kids[0][1] if node.kids else None
            begins = text[first.start : first.end] if first is not None and first.end - first.start <= NEAR else None
            argument = node.kid("arg") if node.kids and node.kind == "call" else None
            argument = argument.name if argument is not None else None
            found = infos[node] = (node.kind, node.name, node.form, node.op, node.open, text[node.start : node.end] if node.end - node.start <= SOURCE else None, len(node.kids), lead, at, span(*node.sel) if node.sel else None, begins, argument)
        return found

    def around(node: Node) -> dict:
        """Blank lines within a node that has a heading and a closing word."""
        heads = [k.end for r, k in node.kids if r in ("params", "superclass", "path", "cond", "value", "recv")]
        if node.kind == "begin":
            heads = []
        head = of(max([node.sel[1] if node.sel else node.start, *heads]) - 1)[0]
        last, column = of(node.end - 1)
        top = bot = 0
        while head + top < last - 1 and not whole[head + top].strip():
            top += 1
        while last - 2 - bot > head - 1 and not whole[last - 2 - bot].strip():
            bot += 1
        word = 1 if text[node.end - 1] == "}" else 3
        inside = [w.strip() for w in whole[head : last - 1]]
        edge = (starts[head], starts[head + top], starts[last - 1 - bot], starts[last - 1]) if head < last else (None,) * 4
        return {"code_lines": sum(bool(w) and w[0] != "#" for w in inside), "full": sum(map(bool, inside)), "blank": edge, "hdr": head, "top": top, "bot": bot if head + top < last - 1 else 0, "close": not whole[last - 1][: column - word].strip()}

    if tree:
        reads = names_read(tree) if has_reads else {}
        todo: list[tuple[Node, str, int | None, int, tuple, int]] = [(tree, "", None, 0, (), 0)]
        while todo:
            node, role, parent, order, up, depth = todo.pop()
            if node.form == "heredoc" and node.sel:
                heredocs.append(node.sel)
            kind, name = node.kind, node.name
            if kinds is not None and (kind not in kinds or kind in named and name not in named[kind][0] and node.form not in named[kind][1]):
                count += 1
                if node.kids:
                    told_by = (node.kid("cond") or node.kid("superclass")) if has_up else None
                    above = ((kind, name, role, node.form, text[told_by.start : told_by.end][:SOURCE] if told_by else None), *up) if has_up else ()
                    me = count - 1
                    todo += [(k, r, me, i, above, depth + 1) for i, (r, k) in reversed(list(enumerate(node.kids)))]
                continue
            if has_kids:
                kind, name, form, op, open_, src, _, _, at, sel, _, _ = info(node)
            else:
                form, op, open_, at, sel = node.form, node.op, node.open, span(node.start, node.end), span(*node.sel) if node.sel else None
                src = text[node.start : node.end] if has_src and node.end - node.start <= SOURCE else None
            kids = [(r, info(k), None) for r, k in node.kids] if has_kids else ()
            deeper = [(r, info(g), i) for i, (_, k) in enumerate(node.kids) for r, g in k.kids] if has_kids2 else ()
            geometry = around(node) if has_around and kind in HEADED else {}
            block = node.kid("block") if has_around and kind == "call" else None
            if block is not None and block.kind == "block":
                geometry = {k: v for k, v in around(block).items() if k in ("code_lines", "full")}
            if node in reads:
                geometry["reads"] = sorted(reads[node])
            line, column = of(node.end) if has_rest else (1, 1)
            me = put(at, sel, kids, deeper, up, parent=parent, ord=order, depth=depth, role=role, kind=kind, name=name, form=form, op=op, open=open_, src=src, rest=whole[line - 1][column - 1 : column - 1 + SOURCE] if has_rest else None, index=indexed(node, up, has_scope) if has_index else NOWHERE, **geometry)
            if not node.kids:
                continue
            told_by = node.kid("cond") or node.kid("superclass")
            above = ((kind, name, role, form, text[told_by.start : told_by.end][:SOURCE] if told_by else None), *up) if has_up else ()
            todo += [(k, r, me, i, above, depth + 1) for i, (r, k) in reversed(list(enumerate(node.kids)))]
        for c in comments if kinds is None or "comment" in kinds else ():
            put(span(c.start, c.end), kind="comment", name=c.name, form=c.form, src=c.name, open="own" if not text[starts[of(c.start)[0] - 1] : c.start].strip() else "trailing")
        for at, form in parser.semicolons if kinds is None or "semicolon" in kinds else ():
            put(span(at, at + 1), kind="semicolon", name=";", form=form, src=";")
    for k in range(n_lines) if lines_asked else ():
        start = starts[k]
        end = start + len(whole[k])
        form = "heredoc" if any(a <= start < b for a, b in heredocs) else "data" if tree and parser.data is not None and start >= parser.data else None
        cr = text.startswith("\r", end)
        put((start, end, k + 1, 1, k + 1, max(1, end - start)), kind="line", ord=k + 1, depth=n_lines, name=code[start:end] if tree else None, form=form, src=whole[k], op="\r" if cr else None, open="final" if text.endswith("\n") else None)


#: Files of a shape come that often in a batch at least to be made into rows by columns, as do
#: lines, but for one in so many.
OFTEN = 16
#: So many of a batch's files are read before the others are looked at again.
AT_FIRST = (32, 512)
#: Whole files have shapes up to so many characters.
SMALL = 200
#: Columns that rows made by columns may have.
BY_COLUMNS = ALWAYS | {"form", "op", "open", "src", "sel", "kids", "kids2", "up", "n_arg", "n_body", *(f"i_{n}" for n in INDEX)}
#: Texts whose lines don't stand for themselves, and files that have no shape of their own.
JOINED, UNSHAPED = re.compile(r"\r|__END__|^=begin", re.M), re.compile(r"[^\x20-\x7e\n]|[%/\\`]|<<|\$-|^=|__END__", re.M)
#: What no line may have to be known by its shape, as UNFIT says of one.
UNFIT_LINES = re.compile(r"[^\x20-\x7e\n]|[%/\\`#]|<<|\?\w|\$-|^ *=", re.M)
#: What a hash sign may stand behind without beginning a comment.
QUOTED = re.compile(r"['\"]|[?$:]$")
#: What words with digits don't vary in: comments, characters and special variables.
HELD, COMMENTS = re.compile(r"#[^\n]*|[?$]\w+"), re.compile(r"#[^\n]*")
#: Shapes of whole files, by their parts; a number: so often seen only; None: the file must be parsed.
FILES: dict[tuple, Shape | int | None] = {}


def file_keyed(text: str) -> tuple[tuple, list[int], list[str]] | None:
    """A small file's parts, as keyed() tells a line's, of which only words with digits
    may be others; None: it has no shape or no such words."""
    if len(text) > SMALL or UNSHAPED.search(COMMENTS.sub("", text)) or "#" in text and ("'" in text or '"' in text):
        return None
    held = [m.span() for m in HELD.finditer(text)] if "#" in text or "?" in text or "$" in text else []
    words: dict[str, int] = {}
    parts, cumulated, size, at = [], [0], 0, 0
    for m in WORD.finditer(text):
        w, begin = m[0], m.start()
        if not w.isalpha() and any(c.isdigit() for c in w) and not any(a <= begin < b for a, b in held):
            parts += [text[at:begin], (words.setdefault(w, len(words)), w[0] >= "a", w[0] <= "9")]
            size += len(w)
            cumulated.append(size)
            at = m.end()
    return ((*parts, text[at:]), cumulated, list(words)) if words else None


def learned(key: tuple, cumulated: list[int], words: list[str], tree: Node, parser: Parser, dirs: list[dict]) -> None:
    """Compare what a whole file's shape gives with what was read."""
    known = FILES.get(key, 0)
    if known is None:
        return
    if len(FILES) >= MOST_SHAPES:
        FILES.clear()
    if known == 0:
        FILES[key] = 1
        return
    FILES[key] = None
    shape = Shape.of(key, whole=True) if known == 1 else known
    literal: list[tuple[int, int]] = []
    if shape and same(shape.node(0, cumulated, words, literal), tree) and literal == parser.literal and shape.dirs in ([], dirs):
        shape.dirs = dirs
        shape.known += 1
        FILES[key] = shape


class Template:
    """How the rows of a shape follow from where it stands and what its words are.
    Places in it are told as characters outside of words and how many words come
    before; texts as None, a text, the number of a word or a tuple of both."""

    def __init__(self, shape: Shape, whole: bool, asked: Asked) -> None:
        self.shape, self.whole, self.asked = shape, whole, asked
        self.fixed = "".join(p for p in shape.key if p.__class__ is str)
        self.placed: list[tuple[int, int]] = []
        at = 0
        for p in shape.key:
            if p.__class__ is str:
                at += len(p)
            else:
                self.placed.append((at, p[0]))
        #: Where its lines begin.
        self.begins = [(0, 0), *((m.end(), sum(c < m.end() for c, _ in self.placed)) for m in re.finditer("\n", self.fixed))] if whole else [(0, 0)]
        self.rows: list[tuple] = []
        self.count = 0
        self.usable = self._plan()

    def line_of(self, place: tuple[int, int]) -> int:
        return sum(a <= place[0] and i <= place[1] for a, i in self.begins) - 1

    def text(self, begin: tuple[int, int], end: tuple[int, int]):
        """The text between two places."""
        out, at = [], begin[0]
        for c, w in self.placed[begin[1] : end[1]]:
            out += [self.fixed[at:c], w]
            at = c
        out = [p for p in (*out, self.fixed[at : end[0]]) if p != ""]
        return tuple(out) if len(out) > 1 else out[0] if out else ""

    def span(self, begin: tuple[int, int], end: tuple[int, int]) -> tuple | None:
        """Begin, end and the lines of the first and the last character; None for
        what is empty or ends with a line."""
        if begin == end or end in self.begins:
            return None
        return begin, end, self.line_of(begin), self.line_of(end)

    def _plan(self) -> bool:
        named, kinds = dict(self.asked.names), self.asked.kinds
        reads = self.asked.reads
        has_up, has_index = reads("up", "i_scope"), reads("n_arg", "n_body", *(f"i_{n}" for n in INDEX))
        spans, nodes = [], self.shape.nodes
        for kind, a, i, b, j, name, kids, sel, op, open_, form in nodes:
            whole_file = kind == "program"
            at = self.span((a, i), (b, j))
            chosen = self.span(sel[:2], sel[2:]) if sel else None
            if sel and chosen is None or at is None and not whole_file:
                return False
            spans.append((at, chosen))

        def info(n: int) -> tuple:
            kind, a, i, b, j, name, kids, _, op, open_, form = nodes[n]
            first = nodes[kids[0][1]] if kids else None
            begins = self.text(first[1:3], first[3:5]) if first else None
            argument = next((nodes[k][5] for r, k in kids if r == "arg"), None) if kind == "call" else None
            ls = self.begins[self.line_of((a, i))]
            indented = (a, i) == ls or i == ls[1] and self.whole and not self.fixed[ls[0] : a].strip(" \t")
            return kind, name, form, op, open_, self.text((a, i), (b, j)), begins, argument, len(kids), indented, *spans[n]

        def told_of(kids: list) -> tuple | None:
            k = next((k for r, k in kids if r == "cond"), next((k for r, k in kids if r == "superclass"), None))
            return self.text(nodes[k][1:3], nodes[k][3:5]) if k is not None else None

        top = () if self.whole else (("program", None, "", None, None),)
        todo: list[tuple] = [(len(nodes) - 1, "" if self.whole else "body", None, 0, top, 0 if self.whole else 1)]
        while todo:
            n, role, parent, order, up, depth = todo.pop()
            kind, a, i, b, j, name, kids, sel, op, open_, form = nodes[n]
            me, self.count = self.count, self.count + 1
            above = ((kind, name, role, form, told_of(kids)), *up)
            todo += [(k, r, me, o, above, depth + 1) for o, (r, k) in reversed(list(enumerate(kids)))]
            if kind not in kinds:
                continue
            only = None
            if kind in named and form not in named[kind][1]:
                if form.__class__ not in (str, type(None)):
                    return False
                if name.__class__ in (str, type(None)):
                    if name not in named[kind][0]:
                        continue
                else:
                    only = named[kind][0]
            plain = Node(kind, 0, 0, kids=[(r, None) for r, _ in kids])
            infos = [(r, info(k), None) for r, k in kids]
            deeper = [(r, info(g), o) for o, (_, k) in enumerate(kids) for r, g in nodes[k][6]]
            self.rows.append((me, parent, order, depth, role, (kind, name, form, op, open_, self.text((a, i), (b, j))), *spans[n], infos, deeper, up if has_up else (), indexed(plain, up, reads("i_scope")) if has_index else NOWHERE, only))
        return True


def empty(kind: pa.DataType, n: int) -> pa.ListArray:
    """So many empty lists."""
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind))


class Standing:
    """Where a template's shape stands in a batch: of each time the number of its file,
    its offset, line and indentation, its place in the program, the id of its first
    row, how long its words are together, up to each, the different ones, and the
    directives that can matter there."""

    def __init__(self, template: Template, found: list[tuple]) -> None:
        self.template, self.n = template, len(found)
        numbers = np.array([f[:6] for f in found], np.int32)
        self.file, self.base, self.line, self.indent, self.order, self.first = (numbers[:, k] for k in range(6))
        self.sizes = np.array([f[6] for f in found], np.int32)
        self.words = [f[7] for f in found]
        self.dirs = [f[8] for f in found]
        self.known: dict = {}
        self.tiles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def texts(self, told) -> pa.Array:
        out = self.known.get(told)
        if out is None:
            if told is None:
                out = pa.nulls(self.n, pa.string())
            elif told.__class__ is str:
                out = pa.repeat(pa.scalar(told, pa.string()), self.n)
            elif told.__class__ is int:
                out = pa.array([w[told] for w in self.words], pa.string())
            else:
                out = pc.binary_join_element_wise(*(pa.scalar(p, pa.string()) if p.__class__ is str else self.texts(p) for p in told), "")
            self.known[told] = out
        return out

    def place(self, place: tuple[int, int]) -> np.ndarray:
        return self.base + (place[0] + self.sizes[:, place[1]])

    def span(self, told: tuple | None) -> list[np.ndarray]:
        if told is None:
            return [np.zeros(self.n, np.int32)] * 6
        begin, end, first, last = told
        start, stop = self.place(begin), self.place(end)
        lines = [self.place(self.template.begins[k]) - self.indent for k in (first, last)]
        return [start, stop, self.line + first, start - lines[0] + 1, self.line + last, stop - lines[1]]

    def woven(self, told: list) -> pa.Array:
        """Texts of several kids, those of one row together."""
        k = len(told)
        if k not in self.tiles:
            self.tiles[k] = np.tile(np.arange(k, dtype=np.int32), self.n), np.arange(k * self.n, dtype=np.int32).reshape(k, self.n).T.ravel()
        if all(t is None or t.__class__ is str for t in told):
            return pa.repeat(pa.scalar(told[0], pa.string()), k * self.n) if len(set(told)) == 1 else pa.array(told, pa.string()).take(pa.array(self.tiles[k][0]))
        return pa.concat_arrays([self.texts(t) for t in told]).take(pa.array(self.tiles[k][1])) if k > 1 else self.texts(told[0])

    def tiled(self, told: list, kind: pa.DataType) -> pa.Array:
        return pa.repeat(pa.scalar(told[0], kind), len(told) * self.n) if len(set(told)) == 1 else pa.array(told * self.n, kind)

    def spans(self, told: list[tuple | None]) -> pa.StructArray:
        columns = zip(*(self.span(t) for t in told), strict=True)
        mask = pa.array(np.tile(np.array([t is None for t in told], bool), self.n)) if None in told else None
        return pa.StructArray.from_arrays([pa.array(np.stack(c, axis=1).ravel() if len(c) > 1 else c[0], pa.int32()) for c in columns], fields=list(SPAN), mask=mask)

    def lists(self, items: pa.Array, k: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(self.n + 1, dtype=np.int32) * np.int32(k)), items)

    def kids(self, some: list[tuple]) -> pa.Array:
        if not some:
            return empty(KID, self.n)
        info = [s[1] for s in some]
        columns = [self.woven([s[0] for s in some]), *(self.woven([i[k] for i in info]) for k in range(8)), self.tiled([i[8] for i in info], pa.int32()), self.tiled([s[2] for s in some], pa.int32()), self.tiled([i[9] for i in info], pa.bool_()), self.spans([i[10] for i in info]), self.spans([i[11] for i in info])]
        return self.lists(pa.StructArray.from_arrays(columns, fields=list(KID)), len(some))

    def up(self, up: tuple) -> pa.Array:
        if not up:
            return empty(UP, self.n)
        return self.lists(pa.StructArray.from_arrays([self.woven([u[k] for u in up]) for k in range(len(UP))], fields=list(UP)), len(up))

    def batches(self, paths: pa.Array, skips: pa.Array) -> Iterator[pa.RecordBatch]:
        """A batch for each row of the template."""
        t = self.template
        file, columns = pa.array(self.file), t.asked.columns
        common = {"paths": paths.take(file), "skip": skips.take(file), "told": empty(TOLD, self.n), "dirs": pa.array(self.dirs, SCHEMA.field("dirs").type) if any(self.dirs) else empty(DIRECTIVE, self.n)}
        for me, parent, order, depth, role, texts, at, sel, kids, deeper, up, index, only in t.rows:
            held = dict(zip((*(f"i_{n}" for n in INDEX), "n_arg", "n_body"), index, strict=True))
            made = {
                "id": lambda: pa.array(self.first + me), "depth": lambda: pa.repeat(pa.scalar(depth, pa.int32()), self.n),
                "parent": lambda: pa.array(self.first + parent) if parent is not None else pa.nulls(self.n, pa.int32()) if t.whole else pa.repeat(pa.scalar(1, pa.int32()), self.n),
                "ord": lambda: pa.array(self.order) if parent is None else pa.repeat(pa.scalar(order, pa.int32()), self.n),
                "role": lambda: self.texts(role), **{n: functools.partial(self.texts, texts[k]) for k, n in enumerate(("kind", "name", "form", "op", "open", "src"))},
                "at": lambda: self.spans([at]), "sel": lambda: self.spans([sel]), "kids": lambda: self.kids(kids), "kids2": lambda: self.kids(deeper), "up": lambda: self.up(up),
            }
            out = pa.record_batch([pa.nulls(self.n, f.type) if f.name not in columns | {"paths"} else common[f.name] if f.name in common else pa.repeat(pa.scalar(held[f.name], f.type), self.n) if f.name in held else made[f.name]() for f in SCHEMA], schema=SCHEMA)
            yield out if only is None else out.filter(pc.is_in(self.texts(texts[1]), pa.array(sorted(only), pa.string())))


class Tables:
    """Rows of files whose lines all have known shapes, or that have one as a whole,
    made by columns: one shape's statements of a batch together. What is asked decides
    whether that goes; other files, and shapes that come seldom, are left."""

    def __init__(self, asked: Asked) -> None:
        self.asked = asked
        self.fits = asked.kinds is not None and asked.columns is not None and not asked.kinds & {"program", "line", "comment", "semicolon"} and not {f.name for f in SCHEMA} & asked.columns - BY_COLUMNS
        self.templates: dict[Shape, Template] = {}
        #: Those of lines, by what they have in common.
        self.lines: dict[tuple, Template] = {}

    def template(self, shape: Shape, whole: bool) -> Template:
        if shape not in self.templates:
            if len(self.templates) >= MOST_SHAPES:
                self.templates.clear()
                self.lines.clear()
            self.templates[shape] = Template(shape, whole, self.asked)
        return self.templates[shape]

    def of_lines(self, text: str, file: int) -> list[tuple[Template, tuple]] | None:
        """Each line's template and where it stands; None if a line has none."""
        if JOINED.search(text):
            return None
        out, dirs, base, first = [], [], 0, 2
        fits = len(text) > 0 and not UNFIT_LINES.search(text)
        for number, whole in enumerate(text.split("\n"), 1):
            line = whole.strip(" ")
            if "#" in line:
                at = whole.index("#")
                line = whole[:at].strip(" ")
                if QUOTED.search(whole[:at]):
                    return None
                told = directive(number, whole[at:], not line) if "# rubocop:" in whole else None
                if told:
                    dirs.append(told)
            if line:
                if len(line) > SMALL or not fits and UNFIT.search(line) or line[0] in ".&":
                    return None
                parts = WORD.split(line)
                words = parts[1::2]
                kept = None
                if not KEPT.isdisjoint(words):
                    kept = tuple([w if w in KEPT else None for w in words])
                    words = [w for w in words if w not in KEPT]
                # what keyed() tells, short: texts between, keywords, kinds of words, which are equal
                among = tuple(parts[::2]), kept, not words or min(words) >= "a" or tuple([(w[0] >= "a", w[0] <= "9") for w in words]), tuple(map(words.index, words))
                template = self.lines.get(among)
                if template is None:
                    shape = SHAPES.get(keyed(line)[0])
                    if not shape or shape.known < TRIED:
                        return None
                    template = self.template(shape, False)
                    if not template.usable:
                        return None
                    if len(self.lines) >= MOST_SHAPES:
                        self.lines.clear()
                    self.lines[among] = template
                cumulated = [0, *itertools.accumulate(map(len, words))]
                words = list(dict.fromkeys(words))
                indent = len(whole) - len(whole.lstrip(" "))
                out.append((template, (file, base + indent, number, indent, len(out), first, cumulated, words, ())))
                first += template.count
            base += len(whole) + 1
        if dirs:
            near = Near(dirs)
            out = [(template, (*where[:8], near.of(where[2], where[2]))) for template, where in out]
        return out

    def of_file(self, text: str, file: int) -> list[tuple[Template, tuple]] | None:
        found = file_keyed(text)
        shape = FILES.get(found[0]) if found else None
        if not isinstance(shape, Shape) or shape.known < TRIED:
            return None
        template = self.template(shape, True)
        return [(template, (file, 0, 1, 0, 0, 1, *found[1:], shape.dirs))] if template.usable else None

    def sorted_out(self, files: list[tuple]) -> tuple[list[tuple], Iterator[pa.RecordBatch]]:
        """Of files(text, told, skip, paths) those that are left, and the rows of the others."""
        if not self.fits:
            return files, iter(())
        left, found, often = [], [], collections.Counter()
        for file in files:
            some = None if file[1] or len(file[3]) > COPIES else self.of_lines(file[0], len(found)) or self.of_file(file[0], len(found))
            if some:
                found.append((file, some))
                often.update(t for t, _ in some)
            else:
                left.append(file)
        kept = []
        for k, (file, some) in enumerate(found):
            if sum(often[t] < OFTEN for t, _ in some) * OFTEN <= len(some):
                kept.append(k)
            else:
                left.append(file)
        return left, self.made(found, kept)

    def made(self, found: list[tuple], kept: list[int]) -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        by_template: dict[Template, list[tuple]] = {}
        for k in kept:
            for template, where in found[k][1]:
                by_template.setdefault(template, []).append(where)
        paths = pa.array([f[0][3] for f in found], SCHEMA.field("paths").type)
        skips = pa.array([list(f[0][2]) for f in found], SCHEMA.field("skip").type)
        held, n = [], 0
        for template, where in by_template.items():
            if not template.rows:
                continue
            for begin in range(0, len(where), ROWS):
                for batch in Standing(template, where[begin : begin + ROWS]).batches(paths, skips):
                    held.append(batch)
                    n += len(batch)
                    if n >= ROWS:
                        yield from pa.Table.from_batches(held, SCHEMA).combine_chunks().to_batches()
                        held, n = [], 0
        if n:
            yield from pa.Table.from_batches(held, SCHEMA).combine_chunks().to_batches()


def _dealt(made: pa.RecordBatch, paths: list[str | None]) -> Iterator[pa.RecordBatch]:
    """The rows of one file for so many of its paths at a time that they stay few."""
    some = max(1, COPIES // max(1, len(made)))
    for begin in range(0, len(paths), some):
        part = paths[begin : begin + some]
        yield made.set_column(0, SCHEMA.field("paths"), pa.array([part], SCHEMA.field("paths").type).take(pa.array(np.zeros(len(made), np.int32))))


def _lists(column: pa.ListArray) -> list:
    """The lists of a column; where all are empty, as most often, they aren't made one by one."""
    return column.to_pylist() if len(column.flatten()) else [()] * len(column)


def _nodes(batches: Iterable[pa.RecordBatch], asked: Asked = Asked()) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    # trees are many objects and no cycles, so young ones are looked through less often
    gc.set_threshold(100_000, 20, 20)
    tables = Tables(asked)
    for batch in batches:
        # files of equal content share their rows
        equal: dict[tuple, list[str | None]] = {}
        columns = (batch.column(n).to_pylist() for n in ("path", "content"))
        for path, text, told, skip in zip(*columns, _lists(batch.column("told")), _lists(batch.column("skip")), strict=True):
            equal.setdefault((text or "", tuple(tuple(t.values()) for t in told) if told else (), tuple(skip) if skip else ()), []).append(path)
        rows, left = Rows(asked.columns), [(text, told, skip, paths) for (text, told, skip), paths in equal.items()]
        # some are read first, so that the others' shapes are known
        for some in (*AT_FIRST, len(left)) if tables.fits else (len(left),):
            left, known = tables.sorted_out(left)
            yield from known
            for text, told, skip, paths in left[:some]:
                begin = len(rows)
                fill(rows, paths, text, [dict(zip(("rule", "severity", "message"), t, strict=True)) for t in told], list(skip), asked)
                if (len(rows) - begin) * len(paths) > COPIES:
                    made = rows.batch()
                    if begin:
                        yield made.slice(0, begin)
                    yield from _dealt(made.slice(begin), paths)
                    rows = Rows(asked.columns)
                elif len(rows) >= ROWS:
                    yield rows.batch()
                    rows = Rows(asked.columns)
            left = left[some:]
        if len(rows):
            yield rows.batch()


def shared_nodes(files: DataFrame, asked: Asked = Asked()) -> DataFrame:
    """As nodes(), but a row may stand for several files of equal content: it has their
    `paths`, and no path."""
    skip = "skip" if "skip" in files.columns else "cast(array() AS array<string>) AS skip"
    told = "told" if "told" in files.columns else "cast(array() AS array<struct<rule:string,severity:string,message:string>>) AS told"
    return files.selectExpr("path", "cast(content AS string) AS content", told, skip).mapInArrow(functools.partial(_nodes, asked=asked), SCHEMA_SQL)


def nodes(files: DataFrame, asked: Asked = Asked()) -> DataFrame:
    """The table of nodes, comments, lines and errors of files(path, content), and
    of what files carry in arrays `told` and `skip`, if they do; of these what is asked."""
    return of_each_path(shared_nodes(files, asked))


def of_each_path(rows: DataFrame) -> DataFrame:
    """Rows with `paths` as rows of each path."""
    return rows.select(F.explode("paths").alias("path"), *(c for c in rows.columns if c != "paths"))
