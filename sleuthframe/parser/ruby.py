"""A parser of Ruby source text to a tree of nodes.

It reads characters directly, since what a character means depends on what may
stand there. Offsets are code points. A text that it can't read raises
ParseError with an offset; nothing is guessed.
"""

from __future__ import annotations

import re
from collections.abc import Callable


class ParseError(ValueError):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class Node:
    """kind; name (a method, variable, constant or literal value); kids as (role,
    node); sel: where the name or keyword stands; op: the call operator, the
    operator of a write, or how a literal closes; open: how it begins; form: what else
    tells forms of a kind apart (modifier, ternary, elsif, endless, command)."""

    __slots__ = ("end", "form", "kids", "kind", "name", "op", "open", "sel", "start")

    def __init__(self, kind: str, start: int, end: int, name: str | None = None, kids: list | None = None, sel: tuple[int, int] | None = None, op: str | None = None, open: str | None = None, form: str | None = None):
        self.kind, self.start, self.end, self.name = kind, start, end, name
        self.kids, self.sel, self.op, self.open, self.form = kids if kids is not None else [], sel, op, open, form

    def kid(self, role: str) -> Node | None:
        for r, k in self.kids:
            if r == role:
                return k
        return None

    def all(self, role: str) -> list[Node]:
        return [k for r, k in self.kids if r == role]


KEYWORDS = frozenset("__ENCODING__ __FILE__ __LINE__ BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split())
#: Keywords that may begin an argument without parentheses.
ARGUMENT_KEYWORDS = frozenset("__ENCODING__ __FILE__ __LINE__ begin case class def defined? false if nil not self super true unless while until yield".split()) - {"if", "unless", "while", "until"}
#: Binary operators from the loosest to the tightest; those of a level group to the left.
LEVELS = [["...", ".."], ["||"], ["&&"], ["<=>", "===", "==", "!=", "=~", "!~"], ["<=", ">=", "<", ">"], ["|", "^"], ["&"], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]
TIGHTNESS = {op: level for level, ops in enumerate(LEVELS) for op in ops}
BINARY = re.compile("|".join(re.escape(op) for op in sorted(TIGHTNESS, key=len, reverse=True)))
ASSIGNABLE = frozenset(["||", "&&", "|", "^", "&", "<<", ">>", "+", "-", "*", "/", "%"])
ASSIGN = re.compile(r"(\*\*|\|\||&&|<<|>>|[-+*/%|&^])?=(?![=~>])")
IDENT = re.compile("[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*")
METHOD = re.compile(r"[^\W\d]\w*[?!]?(?!=[=~>])|[^\W\d]\w*")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[dD][0-9_]+|0[oO]?[0-7_]+(?![\d.eE])|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(r?i?)(?![a-zA-Z_])")
OPERATOR_NAME = re.compile(r"\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+\-~]@|[+\-*/%<>~^&|`]")
CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
SPACE = re.compile(r"(?:[ \t\f\v\r]|\\\r?\n)*")
BLANKS = frozenset(" \t\f\v\r\\")
CONTINUES = re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t\r]*(?:&\.|\.(?!\.))")
HEREDOC = re.compile(r"<<([~-]?)(?:([\"'`])(.+?)\2|([^\W\d]\w*))")
SETTER = re.compile(r"[^\W\d]\w*=(?![=~>]|\s*[^\s(&*\w])")


#: Words and numbers that may be others in a statement of the same shape, but for KEPT.
WORD = re.compile(r"(?<!\w)([A-Za-z][A-Za-z0-9_]*|[1-9][0-9]*)")
KEPT = KEYWORDS | {"defined"}
#: Lines that have no shape: what words mean there goes by their letters, or what follows is theirs.
UNFIT = re.compile(r"[^\x20-\x7e]|[%/\\`#]|<<|\?\w|\$-|^=")
#: From here on a line's statement may go on: blanks, comments and line ends.
CONTINUED = re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t\r]*")
#: Lines of a shape are that long at most, nested that deep, compared with their parse
#: so many times before it is trusted, and so many shapes are held.
LONGEST, DEEP, TRIED, MOST_SHAPES = 300, 40, 2, 5000


def token(start: int, end: int, name: str) -> Node:
    return Node("token", start, end, name)


def same(a: Node, b: Node) -> bool:
    """Whether two trees are equal."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if (a.kind, a.start, a.end, a.name, a.sel, a.op, a.open, a.form, [r for r, _ in a.kids]) != (b.kind, b.start, b.end, b.name, b.sel, b.op, b.open, b.form, [r for r, _ in b.kids]):
            return False
        todo += [(x, y) for (_, x), (_, y) in zip(a.kids, b.kids, strict=True)]
    return True


class Shape:
    """What a one-line statement's tree is, whatever its words are. Of the words only
    these matter: whether they are keywords, constants, names or numbers and which are
    equal; a statement that makes or reads a local variable made outside has no
    shape. The tree is that of the line with made-up words; offsets are told as
    characters outside of words and how many words come before."""

    def __init__(self, key: tuple = ()) -> None:
        self.key = key
        self.nodes: list[tuple] = []
        self.literal: list[tuple[int, int, int, int]] = []
        self.semicolons: list[tuple[int, int, str]] = []
        self.known = 0
        #: What comments of a whole file say about rules.
        self.dirs: list[dict] = []

    @staticmethod
    def of(key: tuple, whole: bool = False) -> Shape | None:
        """The shape of a line's parts, or a whole file's: texts, and (number of the word,
        whether it is a name, whether it is a number) for words."""
        if any(isinstance(p, str) and ("zq7x" in p.lower() or "907307" in p) for p in key) or max((p[0] for p in key if not isinstance(p, str)), default=0) > 99:
            return None
        line, bounds, made = "", [], {}
        for p in key:
            if isinstance(p, str):
                line += p
            else:
                made[p[0]] = f"{'907307' if p[2] else 'zq7x' if p[1] else 'Zq7x'}{p[0]:02d}"
                bounds.append((len(line), len(line) + len(made[p[0]])))
                line += made[p[0]]
        parser = Parser(line if whole else f"{line}\nzq7xend\n")
        # as deep as a line with a shape may be
        parser.depth = 0 if whole else DEEP
        try:
            tree = parser.program() if whole else parser.statement()
        except (ParseError, IndexError, RecursionError):
            return None
        if not whole and (parser.i != len(line) or tree.start or parser.locals != [set()] or parser.comments or parser.skip):
            return None
        shape, index = Shape(key), {}
        words = {w: k for k, w in made.items()}
        pattern = re.compile("(" + "|".join(words) + ")") if words else None

        def at(offset: int) -> tuple[int, int]:
            before = [b - a for a, b in bounds if b <= offset]
            if any(a < offset < b for a, b in bounds):
                raise ValueError
            return offset - sum(before), len(before)

        def text(told: str | None):
            pieces = [p for p in pattern.split(told) if p] if told and pattern else [told]
            pieces = [words.get(p, p) for p in pieces]
            return pieces[0] if len(pieces) == 1 else tuple(pieces) if pieces else told

        def add(node: Node) -> int:
            if id(node) not in index:
                kids = [(r, add(k)) for r, k in node.kids]
                sel = (*at(node.sel[0]), *at(node.sel[1])) if node.sel else None
                shape.nodes.append((node.kind, *at(node.start), *at(node.end), text(node.name), kids, sel, text(node.op), text(node.open), text(node.form)))
                index[id(node)] = len(shape.nodes) - 1
            return index[id(node)]

        try:
            add(tree)
            shape.literal = [(*at(a), *at(b)) for a, b in parser.literal]
            shape.semicolons = [(*at(a), form) for a, form in parser.semicolons]
        except ValueError:
            return None
        return shape

    def stops(self, base: int, size: list[int]) -> list[tuple[int, str]]:
        """Where the semicolons of a line are."""
        return [(base + a + size[i], form) for a, i, form in self.semicolons]

    def node(self, base: int, size: list[int], words: list[str], literal: list[tuple[int, int]]) -> Node:
        """The tree of a line that begins at base; size: how long its words are together,
        up to each; the ranges of its literals are added."""
        made: list[Node] = []
        for kind, a, i, b, j, name, kids, sel, op, open_, form in self.nodes:
            if name is not None and name.__class__ is not str:
                name = words[name] if name.__class__ is int else told(name, words)
            if op.__class__ is int or op.__class__ is tuple:
                op = told((op,) if op.__class__ is int else op, words)
            if open_.__class__ is int or open_.__class__ is tuple:
                open_ = told((open_,) if open_.__class__ is int else open_, words)
            if form.__class__ is int or form.__class__ is tuple:
                form = told((form,) if form.__class__ is int else form, words)
            if sel is not None:
                sel = base + sel[0] + size[sel[1]], base + sel[2] + size[sel[3]]
            made.append(Node(kind, base + a + size[i], base + b + size[j], name, [(r, made[k]) for r, k in kids], sel, op, open_, form))
        for a, i, b, j in self.literal:
            literal.append((base + a + size[i], base + b + size[j]))
        return made[-1]


def told(pieces: tuple, words: list[str]) -> str:
    return "".join([words[p] if p.__class__ is int else p for p in pieces])


def keyed(line: str) -> tuple[tuple, list[int], list[str]]:
    """A line's parts (see Shape.of), how long its words are together, up to each, and
    its different words."""
    parts = WORD.split(line)
    words: dict[str, int] = {}
    cumulated, size = [0], 0
    for k in range(1, len(parts), 2):
        w = parts[k]
        if w not in KEPT:
            parts[k] = words.setdefault(w, len(words)), w[0] >= "a", w[0] <= "9"
            size += len(w)
            cumulated.append(size)
    return tuple(parts), cumulated, list(words)


#: Shapes by a line's parts; None: the line must be parsed.
SHAPES: dict[tuple, Shape | None] = {}


class Parser:
    def __init__(self, text: str):
        self.s, self.n, self.i = text, len(text), 0
        self.skip: dict[int, int] = {}
        self.comments: list[Node] = []
        self.semicolons: list[tuple[int, str]] = []
        self.seen: set[int] = set()
        #: Ranges of literal text, for masking.
        self.literal: list[tuple[int, int]] = []
        self.locals: list[set[str]] = [set()]
        self.no_do = 0
        self.no_brace = 0
        self.depth = 0
        self.data: int | None = None

    # -- characters ---------------------------------------------------------------

    def fail(self, message: str):
        raise ParseError(self.i, message)

    def ws(self) -> None:
        if self.s[self.i : self.i + 1] in BLANKS:
            self.i = SPACE.match(self.s, self.i).end()

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def newline(self) -> None:
        """Step over the line end at i, and the heredoc texts that follow it."""
        self.i = self.skip.get(self.i, self.i + 1)

    def comment(self) -> None:
        end = self.s.find("\n", self.i)
        end = self.n if end < 0 else end
        stop = end - 1 if end > self.i and self.s[end - 1] == "\r" else end
        if self.i not in self.seen:
            self.seen.add(self.i)
            self.comments.append(Node("comment", self.i, stop, self.s[self.i : stop]))
        self.i = end

    def nl(self, semicolons: bool = True) -> bool:
        """Skip blanks, line ends, comments and, if asked, semicolons. Whether a
        statement may end here."""
        found = False
        while True:
            self.ws()
            c = self.peek()
            if c == "#":
                self.comment()
            elif c == "\n":
                found = True
                self.newline()
                if self.s.startswith("=begin", self.i) and (self.i + 6 >= self.n or self.s[self.i + 6].isspace()):
                    end = re.compile(r"^=end\b[^\n]*", re.M).search(self.s, self.i)
                    if not end:
                        self.fail("embedded document meets end of file")
                    if self.i not in self.seen:
                        self.seen.add(self.i)
                        self.comments.append(Node("comment", self.i, end.end(), self.s[self.i : end.end()], form="block"))
                    self.i = end.end()
                elif self.s.startswith("__END__", self.i) and (self.i + 7 >= self.n or self.s[self.i + 7] in "\r\n"):
                    self.data = self.i
                    self.n = self.i
                    self.s = self.s[: self.i]
            elif c == ";" and semicolons:
                if self.i not in self.seen:
                    self.seen.add(self.i)
                    self.semicolons.append((self.i, "between"))
                found = True
                self.i += 1
            else:
                return found or self.i >= self.n

    def word(self) -> str:
        m = IDENT.match(self.s, self.i)
        if not m:
            return ""
        w = m.group()
        if w == "defined" and self.s.startswith("?", m.end()):
            return "defined?"
        # a name before a single colon is a label
        return w

    def at_word(self, *words: str) -> bool:
        w = self.word()
        if w not in words:
            return False
        after = self.s[self.i + len(w) : self.i + len(w) + 2]
        return not (after[:1] in ("?", "!") and w != "defined?" and after[1:] != "=") and not (after[:1] == ":" and after[1:] != ":")

    def expect(self, text: str) -> int:
        self.ws()
        if not self.s.startswith(text, self.i):
            self.fail(f"expected `{text}`")
        self.i += len(text)
        return self.i

    def expect_word(self, word: str) -> tuple[int, int]:
        self.nl()
        if not self.at_word(word):
            self.fail(f"expected `{word}`")
        start = self.i
        self.i += len(word)
        return start, self.i

    # -- statements -----------------------------------------------------------------

    def program(self) -> Node:
        if self.s.startswith("\ufeff"):
            self.i = 1
        if self.s.startswith("=begin"):
            self.s = self.s  # an embedded document may begin the file
            end = re.compile(r"^=end\b[^\n]*", re.M).search(self.s, 0)
            if not end:
                self.fail("embedded document meets end of file")
            self.comments.append(Node("comment", 0, end.end(), self.s[: end.end()], form="block"))
            self.i = end.end()
        elif self.s.startswith("__END__") and (self.n == 7 or self.s[7] in "\r\n"):
            self.data, self.n, self.s = 0, 0, ""
        body = self.statements(())
        if self.i < self.n:
            self.fail("unexpected text")
        return Node("program", 0, self.n, kids=[("body", b) for b in body])

    def statements(self, stops: tuple[str, ...], closer: str = "") -> list[Node]:
        out: list[Node] = []
        self.depth += 1
        if self.depth > 120:
            self.fail("nested too deeply")
        no_do, self.no_do = self.no_do, 0
        no_brace, self.no_brace = self.no_brace, 0
        self.nl()
        while self.i < self.n and not (closer and self.s.startswith(closer, self.i)) and not (stops and self.at_word(*stops)):
            out.append(self.known_statement() or self.statement())
            at = self.i
            if not self.nl():
                if closer and self.s.startswith(closer, self.i) or stops and self.at_word(*stops):
                    break
                self.i = at
                self.ws()
                self.fail("unexpected text after a statement")
        self.no_do, self.no_brace = no_do, no_brace
        self.depth -= 1
        return out

    def known_statement(self) -> Node | None:
        """The statement that is the rest of the line at i, if one of its shape has
        been read before (see Shape), else None."""
        if self.in_list or self.ternaries or self.no_pipe or self.depth > DEEP:
            return None
        end = self.s.find("\n", self.i, self.n)
        line = self.s[self.i : self.n if end < 0 else end]
        if "#" in line and ("'" not in line and '"' not in line):
            line = line[: line.index("#")]
        line = line.rstrip(" \t\r")
        if not line or len(line) > LONGEST or UNFIT.search(line):
            return None
        key, cumulated, words = keyed(line)
        if not self.locals[-1].isdisjoint(words):
            return None
        shape = SHAPES.get(key, False)
        if shape is None:
            return None
        stop = self.i + len(line)
        if shape is False or shape.known < TRIED:
            return self.tried_statement(key, shape, stop, cumulated, words)
        if self.s.startswith((".", "&"), CONTINUED.match(self.s, stop).end()):
            return None
        node = shape.node(self.i, cumulated, words, self.literal)
        for at, form in shape.stops(self.i, cumulated):
            if at not in self.seen:
                self.seen.add(at)
                self.semicolons.append((at, form))
        self.i = stop
        return node

    def tried_statement(self, key: tuple, shape: Shape | bool, stop: int, cumulated: list[int], words: list[str]) -> Node:
        """The statement at i, read; what its shape gives is compared with it."""
        start, told, stops = self.i, len(self.literal), len(self.semicolons)
        if len(SHAPES) >= MOST_SHAPES:
            SHAPES.clear()
        SHAPES[key] = None
        node = self.statement()
        if self.i == stop and node.start == start:
            shape = shape or Shape.of(key)
            literal: list[tuple[int, int]] = []
            if shape and same(shape.node(start, cumulated, words, literal), node) and literal == self.literal[told:] and shape.stops(start, cumulated) == self.semicolons[stops:]:
                shape.known += 1
                SHAPES[key] = shape
        return node

    def statement(self) -> Node:
        node = self.expression_statement()
        while True:
            at = self.i
            self.ws()
            w = self.word()
            if w in ("if", "unless", "while", "until", "rescue") and self.at_word(w):
                sel = (self.i, self.i + len(w))
                self.i += len(w)
                self.nl(False) if w != "rescue" else None
                cond = self.expression_statement()
                if w == "rescue":
                    node = Node("rescue_modifier", node.start, cond.end, kids=[("body", node), ("rescue", cond)], sel=sel)
                else:
                    node = Node(w, node.start, cond.end, kids=[("body", node), ("cond", cond)], sel=sel, form="modifier")
            else:
                self.i = at
                return node

    def expression_statement(self) -> Node:
        left = self.not_expression()
        while True:
            at = self.i
            self.ws()
            w = self.word()
            if w in ("and", "or") and self.at_word(w):
                sel = (self.i, self.i + len(w))
                self.i += len(w)
                self.nl(False)
                right = self.not_expression()
                left = Node(w, left.start, right.end, w, [("left", left), ("right", right)], sel)
            else:
                self.i = at
                return left

    def not_expression(self) -> Node:
        self.ws()
        if self.at_word("not"):
            start = self.i
            self.i += 3
            self.ws()
            inner = self.not_expression()
            return Node("call", start, inner.end, "!", [("recv", inner)], (start, start + 3), open="not")
        first = self.expression()
        at = self.i
        self.ws()
        if self.peek() == "," and self.assignable(first):
            saved = self.i
            node = self.multi_assign([first])
            if node:
                return node
            self.i = saved
        elif self.s.startswith("=>", self.i) or self.at_word("in"):
            if self.no_do and self.at_word("in"):
                self.i = at
                return first
            form = "=>" if self.peek(2) == "=>" else "in"
            self.i += 2
            self.ws()
            pattern = self.pattern_top()
            return Node("match", first.start, pattern.end, form, [("value", first), ("pattern", pattern)])
        self.i = at
        return first

    def assignable(self, node: Node) -> bool:
        return node.kind in ("local_variable_read", "instance_variable_read", "class_variable_read", "global_variable_read", "constant_read", "constant_path", "splat", "mlhs") or node.kind == "call" and not node.all("arg") and not node.kid("block") and node.open is None or node.kind == "call" and node.name == "[]"

    def multi_assign(self, targets: list[Node]) -> Node | None:
        while True:
            self.ws()
            if self.peek() != ",":
                break
            self.i += 1
            self.ws()
            if ASSIGN.match(self.s, self.i):
                break
            target = self.mlhs_item()
            if target is None:
                return None
            targets.append(target)
        self.ws()
        m = ASSIGN.match(self.s, self.i)
        if not m or m.group(1):
            return None
        self.i = m.end()
        self.nl(False)
        kids = [("target", self.as_target(t)) for t in targets]
        values = self.value_list()
        return Node("multi_write", targets[0].start, values[-1].end, None, kids + [("value", v) for v in values], (m.start(), m.end()))

    def mlhs_item(self) -> Node | None:
        start = self.i
        if self.peek() == "*":
            self.i += 1
            inner = self.mlhs_item() if IDENT.match(self.s, self.i) or self.peek() in "@$" else None
            return Node("splat", start, self.i, kids=[("value", inner)] if inner else [])
        if self.peek() == "(":
            self.i += 1
            inner = []
            while True:
                self.nl(False)
                item = self.mlhs_item()
                if item is None:
                    return None
                inner.append(item)
                self.nl(False)
                if self.peek() == ",":
                    self.i += 1
                    continue
                break
            if self.peek() != ")":
                return None
            self.i += 1
            return Node("mlhs", start, self.i, kids=[("target", t) for t in inner])
        node = self.primary_postfix()
        return node if self.assignable(node) else None

    def value_list(self) -> list[Node]:
        out = [self.value_item()]
        while True:
            at = self.i
            self.ws()
            if self.peek() != ",":
                self.i = at
                return out
            self.i += 1
            self.nl(False)
            out.append(self.value_item())

    def value_item(self) -> Node:
        start = self.i
        if self.peek() == "*" and self.peek(2) != "**":
            self.i += 1
            inner = self.expression()
            return Node("splat", start, inner.end, kids=[("value", inner)])
        return self.expression()

    # -- expressions ------------------------------------------------------------------

    def as_target(self, node: Node) -> Node:
        if node.kind == "call" and node.form == "name" and not node.kid("recv"):
            self.locals[-1].add(node.name)
            return Node("local_variable_target", node.start, node.end, node.name, sel=node.sel)
        if node.kind == "local_variable_read":
            return Node("local_variable_target", node.start, node.end, node.name, sel=node.sel)
        if node.kind in ("splat", "mlhs"):
            return Node(node.kind, node.start, node.end, kids=[(r, self.as_target(k)) for r, k in node.kids])
        if node.kind.endswith("_read"):
            return Node(node.kind.removesuffix("_read") + "_target", node.start, node.end, node.name, sel=node.sel)
        return node

    def expression(self) -> Node:
        """An expression without and, or, not and modifiers."""
        self.ws()
        start = self.i
        if self.peek() == "*" and self.peek(2) != "**":
            target = self.mlhs_item()
            self.ws()
            if target is not None and (self.peek() == "," or ASSIGN.match(self.s, self.i)):
                node = self.multi_assign([target])
                if node:
                    return node
            self.i = start
            self.fail("unexpected `*`")
        if self.peek() == "(":
            node = self.nested_targets()
            if node:
                return node
        left = self.ternary()
        at = self.i
        self.ws()
        m = ASSIGN.match(self.s, self.i)
        if m and (self.assignable(left) or left.kind == "call" and left.name == "[]"):
            self.i = m.end()
            operator = m.group(1)
            return self.write(left, operator, (m.start(), m.end()))
        self.i = at
        return left

    def nested_targets(self) -> Node | None:
        """(a, b), c = ... at the beginning of a statement."""
        if not re.compile(r"\([\w*@$, ]+\)\s*=[^=~>]|\(\s*[\w*@$(][^()=\n]*(?:\([^()]*\)[^()=\n]*)*\)\s*,[^=\n]*[^=!<>\n]=[^=~>]").match(self.s, self.i):
            return None
        saved = self.i, len(self.comments)
        try:
            first = self.mlhs_item()
            self.ws()
            node = self.multi_assign([first]) if first is not None and self.peek() in (",", "=") else None
        except ParseError:
            node = None
        if node is None:
            self.i = saved[0]
        return node

    def write(self, left: Node, operator: str | None, sel: tuple[int, int]) -> Node:
        self.nl(False)
        if left.kind == "call" and left.form == "name" and not left.kid("recv"):
            self.locals[-1].add(left.name)
            base = "local_variable"
        elif left.kind == "call" and left.name == "[]":
            base = "index"
        elif left.kind == "call":
            base = "call"
        else:
            base = left.kind.removesuffix("_read")
        value = self.value_item()
        if not operator:
            at = self.i
            self.ws()
            if self.peek() == "," and not self.in_list:
                values = [value]
                while self.peek() == ",":
                    self.i += 1
                    self.nl(False)
                    values.append(self.value_item())
                    at = self.i
                    self.ws()
                value = Node("array", values[0].start, values[-1].end, kids=[("element", v) for v in values])
            self.i = at
        at = self.i
        self.ws()
        if self.at_word("rescue") and not self.in_list:
            mark = (self.i, self.i + 6)
            self.i += 6
            self.ws()
            other = self.expression()
            value = Node("rescue_modifier", value.start, other.end, kids=[("body", value), ("rescue", other)], sel=mark)
        else:
            self.i = at
        kids = ([("recv", r) for r in left.all("recv")] + [("arg", a) for a in left.all("arg")]) if base in ("index", "call") else [("recv", r) for r in left.kids and [k for _, k in left.kids]] if base == "constant_path" else []
        kind = f"{base}_write" if not operator else f"{base}_{'or' if operator == '||' else 'and' if operator == '&&' else 'operator'}_write"
        return Node(kind, left.start, value.end, left.name, [*kids, ("value", value), ("operator", token(*sel, (operator or "") + "="))], left.sel or (left.start, left.end), (operator or "") + "=")

    in_list = 0

    def ternary(self) -> Node:
        cond = self.defined_or(0)
        at = self.i
        self.ws()
        if self.peek() == "?" and not (self.i == at and self.s[self.i - 1 : self.i].isalnum() and False):
            mark = self.i
            self.i += 1
            self.nl(False)
            in_list, self.in_list = self.in_list, 1
            labels, self.ternaries = self.ternaries, self.ternaries + 1
            then = self.ternary_branch()
            self.ternaries = labels
            self.nl(False)
            if self.peek() != ":":
                self.fail("expected `:` of a conditional")
            self.i += 1
            self.nl(False)
            other = self.ternary_branch()
            self.in_list = in_list
            return Node("if", cond.start, other.end, None, [("cond", cond), ("body", then), ("else", other)], (mark, mark + 1), op=":", form="ternary")
        self.i = at
        return cond

    ternaries = 0

    def ternary_branch(self) -> Node:
        return self.not_expression() if self.at_word("not") else self.expression()

    def defined_or(self, level: int) -> Node:
        self.ws()
        if level == 0:
            if self.at_word("defined?"):
                start = self.i
                self.i += 8
                self.ws()
                if self.peek() == "(":
                    return self.binary_rest(self.postfix(self.defined(start)), 0)
                inner = self.unary()
                return self.binary_rest(Node("defined", start, inner.end, kids=[("value", inner)], sel=(start, start + 8)), 0)
            if self.peek(2) == ".." and self.peek(3) != "...." and not self.s[self.i - 1 : self.i].isalnum():
                start = self.i
                op = "..." if self.peek(3) == "..." else ".."
                self.i += len(op)
                right = self.binary(1)
                return Node("range", start, right.end, op, [("right", right)], (start, start + len(op)))
        return self.binary(0)

    def defined(self, start: int) -> Node:
        self.i += 1
        self.nl(False)
        inner = self.expression_statement()
        self.nl(False)
        self.expect(")")
        return Node("defined", start, self.i, kids=[("value", inner)], sel=(start, start + 8), open="(")

    def binary(self, level: int) -> Node:
        return self.binary_rest(self.unary(), level)

    def operator(self) -> str | None:
        """The binary operator at i."""
        m = BINARY.match(self.s, self.i)
        if not m:
            return None
        op, end = m.group(), m.end()
        after = self.s[end : end + 1]
        if after == "=" and op in ASSIGNABLE and self.s[end + 1 : end + 2] not in ("=", "~"):
            return None
        if op == "&" and after == "." or op == "*" and after == "*" or op == "|" and self.no_pipe:
            return None
        return op

    def binary_rest(self, left: Node, level: int) -> Node:
        """Operators of this level and tighter ones after an operand."""
        while True:
            at = self.i
            self.ws()
            op = self.operator()
            if not op or TIGHTNESS[op] < level:
                self.i = at
                return left
            sel = (self.i, self.i + len(op))
            self.i += len(op)
            if op in ("..", "..."):
                mark = self.i
                self.ws()
                if self.i >= self.n or self.peek() in ")]}\n,;#" or self.at_word("then", "do", "and", "or", "if", "unless"):
                    self.i = mark
                    return Node("range", left.start, mark, op, [("left", left)], sel)
            self.nl(False)
            tighter = TIGHTNESS[op] + 1
            if op in ("&&", "||") and self.at_word("not"):
                right = self.not_expression()
            elif op in ("&&", "||") and self.at_word("return", "break", "next", "raise"):
                right = self.expression()
            else:
                right = self.binary(tighter)
                mark = self.i
                self.ws()
                m = ASSIGN.match(self.s, self.i)
                if m and op in ("&&", "||") and self.assignable(right):
                    self.i = m.end()
                    right = self.write(right, m.group(1), (m.start(), m.end()))
                else:
                    self.i = mark
            if op in ("&&", "||"):
                left = Node("and" if op == "&&" else "or", left.start, right.end, op, [("left", left), ("right", right)], sel)
            elif op in ("..", "..."):
                left = Node("range", left.start, right.end, op, [("left", left), ("right", right)], sel)
            else:
                left = Node("call", left.start, right.end, op, [("recv", left), ("arg", right)], sel, form="binary")

    no_pipe = 0

    def unary(self) -> Node:
        self.ws()
        start, c = self.i, self.peek()
        if c == "!" and self.peek(2) not in ("!=", "!~"):
            self.i += 1
            self.ws()
            inner = self.unary()
            return Node("call", start, inner.end, "!", [("recv", inner)], (start, start + 1), open="!")
        if c == "-" and self.peek(2) != "->":
            m = NUMBER.match(self.s, self.i + 1)
            if m:
                self.i += 1
                number = self.number()
                number.start, number.name = start, "-" + number.name
                node = self.postfix(number)
                return self.power(node, minus=start if node is number else None)
            self.i += 1
            self.ws()
            inner = self.unary()
            return Node("call", start, inner.end, "-@", [("recv", inner)], (start, start + 1), form="unary")
        if c in ("+", "~"):
            self.i += 1
            self.ws()
            inner = self.unary()
            return Node("call", start, inner.end, "+@" if c == "+" else "~", [("recv", inner)], (start, start + 1), form="unary")
        if self.at_word("defined?"):
            self.i += 8
            self.ws()
            if self.peek() == "(":
                return self.postfix(self.defined(start))
            self.i = start
            return self.defined_or(0)
        return self.power(self.primary_postfix())

    def power(self, left: Node, minus: int | None = None) -> Node:
        at = self.i
        self.ws()
        if self.s.startswith("**", self.i) and not self.s.startswith("**=", self.i):
            sel = (self.i, self.i + 2)
            self.i += 2
            self.nl(False)
            right = self.unary()
            if minus is not None:
                left.start, left.name = minus + 1, left.name[1:]
                inner = Node("call", left.start, right.end, "**", [("recv", left), ("arg", right)], sel, form="binary")
                return Node("call", minus, right.end, "-@", [("recv", inner)], (minus, minus + 1), form="unary")
            return Node("call", left.start, right.end, "**", [("recv", left), ("arg", right)], sel, form="binary")
        self.i = at
        return left

    # -- calls ------------------------------------------------------------------------

    def primary_postfix(self) -> Node:
        return self.postfix(self.primary())

    def postfix(self, node: Node) -> Node:
        while True:
            at = self.i
            c = self.peek()
            if c == "[" and node.kind not in ("return", "break", "next") and not (node.kind == "call" and node.form == "command"):
                self.i += 1
                args = self.arguments("]")
                node = Node("call", node.start, self.i, "[]", [("recv", node), *args], (at, self.i), open="[", form="index")
                continue
            if c == "{" and not self.no_brace and self.takes_block(node):
                node = self.with_block(node, self.block("{", "}"))
                continue
            self.ws()
            c = self.peek()
            if c == "{" and not self.no_brace and self.takes_block(node):
                node = self.with_block(node, self.block("{", "}"))
                continue
            if c == "d" and not self.no_do and self.at_word("do") and self.takes_block(node, do=True):
                node = self.with_block(node, self.block("do", "end"))
                continue
            if c in ("\n", "#", ""):
                m = CONTINUES.match(self.s, self.i) if self.i not in self.skip else CONTINUES.match(self.s, self.skip[self.i])
                if not m:
                    self.i = at
                    return node
                stop = m.end()
                while self.i < stop - 2:
                    before = self.i
                    self.nl(False)
                    if self.peek() == "." or self.peek(2) == "&." or self.i == before:
                        break
                c = self.peek()
            if self.peek(2) == "&." or c == "." and self.peek(2) != "..":
                op = "&." if c == "&" else "."
                self.i += len(op)
                self.nl(False)
                node = self.method(node, op)
                continue
            if self.peek(2) == "::" and self.i == at:
                self.i += 2
                m = IDENT.match(self.s, self.i)
                if m and m.group()[0].isupper() and self.s[m.end() : m.end() + 1] not in ("(", "?", "!"):
                    self.i = m.end()
                    node = Node("constant_path", node.start, self.i, m.group(), [("parent", node)], m.span())
                    if self.peek() in "\"'" and False:
                        self.fail("unexpected string")
                    continue
                node = self.method(node, "::")
                continue
            self.i = at
            return node

    def takes_block(self, node: Node, do: bool = False) -> bool:
        if node.kind in ("super", "forwarding_super", "lambda_start"):
            return not node.kid("block")
        return node.kind == "call" and not node.kid("block") and node.form not in ("binary", "unary", "index", "variable") and node.open not in ("!", "not") and (do or node.form != "command")

    def with_block(self, node: Node, block: Node) -> Node:
        if node.kind == "lambda_start":
            return Node("lambda", node.start, block.end, None, [*node.kids, *block.kids], node.sel, open=block.open)
        node.kids.append(("block", block))
        node.end = block.end
        return node

    def block(self, opener: str, closer: str) -> Node:
        start = self.i
        self.i += len(opener)
        self.locals.append(set(self.locals[-1]))
        kids: list = []
        at = self.i
        self.nl(False)
        if self.peek() == "|":
            kids += self.block_parameters()
        else:
            self.i = at
        pipe, self.no_pipe = self.no_pipe, 0
        in_list, self.in_list = self.in_list, 0
        if opener == "do":
            kids += self.body(("end",))
            end = self.expect_word("end")[1]
        else:
            kids += [("body", b) for b in self.statements((), "}")]
            end = self.expect("}")
        self.no_pipe, self.in_list = pipe, in_list
        self.locals.pop()
        return Node("block", start, end, None, kids, (start, start + len(opener)), open=opener)

    def block_parameters(self) -> list:
        start = self.i
        self.i += 1
        pipe, self.no_pipe = self.no_pipe, 1
        params = self.parameters("|")
        self.no_pipe = pipe
        self.expect("|")
        return [("params", Node("block_parameters", start, self.i, kids=params, open="|"))]

    def method(self, receiver: Node, op: str) -> Node:
        start = self.i
        if self.peek() == "(":
            return self.call_rest(receiver, "call", (start, start), op)
        m = METHOD.match(self.s, self.i) or OPERATOR_NAME.match(self.s, self.i)
        if not m:
            self.fail("expected a method name")
        self.i = m.end()
        return self.call_rest(receiver, m.group(), m.span(), op)

    def call_rest(self, receiver: Node | None, name: str, sel: tuple[int, int], op: str | None) -> Node:
        kids = [("recv", receiver)] if receiver else []
        start = receiver.start if receiver else sel[0]
        if self.peek() == "(":
            self.i += 1
            kids += self.arguments(")")
            return Node("call", start, self.i, name, kids, sel, op, "(")
        if self.begins_argument(name if not receiver else None):
            args = self.command_arguments()
            return Node("call", start, args[-1][1].end, name, kids + args, sel, op, form="command")
        return Node("call", start, self.i, name, kids, sel, op, form=None if receiver else "name")

    def begins_argument(self, name: str | None) -> bool:
        """Whether what follows a name is its first argument without parentheses."""
        at = self.i
        self.ws()
        i, spaced = self.i, self.i > at
        self.i = at
        if not spaced or i >= self.n:
            return False
        s, c, d = self.s, self.s[i], self.s[i + 1 : i + 2]
        m = IDENT.match(s, i)
        if m:
            w = m.group()
            after = s[m.end() : m.end() + 2]
            if after[:1] == ":" and after != "::":
                return not (self.ternaries and False)
            if w in KEYWORDS or w == "defined":
                return w in ARGUMENT_KEYWORDS or w == "defined" and after[:1] == "?"
            return True
        if c.isdigit() or c in "\"'@$`":
            return True
        if c == "(":
            return True
        if c == ":":
            return d == ":" and s[i + 2 : i + 3].isupper() or d != "" and (d in "\"'@$_" or d.isalpha() or d > "\x7f") or bool(d and OPERATOR_NAME.match(s, i + 1) and not d.isspace())
        if c == "[":
            return not (name in self.locals[-1] if name else False)
        if c == "-":
            return d == ">" or d not in (" ", "=", "\n", "\t", "")
        if c == "!":
            return d not in ("=", "~")
        if c == "~":
            return True
        if c == "*":
            return d not in (" ", "=", "\n", "\t", "") and not (d == "*" and s[i + 2 : i + 3] in (" ", "=", "\n"))
        if c == "&":
            return d not in (" ", "&", "=", ".", "\n", "\t", "")
        if c == "<":
            return bool(HEREDOC.match(s, i)) and d == "<"
        if c == "%":
            return d not in (" ", "=", "\n", "\t", "") and bool(re.compile(r"%[wWiIqQrsx]?[^\w\s]").match(s, i))
        if c == "/":
            return d not in (" ", "=", "\n", "\t", "")
        if c == "?":
            return bool(re.compile(r"\?(?:\\.|[^\s])(?!\w)").match(s, i)) and d not in (" ", "\n", "")
        if c == "+":
            return d not in (" ", "=", "\n", "\t", "") and d.isdigit()
        if c == ".":
            return s.startswith("..", i) and False
        return False

    def command_arguments(self) -> list:
        self.ws()
        self.no_do += 1
        in_list, self.in_list = self.in_list, 1
        out = self.argument_list("")
        self.no_do -= 1
        self.in_list = in_list
        return out

    def arguments(self, closer: str) -> list:
        no_do, self.no_do = self.no_do, 0
        no_brace, self.no_brace = self.no_brace, 0
        in_list, self.in_list = self.in_list, 1
        pipe, self.no_pipe = self.no_pipe, 0
        out = self.argument_list(closer)
        self.nl(False)
        self.no_do, self.no_brace, self.in_list, self.no_pipe = no_do, no_brace, in_list, pipe
        if not self.s.startswith(closer, self.i):
            self.fail(f"expected `{closer}`")
        self.i += len(closer)
        return out

    def argument_list(self, closer: str) -> list:
        out: list = []
        pairs: list[Node] = []
        while True:
            if closer:
                self.nl(False)
                if self.s.startswith(closer, self.i):
                    break
            else:
                self.ws()
            node = self.argument()
            if node.kind in ("assoc", "assoc_splat"):
                pairs.append(node)
            else:
                if pairs and node.kind != "block_argument":
                    out.append(("arg", Node("keyword_hash", pairs[0].start, pairs[-1].end, kids=[("element", p) for p in pairs])))
                    pairs = []
                if pairs:
                    out.append(("arg", Node("keyword_hash", pairs[0].start, pairs[-1].end, kids=[("element", p) for p in pairs])))
                    pairs = []
                out.append(("block" if node.kind == "block_argument" else "arg", node))
            at = self.i
            self.nl(False) if closer else self.ws()
            if self.peek() == ",":
                self.i += 1
                if not closer:
                    self.nl(False)
                continue
            if not closer:
                self.i = at
            break
        if pairs:
            out.append(("arg", Node("keyword_hash", pairs[0].start, pairs[-1].end, kids=[("element", p) for p in pairs])))
        return out

    def label(self) -> Node | None:
        """name: or "name": of a pair."""
        start = self.i
        m = METHOD.match(self.s, self.i)
        if m and self.s.startswith(":", m.end()) and not self.s.startswith("::", m.end()):
            if self.ternaries and not self.s[m.end() + 1 : m.end() + 2].isspace():
                return None
            if self.ternaries and not self.in_call_list:
                return None
            self.i = m.end() + 1
            return Node("symbol", start, self.i, m.group(), sel=(start, m.end()), open="label")
        if self.peek() in "\"'" and self.peek() and not self.ternaries:
            end = self.string_end(self.i)
            if end and self.s.startswith(":", end) and not self.s.startswith("::", end):
                node = self.quoted()
                self.i += 1
                return Node("symbol" if node.kind == "string" else "interpolated_symbol", start, self.i, node.name, node.kids, (start, self.i - 1), open="label" + node.open)
        return None

    in_call_list = 1

    def string_end(self, at: int) -> int | None:
        """Where a plain quoted string without interpolation ends."""
        m = re.compile(r"\"(?:\\.|#(?!\{)|[^\"\\#])*\"|'(?:\\.|[^'\\])*'", re.S).match(self.s, at)
        if m:
            return m.end()
        m = re.compile(r"\"(?:\\.|[^\"\\\n])*\"(?=:[ \n])").match(self.s, at)
        return m.end() if m else None

    def argument(self) -> Node:
        start, c = self.i, self.peek()
        if c == "*" and self.peek(2) == "**":
            self.i += 2
            if self.peek() in ",)|\n ":
                return Node("assoc_splat", start, self.i)
            inner = self.ternary()
            return Node("assoc_splat", start, inner.end, kids=[("value", inner)])
        if c == "*" and self.s[self.i + 1 : self.i + 2] != "=":
            self.i += 1
            self.ws()
            if self.peek() in ",)]":
                return Node("splat", start, start + 1)
            inner = self.ternary()
            return Node("splat", start, inner.end, kids=[("value", inner)])
        if c == "&" and self.peek(2) not in ("&&", "&."):
            self.i += 1
            self.ws()
            if self.peek() in ",)":
                return Node("block_argument", start, start + 1)
            inner = self.ternary()
            return Node("block_argument", start, inner.end, kids=[("value", inner)])
        if self.peek(3) == "..." and self.s[self.i + 3 : self.i + 4] in (")", ","):
            self.i += 3
            return Node("forwarding_arguments", start, self.i)
        ternaries, self.ternaries = self.ternaries, 0 if not self.ternaries else self.ternaries
        key = self.label()
        if key:
            self.ternaries = 0
            self.ws()
            if self.peek() in (",", ")", "]", "}", "|", "") or self.peek() in "\n#" and not self.continues_value():
                self.ternaries = ternaries
                return Node("assoc", start, key.end, key.name, [("key", key)], form="shorthand", open="label")
            self.nl(False)
            value = self.no_comma()
            self.ternaries = ternaries
            return Node("assoc", start, value.end, key.name, [("key", key), ("value", value)], open="label")
        self.ternaries = ternaries
        node = self.no_comma()
        at = self.i
        self.ws()
        if self.s.startswith("=>", self.i):
            sel = (self.i, self.i + 2)
            self.i += 2
            self.nl(False)
            value = self.no_comma()
            return Node("assoc", start, value.end, node.name, [("key", node), ("value", value)], sel, open="=>")
        self.i = at
        return node

    def continues_value(self) -> bool:
        at = self.i
        self.nl(False)
        more = self.i < self.n and self.peek() not in ")]},|" and not (self.at_word("end", "if", "unless", "do") or METHOD.match(self.s, self.i) and self.s.startswith(":", METHOD.match(self.s, self.i).end()))
        self.i = at
        return more

    def no_comma(self) -> Node:
        in_list, self.in_list = self.in_list, 1
        node = self.not_expression_in_list()
        self.in_list = in_list
        return node

    def not_expression_in_list(self) -> Node:
        self.ws()
        if self.at_word("not"):
            return self.not_expression()
        return self.expression()

    # -- primaries --------------------------------------------------------------------

    def primary(self) -> Node:
        self.ws()
        if self.i >= self.n:
            self.fail("unexpected end of text")
        start, c, s = self.i, self.s[self.i], self.s
        if c.isdigit():
            return self.number()
        if c in "\"'`":
            return self.strings()
        if c == ":":
            if self.peek(2) == "::":
                self.i += 2
                m = IDENT.match(s, self.i)
                if not m:
                    self.fail("expected a constant")
                self.i = m.end()
                return Node("constant_path", start, self.i, m.group(), [], m.span(), open="::")
            return self.symbol()
        if c == "@":
            m = re.compile(r"@@?[^\W\d]\w*").match(s, start)
            if not m:
                self.fail("expected a variable")
            self.i = m.end()
            return Node("class_variable_read" if s.startswith("@@", start) else "instance_variable_read", start, self.i, m.group(), sel=m.span())
        if c == "$":
            m = re.compile(r"\$(?:[^\W\d]\w*|\d+|-\w|[~*$?!@/\\;,.=:<>\"&`'+_])").match(s, start)
            if not m:
                self.fail("expected a variable")
            self.i = m.end()
            kind = "numbered_reference_read" if m.group()[1:].isdigit() and m.group() != "$0" else "back_reference_read" if m.group()[1] in "&`'+" else "global_variable_read"
            return Node(kind, start, self.i, m.group(), sel=m.span())
        if c == "[":
            self.i += 1
            kids = [("element", k) for _, k in self.arguments("]")]
            return Node("array", start, self.i, kids=kids, open="[")
        if c == "{":
            return self.hash()
        if c == "(":
            self.i += 1
            in_list, self.in_list = self.in_list, 0
            ternaries, self.ternaries = self.ternaries, 0
            pipe, self.no_pipe = self.no_pipe, 0
            body = self.statements((), ")")
            self.in_list, self.ternaries, self.no_pipe = in_list, ternaries, pipe
            self.nl()
            self.expect(")")
            return Node("parentheses", start, self.i, kids=[("body", b) for b in body], open="(")
        if c == "/":
            return self.regexp(start, "/", 1)
        if c == "%":
            return self.percent()
        if c == "?":
            m = re.compile(r"\?(?:\\u\{[^}]*\}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{1,2}|\\C-.|\\M-.|\\.|[^\s\\])", re.S).match(s, start)
            if not m:
                self.fail("unexpected `?`")
            self.i = m.end()
            self.literal.append((start, self.i))
            return Node("string", start, self.i, m.group()[1:], open="?")
        if c == "<" and self.peek(2) == "<<":
            node = self.heredoc()
            if node:
                return node
        if c == "-" and self.peek(2) == "->":
            return self.lambda_()
        if self.peek(2) == "..":
            return self.defined_or(0)
        m = METHOD.match(s, start)
        if not m:
            self.fail(f"unexpected `{c}`")
        word = self.word()
        if word in KEYWORDS and self.at_word(word):
            return self.keyword(word)
        name = m.group()
        self.i = m.end()
        if self.peek() == ":" and self.peek(2) != "::" and not self.ternaries and self.s[self.i + 1 : self.i + 2] in (" ", "\n") and name[-1] not in "?!":
            self.i = start
            self.fail("unexpected label")
        if name[0].isupper() and name[-1] not in "?!":
            if self.peek() == "(":
                return self.call_rest(None, name, m.span(), None)
            at = self.i
            if self.begins_constant_argument():
                return self.call_rest(None, name, m.span(), None)
            self.i = at
            return Node("constant_read", start, self.i, name, sel=m.span())
        if name in self.locals[-1] and self.peek() != "(":
            if not (self.begins_argument(name) and self.command_of_local()):
                return Node("local_variable_read", start, self.i, name, sel=m.span())
        return self.call_rest(None, name, m.span(), None)

    def begins_constant_argument(self) -> bool:
        """Integer "3" is a call, Foo -1 and Foo [1] are not."""
        m = re.compile(r"[ \t]+(?=[\"'@$]|\d|[a-z_]\w*\b(?![?!]?[ \t]*=[^=])|:[a-z\"'])").match(self.s, self.i)
        if not m:
            return False
        word = IDENT.match(self.s, m.end())
        return not (word and word.group() in KEYWORDS) and self.peek() == " "

    def command_of_local(self) -> bool:
        """A known local followed by what can only be an argument."""
        at = self.i
        self.ws()
        c = self.peek()
        self.i = at
        return c in "\"'@$" or c.isdigit()

    def number(self) -> Node:
        m = NUMBER.match(self.s, self.i)
        if not m:
            self.fail("malformed number")
        start, self.i = self.i, m.end()
        text = m.group()
        kind = "imaginary" if text.endswith("i") else "rational" if text.endswith("r") else "float" if re.match(r"\d[\d_]*(\.|[eE])", text) else "integer"
        return Node(kind, start, self.i, text)

    def symbol(self) -> Node:
        start = self.i
        nxt = self.s[start + 1 : start + 2]
        if nxt and nxt in "\"'":
            self.i += 1
            node = self.quoted()
            return Node("symbol" if node.kind == "string" else "interpolated_symbol", start, self.i, node.name, node.kids, open=":" + nxt)
        m = re.compile(rf":(@@?{IDENT.pattern}|\${IDENT.pattern}|\$.|{IDENT.pattern}(?:[?!](?!=[^=~>])|=(?![=~>]))?)").match(self.s, start)
        if not m:
            op = OPERATOR_NAME.match(self.s, start + 1)
            if not op:
                self.fail("unexpected `:`")
            self.i = op.end()
            return Node("symbol", start, self.i, op.group(), sel=op.span(), open=":")
        self.i = m.end()
        return Node("symbol", start, self.i, m.group(1), sel=m.span(1), open=":")

    # -- strings ----------------------------------------------------------------------

    def strings(self) -> Node:
        first = self.quoted()
        parts = [first]
        while first.kind in ("string", "interpolated_string"):
            at = self.i
            self.ws()
            if self.peek() and self.peek() in "\"'" and self.s[at : self.i + 1].strip("\\\r\n \t") in ('"', "'"):
                end = self.string_end(self.i)
                if end and self.s.startswith(":", end) and not self.s.startswith("::", end) and not self.ternaries:
                    self.i = at
                    break
                parts.append(self.quoted())
            else:
                self.i = at
                break
        if len(parts) == 1:
            return first
        return Node("interpolated_string", first.start, parts[-1].end, None, [("part", p) for p in parts], form="adjacent")

    def quoted(self) -> Node:
        start, quote = self.i, self.peek()
        self.i += 1
        kids, text = self.content(quote, quote, interpolates=quote != "'")
        kind = {"`": "x_string"}.get(quote, "interpolated_string" if any(r == "part" for r, _ in kids) else "string")
        return Node(kind, start, self.i, text, kids, open=quote, op=quote)

    def content(self, opener: str, closer: str, *, interpolates: bool, limit: int | None = None) -> tuple[list, str]:
        """Text up to the closer, or up to limit; interpolations as parts."""
        s, kids, begin, depth = self.s, [], self.i, 0
        out: list[str] = []
        stop = self.n if limit is None else limit
        mark = begin
        while self.i < stop:
            c = s[self.i]
            if c == "\\":
                self.i += 2
                continue
            if limit is None and c == closer and (opener == closer or depth == 0):
                out.append(s[mark : self.i])
                self.literal.append((mark, self.i))
                self.i += 1
                return kids, "".join(out)
            if opener != closer and limit is None:
                depth += (c == opener) - (c == closer)
            if c == "#" and interpolates and s.startswith("{", self.i + 1):
                out.append(s[mark : self.i])
                self.literal.append((mark, self.i))
                start = self.i
                self.i += 2
                saved = self.no_do, self.no_brace, self.in_list, self.ternaries, self.no_pipe
                self.no_do = self.no_brace = self.in_list = self.ternaries = self.no_pipe = 0
                body = self.statements((), "}")
                self.no_do, self.no_brace, self.in_list, self.ternaries, self.no_pipe = saved
                self.nl()
                self.expect("}")
                kids.append(("part", Node("embedded_statements", start, self.i, kids=[("body", b) for b in body], open="#{")))
                out.append(s[start : self.i])
                mark = self.i
                continue
            if c == "#" and interpolates and s[self.i + 1 : self.i + 2] in ("@", "$"):
                m = re.compile(r"#(@@?[^\W\d]\w*|\$[^\W\d]\w*)").match(s, self.i)
                if m:
                    out.append(s[mark : self.i])
                    self.literal.append((mark, self.i))
                    kind = "class_variable_read" if m[1].startswith("@@") else "global_variable_read" if m[1][0] == "$" else "instance_variable_read"
                    kids.append(("part", Node("embedded_variable", self.i, m.end(), m[1], [("body", Node(kind, m.start(1), m.end(), m[1], sel=m.span(1)))], open="#")))
                    out.append(m.group())
                    self.i = mark = m.end()
                    continue
            if c == "\n" and limit is None and self.i in self.skip:
                self.i = self.skip[self.i]
                continue
            self.i += 1
        if limit is not None:
            out.append(s[mark:stop])
            self.literal.append((mark, stop))
            self.i = stop
            return kids, "".join(out)
        self.i = begin
        self.fail("unterminated literal")

    def percent(self) -> Node:
        m = re.compile(r"%([wWiIqQrsx]?)([^\w\s])").match(self.s, self.i)
        if not m:
            self.fail("unexpected `%`")
        start, kind, opener = self.i, m[1], m[2]
        closer = CLOSERS.get(opener, opener)
        if kind == "r":
            return self.regexp(start, opener, 3)
        self.i = m.end()
        if kind in ("w", "W", "i", "I") and kind:
            begin = self.i
            kids, text = self.content(opener, closer, interpolates=kind in "WI")
            element = "string" if kind in "wW" else "symbol"
            parts = {k.start: k for _, k in kids}
            out, i, stop = [], begin, self.i - 1
            while i < stop:
                if self.s[i].isspace():
                    i += 1
                    continue
                word, inner = i, []
                while i < stop and not self.s[i].isspace():
                    if i in parts:
                        inner.append(("part", parts[i]))
                        i = parts[i].end
                    else:
                        i += 2 if self.s[i] == "\\" else 1
                out.append(("element", Node(("interpolated_" if inner else "") + element, word, i, self.s[word:i], inner, open="%")))
            return Node("array", start, self.i, text, out, open=m.group(), op=closer)
        kids, text = self.content(opener, closer, interpolates=kind not in ("q", "s"))
        base = {"x": "x_string", "s": "symbol"}.get(kind, "interpolated_string" if kids else "string")
        return Node(base, start, self.i, text, kids, open=m.group(), op=closer)

    def regexp(self, start: int, opener: str, width: int) -> Node:
        self.i = start + width
        kids, text = self.content(opener, CLOSERS.get(opener, opener), interpolates=True)
        m = re.compile(r"[mixounse]*").match(self.s, self.i)
        self.i = m.end()
        return Node("interpolated_regular_expression" if kids else "regular_expression", start, self.i, text, kids, open=self.s[start : start + width], op=m.group())

    def heredoc(self) -> Node | None:
        m = HEREDOC.match(self.s, self.i)
        if not m:
            return None
        start = self.i
        mode, quote, tag = m[1], m[2], m[3] or m[4]
        end = self.s.find("\n", m.end())
        if end < 0:
            self.fail("unterminated heredoc")
        begin = self.skip.get(end, end + 1)
        at = begin
        while True:
            if at >= self.n:
                self.fail("unterminated heredoc")
            stop = self.s.find("\n", at)
            stop = self.n if stop < 0 else stop
            line = self.s[at:stop].rstrip("\r")
            if (line.strip(" \t") if mode else line) == tag:
                break
            at = stop + 1
        after = min(stop + 1, self.n)
        if start not in self.seen:
            self.seen.add(start)
            self.literal.append((at, stop))
        self.skip[end] = after if stop < self.n else self.n
        self.i = begin
        kids, text = self.content("", "", interpolates=quote != "'", limit=at)
        self.i = m.end()
        return Node("x_string" if quote == "`" else "interpolated_string" if kids else "string", start, m.end(), text, kids, (begin, stop), op=tag, open=m.group(), form="heredoc")

    def hash(self) -> Node:
        start = self.i
        self.i += 1
        pairs = []
        saved = self.no_do, self.no_brace, self.in_list, self.ternaries, self.no_pipe
        self.no_do = self.no_brace = self.ternaries = self.no_pipe = 0
        self.in_list = 1
        while True:
            self.nl(False)
            if self.peek() == "}":
                break
            node = self.argument()
            if node.kind not in ("assoc", "assoc_splat"):
                self.fail("expected a pair")
            pairs.append(("element", node))
            self.nl(False)
            if self.peek() == ",":
                self.i += 1
                continue
            break
        self.no_do, self.no_brace, self.in_list, self.ternaries, self.no_pipe = saved
        self.nl(False)
        self.expect("}")
        return Node("hash", start, self.i, kids=pairs, open="{")

    def lambda_(self) -> Node:
        start = self.i
        self.i += 2
        self.ws()
        self.locals.append(set(self.locals[-1]))
        kids = []
        if self.peek() == "(":
            at = self.i
            self.i += 1
            params = self.parameters(")")
            self.expect(")")
            kids = [("params", Node("block_parameters", at, self.i, kids=params, open="("))]
        elif self.peek() and (IDENT.match(self.s, self.i) and not self.at_word("do") or self.peek() in "*&"):
            at = self.i
            params = self.parameters("{")
            kids = [("params", Node("block_parameters", at, params[-1][1].end, kids=params))]
        self.ws()
        if self.peek() == "{":
            block = self.block("{", "}")
        elif self.at_word("do"):
            block = self.block("do", "end")
        else:
            self.fail("expected a lambda body")
        self.locals.pop()
        return Node("lambda", start, block.end, None, kids + block.kids, (start, start + 2), open=block.open)

    # -- keywords ---------------------------------------------------------------------

    def keyword(self, word: str) -> Node:
        start = self.i
        sel = (start, start + len(word))
        if word in ("nil", "true", "false", "self", "redo", "retry", "__FILE__", "__LINE__", "__ENCODING__"):
            self.i = sel[1]
            return Node(word.strip("_").lower() if word.startswith("__") else word, start, self.i, word, sel=sel)
        if word in ("if", "unless"):
            return self.if_(word)
        if word in ("while", "until"):
            self.i = sel[1]
            self.no_do += 1
            cond = self.expression_statement()
            self.no_do -= 1
            mark = self.do_or_line()
            body = self.statements(("end",))
            end = self.expect_word("end")
            return Node(word, start, end[1], None, [("cond", cond), *(("body", b) for b in body), *mark], sel)
        if word == "for":
            self.i = sel[1]
            self.ws()
            targets = []
            while True:
                self.ws()
                item = self.mlhs_item()
                if item is None:
                    self.fail("expected a loop variable")
                targets.append(("target", self.as_target(item)))
                self.ws()
                if self.peek() != ",":
                    break
                self.i += 1
            self.expect_word("in")
            self.no_do += 1
            value = self.expression_statement()
            self.no_do -= 1
            self.do_or_line()
            body = self.statements(("end",))
            end = self.expect_word("end")
            return Node("for", start, end[1], None, [*targets, ("value", value), *(("body", b) for b in body)], sel)
        if word == "case":
            return self.case()
        if word == "begin":
            self.i = sel[1]
            kids = self.body(("end",))
            end = self.expect_word("end")
            return Node("begin", start, end[1], None, kids, sel)
        if word == "def":
            return self.def_()
        if word == "class":
            return self.class_()
        if word == "module":
            self.i = sel[1]
            self.ws()
            path = self.constant()
            self.locals.append(set())
            body = self.body(("end",))
            self.locals.pop()
            end = self.expect_word("end")
            return Node("module", start, end[1], path.name, [("path", path), *body], sel)
        if word in ("return", "break", "next"):
            self.i = sel[1]
            args = self.command_arguments() if self.has_value() else []
            return Node(word, start, args[-1][1].end if args else self.i, None, args, sel)
        if word == "yield":
            self.i = sel[1]
            if self.peek() == "(":
                self.i += 1
                args = self.arguments(")")
                return Node("yield", start, self.i, None, args, sel, open="(")
            args = self.command_arguments() if self.begins_argument(None) and not self.s.startswith("[", SPACE.match(self.s, self.i).end()) else []
            return Node("yield", start, args[-1][1].end if args else self.i, None, args, sel, form="command" if args else None)
        if word == "super":
            self.i = sel[1]
            if self.peek() == "(":
                self.i += 1
                args = self.arguments(")")
                return Node("super", start, self.i, None, args, sel, open="(")
            if self.begins_argument(None):
                args = self.command_arguments()
                return Node("super", start, args[-1][1].end, None, args, sel, form="command")
            return Node("forwarding_super", start, self.i, None, [], sel)
        if word == "alias":
            self.i = sel[1]
            self.ws()
            new = self.bare_name()
            self.ws()
            old = self.bare_name()
            return Node("alias", start, old.end, new.name, [("new", new), ("old", old)], sel)
        if word == "undef":
            self.i = sel[1]
            names = []
            while True:
                self.ws()
                names.append(("name", self.bare_name()))
                at = self.i
                self.ws()
                if self.peek() != ",":
                    self.i = at
                    break
                self.i += 1
            return Node("undef", start, names[-1][1].end, None, names, sel)
        if word in ("BEGIN", "END"):
            self.i = sel[1]
            self.ws()
            self.expect("{")
            body = self.statements((), "}")
            self.nl()
            self.expect("}")
            return Node("pre_execution" if word == "BEGIN" else "post_execution", start, self.i, None, [("body", b) for b in body], sel)
        if word == "defined?":
            return self.defined_or(0)
        if word == "not":
            return self.not_expression()
        self.fail(f"unexpected `{word}`")

    def has_value(self) -> bool:
        at = self.i
        self.ws()
        ok = self.i < self.n and self.peek() not in "\n;)}]#|&,:." and not self.at_word("if", "unless", "while", "until", "end", "and", "or", "rescue", "do", "then", "in") and not (self.peek() in "=?" and self.peek(2) != "?x")
        ok = ok or self.peek(2) == "::" or self.peek() == ":" and self.s[self.i + 1 : self.i + 2].strip() != "" and not self.ternaries
        self.i = at
        return bool(ok)

    def do_or_line(self) -> list:
        self.ws()
        if self.at_word("do"):
            self.i += 2
            return [("do", token(self.i - 2, self.i, "do"))]
        return []

    def then(self) -> tuple[int, int] | None:
        """The then, if there is one."""
        self.nl()
        if self.at_word("then"):
            self.i += 4
            return self.i - 4, self.i
        return None

    def if_(self, word: str) -> Node:
        start = self.i
        sel = (start, start + len(word))
        self.i = sel[1]
        saved = self.no_do, self.in_list, self.ternaries, self.no_pipe
        self.no_do = self.in_list = self.ternaries = self.no_pipe = 0
        self.nl(False)
        cond = self.expression_statement()
        then = self.then()
        body = self.statements(("elsif", "else", "end"))
        kids = [("cond", cond), *(("body", b) for b in body)]
        form = None
        if self.at_word("elsif"):
            form = "has_elsif"
            inner = self.if_("elsif")
            kids.append(("else", inner))
            end = inner.end
            if word != "elsif":
                end = self.expect_word("end")[1]
        elif self.at_word("else"):
            at = self.i
            self.i += 4
            other = self.statements(("end",))
            kids.append(("else", Node("else", at, other[-1].end if other else at + 4, None, [("body", b) for b in other], (at, at + 4))))
            self.nl()
            end = self.i if word == "elsif" else self.expect_word("end")[1]
        else:
            self.nl()
            end = self.i if word == "elsif" else self.expect_word("end")[1]
        if word == "elsif":
            end = max([k.end for _, k in kids])
        self.no_do, self.in_list, self.ternaries, self.no_pipe = saved
        if then:
            kids.append(("then", token(*then, "then")))
        return Node("if" if word != "unless" else "unless", start, end, None, kids, sel, op="then" if then else None, open=word, form="elsif" if word == "elsif" else form)

    def case(self) -> Node:
        start = self.i
        self.i += 4
        at = self.i
        kids = []
        saved = self.no_do, self.in_list, self.ternaries, self.no_pipe
        self.no_do = self.in_list = self.ternaries = self.no_pipe = 0
        self.ws()
        if self.peek() not in "\n;#":
            kids.append(("value", self.expression_statement()))
        else:
            self.i = at
        self.nl()
        kind = "case"
        while self.at_word("when"):
            begin, count = self.i, len(self.comments)
            self.i += 4
            conds = []
            while True:
                self.nl(False)
                conds.append(("cond", self.value_item()))
                at = self.i
                self.ws()
                if self.peek() != ",":
                    self.i = at
                    break
                self.i += 1
            semi = self.i
            self.ws()
            semi = self.i if self.peek() == ";" else None
            then = self.then()
            body = self.statements(("when", "else", "end"))
            end = body[-1].end if body else conds[-1][1].end
            mark = [("then", token(*then, "then"))] if then else [("then", token(semi, semi + 1, ";"))] if semi else []
            kids.append(("when", Node("when", begin, end, None, [*conds, *(("body", b) for b in body), *mark], (begin, begin + 4), form=self.commented(body, count))))
        while self.at_word("in"):
            kind = "case_match"
            begin, count = self.i, len(self.comments)
            self.i += 2
            self.ws()
            pattern = self.pattern_top()
            guard = []
            self.ws()
            if self.at_word("if", "unless"):
                self.i += len(self.word())
                guard = [("guard", self.expression_statement())]
            self.ws()
            semi = self.i if self.peek() == ";" else None
            then = self.then()
            body = self.statements(("in", "else", "end"))
            end = body[-1].end if body else pattern.end
            mark = [("then", token(*then, "then"))] if then else [("then", token(semi, semi + 1, ";"))] if semi else []
            kids.append(("in", Node("in", begin, end, None, [("pattern", pattern), *guard, *(("body", b) for b in body), *mark], (begin, begin + 2), form=self.commented(body, count))))
        if self.at_word("else"):
            at = self.i
            self.i += 4
            other = self.statements(("end",))
            kids.append(("else", Node("else", at, other[-1].end if other else at + 4, None, [("body", b) for b in other], (at, at + 4))))
        end = self.expect_word("end")[1]
        self.no_do, self.in_list, self.ternaries, self.no_pipe = saved
        return Node(kind, start, end, None, kids, (start, start + 4))

    def commented(self, body: list[Node], count: int) -> str | None:
        """Whether an empty body holds a comment, of which there were count before."""
        return "commented" if not body and len(self.comments) > count else None

    def body(self, stops: tuple[str, ...]) -> list:
        """Statements with rescue, else and ensure clauses."""
        kids = [("body", b) for b in self.statements(("rescue", "else", "ensure", *stops))]
        while self.at_word("rescue"):
            begin, count = self.i, len(self.comments)
            self.i += 6
            classes, parts = [], []
            self.ws()
            while self.peek() not in "\n;#" and not self.at_word("then") and not self.s.startswith("=>", self.i):
                classes.append(("class", self.value_item()))
                self.ws()
                if self.peek() != ",":
                    break
                self.i += 1
                self.nl(False)
            self.ws()
            end = classes[-1][1].end if classes else begin + 6
            if self.s.startswith("=>", self.i):
                self.i += 2
                self.ws()
                target = self.mlhs_item()
                if target is None:
                    self.fail("expected a variable")
                parts.append(("target", self.as_target(target)))
                end = self.i
            self.then()
            body = self.statements(("rescue", "else", "ensure", *stops))
            end = body[-1].end if body else end
            kids.append(("rescue", Node("rescue", begin, end, None, [*classes, *parts, *(("body", b) for b in body)], (begin, begin + 6), form=self.commented(body, count))))
        for word in ("else", "ensure"):
            if self.at_word(word):
                begin, count = self.i, len(self.comments)
                self.i += len(word)
                body = self.statements(("ensure", *stops) if word == "else" else stops)
                kids.append((word, Node(word, begin, body[-1].end if body else begin + len(word), None, [("body", b) for b in body], (begin, begin + len(word)), form=self.commented(body, count))))
        return kids

    def constant(self) -> Node:
        start = self.i
        if self.peek(2) == "::":
            self.i += 2
        m = IDENT.match(self.s, self.i)
        if not m or not m.group()[0].isupper():
            self.fail("expected a constant")
        self.i = m.end()
        node = Node("constant_read", start, self.i, m.group(), sel=m.span()) if start == m.start() else Node("constant_path", start, self.i, m.group(), [], m.span(), open="::")
        while self.peek(2) == "::":
            self.i += 2
            m = IDENT.match(self.s, self.i)
            if not m:
                self.fail("expected a constant")
            self.i = m.end()
            node = Node("constant_path", start, self.i, m.group(), [("parent", node)], m.span())
        return node

    def class_(self) -> Node:
        start = self.i
        self.i += 5
        self.ws()
        if self.peek(2) == "<<":
            self.i += 2
            self.ws()
            target = self.expression()
            self.locals.append(set())
            body = self.body(("end",))
            self.locals.pop()
            end = self.expect_word("end")
            return Node("singleton_class", start, end[1], None, [("value", target), *body], (start, start + 5))
        path = self.constant()
        kids = [("path", path)]
        self.ws()
        if self.peek() == "<":
            self.i += 1
            self.ws()
            kids.append(("superclass", self.expression()))
        self.locals.append(set())
        body = self.body(("end",))
        self.locals.pop()
        end = self.expect_word("end")
        return Node("class", start, end[1], path.name, kids + body, (start, start + 5))

    def bare_name(self) -> Node:
        start = self.i
        if self.peek() == ":":
            return self.symbol()
        if self.peek() == "$":
            return self.primary()
        m = SETTER.match(self.s, start) or METHOD.match(self.s, start) or OPERATOR_NAME.match(self.s, start)
        if not m:
            self.fail("expected a method name")
        self.i = m.end()
        return Node("symbol", start, self.i, m.group(), sel=m.span(), open="bare")

    def def_(self) -> Node:
        start = self.i
        sel = (start, start + 3)
        self.i += 3
        self.ws()
        kids = []
        m = re.compile(r"(self|[^\W\d]\w*|@\w+)(\.|::)(?=[^\W\d]|[\[+\-*/%<>=~!&|^])").match(self.s, self.i)
        op = None
        if m:
            word, op = m[1], m[2]
            kind = "self" if word == "self" else "constant_read" if word[0].isupper() else "instance_variable_read" if word[0] == "@" else "local_variable_read"
            kids.append(("recv", Node(kind, m.start(1), m.end(1), word, sel=m.span(1))))
            self.i = m.end()
        name = re.compile(r"[^\W\d]\w*=(?=\(|[ ]\()").match(self.s, self.i) or re.compile(r"[^\W\d]\w*=(?![=~>\s])(?=[a-z_*&])").match(self.s, self.i) or re.compile(r"[^\W\d]\w*[?!]?").match(self.s, self.i) or OPERATOR_NAME.match(self.s, self.i)
        if not name:
            self.fail("expected a method name")
        if name.group()[-1] == "=" and name.group()[0].isalpha() and re.compile(r"=\(").search(self.s, name.end() - 1, name.end() + 1) is None and self.s[name.end() : name.end() + 1] == " ":
            pass
        self.i = name.end()
        self.locals.append(set())
        saved = self.no_do, self.no_brace, self.in_list, self.ternaries, self.no_pipe
        self.no_do = self.no_brace = self.in_list = self.ternaries = self.no_pipe = 0
        at = self.i
        self.ws()
        if self.peek() == "(":
            begin = self.i
            self.i += 1
            params = self.parameters(")")
            self.expect(")")
            kids.append(("params", Node("parameters", begin, self.i, kids=params, open="(")))
        elif self.i > at and self.peek() not in "\n;#=" and self.i < self.n:
            begin = self.i
            params = self.parameters("\n")
            kids.append(("params", Node("parameters", begin, params[-1][1].end if params else begin, kids=params)))
        self.ws()
        if self.peek() == "=" and self.peek(2) not in ("==", "=~", "=>"):
            self.i += 1
            self.nl(False)
            body = self.expression()
            self.locals.pop()
            self.no_do, self.no_brace, self.in_list, self.ternaries, self.no_pipe = saved
            return Node("def", start, body.end, name.group(), [*kids, ("body", body)], name.span(), op, form="endless")
        kids += self.body(("end",))
        self.locals.pop()
        self.no_do, self.no_brace, self.in_list, self.ternaries, self.no_pipe = saved
        end = self.expect_word("end")
        return Node("def", start, end[1], name.group(), kids, name.span(), op)

    def parameters(self, closer: str) -> list:
        out = []
        scope = self.locals[-1]
        skip: Callable[[], object] = (lambda: self.nl(False)) if closer in ")|" else self.ws
        saved, self.in_list = self.in_list, 1
        while True:
            skip()
            start, c = self.i, self.peek()
            if not c or self.s.startswith(closer, self.i) or closer == "{" and self.at_word("do") or closer == "\n" and c in ";#":
                break
            if c == ";" and closer in "|)":
                self.i += 1
                while True:
                    self.nl(False)
                    m = IDENT.match(self.s, self.i)
                    if not m:
                        break
                    scope.add(m.group())
                    out.append(("param", Node("block_local_variable", m.start(), m.end(), m.group(), sel=m.span())))
                    self.i = m.end()
                    self.nl(False)
                    if self.peek() == ",":
                        self.i += 1
                break
            if self.peek(3) == "...":
                self.i += 3
                out.append(("param", Node("forwarding_parameter", start, self.i, "...")))
            elif c == "*" or c == "&":
                mark = "**" if self.peek(2) == "**" else c
                self.i += len(mark)
                m = IDENT.match(self.s, self.i)
                kind = {"*": "rest_parameter", "**": "keyword_rest_parameter", "&": "block_parameter"}[mark]
                name = m.group() if m else None
                if m:
                    self.i = m.end()
                    if mark == "**" and name == "nil":
                        kind = "no_keywords_parameter"
                    scope.add(name)
                out.append(("param", Node(kind, start, self.i, name, sel=m.span() if m else None, open=mark)))
            elif c == "(":
                self.i += 1
                inner = self.parameters(")")
                self.expect(")")
                out.append(("param", Node("multi_target", start, self.i, kids=inner, open="(")))
            else:
                m = IDENT.match(self.s, self.i)
                if not m:
                    self.fail("expected a parameter")
                name = m.group()
                self.i = m.end()
                known = "shadows" if name in scope else None
                scope.add(name)
                if self.peek() == ":" and self.peek(2) != "::":
                    self.i += 1
                    at = self.i
                    self.ws()
                    if self.peek() in (",", ")", "|", "\n", ";", "") or closer == "{" and self.peek() == "{":
                        self.i = at
                        out.append(("param", Node("required_keyword_parameter", start, at, name, sel=m.span())))
                    else:
                        value = self.ternary()
                        out.append(("param", Node("optional_keyword_parameter", start, value.end, name, [("value", value)], m.span())))
                else:
                    at = self.i
                    self.ws()
                    if self.peek() == "=" and self.peek(2) not in ("==", "=~"):
                        self.i += 1
                        self.ws()
                        value = self.ternary()
                        out.append(("param", Node("optional_parameter", start, value.end, name, [("value", value)], m.span())))
                    else:
                        self.i = at
                        out.append(("param", Node("required_parameter", start, at, name, sel=m.span(), form=known)))
            skip()
            if self.peek() == ",":
                self.i += 1
                if closer == "\n":
                    self.nl(False)
                continue
            if self.peek() == ";" and closer in "|)":
                continue
            break
        skip()
        self.in_list = saved
        return out

    # -- patterns ---------------------------------------------------------------------

    def pattern_top(self) -> Node:
        m = METHOD.match(self.s, self.i)
        if m and self.s.startswith(":", m.end()) and not self.s.startswith("::", m.end()) or self.peek(2) == "**":
            return self.pattern_hash("", self.i)
        first = self.pattern()
        items = [first]
        while True:
            at = self.i
            self.ws()
            if self.peek() != ",":
                self.i = at
                break
            self.i += 1
            self.ws()
            if self.peek() in "\n;" or self.at_word("then", "if", "unless"):
                break
            items.append(self.pattern())
        if len(items) == 1 and first.kind != "splat":
            return first
        return Node("array_pattern", first.start, items[-1].end, kids=[("element", k) for k in items])

    def pattern(self) -> Node:
        left = self.pattern_value()
        while True:
            at = self.i
            self.ws()
            if self.peek() == "|" and self.peek(2) != "||":
                self.i += 1
                self.nl(False)
                right = self.pattern_value()
                left = Node("alternation_pattern", left.start, right.end, kids=[("left", left), ("right", right)])
            elif self.s.startswith("=>", self.i):
                self.i += 2
                self.ws()
                m = IDENT.match(self.s, self.i)
                if not m:
                    self.fail("expected a variable")
                self.i = m.end()
                self.locals[-1].add(m.group())
                left = Node("capture_pattern", left.start, self.i, m.group(), [("value", left)])
            else:
                self.i = at
                return left

    def pattern_value(self) -> Node:
        self.ws()
        start, c = self.i, self.peek()
        if c == "[":
            self.i += 1
            return Node("array_pattern", start, *self.pattern_items("]", start))
        if c == "{":
            self.i += 1
            return self.pattern_hash("}", start)
        if c == "*":
            self.i += 1
            m = IDENT.match(self.s, self.i)
            if m:
                self.i = m.end()
                self.locals[-1].add(m.group())
            return Node("splat", start, self.i, m.group() if m else None)
        if c == "^":
            self.i += 1
            inner = self.primary()
            return Node("pinned", start, inner.end, kids=[("value", inner)])
        if c == "(":
            self.i += 1
            self.nl(False)
            inner = self.pattern()
            self.nl(False)
            self.expect(")")
            return Node("parentheses", start, self.i, kids=[("body", inner)], open="(")
        m = IDENT.match(self.s, self.i)
        if m and m.group() not in KEYWORDS and not m.group()[0].isupper() and self.s[m.end() : m.end() + 1] not in (".", "(", "?", "!"):
            self.i = m.end()
            self.locals[-1].add(m.group())
            return Node("local_variable_target", start, self.i, m.group(), sel=m.span())
        if m and m.group()[0].isupper() or self.peek(2) == "::":
            path = self.constant()
            if self.peek() in ("(", "["):
                closer = ")" if self.peek() == "(" else "]"
                self.i += 1
                at = self.i
                self.nl(False)
                m = METHOD.match(self.s, self.i)
                if m and self.s.startswith(":", m.end()) and not self.s.startswith("::", m.end()):
                    inner = self.pattern_hash(closer, start)
                    return Node("hash_pattern", start, self.i, path.name, [("path", path), *inner.kids])
                self.i = at
                end, _, _, kids = self.i, None, None, None
                end, name, kids = self.pattern_items(closer, start)
                return Node("array_pattern", start, end, path.name, [("path", path), *kids])
            at = self.i
            if self.peek(2) == "..":
                self.i = start
                pipe, self.no_pipe = self.no_pipe, 1
                node = self.binary(0)
                self.no_pipe = pipe
                return node
            self.i = at
            return path
        pipe, self.no_pipe = self.no_pipe, 1
        node = self.defined_or(0)
        self.no_pipe = pipe
        return node

    def pattern_items(self, closer: str, start: int) -> tuple[int, None, list]:
        kids = []
        while True:
            self.nl(False)
            if self.s.startswith(closer, self.i):
                break
            kids.append(("element", self.pattern()))
            self.nl(False)
            if self.peek() != ",":
                break
            self.i += 1
        self.nl(False)
        self.expect(closer)
        return self.i, None, kids

    def pattern_hash(self, closer: str, start: int) -> Node:
        kids = []
        while True:
            self.nl(False) if closer else self.ws()
            if closer and self.s.startswith(closer, self.i):
                break
            at = self.i
            if self.peek(2) == "**":
                self.i += 2
                m = IDENT.match(self.s, self.i)
                if m:
                    self.i = m.end()
                    self.locals[-1].add(m.group())
                kids.append(("element", Node("assoc_splat", at, self.i, m.group() if m else None)))
            else:
                m = METHOD.match(self.s, self.i)
                if not m or not self.s.startswith(":", m.end()):
                    self.fail("expected a key")
                self.i = m.end() + 1
                key = Node("symbol", at, self.i, m.group(), sel=m.span(), open="label")
                self.ws()
                if self.peek() in (",", closer[:1] or "\n", "\n", ";", "") or self.at_word("then", "if", "unless", "and", "or"):
                    self.locals[-1].add(m.group())
                    kids.append(("element", Node("assoc", at, key.end, m.group(), [("key", key)], form="shorthand", open="label")))
                else:
                    value = self.pattern()
                    kids.append(("element", Node("assoc", at, value.end, m.group(), [("key", key), ("value", value)], open="label")))
            mark = self.i
            self.nl(False) if closer else self.ws()
            if self.peek() != ",":
                if not closer:
                    self.i = mark
                break
            self.i += 1
        if closer:
            self.nl(False)
            self.expect(closer)
        return Node("hash_pattern", start, self.i, kids=kids)


def parse(text: str) -> tuple[Node, Parser]:
    """The tree of a text, and the parser with its comments and literal ranges."""
    parser = Parser(text)
    try:
        return parser.program(), parser
    except RecursionError:
        raise ParseError(parser.i, "nested too deeply") from None
    except IndexError:
        raise ParseError(min(parser.i, parser.n), "unexpected end of text") from None
