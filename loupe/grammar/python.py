"""Python: tokens, indentation and statements, tolerant of fragments."""

from __future__ import annotations

import re

from .base import Node, Query, Token, either, enclosing, fields, kinds, nest

_PREFIX = r"(?i:rb|br|fr|rf|tr|rt|[rbfut])?"
_LEX = re.compile(
    rf"""(?P<comment>\#[^\n]*)|(?P<string>{_PREFIX}(?:\"\"\"|'''|"|'))|(?P<ident>[^\W\d]\w*)|(?P<number>\d[\w.]*)
    |(?P<join>\\\r?\n)|(?P<newline>\n)|(?P<space>[ \t\r\f]+)|(?P<punct>->|:=|\*\*|//|[<>=!+\-*/%&|^@]=|\.\.\.|.)""",
    re.X | re.S,
)
KEYWORDS = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global if import in is
    lambda nonlocal not or pass raise return try while with yield""".split()
)


class Parser:
    def __init__(self, source: str, base: int = 0):
        self.source = source
        self.nodes: list[Node] = []
        self.t: list[Token] = []
        self.lex(0, len(source), None)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, x in enumerate(self.t):
            if x.kind == "punct" and x.text in "([{":
                stack.append(i)
            elif x.kind == "punct" and x.text in ")]}" and stack:
                a = stack.pop()
                self.match[a], self.match[i] = i, a
        self.around = enclosing(self.match, len(self.t))
        self.field: dict[tuple[int, int], str] = {}
        self.soft: set[int] = set()  # where match, case and type are keywords

    def lex(self, at: int, end: int, close: str | None) -> int:
        depth = 0
        while at < end:
            m = _LEX.match(self.source, at, end)
            kind = m.lastgroup
            if kind == "string":
                at = self.string(m.start(), m.end(), end)
                continue
            if kind == "comment":
                self.nodes.append(Node("comment", m.start(), m.end()))
            elif kind in ("ident", "number", "punct", "newline"):
                x = m.group()
                if close and depth == 0 and x in ("}", ":", "!") and not (x == ":" and self.source.startswith("=", m.end())):
                    return at
                depth += (x in "([{") - (x in ")]}") if kind == "punct" else 0
                self.t.append(Token(kind, m.start(), m.end(), x))
            at = m.end()
        return end

    def string(self, start: int, at: int, end: int) -> int:
        """Lex a string whose opening quotes end at `at`; interpolations are lexed as code."""
        head = self.source[start:at]
        quotes = head.lstrip("rRbBfFuUtT")
        prefix = head[: len(head) - len(quotes)].lower()
        formatted, content = "f" in prefix or "t" in prefix, at
        whole = Token("string", start, at, head)
        self.t.append(whole)
        self.nodes.append(Node("string_start", start, at))

        def piece(b: int) -> None:
            if b > content:
                self.nodes.append(Node("string_content", content, b))

        while at < end:
            c = self.source[at]
            if c == "\\":
                at += 2
            elif self.source.startswith(quotes, at):
                piece(at)
                self.nodes.append(Node("string_end", at, at + len(quotes)))
                at += len(quotes)
                break
            elif c == "\n" and len(quotes) == 1:
                piece(at)
                break
            elif formatted and c == "{" and not self.source.startswith("{{", at):
                piece(at)
                b = self.lex(at + 1, end, "}")
                depth = 1
                while b < end and depth:
                    depth += (self.source[b] == "{") - (self.source[b] == "}")
                    b += 1
                self.nodes.append(Node("interpolation", at, b))
                at = content = b
            elif formatted and self.source.startswith(("{{", "}}"), at):
                at += 2
            else:
                at += 1
        else:
            piece(end)
        whole.end = min(at, end)
        self.nodes.append(Node("string", start, whole.end))
        return whole.end

    # Statements: lines joined over brackets, with their column

    def lines(self) -> list[tuple[int, int, int]]:
        out, first, i = [], None, 0
        while i < len(self.t):
            x = self.t[i]
            if x.kind == "newline":
                if first is not None:
                    out.append((first, i))
                first = None
                i += 1
                continue
            if first is None:
                first = i
            i = self.match.get(i, i) + 1 if x.text in ("(", "[", "{") and x.kind == "punct" else i + 1
        if first is not None:
            out.append((first, len(self.t)))
        result = []
        for a, b in out:
            begin = self.t[a].start
            column = len(self.source[self.source.rfind("\n", 0, begin) + 1 : begin].expandtabs(8))
            result.append((a, b, column))
        return result

    def add(self, kind: str, start: int, end: int, name: str | None = None) -> Node:
        n = Node(kind, start, end, name)
        self.nodes.append(n)
        return n

    def at_level(self, a: int, b: int, *texts: str) -> int:
        """First token of [a, b) with one of the texts outside brackets, or b."""
        while a < b:
            if self.t[a].kind == "punct" and self.t[a].text in texts:
                return a
            a = self.match.get(a, a) + 1 if self.t[a].kind == "punct" and self.t[a].text in "([{" else a + 1
        return b

    def tree(self) -> Node:
        lines = self.lines()
        ends = [0] * len(lines)  # end of the last line under each line
        for n in range(len(lines) - 1, -1, -1):
            k, end = n + 1, self.t[lines[n][1] - 1].end
            while k < len(lines) and lines[k][2] > lines[n][2]:
                end, k = max(end, ends[k]), k + 1
            ends[n] = end
        for n, (a, b, column) in enumerate(lines):
            self.line(n, a, b, column, lines, ends)
        for i in range(len(self.t)):
            self.expression(i)
        for x in self.t:
            if x.kind == "ident" and x.text not in KEYWORDS and x.start not in self.soft:
                self.nodes.append(Node("identifier", x.start, x.end, self.field.get((x.start, x.end))))
        for node in self.nodes:
            node.field = self.field.get((node.start, node.end), node.field)
        rank = {"module": 0, "decorated_definition": 1, "block": 2, "expression_statement": 3, "assignment": 4, "type": 5}
        self.nodes.sort(key=lambda x: rank.get(x.kind, 9))
        return nest(self.nodes, Node("module", 0, len(self.source)))

    def line(self, n: int, a: int, b: int, column: int, lines, ends) -> None:
        t = self.t
        first = t[a].text if t[a].kind in ("ident", "punct") else ""
        start, end = t[a].start, t[b - 1].end
        i = a + 1 if first == "async" else a
        word = t[i].text if i < b else ""
        if word in ("def", "class") and i + 1 < b:
            kind = "function_definition" if word == "def" else "class_definition"
            self.add(kind, start, ends[n])
            self.field[(t[i + 1].start, t[i + 1].end)] = "name"
            colon = self.at_level(i, b, ":")
            if word == "def":
                self.signature(i + 2, colon)
            self.block(n, colon, b, lines, ends)
            k = n - 1
            while k >= 0 and lines[k][2] == column and t[lines[k][0]].text == "@":
                k -= 1
            if k + 1 < n:
                self.add("decorated_definition", t[lines[k + 1][0]].start, ends[n])
                self.field[(start, ends[n])] = "definition"
            return
        if first in ("match", "case") and b > a + 1 and t[b - 1].text == ":" and self.at_level(a, b, "=", ":") == b - 1:
            self.soft.add(start)
            if first == "case" and t[a + 1].text == "_":
                self.soft.add(t[a + 1].start)
            self.block(n, b - 1, b, lines, ends)
            return
        if first == "@":
            self.add("decorator", start, end)
            return
        if word in ("with", "try", "if", "for", "while"):
            kind = {"with": "with_statement", "try": "try_statement", "if": "if_statement", "for": "for_statement", "while": "while_statement"}[word]
            k, last = n + 1, ends[n]
            rest = {"try": ("except", "else", "finally"), "if": ("elif", "else"), "for": ("else",), "while": ("else",)}.get(word, ())
            while k < len(lines) and lines[k][2] >= column:
                if lines[k][2] == column:
                    if t[lines[k][0]].text not in rest:
                        break
                    last = ends[k]
                k += 1
            self.add(kind, start, last)
            self.block(n, self.at_level(i, b, ":"), b, lines, ends)
            return
        if word in ("elif", "else", "except", "finally"):
            self.block(n, self.at_level(i, b, ":"), b, lines, ends)
            return
        if word in ("import", "from"):
            self.imports(a, b, start, end)
            return
        if word in KEYWORDS - {"None", "True", "False", "not", "lambda", "await", "yield"}:
            return
        # expression statements, one for each semicolon
        while a < b:
            stop = self.at_level(a, b, ";")
            if a < stop:
                self.add("expression_statement", t[a].start, t[stop - 1].end)
                self.assignment(a, stop)
            a = stop + 1

    def block(self, n: int, colon: int, b: int, lines, ends) -> None:
        if colon + 1 < b:
            self.add("block", self.t[colon + 1].start, self.t[b - 1].end)
        elif n + 1 < len(lines) and lines[n + 1][2] > lines[n][2]:
            self.add("block", self.t[lines[n + 1][0]].start, ends[n])

    def signature(self, i: int, colon: int) -> None:
        """Type hints of parameters and of the result."""
        t = self.t
        if i < colon and t[i].text == "[":
            i = self.match.get(i, i) + 1
        if i < colon and t[i].text == "(":
            a, b = i + 1, self.match.get(i, colon)
            while a < b:
                stop = self.at_level(a, b, ",")
                hint = self.at_level(a, stop, ":")
                if hint + 1 < stop:
                    self.add("type", t[hint + 1].start, t[self.at_level(hint, stop, "=") - 1].end)
                a = stop + 1
            i = b + 1
        if i + 1 < colon and t[i].text == "->":
            self.add("type", t[i + 1].start, t[colon - 1].end)

    def assignment(self, a: int, b: int) -> None:
        t = self.t
        equal = self.at_level(a, b, "=")
        colon = self.at_level(a, equal, ":")
        if colon == b:
            return
        self.add("assignment", t[a].start, t[b - 1].end)
        if min(equal, colon) == a + 1 and t[a].kind == "ident":
            self.field[(t[a].start, t[a].end)] = "left"
        if colon < equal and colon + 1 < equal:
            self.add("type", t[colon + 1].start, t[equal - 1].end)
        if equal < b and self.at_level(equal + 1, b, "=") < b:
            self.assignment(equal + 1, b)

    def imports(self, a: int, b: int, start: int, end: int) -> None:
        t = self.t
        if t[a].text == "from":
            kind = "import_from_statement"
            at = next((k for k in range(a, b) if t[k].text == "import"), b)
            if a + 1 < at:
                dots = t[a + 1].text.startswith(".")
                span = (t[a + 1].start, t[at - 1].end)
                self.add("relative_import" if dots else "dotted_name", *span)
                self.field[span] = "module_name"
        else:
            kind, at = "import_statement", a
        self.add(kind, start, end)
        i = at + 1
        while i < b:
            while i < b and t[i].text in ("(", ")", ","):
                i += 1
            j = i
            while j < b and (t[j].kind == "ident" and t[j].text != "as" or t[j].text == "."):
                j += 1
            if j == i:
                i += 1
                continue
            alias = j < b and t[j].text == "as"
            span = (t[i].start, t[j - 1].end)
            self.add("dotted_name", *span)
            if alias:
                whole = (t[i].start, t[min(j + 1, b - 1)].end)
                self.add("aliased_import", *whole)
                self.field[whole] = "name"
                j += 2
            self.field.setdefault(span, "name")
            i = j

    def expression(self, i: int) -> None:
        t = self.t
        x = t[i]
        if x.text == "lambda" and x.kind == "ident":
            end = min(self.closing(i), self.at_level(i, len(t), ",", ";"))
            newline = i
            while newline < end and t[newline].kind != "newline":
                newline = self.match.get(newline, newline) + 1 if t[newline].text in ("(", "[", "{") else newline + 1
            self.add("lambda", x.start, t[(newline if not self.inside(i) else end) - 1].end)
        elif x.kind == "ident" and x.text not in KEYWORDS and i + 1 < len(t) and t[i + 1].text == "(" and t[i + 1].kind == "punct":
            before = t[i - 1].text if i else ""
            if before not in (".", "def", "class"):
                close = self.match.get(i + 1, i + 1)
                self.add("call", x.start, t[close].end)
                self.field[(x.start, x.end)] = "function"

    def closing(self, i: int) -> int:
        around = self.around[i]
        return self.match[around] if around >= 0 else len(self.t)

    def inside(self, i: int) -> bool:
        return self.around[i] >= 0


def parse(source: str) -> Node:
    return Parser(source).tree()


def _docstring(n: Node, s: str) -> bool:
    p = n.parent
    return (
        p is not None and p.kind == "string" and p.children[0].text(s) == '"""' and p.parent is not None
        and p.parent.kind == "expression_statement" and (p.parent.start, p.parent.end) == (p.start, p.end)
    )


def _left(n: Node) -> bool:
    return n.kind == "identifier" and n.field == "left"


def _method(n: Node, s: str) -> bool:
    block = n.parent
    return block is not None and block.kind == "block" and block.parent is not None and block.parent.kind == "class_definition"


def _decorated(name: str):
    def test(n: Node, s: str) -> bool:
        p = n.parent
        return (
            n.kind == "function_definition" and p is not None and p.kind == "decorated_definition"
            and any(c.kind == "decorator" and c.text(s)[1:].strip() == name for c in p.children)
        )

    return test


def _global(n: Node, s: str) -> bool:
    a = n.parent
    return _left(n) and a.kind == "assignment" and a.parent.kind == "expression_statement" and a.parent.parent.kind == "module"


QUERIES: dict[str, Query] = {
    "comments": kinds("comment"),
    "strings": kinds("string_content"),
    "imports": kinds("dotted_name", "relative_import", where=lambda n, s: n.field in ("name", "module_name") and not (n.parent.kind == "import_from_statement" and n.field == "name") and not (n.parent.kind == "aliased_import" and n.parent.parent.kind == "import_from_statement")),
    "doc-strings": kinds("string_content", where=_docstring),
    "function-names": fields("function_definition", "name"),
    "function-calls": fields("call", "function", "identifier"),
    "class": kinds("class_definition"),
    "def": kinds("function_definition"),
    "async-def": kinds("function_definition", where=lambda n, s: n.text(s).startswith("async ")),
    "methods": either(
        kinds("function_definition", where=_method),
        kinds("decorated_definition", where=lambda n, s: _method(n, s) and any(c.kind == "function_definition" for c in n.children)),
    ),
    "class-methods": kinds("function_definition", where=_decorated("classmethod")),
    "static-methods": kinds("function_definition", where=_decorated("staticmethod")),
    "with": kinds("with_statement"),
    "try": kinds("try_statement"),
    "lambda": kinds("lambda"),
    "globals": kinds("identifier", where=_global),
    "variable-identifiers": kinds("identifier", where=lambda n, s: _left(n)),
    "types": kinds("type"),
    "identifiers": kinds("identifier"),
}
