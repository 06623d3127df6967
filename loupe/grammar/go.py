"""Go."""

from __future__ import annotations

import re

from .base import Braces, Node, Query, fields, kinds, minus, named

KEYWORDS = frozenset(
    """break case chan const continue default defer else fallthrough for func go goto if import interface map package range return
    select struct switch type var""".split()
)


class Parser(Braces):
    KEYWORDS = KEYWORDS
    LEXICON = (
        ("comment", r"//[^\n]*|/\*.*?(?:\*/|\Z)"),
        ("raw", r"`[^`]*(?:`|\Z)"),
        ("string", r'"(?:\\.|[^"\\\n])*"'),
        ("rune", r"'(?:\\.|[^'\\\n])*'"),
        ("ident", r"[^\W\d]\w*"),
        ("number", r"\.?\d(?:[eEpP][+-]|[\w.])*"),
        ("newline", r"\n"),
        ("space", r"[ \t\r]+"),
        ("punct", r":=|<-|\+\+|--|<<=?|>>=?|&\^=?|&&|\|\||[<>=!+\-*/%&|^]=|\.\.\.|."),
    )

    def __init__(self, source: str):
        super().__init__(source)
        # line ends matter only where they end statements
        self.ends = {x.start for x in self.t if x.kind == "newline"}
        self.t = [x for x in self.t if x.kind != "newline"]
        self.index()
        self.all = [x for x in self.all if x.kind != "newline"]

    def leaf(self, x):
        kind = {"raw": "raw_string_literal", "string": "interpreted_string_literal", "rune": "rune_literal"}.get(x.kind)
        return Node(kind, x.start, x.end) if kind else super().leaf(x)

    def line_end(self, i: int, *stops: str) -> int:
        """Behind the statement that begins at i: the first token on a later line, groups skipped."""
        j = self.skip(i)
        while j < len(self.t) and not self.is_(j, ";", ")", "}", *stops):
            before = self.t[j - 1]
            if "\n" in self.source[before.end : self.t[j].start] and (
                before.kind != "punct" or before.text in (")", "]", "}", "++", "--")
            ):
                return j
            j = self.skip(j)
        return j

    def construct(self, i):
        x = self.t[i]
        if x.kind == "ident" and x.text in KEYWORDS:
            getattr(self, f"_{x.text}", lambda i: None)(i)
        elif x.kind == "ident" and self.is_(i + 1, ":") and not self.is_(i + 1, ":=") and self._statement(i):
            j = i + 2
            self.add("labeled_statement", i, self._body(j))

    def _statement(self, i: int) -> bool:
        if i == 0 or self.is_(i - 1, ";"):
            return True
        between = self.source[self.t[i - 1].end : self.t[i].start]
        if "\n" not in between:
            return False
        a = self.around[i]
        if a < 0:
            return True
        return self.is_(a, "{") and not self._literal(a)

    def _literal(self, a: int) -> bool:
        """Whether the brace opens a composite literal."""
        return self.t[a - 1].kind == "ident" and not self.t[a - 1].text in KEYWORDS and not self._head(a) or self.is_(a - 1, "]", "}")

    def _head(self, a: int) -> bool:
        j = a - 1
        while j >= 0 and "\n" not in self.source[self.t[j].end : self.t[j + 1].start]:
            if self.t[j].text in ("func", "if", "for", "switch", "select", "type", "case", ")"):
                return True
            j -= 1
        return False

    def _body(self, i: int) -> int:
        """Behind the statement at i, its block included."""
        j = i
        while j < len(self.t) and not self.is_(j, "{"):
            if j > i and "\n" in self.source[self.t[j - 1].end : self.t[j].start]:
                return j
            j = self.skip(j) if not self.is_(j, "{") else j
        return self.skip(j)

    def _func(self, i: int) -> None:
        j = i + 1
        if self.is_(j, "(") and self.ident(self.skip(j)) and self.is_(self.skip(j) + 1, "(") and self._statement(i):
            name, kind = self.skip(j), "method_declaration"
            j = name + 1
        elif self.ident(j) and (self.is_(j + 1, "(", "[")):
            name, kind = j, "function_declaration"
            j += 1
            if self.is_(j, "["):
                self._params(j)
                j = self.skip(j)
        elif self.is_(j, "("):
            name, kind = None, "func_literal"
        else:
            return
        j = self.skip(j)
        while j < len(self.t) and not self.is_(j, "{"):
            if "\n" in self.source[self.t[j - 1].end : self.t[j].start] or self.is_(j, ",", ")", ";", "}"):
                if kind == "func_literal":
                    return
                break
            if self.is_(j, "interface", "struct") and self.is_(j + 1, "{"):
                j += 1
            j = self.skip(j)
        self.add(kind, i, self.skip(j) if self.is_(j, "{") else j, name=name)

    def _params(self, i: int) -> None:
        """Type parameters between brackets."""
        a, end = i + 1, self.match.get(i, i)
        pending = a
        while a < end:
            stop = self.until(a, ",")
            if stop - a > 1 or self.is_(a, "*"):
                self.add("type_parameter_declaration", pending, stop)
                pending = stop + 1
            a = stop + 1

    def _specs(self, i: int):
        """(first, end) of each spec under a keyword."""
        if not self.is_(i + 1, "("):
            yield i + 1, self.line_end(i + 1)
            return
        j, end = i + 2, self.match.get(i + 1, i + 1)
        while j < end:
            k = min(self.line_end(j), end)
            yield j, k
            j = k + self.is_(k, ";") if k > j else j + 1

    def _import(self, i: int) -> None:
        for a, b in self._specs(i):
            self.add("import_spec", a, b, path=b - 1)
        self.add("import_declaration", i, self.skip(i + 1) if self.is_(i + 1, "(") else self.line_end(i + 1))

    def _const(self, i: int) -> None:
        for a, b in self._specs(i):
            self.add("const_spec", a, b, name=a)

    def _var(self, i: int) -> None:
        for a, b in self._specs(i):
            self.add("var_spec", a, b, name=a)

    def _type(self, i: int) -> None:
        if self.is_(i - 1, "(") and self.is_(i + 1, ")"):
            return
        end = self.skip(i + 1) if self.is_(i + 1, "(") else self.line_end(i + 1)
        self.add("type_declaration", i, end)
        for a, b in self._specs(i):
            self.add("type_alias" if self.is_(a + 1, "=") else "type_spec", a, b, name=a)
            j = a + 1
            if self.is_(j, "[") and self.ident(j + 1) and not self.is_(j + 2, "]"):
                self._params(j)
                j = self.skip(j)
            if self.is_(j, "struct", "interface") and self.is_(j + 1, "{"):
                self.add(f"{self.t[j].text}_type", j, self.skip(j + 1), type=(j, self.skip(j + 1)))

    def _struct(self, i: int) -> None:
        if self.is_(i + 1, "{"):
            j, end = i + 2, self.match.get(i + 1, i + 1)
            while j < end:
                k = min(self.line_end(j), end)
                k = max(k, j + 1)
                self.add("field_declaration", j, k, tag=k - 1 if self.t[k - 1].kind in ("raw", "string") else None)
                j = k + self.is_(k, ";")

    def _defer(self, i: int) -> None:
        self.add("defer_statement", i, self.line_end(i))

    def _go(self, i: int) -> None:
        self.add("go_statement", i, self.line_end(i))

    def _goto(self, i: int) -> None:
        self.add("goto_statement", i, i + 2)

    def _select(self, i: int) -> None:
        self.add("select_statement", i, self.skip(i + 1))

    def _switch(self, i: int) -> None:
        j = self.until(i + 1, "{")
        if self.is_(j - 1, ")") and self.is_(j - 2, "type"):
            self.add("type_switch_statement", i, self.skip(j))
        else:
            self.add("expression_switch_statement", i, self.skip(j))

    def finish(self):
        for i, x in enumerate(self.t):
            if x.kind == "number":
                self.nodes.append(Node("number", x.start, x.end))
            if x.kind == "ident" and x.text not in KEYWORDS and self.is_(i + 1, "("):
                j = i
                while self.is_(j - 1, ".") and j > 1:
                    j = self.match.get(j - 2, j - 2)
                    j = j - 1 if self.is_(j, "(", "[") and self.ident(j - 1) else j
                if not self.is_(j - 1, "func"):
                    self.add("call_expression", j, self.skip(i + 1), function=(j, i + 1))


def parse(source: str) -> Node:
    return Parser(source).tree()


def _holds(kind: str):
    return lambda n, s: any(c.kind == "type_spec" and any(d.kind == kind for d in c.children) for c in n.children)


def _typed(kind: str):
    def make(pattern: str) -> Query:
        p = re.compile(pattern)
        return kinds(
            "type_declaration",
            where=lambda n, s: any(
                c.kind == "type_spec" and any(d.kind == kind for d in c.children) and p.search(c.child("name").text(s))
                for c in n.children
            ),
        )

    return make


_strings = kinds("raw_string_literal", "interpreted_string_literal")
_UNARY = frozenset(("+", "-", "!", "^", "*", "&", "<-"))
_BINARY = frozenset("+ - * / % & | ^ << >> &^ == != < <= > >= && ||".split())
_ENDING = frozenset((")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return"))
_SKIPPED = frozenset(("break", "continue", "goto", "fallthrough"))


class Expressions:
    """The outermost expressions of a file, statement by statement."""

    def __init__(self, parser: Parser):
        self.p, self.t, self.found = parser, parser.t, []
        self.block(0, len(self.t))

    def is_(self, i: int, *texts: str) -> bool:
        return self.p.is_(i, *texts)

    def line_ends(self, i: int) -> bool:
        """Whether a statement ends between the tokens i - 1 and i."""
        before = self.t[i - 1]
        if before.kind == "punct" and before.text not in _ENDING or before.kind == "ident" and before.text in KEYWORDS and before.text not in _ENDING:
            return False
        return "\n" in self.p.source[before.end : self.t[i].start]

    def type(self, i: int, end: int) -> int:
        """Behind the type at i; lengths of arrays are expressions."""
        while i < end:
            if self.is_(i, "*", "...", "chan", "<-"):
                i += 1
            elif self.is_(i, "["):
                close = self.p.match.get(i, i)
                if close > i + 1 and not self.is_(i + 1, "..."):
                    self.list(i + 1, close)
                i = close + 1
            elif self.is_(i, "map") and self.is_(i + 1, "["):
                close = self.p.match.get(i + 1, i + 1)
                self.type(i + 2, close)
                i = close + 1
            elif self.is_(i, "func"):
                i = self.signature(i + 1, end)
                return i
            elif self.is_(i, "struct", "interface") and self.is_(i + 1, "{"):
                close = self.p.match.get(i + 1, i + 1)
                if self.is_(i, "struct"):
                    self.members(i + 2, close)
                return close + 1
            elif self.is_(i, "("):
                return self.p.match.get(i, i) + 1
            elif self.p.ident(i) and self.t[i].text not in KEYWORDS:
                i += 1
                while self.is_(i, ".") and self.p.ident(i + 1):
                    i += 2
                if self.is_(i, "[") and not self.line_ends(i):
                    i = self.p.match.get(i, i) + 1
                return i
            else:
                return i
        return i

    def members(self, i: int, end: int) -> None:
        """Fields of a structure: names, a type, a tag."""
        while i < end:
            j = i
            while self.p.ident(j) and self.is_(j + 1, ","):
                j += 2
            if self.p.ident(j) and j + 1 < end and not self.line_ends(j + 1) and not self.is_(j + 1, ".", ";") and self.t[j + 1].kind not in ("raw", "string"):
                j += 1
            i = max(self.type(j, end), j + 1)
            while i < end and (self.is_(i, ";") or self.t[i].kind in ("raw", "string")):
                i += 1

    def parameters(self, i: int) -> int:
        """Behind the parameters in the parentheses at i."""
        close = self.p.match.get(i, i)
        for k in range(i + 1, close):
            if self.is_(k, "[") and not (self.p.ident(k - 1) and self.t[k - 1].text not in KEYWORDS and self.t[k - 1].end == self.t[k].start) and not self.is_(k - 1, "map"):
                end = self.p.match.get(k, k)
                if end > k + 1 and not self.is_(k + 1, "..."):
                    self.list(k + 1, end)
        return close + 1

    def signature(self, i: int, end: int) -> int:
        """Behind the parameters at i and the result."""
        if not self.is_(i, "("):
            return i
        i = self.parameters(i)
        if i < end and self.is_(i, "(") and not self.line_ends(i):
            return self.parameters(i)
        return i if i >= end or self.is_(i, "{", ")", ",", ";") or self.line_ends(i) else self.type(i, end)

    def operand(self, i: int, end: int, head: bool) -> int:
        while i < end and self.t[i].text in _UNARY:
            i += 1
        if i >= end:
            return i
        x = self.t[i]
        open_ = False  # a type, which a literal or a conversion follows
        if x.text == "(":
            i = self.p.match.get(i, i) + 1
        elif x.kind in ("string", "raw", "rune", "number"):
            i += 1
        elif x.text == "func":
            kept = len(self.found)
            i = self.signature(i + 1, end)
            if self.is_(i, "{"):
                i = self.p.match.get(i, i) + 1
            del self.found[kept:]
        elif x.text in ("[", "map", "struct", "chan", "interface"):
            kept = len(self.found)
            i, open_ = self.type(i, end), True
            del self.found[kept:]
        elif x.kind == "ident" and x.text not in KEYWORDS:
            i, open_ = i + 1, True
        else:
            return i
        while i < end and not self.line_ends(i):
            if self.is_(i, ".") and self.is_(i + 1, "("):
                if self.is_(i + 2, "type"):
                    break
                i = self.p.match.get(i + 1, i + 1) + 1
            elif self.is_(i, ".") and self.p.ident(i + 1):
                i += 2
            elif self.is_(i, "[", "("):
                i = self.p.match.get(i, i) + 1
            elif self.is_(i, "{") and open_ and not (head and x.kind == "ident" and x.text not in ("map", "struct")):
                i = self.p.match.get(i, i) + 1
            else:
                break
        return min(i, end)

    def expression(self, i: int, end: int, head: bool = False) -> int:
        """Behind the expression at i, which is noted; i where there is none."""
        j = self.operand(i, end, head)
        while i < j < end and self.t[j].text in _BINARY and not self.line_ends(j):
            k = self.operand(j + 1, end, head)
            if k == j + 1:
                break
            j = k
        if j > i:
            self.found.append((self.t[i].start, self.t[j - 1].end))
        return j

    def list(self, i: int, end: int, head: bool = False) -> int:
        while i < end:
            j = self.expression(i, end, head)
            if not self.is_(j, ","):
                return j
            i = j + 1
        return i

    def spec(self, i: int, end: int) -> int:
        """Behind the names, type and values of a constant or variable."""
        while self.p.ident(i) and self.is_(i + 1, ","):
            i += 2
        i += 1
        if i < end and not self.is_(i, "=", ";") and not self.line_ends(i):
            i = self.type(i, end)
        return self.list(i + 1, end) if i < end and self.is_(i, "=") else i

    def block(self, i: int, end: int, types: bool = False) -> None:
        head = choice = False
        while i < end:
            x = self.t[i].text if self.t[i].kind in ("ident", "punct") else ""
            if x == "package":
                i += 2
            elif x == "import":
                i += 1
                if self.is_(i, "("):
                    i = self.p.match.get(i, i) + 1
                else:
                    while i < end and self.t[i].kind not in ("string", "raw"):
                        i += 1
                    i += 1
            elif x == "type" and (self.p.ident(i + 1) or self.is_(i + 1, "(")):
                if self.is_(i + 1, "("):
                    j, close = i + 2, self.p.match.get(i + 1, i + 1)
                else:
                    j, close = i + 1, end
                while j < close and self.p.ident(j):
                    j += 1
                    if self.is_(j, "[") and self.p.ident(j + 1) and not self.is_(j + 2, "]"):  # type parameters
                        j = self.p.match.get(j, j) + 1
                    if self.is_(j, "="):
                        j += 1
                    j = max(self.type(j, close), j)
                    while self.is_(j, ";"):
                        j += 1
                    if close == end:
                        break
                i = max(close + 1 if close != end else j, i + 1)
            elif x in ("const", "var"):
                i += 1
                if self.is_(i, "("):
                    j, close = i + 1, self.p.match.get(i, i)
                    while j < close:
                        j = self.spec(j, close) if self.p.ident(j) else j + 1
                    i = close + 1
                else:
                    i = self.spec(i, end)
            elif x == "func" and (self.p.ident(i + 1) or self.is_(i + 1, "(") and self.p.ident(self.p.match.get(i + 1, i) + 1) and self.is_(self.p.match.get(i + 1, i) + 2, "(", "[")):
                j = i + 1
                if self.is_(j, "("):
                    j = self.parameters(j)
                j += 1
                if self.is_(j, "["):
                    j = self.p.match.get(j, j) + 1
                i = max(self.signature(j, end), j)
            elif x in ("if", "for", "switch", "select"):
                head, choice, i = True, x == "switch", i + 1
            elif x == "{":
                close = self.p.match.get(i, end)
                inside = any(self.is_(k, "type") and self.is_(k - 1, "(") and self.is_(k - 2, ".") for k in range(max(0, i - 8), i)) if choice else False
                self.block(i + 1, close, inside)
                head, choice, i = False, False, close + 1
            elif x == "case":
                i += 1
                if types:
                    while i < end and not self.is_(i, ":"):
                        i = self.p.skip(i)
            elif x == "<-" and i and not self.line_ends(i) and (self.is_(i - 1, ")", "]", "}") or self.p.ident(i - 1) and self.t[i - 1].text not in KEYWORDS):
                i += 1  # a value is sent
            elif x in _SKIPPED:
                i += 1
                if self.p.ident(i) and not self.line_ends(i):
                    i += 1
            elif self.p.ident(i) and x not in KEYWORDS and self.is_(i + 1, ":") and not head and (i == 0 or self.is_(i - 1, "{", "}", ";", ":") or self.line_ends(i)):
                i += 2
            else:
                j = self.expression(i, end, head)
                if self.is_(j, ".") and self.is_(j + 1, "(") and self.is_(j + 2, "type"):
                    j += 4
                i = j if j > i else i + 1


def _expressions(root: Node, source: str) -> list[tuple[int, int]]:
    return Expressions(Parser(source)).found


QUERIES: dict[str, Query] = {
    "comments": kinds("comment"),
    "strings": minus(_strings, lambda root, s: kinds("import_spec")(root, s) + kinds("field_declaration", where=lambda n, s: n.child("tag") is not None)(root, s)),
    "imports": fields("import_spec", "path"),
    "expression": _expressions,
    "type-def": kinds("type_declaration"),
    "type-alias": kinds("type_alias"),
    "struct": kinds("type_declaration", where=_holds("struct_type")),
    "interface": kinds("type_declaration", where=_holds("interface_type")),
    "const": kinds("const_spec"),
    "var": kinds("var_spec"),
    "func": kinds("method_declaration", "function_declaration", "func_literal"),
    "method": kinds("method_declaration"),
    "free-func": kinds("function_declaration"),
    "init-func": kinds("function_declaration", where=lambda n, s: n.child("name").text(s) == "init"),
    "type-params": kinds("type_parameter_declaration"),
    "defer": kinds("defer_statement"),
    "select": kinds("select_statement"),
    "go": kinds("go_statement"),
    "switch": kinds("expression_switch_statement"),
    "labeled": kinds("labeled_statement"),
    "goto": kinds("goto_statement"),
    "struct-tags": fields("field_declaration", "tag", "raw_string_literal"),
}
NAMED = {
    "struct": _typed("struct_type"),
    "interface": _typed("interface_type"),
    "func": lambda p: named(("method_declaration", "function_declaration"), p),
}
