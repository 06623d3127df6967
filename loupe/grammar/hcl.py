"""HCL: blocks, attributes and expressions."""

from __future__ import annotations

import re

from .base import Braces, Node, Query, either, kinds, nest

_WORD = r"[^\W\d][\w-]*"


class Parser(Braces):
    ROOT = "config_file"
    LEXICON = (
        ("comment", r"\#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z)"),
        ("heredoc", r"<<-?" + _WORD + r"[^\n]*\n"),
        ("string", r'"'),
        ("ident", _WORD),
        ("number", r"\d[\w.]*"),
        ("newline", r"\n"),
        ("space", r"[ \t\r]+"),
        ("punct", r"=>|==|!=|<=|>=|&&|\|\||\.\.\.|."),
    )

    def __init__(self, source: str):
        self.inner: list[Node] = []
        super().__init__(source)

    def template(self, at: int, end: int) -> None:
        """Literal pieces, without blanks at their ends, and interpolations of [at, end)."""
        piece = at

        def literal(a: int, b: int) -> None:
            text = self.source[a:b]
            a, b = a + len(text) - len(text.lstrip()), b - len(text) + len(text.rstrip())
            if a < b:
                self.inner.append(Node("template_literal", a, b))

        while at < end:
            if self.source.startswith(("$${", "%%{"), at):
                at += 3
            elif self.source.startswith(("${", "%{"), at):
                literal(piece, at)
                depth, b = 1, at + 2
                while b < end and depth:
                    if self.source[b] == '"':
                        b = self.quoted(b, False)
                        continue
                    depth += (self.source[b] == "{") - (self.source[b] == "}")
                    b += 1
                self.inner.append(Node("template_interpolation", at, b))
                self.code(at + 2, b - 1)
                at = piece = b
            else:
                at += 2 if self.source[at] == "\\" else 1
        literal(piece, end)

    def code(self, a: int, b: int) -> None:
        """An expression inside a template, parsed by itself."""
        part = Parser(self.source[a:b])
        for n in part.tree().walk():
            if n.kind != self.ROOT:
                self.inner.append(Node(n.kind, n.start + a, n.end + a, n.field))

    def quoted(self, at: int, keep: bool = True) -> int:
        """Behind the string that begins at `at`."""
        b, templated = at + 1, False
        while b < len(self.source) and self.source[b] not in '"\n':
            if self.source.startswith(("${", "%{"), b) and self.source[b - 1] != self.source[b]:
                templated, depth = True, 1
                b += 2
                while b < len(self.source) and depth:
                    if self.source[b] == '"':
                        b = self.quoted(b, False)
                        continue
                    depth += (self.source[b] == "{") - (self.source[b] == "}")
                    b += 1
            else:
                b += 2 if self.source[b] == "\\" else 1
        if keep:
            self.inner.append(Node("quoted_template" if templated else "string_lit", at, b + 1))
            self.template(at + 1, b)
        return min(b + 1, len(self.source))

    def extend(self, kind, start, end):
        if kind == "string":
            return self.quoted(start)
        if kind == "heredoc":
            name = re.compile(_WORD).search(self.source, start).group()
            m = re.compile(rf"^[ \t]*{re.escape(name)}[ \t]*$", re.M).search(self.source, end)
            stop = m.start() if m else len(self.source)
            self.inner.append(Node("heredoc_template", start, m.end() if m else stop))
            # the line end before the closing name belongs to it
            self.template(end, stop - 1 if m and stop > end else stop)
            return m.end() if m else stop
        return end

    def lex(self):
        return [x for x in super().lex()]

    def tree(self) -> Node:
        self.t = [x for x in self.all if x.kind != "comment"]
        self.index()
        self.mark = {}
        for x in self.all:
            if x.kind == "comment":
                self.nodes.append(Node("comment", x.start, x.end))
        self.body(0, len(self.t))
        self.nodes += self.inner
        rank = {"body": 0, "block": 1, "attribute": 2, "expression": 3, "get_attr": 5, "variable_expr": 5, "identifier": 6}
        self.nodes.sort(key=lambda n: rank.get(n.kind, 4))
        return nest(self.nodes, Node(self.ROOT, 0, len(self.source)))

    def body(self, i: int, end: int) -> None:
        while i < end:
            if self.t[i].kind == "ident":
                j = i + 1
                while j < end and self.t[j].kind in ("string", "ident"):
                    j += 1
                if self.is_(j, "{") and j < end:
                    close = self.match.get(j, end - 1)
                    self.add("block", i, close + 1)
                    for k in range(i, j):
                        if self.t[k].kind == "ident":
                            self.nodes.append(Node("identifier", self.t[k].start, self.t[k].end))
                    inside = [k for k in range(j + 1, close) if self.t[k].kind != "newline"]
                    if inside:
                        self.add("body", inside[0], inside[-1] + 1)
                    self.body(j + 1, close)
                    i = close + 1
                    continue
                if self.is_(i + 1, "="):
                    j = i + 2
                    while j < end and self.t[j].kind != "newline":
                        j = self.skip(j)
                    self.nodes.append(Node("attribute", self.t[i].start, self.end_of(j)))
                    self.nodes.append(Node("identifier", self.t[i].start, self.t[i].end))
                    if i + 2 < j:
                        self.nodes.append(Node("expression", self.t[i + 2].start, self.end_of(j)))
                    self.expression(i + 2, j)
                    i = j
                    continue
            j = i
            while j < end and self.t[j].kind != "newline":
                j = self.skip(j)
            self.expression(i, j)
            i = j + 1

    def expression(self, i: int, end: int) -> None:
        """Traversals: a variable and the attributes behind it."""
        while i < end:
            x = self.t[i]
            if x.kind == "ident" and not self.is_(i + 1, "("):
                self.nodes.append(Node("variable_expr", x.start, x.end))
                self.nodes.append(Node("identifier", x.start, x.end))
                i += 1
                while i < end:
                    if self.is_(i, ".") and self.t[i + 1 : i + 2] and self.t[i + 1].kind == "ident":
                        self.nodes.append(Node("get_attr", self.t[i].start, self.t[i + 1].end))
                        self.nodes.append(Node("identifier", self.t[i + 1].start, self.t[i + 1].end))
                        i += 2
                    elif self.is_(i, "[") and self.t[i].start == self.t[i - 1].end:
                        close = self.match.get(i, i)
                        self.nodes.append(Node("index", self.t[i].start, self.t[close].end))
                        self.expression(i + 1, close)
                        i = close + 1
                    elif self.is_(i, ".") and self.is_(i + 1, "*"):
                        i += 2
                    else:
                        break
            else:
                i += 1

    KEYWORDS = frozenset()


def parse(source: str) -> Node:
    return Parser(source).tree()


def _head(n: Node, s: str) -> str | None:
    return next((c.text(s) for c in n.children if c.kind == "identifier"), None)


def _block(name: str) -> Query:
    return kinds("block", where=lambda n, s: _head(n, s) == name)


def _label(block: str, place: int) -> Query:
    """Text of the nth label of blocks."""

    def run(root: Node, s: str):
        out = []
        for n in root.walk():
            if n.kind == "block" and _head(n, s) == block:
                labels = [c for c in n.children if c.kind in ("string_lit", "quoted_template")]
                if place < len(labels):
                    out += [(c.start, c.end) for c in labels[place].children if c.kind == "template_literal"]
        return out

    return run


RESERVED = ("var", "data", "count", "module", "local")


def _traversal(place: int, root_fits) -> Query:
    """The nth attribute after a root variable that fits; 0 is the root."""

    def run(root: Node, s: str):
        out = []
        for p in root.walk():
            row = [c for c in p.children if c.kind in ("variable_expr", "get_attr", "index")]
            for k, c in enumerate(row):
                if c.kind != "variable_expr" or not root_fits(c.text(s)):
                    continue
                if place == 0:
                    if k + 1 < len(row) and row[k + 1].kind == "get_attr" and row[k + 1].start == c.end:
                        out.append((c.start, c.end))
                    continue
                chain, at = [], c.end
                for d in row[k + 1 :]:
                    if d.kind != "get_attr" or d.start != at:
                        break
                    chain.append(d)
                    at = d.end
                if len(chain) >= place:
                    out.append((chain[place - 1].start + 1, chain[place - 1].end))
        return out

    return run


def _providers(root: Node, s: str) -> list[Node]:
    return [
        c for n in root.walk() if n.kind == "block" and _head(n, s) == "required_providers"
        and n.parent.kind == "body" and n.parent.parent.kind == "block" and _head(n.parent.parent, s) == "terraform"
        for c in n.children if c.kind == "body"
    ]


def _named_providers(pattern: str) -> Query:
    p = re.compile(pattern)

    def run(root: Node, s: str):
        return [
            (e.start, e.end) for b in _providers(root, s) for a in b.children
            if a.kind == "attribute" and p.search(_head(a, s) or "") for e in a.children if e.kind == "expression"
        ]

    return run


def _string(n: Node, s: str) -> bool:
    p = n.parent
    if p.kind in ("quoted_template", "heredoc_template"):
        return p.parent.kind != "block"
    return p.kind == "string_lit" and p.parent.kind != "block"


_own = lambda x: x not in RESERVED
QUERIES: dict[str, Query] = {
    **{q: _block(q) for q in ("variable", "resource", "data", "output", "provider", "terraform", "locals", "module")},
    "required-providers": lambda root, s: [(b.start, b.end) for b in _providers(root, s)],
    "variables": either(_label("variable", 0), _traversal(1, lambda x: "var" in x)),
    "resource-names": either(_label("resource", 1), _traversal(1, _own)),
    "resource-types": either(_label("resource", 0), _traversal(0, _own)),
    "data-names": either(_label("data", 1), _traversal(2, lambda x: x == "data")),
    "data-sources": either(_label("data", 0), _traversal(1, lambda x: x == "data")),
    "comments": kinds("comment"),
    "strings": kinds("template_literal", where=_string),
}
NAMED = {"required-providers": _named_providers}
