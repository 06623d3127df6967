"""Syntax nodes, a lexer and the skimming parser that the brace languages share.

The parser recognises the constructs that queries ask for and leaves the rest flat; nodes
nest by their ranges.  Offsets are characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
import dataclasses
from dataclasses import dataclass


@dataclass(eq=False)
class Node:
    kind: str
    start: int
    end: int
    field: str | None = None
    named: bool = True
    parent: Node | None = None
    children: list[Node] = dataclasses.field(default_factory=list)

    def text(self, source: str) -> str:
        return source[self.start : self.end]

    def walk(self) -> Iterable[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.field == name), None)


def enclosing(match: dict[int, int], n: int) -> list[int]:
    """For each of n tokens the innermost matched bracket around it, -1 without one."""
    out, stack = [-1] * n, [-1]
    for i in range(n):
        other = match.get(i, i)
        if other < i:
            stack.pop()
        out[i] = stack[-1]
        if other > i:
            stack.append(i)
    return out


def nest(nodes: list[Node], root: Node) -> Node:
    """Build the tree: a node belongs to the smallest one around it; of equal ranges the earlier is outside."""
    order = sorted(range(len(nodes)), key=lambda i: (nodes[i].start, -nodes[i].end, i))
    stack = [root]
    for i in order:
        n = nodes[i]
        while stack[-1] is not root and (n.start >= stack[-1].end or n.end > stack[-1].end):
            stack.pop()
        n.parent = stack[-1]
        stack[-1].children.append(n)
        stack.append(n)
    return root


@dataclass(eq=False, slots=True)
class Token:
    kind: str  # ident, number, punct, comment, string, or what a lexer calls it
    start: int
    end: int
    text: str


class Braces:
    """Base of languages with bracketed blocks.  Subclasses give LEXICON and construct()."""

    LEXICON: tuple[tuple[str, str], ...] = ()
    ROOT = "source_file"

    def __init__(self, source: str):
        self.source = source
        self.all: list[Token] = list(self.lex())
        self.t = [x for x in self.all if x.kind != "comment"]
        self.index()
        self.nodes: list[Node] = []

    def index(self) -> None:
        """What is looked up by token; to be called again if the tokens change."""
        self.size = len(self.t)
        self.match = self._brackets()
        self.around = enclosing(self.match, self.size)

    @classmethod
    def _pattern(cls) -> re.Pattern:
        if "_compiled" not in cls.__dict__:
            cls._compiled = re.compile("|".join(f"(?P<{k}>{p})" for k, p in cls.LEXICON), re.S)
        return cls._compiled

    def lex(self) -> Iterable[Token]:
        match, source, at, size = self._pattern().match, self.source, 0, len(self.source)
        extend = None if type(self).extend is Braces.extend else self.extend
        while at < size:
            m = match(source, at)
            end = m.end() if m else at
            if end == at:
                at += 1
                continue
            kind = m.lastgroup
            if extend:
                end = extend(kind, at, end)
            if kind != "space":
                yield Token(kind, at, end, source[at:end])
            at = end

    def extend(self, kind: str, start: int, end: int) -> int:
        """Where a token really ends, for what no regular expression can tell."""
        return end

    def _brackets(self) -> dict[int, int]:
        match, stack = {}, []
        closing = {")": "(", "]": "[", "}": "{"}
        for i, x in enumerate(self.t):
            if x.kind == "punct" and x.text in "([{":
                stack.append(i)
            elif x.kind == "punct" and x.text in closing:
                while stack and self.t[stack[-1]].text != closing[x.text]:
                    stack.pop()
                if stack:
                    a = stack.pop()
                    match[a], match[i] = i, a
        return match

    # Moving over tokens

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.size and self.t[i].text in texts

    def ident(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "ident"

    def skip(self, i: int) -> int:
        """Behind the token or the bracketed group at i."""
        return self.match.get(i, i) + 1 if self.is_(i, "(", "[", "{") else i + 1

    def within(self, i: int, bracket: str) -> int:
        """The innermost bracket of this kind around i, -1 without one."""
        i = self.around[i]
        while i >= 0 and self.t[i].text != bracket:
            i = self.around[i]
        return i

    def until(self, i: int, *stops: str, limit: int | None = None) -> int:
        """The first of the stops at this level from i on, or where the level or the limit ends."""
        limit = len(self.t) if limit is None else limit
        while i < limit and not self.is_(i, *stops):
            if self.is_(i, ")", "]", "}"):
                return i
            i = self.skip(i)
        return i

    def angle(self, i: int) -> int:
        """Behind a type argument list that opens at i."""
        depth = 0
        while i < len(self.t):
            x = self.t[i].text
            if x == "<":
                depth += 1
            elif x in (">", ">>", ">>>"):
                depth -= len(x)
            elif x in (";", "{", "}"):
                return i
            i = self.skip(i)
            if depth <= 0:
                return i
        return i

    def end_of(self, i: int) -> int:
        """Character behind the token before i."""
        return self.t[min(i, len(self.t)) - 1].end

    def statement(self, i: int) -> int:
        """Behind the statement at i, in C's manner."""
        if self.is_(i, "{"):
            return self.skip(i)
        if self.is_(i, "if", "for", "while", "switch", "foreach", "lock", "using", "fixed") and self.is_(i + 1, "("):
            j = self.statement(self.skip(i + 1))
            if self.is_(i, "if") and self.is_(j, "else"):
                j = self.statement(j + 1)
            return j
        if self.is_(i, "do"):
            j = self.statement(i + 1)
            return self.until(j, ";") + 1
        if self.is_(i, "try"):
            j = self.skip(i + 1)
            while self.is_(j, "catch", "finally"):
                j = self.skip(self.until(j, "{"))
            return j
        j = self.until(i, ";")
        return j + 1 if self.is_(j, ";") else j

    # Nodes

    def add(self, kind: str, i: int, j: int, **fields: int | tuple[int, int] | None) -> Node:
        """A node over tokens [i, j); fields name tokens or token ranges of it."""
        n = Node(kind, self.t[i].start, self.end_of(j))
        self.nodes.append(n)
        for name, at in fields.items():
            if at is None:
                continue
            a, b = at if isinstance(at, tuple) else (at, at + 1)
            if a < len(self.t):
                self.mark[(self.t[a].start, self.end_of(b))] = name
        return n

    def tree(self) -> Node:
        self.mark: dict[tuple[int, int], str] = {}
        for i in range(len(self.t)):
            self.construct(i)
        # after the constructs, so that of equal ranges the leaf is inside
        for x in self.all:
            if x.kind == "comment":
                self.nodes.append(self.comment(x))
            elif x.kind not in ("punct", "number"):
                n = self.leaf(x)
                if n is not None:
                    self.nodes.append(n)
        self.finish()
        for n in self.nodes:
            n.field = self.mark.get((n.start, n.end), n.field)
        return nest(self.nodes, Node(self.ROOT, 0, len(self.source)))

    def comment(self, x: Token) -> Node:
        return Node("comment", x.start, x.end)

    def leaf(self, x: Token) -> Node | None:
        return Node("identifier", x.start, x.end) if x.kind == "ident" and x.text not in self.KEYWORDS else None

    KEYWORDS: frozenset[str] = frozenset()

    def construct(self, i: int) -> None:
        """Add the nodes that begin at token i."""

    def finish(self) -> None:
        """Add what needs all nodes."""


Query = Callable[[Node, str], list[tuple[int, int]]]


def kinds(*names: str, where: Callable[[Node, str], bool] | None = None) -> Query:
    """All nodes of these kinds that satisfy the condition."""

    def run(root: Node, source: str) -> list[tuple[int, int]]:
        return [(n.start, n.end) for n in root.walk() if n.kind in names and (where is None or where(n, source))]

    return run


def fields(kind: str, name: str, *of: str) -> Query:
    """Children in a field of nodes of a kind, themselves of given kinds."""

    def run(root: Node, source: str) -> list[tuple[int, int]]:
        return [
            (c.start, c.end) for n in root.walk() if n.kind == kind for c in n.children if c.field == name and (not of or c.kind in of)
        ]

    return run


def either(*queries: Query) -> Query:
    return lambda root, source: [r for q in queries for r in q(root, source)]


def minus(query: Query, holes: Query) -> Query:
    from ..functions.ranges import merge, subtract

    return lambda root, source: subtract(merge(query(root, source)), holes(root, source))


def named(query_kinds: tuple[str, ...], pattern: str) -> Query:
    """Nodes of these kinds whose name contains a match."""
    p = re.compile(pattern)
    return kinds(*query_kinds, where=lambda n, s: (c := n.child("name")) is not None and p.search(c.text(s)) is not None)
