"""Tree queries in S-expressions: parsing, checking and matching.

Supported: kinds, `_` and `(_)`, fields, negated fields, alternations, groups, the
quantifiers `+`, `*` and `?`, anchors, captures, and the predicates eq?, not-eq?, match?,
not-match?, any-of? and not-any-of?.  All captures count, but those whose name begins with
`_IGNORE`, or has a prefix of capitals before that word, are taken away from the others.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..functions.ranges import Range, merge, subtract
from .base import Node
from .registry import tree

#: Captures of such names are what the others are cut by.
IGNORE = re.compile(r"_[A-Z_]*IGNORE")
_TOKENS = re.compile(r""";[^\n]*|\s+|"(?:\\.|[^"\\])*"|[()\[\]]|@[\w.\-]+|\#[\w\-]+[?!]|!\w+|[A-Za-z_][\w.\-]*:|[A-Za-z_][\w.\-/]*|[+*?.]""")


class InvalidQuery(ValueError):
    """A query that isn't well formed."""


@dataclass
class Pattern:
    kind: str | None = None  # None: any node
    named: bool = True
    field: str | None = None
    without: list[str] = dataclasses.field(default_factory=list)
    items: list = dataclasses.field(default_factory=list)  # Pattern or "."
    choices: list[Pattern] | None = None
    group: bool = False
    captures: list[str] = dataclasses.field(default_factory=list)
    repeat: str = ""


Captures = list[tuple[str, Node]]


class Reader:
    def __init__(self, text: str):
        self.tokens: list[str] = []
        at = 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if m is None:
                raise InvalidQuery(f"unexpected character in query: {text[at:at + 10]!r}")
            at = m.end()
            if not m.group().isspace() and not m.group().startswith(";"):
                self.tokens.append(m.group())
        self.at = 0
        self.predicates: list[list[str]] = []

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> str:
        x = self.peek()
        if x is None:
            raise InvalidQuery("query ends too early")
        self.at += 1
        return x

    def top(self) -> list[tuple[Pattern, list[list[str]]]]:
        out = []
        while self.peek() is not None:
            self.predicates = []
            p = self.pattern()
            out.append((p, self.predicates))
        if not out:
            raise InvalidQuery("empty query")
        return out

    def pattern(self) -> Pattern:
        x = self.next()
        name = None
        if x.endswith(":") and len(x) > 1:
            name, x = x[:-1], self.next()
        if x == "(":
            p = self.node()
        elif x == "[":
            p = Pattern(choices=[])
            while self.peek() != "]":
                p.choices.append(self.pattern())
            self.next()
        elif x.startswith('"'):
            p = Pattern(kind=_string(x), named=False)
        elif x == "_":
            p = Pattern(named=False)
        else:
            raise InvalidQuery(f"unexpected {x!r} in query")
        p.field = name or p.field
        while self.peek() is not None and (self.peek() in "+*?" or self.peek().startswith("@")):
            y = self.next()
            if y.startswith("@"):
                p.captures.append(y[1:])
            else:
                p.repeat = y
        return p

    def node(self) -> Pattern:
        x = self.peek()
        if x is None:
            raise InvalidQuery("query ends too early")
        if x.startswith("#"):
            self.predicate()
            return self.node_after_predicate()
        if x in ("(", "[") or x.endswith(":") or x.startswith('"') or x == ".":
            p = Pattern(group=True)
        else:
            self.next()
            p = Pattern(kind=None if x == "_" else x.split("/")[-1])
        while (x := self.peek()) != ")":
            if x is None:
                raise InvalidQuery("query ends too early")
            if x == ".":
                p.items.append(self.next())
            elif x.startswith("!"):
                p.without.append(self.next()[1:])
            elif x == "(" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].startswith("#"):
                self.next()
                self.predicate()
            else:
                p.items.append(self.pattern())
        self.next()
        return p

    def node_after_predicate(self) -> Pattern:
        raise InvalidQuery("a predicate stands inside the pattern it is about")

    def predicate(self) -> None:
        row = []
        while (x := self.next()) != ")":
            row.append(x)
        if row[0] not in ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?", "#not-any-of?"):
            raise InvalidQuery(f"unknown predicate {row[0]}")
        if row[0].endswith("match?"):
            try:
                re.compile(_string(row[2]))
            except (re.error, IndexError) as e:
                raise InvalidQuery(f"invalid pattern in {row[0]}: {e}") from None
        self.predicates.append(row)


def _string(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), x[1:-1])


def _matches(p: Pattern, n: Node) -> Iterator[Captures]:
    """Ways in which one node fits one pattern."""
    if p.field is not None and n.field != p.field:
        return
    own = [(c, n) for c in p.captures]
    if p.choices is not None:
        for c in p.choices:
            for got in _matches(c, n):
                yield own + got
        return
    if p.kind is not None and n.kind != p.kind:
        return
    if any(c.field in p.without for c in n.children if c.field):
        return
    for got, _ in _sequence(p.items, n.children, 0, False):
        yield own + got


def _sequence(items: list, row: list[Node], at: int, tight: bool) -> Iterator[tuple[Captures, int]]:
    """Ways in which the items fit nodes of the row from `at` on, in order."""
    if not items:
        yield [], at
        return
    head, rest = items[0], items[1:]
    if head == ".":
        if not rest:
            if at == len(row):
                yield [], at
            return
        yield from _sequence(rest, row, at, True)
        return
    if head.repeat in ("*", "?"):
        once = Pattern(**(head.__dict__ | {"repeat": ""}))
        found = False
        for got in _sequence([Pattern(**(head.__dict__ | {"repeat": "+" if head.repeat == "*" else ""})), *rest], row, at, tight):
            found = True
            yield got
        if not found or once.captures == []:
            yield from _sequence(rest, row, at, tight)
        return
    for i in range(at, at + 1 if tight else len(row)):
        if i >= len(row):
            return
        fits = _sequence(head.items, row, i, True) if head.group else ((g, i + 1) for g in _matches(head, row[i]))
        for got, end in fits:
            own = [(c, row[i]) for c in head.captures] if head.group else []
            if head.repeat == "+":
                longer = False
                for more, last in _sequence([head], row, end, True):
                    for tail, stop in _sequence(rest, row, last, False):
                        longer = True
                        yield own + got + more + tail, stop
                if longer:
                    continue
            for tail, stop in _sequence(rest, row, end, False):
                yield own + got + tail, stop


def _holds(predicates: list[list[str]], captures: Captures, source: str) -> bool:
    def texts(x: str) -> list[str]:
        return [n.text(source) for c, n in captures if c == x[1:]] if x.startswith("@") else [_string(x)]

    for name, *args in predicates:
        left = texts(args[0])
        if name in ("#eq?", "#not-eq?"):
            right = texts(args[1])
            ok = all(a == b for a in left for b in right)
            if left and right and ok is not (name == "#eq?"):
                return False
        elif name in ("#match?", "#not-match?"):
            p = re.compile(_string(args[1]))
            if left and any((p.search(a) is not None) is not (name == "#match?") for a in left):
                return False
        else:
            among = {_string(a) for a in args[1:]}
            if any((a in among) is not (name == "#any-of?") for a in left):
                return False
    return True


def compile_query(language: str, text: str) -> Callable[[str], list[Range]]:
    from .registry import language as known

    known(language)
    patterns = Reader(text).top()

    def run(source: str) -> list[Range]:
        good: list[Range] = []
        bad: list[Range] = []
        for n in tree(language, source).walk():
            for p, predicates in patterns:
                # a group's items are siblings, so they are looked for under every node
                found = (g for g, _ in _sequence([p], n.children, 0, False)) if p.group else _matches(p, n)
                for captures in found:
                    if _holds(predicates, captures, source):
                        for c, x in captures:
                            (bad if IGNORE.match(c) else good).append((x.start, x.end))
        return subtract(merge(good), bad) if bad else merge(good)

    return run
