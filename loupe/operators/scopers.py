"""Scopers: what of a text is in scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.dialect import analyse, compiled
from ..functions.escapes import unescape
from . import fragments as G


class Scoper:
    """Base of all scopers.  A subclass gives scope(), and may give native() to stay in the JVM."""

    #: Keys of the capture groups that fragments get, None without any.
    groups: tuple[str, ...] | None = None

    def scope(self, text: str) -> list[G.Fragment]:
        raise NotImplementedError

    def native(self) -> Callable[[Column], Column] | None:
        return None

    def apply(self, frags: Column) -> Column:
        native = self.native()
        return G.explode(frags, native) if native else G.python_explode(frags, self.scope)


def _interleave(out: Column, found: list[Column], names: tuple[str, ...] | None = None) -> Column:
    """out[0], found[0], out[1], ..., out[n]; found holds the matches, then their groups.

    The arrays are zipped rather than indexed, as a lambda's body is run for each element.
    """
    zipped = F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)])

    def pair(x: Column, m: Column) -> Column:
        groups = [m[f"g{i}"] for i in range(len(found))]
        caps = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*groups)) if names else None
        return F.when(m.isNull(), F.array(G.fragment(x, False))).otherwise(
            F.array(G.fragment(x, False), G.fragment(groups[0], True, caps))
        )

    return F.flatten(F.zip_with(out, zipped, pair))


class Literal(Scoper):
    """Every non-overlapping occurrence of a string, after resolving its escapes."""

    def __init__(self, literal: str):
        self.literal = unescape(literal)
        if not self.literal:
            raise ValueError("an empty literal matches nothing")

    def scope(self, text: str) -> list[G.Fragment]:
        out: list[G.Fragment] = []
        for i, piece in enumerate(text.split(self.literal)):
            if i:
                out.append((self.literal, True, None))
            out.append((piece, False, None))
        return [f for f in out if f[0]]

    def native(self):
        quoted = "\\Q" + self.literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"

        def scope(text: Column) -> Column:
            return F.flatten(
                F.transform(
                    F.split(text, quoted, -1),
                    lambda x, i: F.when(i == 0, F.array(G.fragment(x, False))).otherwise(
                        F.array(G.fragment(F.lit(self.literal), True), G.fragment(x, False))
                    ),
                )
            )

        return scope


class Lines(Scoper):
    """The default scope: everything but line feeds, without running a pattern."""

    groups = ("0",)

    def __init__(self, captures: bool = True):
        self.captures = captures

    def scope(self, text: str) -> list[G.Fragment]:
        out: list[G.Fragment] = []
        for i, piece in enumerate(text.split("\n")):
            if i:
                out.append(("\n", False, None))
            out.append((piece, True, {"0": piece} if self.captures else None))
        return [f for f in out if f[0]]

    def native(self):
        def one(x: Column) -> Column:
            return G.fragment(x, True, F.create_map(F.lit("0"), x) if self.captures else None)

        return lambda text: F.flatten(
            F.transform(
                F.split(text, "\n", -1),
                lambda x, i: F.when(i == 0, F.array(one(x))).otherwise(F.array(G.fragment(F.lit("\n"), False), one(x))),
            )
        )


class Regex(Scoper):
    """All non-overlapping matches from left to right, with their capture groups.

    A group is known by its name if it has one, else by its number; 0 is the match; a group
    that took no part is absent.
    """

    def __init__(self, pattern: str, captures: bool = True):
        self.pattern = analyse(pattern)
        self.captures = captures
        self.groups = ("0", *self.pattern.groups)

    def scope(self, text: str) -> list[G.Fragment]:
        spans, caps = [], []
        for m in compiled(self.pattern.source).finditer(text):
            spans.append(m.span())
            mine = {"0": m.group()}
            for i, name in enumerate(self.pattern.groups, 1):
                if m.group(i) is not None:
                    mine[name] = m.group(i)
            caps.append(mine if self.captures else None)
        return G.from_ranges(text, spans, caps)

    def native(self):
        p = self.pattern
        if not p.native or (self.captures and p.optional_groups):
            return None

        def scope(text: Column) -> Column:
            pattern = F.lit(p.java)
            found = [F.regexp_extract_all(text, pattern, F.lit(i)) for i in range(len(p.groups) + 1 if self.captures else 1)]
            return _interleave(F.split(text, p.java, -1), found, self.groups if self.captures else None)

        return scope


class Function(Scoper):
    """A user's function from a text to ranges of characters."""

    def __init__(self, ranges: Callable[[str], list[R.Range]]):
        self.ranges = ranges

    def scope(self, text: str) -> list[G.Fragment]:
        return G.from_ranges(text, R.merge(self.ranges(text)))


class Language(Function):
    """What a grammar query finds in the text, parsed as a file of its own."""

    def __init__(self, language: str, query: str):
        from ..grammar import registry

        self.language, self.query = language, query
        super().__init__(registry.ranges(language, query))


class CustomQuery(Function):
    """What a tree query in S-expressions finds."""

    def __init__(self, language: str, query: str):
        from ..grammar import query as Q

        self.language, self.query = language, query
        super().__init__(Q.compile_query(language, query))


class Union(Function):
    """The union of several range scopers over one text; of none, everything."""

    def __init__(self, scopers: list[Function]):
        self.scopers = scopers
        super().__init__(self._all)

    def _all(self, text: str) -> list[R.Range]:
        if not self.scopers:
            return [(0, len(text))]
        return R.merge([r for s in self.scopers for r in s.ranges(text)])


def general(pattern: str | None = None, literal: bool = False, captures: bool = True) -> Scoper:
    """The scoper of the positional scope argument."""
    if literal:
        if pattern is None:
            raise ValueError("a literal needs a scope")
        return Literal(pattern)
    return Lines(captures) if pattern in (None, ".*") else Regex(pattern, captures)
