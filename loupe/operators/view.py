"""The programmatic surface: a DataFrame column as scoped text.

    scoped(df, "text").scope(Regex(r"[A-Z]\\w+")).act(Upper()).to_text("new")

Steps only build column expressions; nothing runs before the result is used.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fragments as G
from .actions import (
    Action,
    Call,
    Deletion,
    German,
    Lower,
    Normalization,
    Replacement,
    Symbols,
    SymbolsInverse,
    Titlecase,
    Upper,
)
from ..sources.tables import spread
from .scopers import Function, Scoper, Union

log = logging.getLogger(__name__)

COLUMNS = "array<struct<start: int, end: int>>"
LINE = f"struct<line_no: int, line: string, cols: {COLUMNS}>"
LINES = f"array<{LINE}>"
#: A line in Python: its fragments.
Line = list[G.Fragment]


def split_lines(frags: list[G.Fragment]) -> list[Line]:
    """Fragments by line; line feeds end their line, empty fragments vanish."""
    lines: list[Line] = []
    fresh = True
    for text, in_scope, caps in frags:
        at = 0
        while at < len(text):
            end = text.find("\n", at) + 1 or len(text)
            if fresh:
                lines.append([])
            lines[-1].append((text[at:end], in_scope, caps))
            fresh = text[end - 1] == "\n"
            at = end
    return lines


def zip_shortest(*lists: list) -> list[tuple]:
    """The nth items of all lists, until the shortest ends."""
    return list(zip(*lists)) if lists else []


def format_hit(path: str, line_no: int, line: str, cols: list) -> str:
    """`path:line:cols:text`, as other programs read it."""
    spans = ";".join(f"{c['start']}-{c['end']}" for c in cols)
    return f"{path}:{line_no}:{spans}:{line}"


def format_column(path: Column, row: Column) -> Column:
    spans = F.array_join(
        F.transform(row["cols"], lambda c: F.concat_ws("-", c["start"].cast("string"), c["end"].cast("string"))), ";"
    )
    return F.concat(path, F.lit(":"), row["line_no"].cast("string"), F.lit(":"), spans, F.lit(":"), row["line"])


FRAGS, TEXT = "__lp_frags", "__lp_text"


def unnested(df: DataFrame, keys: tuple[str, ...], items: Column, name: str, position: str = "__lp_at") -> DataFrame:
    """One row for each item, with its position.

    posexplode() would make the optimizer test the array's size below it, where the array's whole
    expression is computed once more; posexplode_outer() doesn't, and its rows of empty arrays go here.
    """
    return df.select(*keys, F.posexplode_outer(items).alias(position, name)).where(F.col(position).isNotNull())


class Scoped:
    """A DataFrame with one column under scoping; every method returns a new one.

    The fragments are a column of `df`, so that an expression over them that needs them
    twice doesn't compute them twice.
    """

    def __init__(self, df: DataFrame, groups: tuple[str, ...] | None, built: bool):
        self.df, self._groups, self._built = df, groups, built

    @property
    def _frags(self) -> Column:
        return F.col(FRAGS)

    def _with(self, frags: Column, groups: tuple[str, ...] | None = None, built: bool | None = None) -> Scoped:
        return Scoped(self.df.withColumn(FRAGS, frags), groups, self._built if built is None else built)

    def scope(self, scoper: Scoper) -> Scoped:
        """Narrow to what the scoper finds in each fragment in scope."""
        if self._built:
            raise ValueError("scopers come before actions")
        return self._with(scoper.apply(self._frags), scoper.groups)

    def scope_any(self, scopers: list[Function]) -> Scoped:
        """Narrow to the union of what the scopers find in the whole text."""
        return self.scope(Union(scopers))

    def invert(self) -> Scoped:
        return self._with(G.invert(self._frags))

    def build(self) -> Scoped:
        """End scoping; carriage returns of line ends leave the scope."""
        return self if self._built else self._with(G.repair_line_ends(self._frags), self._groups, True)

    def act(self, action: Action | Callable[[str], str]) -> Scoped:
        built = self.build()
        if not isinstance(action, Action):
            action = Call(action)
        if isinstance(action, Replacement):
            action.check(built._groups)
        return built._with(action.apply(built._frags), built._groups)

    def squeeze(self) -> Scoped:
        built = self.build()
        return built._with(G.squeeze(built._frags), built._groups)

    def delete(self) -> Scoped:
        return self.act(Deletion())

    def upper(self) -> Scoped:
        return self.act(Upper())

    def lower(self) -> Scoped:
        return self.act(Lower())

    def titlecase(self) -> Scoped:
        return self.act(Titlecase())

    def normalize(self) -> Scoped:
        return self.act(Normalization())

    def replace(self, replacement: str) -> Scoped:
        return self.act(Replacement(replacement))

    def symbols(self) -> Scoped:
        return self.act(Symbols())

    def invert_symbols(self) -> Scoped:
        return self.act(SymbolsInverse())

    def german(self, **options) -> Scoped:
        return self.act(German(**options))

    # Results

    def column(self) -> Column:
        """The fragments, as a column of df of a built view."""
        if not self._built:
            raise ValueError("build() comes before results")
        return self._frags

    def text(self) -> Column:
        """The text put together again, as a column of df."""
        return G.render(self.column())

    def has_any_in_scope(self) -> Column:
        return G.any_in_scope(self.column())

    def to_text(self, name: str = "text") -> DataFrame:
        built = self.build()
        return built.df.withColumn(name, built.text()).drop(FRAGS, TEXT)

    def changed(self, name: str = "text", old: str = "old_text") -> DataFrame:
        """Rows whose text changed, with old and new; fails if a text would be wiped out entirely."""
        built = self.build()
        df = built.df.withColumn("__lp_new", built.text())
        wiped = (F.length(TEXT) > 0) & (F.col("__lp_new") == "")
        guarded = F.when(wiped, F.raise_error(F.lit("refusing to wipe a text")).cast("string")).otherwise(F.col("__lp_new"))
        return (
            df.where(~F.col("__lp_new").eqNullSafe(F.col(TEXT)))
            .withColumns({name: guarded, old: F.col(TEXT)})
            .drop(FRAGS, TEXT, "__lp_new")
        )

    def fragments(self, *keys: str) -> DataFrame:
        """Long form: keys, seg_idx, text, in_scope, caps."""
        return unnested(self.build().df, keys, F.col(FRAGS), "f", "seg_idx").select(*keys, "seg_idx", "f.*")

    def lines(self, *keys: str, only_matching: bool = False) -> DataFrame:
        """Long form by line: keys, line_no, line, cols.  With only_matching, texts without a hit don't reach Python."""
        df = self.build().df
        frags = F.when(G.any_in_scope(F.col(FRAGS)), F.col(FRAGS)) if only_matching else F.col(FRAGS)
        rows = F.arrow_udf(_lines_of(only_matching), LINES)(frags)
        return unnested(df, keys, rows, "l").select(*keys, "l.*")

    def search(self, *keys: str) -> DataFrame:
        """The lines that have something in scope."""
        return self.lines(*keys, only_matching=True)

    def dry_run(self, act: Callable[[Scoped], Scoped], *keys: str) -> DataFrame:
        """Lines before and after `act`, paired up to the shorter: keys, pair, side, line_no, line, cols."""
        built = self.build()
        both = act(Scoped(built.df.withColumn("__lp_before", F.col(FRAGS)), built._groups, True)).df
        before = F.arrow_udf(_lines_of(True), LINES)("__lp_before")
        after = F.arrow_udf(_lines_of(True), LINES)(FRAGS)
        rows = both.select(*keys, before.alias("__lp_b"), after.alias("__lp_a"))
        n = F.least(F.size("__lp_b"), F.size("__lp_a"))
        pairs = F.arrays_zip(F.slice("__lp_b", F.lit(1), n).alias("b"), F.slice("__lp_a", F.lit(1), n).alias("a"))
        both = unnested(rows, keys, pairs, "p", "pair")
        sides = F.array(
            F.struct(F.lit("before").alias("side"), F.col("p.b").alias("l")),
            F.struct(F.lit("after").alias("side"), F.col("p.a").alias("l")),
        )
        return both.select(*keys, "pair", F.explode(sides).alias("s")).select(*keys, "pair", "s.side", "s.l.*")


def _lines_of(only_matching: bool) -> Callable[[pa.Array], pa.Array]:
    """Lines of a batch of fragments, built field by field."""

    def column(batch: pa.Array) -> pa.Array:
        rows, numbers, texts = [0], [], []
        cols, starts, ends = [0], [], []
        for row in G.to_python(batch):
            for number, line in enumerate(split_lines(row or []), 1):
                if only_matching and not any(f[1] for f in line):
                    continue
                at = 0
                for text, in_scope, _ in line:
                    size = len(text) if text.isascii() else len(text.encode())
                    if in_scope:
                        starts.append(at)
                        ends.append(at + size)
                    at += size
                numbers.append(number)
                texts.append("".join(f[0] for f in line).removesuffix("\n"))
                cols.append(len(starts))
            rows.append(len(numbers))
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
        lines = [pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(cols, pa.int32()), spans)]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(lines, ["line_no", "line", "cols"]))

    return column


def scoped(df: DataFrame, column: str = "text") -> Scoped:
    """Start scoping a column; the whole text is in scope."""
    df = spread(df).withColumn(TEXT, F.col(column))
    return Scoped(df.withColumn(FRAGS, G.whole(F.col(TEXT))), None, False)


class NothingInScope(ValueError):
    """Something was to be in scope, and nothing was."""


class SomethingInScope(ValueError):
    """Nothing was to be in scope, and something was."""


class NoFiles(ValueError):
    """No input passed the filters."""


def check_scope(view: Scoped, fail_any: bool = False, fail_none: bool = False, fail_empty: bool = False) -> None:
    """Raise as asked; fail_any stops at the first text found."""
    view = view.build()
    hits = view.df.select(view.has_any_in_scope().alias("hit"))
    if fail_any and not hits.where("hit").limit(1).isEmpty():
        raise SomethingInScope("some input was in scope")
    if fail_empty or fail_none:
        seen, found = hits.agg(F.count("*"), F.count_if(F.col("hit"))).first()
        if fail_empty and not seen:
            raise NoFiles("no files found")
        if fail_none and not found:
            raise NothingInScope("nothing was in scope")
