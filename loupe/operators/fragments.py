"""A text as an ordered array of fragments, each in or out of scope.

Scopers narrow: they split fragments that are in scope and never touch the others.  Joined
together, the fragments are always the text.  A null text has null fragments.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAGMENT = "struct<text: string, in_scope: boolean, caps: map<string, string>>"
FRAGMENTS = f"array<{FRAGMENT}>"
_NO_CAPS = "map<string, string>"

#: A fragment in Python: text, whether it is in scope, capture groups or None.
Fragment = tuple[str, bool, dict[str, str] | None]


def fragment(text: Column, in_scope: Column | bool, caps: Column | None = None) -> Column:
    flag = F.lit(in_scope) if isinstance(in_scope, bool) else in_scope
    return F.struct(
        text.alias("text"), flag.alias("in_scope"), (F.lit(None).cast(_NO_CAPS) if caps is None else caps).alias("caps")
    )


def whole(text: Column) -> Column:
    """The text as one fragment in scope; the empty text has none."""
    one = F.array(fragment(text, True))
    return F.when(text.isNotNull(), F.filter(one, lambda f: f["text"] != ""))


def explode(frags: Column, scope: Callable[[Column], Column]) -> Column:
    """Replace every fragment in scope by what `scope` makes of its text; empty fragments go."""
    spliced = F.transform(frags, lambda f: F.when(f["in_scope"], scope(f["text"])).otherwise(F.array(f)))
    return F.filter(F.flatten(spliced), lambda f: f["text"] != "")


def invert(frags: Column) -> Column:
    """Swap in and out; capture groups are lost."""
    return F.transform(frags, lambda f: fragment(f["text"], ~f["in_scope"]))


def repair_line_ends(frags: Column) -> Column:
    """Keep carriage returns that belong to line ends out of scope.

    If any fragment in scope ends in a carriage return and the next one, out of scope,
    starts with a line feed, then all carriage returns leave the scope, and all fragments
    lose their capture groups.
    """
    broken = F.exists(
        F.zip_with(
            frags,
            F.slice(frags, F.lit(2), F.greatest(F.size(frags) - 1, F.lit(0))),
            lambda a, b: a["in_scope"] & a["text"].endswith("\r") & ~b["in_scope"] & b["text"].startswith("\n"),
        ),
        lambda x: F.coalesce(x, F.lit(False)),
    )
    cut = explode(
        frags,
        lambda t: F.flatten(
            F.transform(
                F.split(t, "\r", -1),
                lambda x, i: F.when(i == 0, F.array(fragment(x, True))).otherwise(
                    F.array(fragment(F.lit("\r"), False), fragment(x, True))
                ),
            )
        ),
    )
    return F.when(F.exists(frags, lambda f: f["in_scope"] & f["text"].contains("\r")) & broken, cut).otherwise(frags)


def squeeze(frags: Column) -> Column:
    """Of neighbouring fragments in scope, keep the first."""
    before = F.concat(F.array(F.lit(False)), F.transform(frags, lambda f: f["in_scope"]))
    kept = F.zip_with(
        frags, F.slice(before, F.lit(1), F.size(frags)), lambda f, b: F.when(~(f["in_scope"] & b), f)
    )
    return F.filter(kept, lambda f: f.isNotNull())


def render(frags: Column) -> Column:
    return F.array_join(F.transform(frags, lambda f: f["text"]), "")


def any_in_scope(frags: Column) -> Column:
    return F.exists(frags, lambda f: f["in_scope"])


ARROW = pa.list_(
    pa.struct([("text", pa.string()), ("in_scope", pa.bool_()), ("caps", pa.map_(pa.string(), pa.string()))])
)


def to_python(column: pa.Array) -> list[list[Fragment] | None]:
    """Rows of fragments, field by field rather than one object for each fragment."""
    flat = column.flatten()
    texts, flags, caps = (flat.field(k) for k in range(3))
    groups = [None] * len(flat) if caps.null_count == len(caps) else [None if c is None else dict(c) for c in caps.to_pylist()]
    found = list(zip(texts.to_pylist(), flags.to_pylist(), groups))
    out: list[list[Fragment] | None] = []
    at = 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else found[at : at + n])
        at += n or 0
    return out


def to_arrow(rows: list[list[Fragment] | None]) -> pa.Array:
    offsets, at = [0], 0
    for row in rows:
        at += len(row or ())
        offsets.append(at)
    texts, flags, caps = zip(*(f for row in rows for f in row or ())) if at else ((), (), ())
    kind = ARROW.value_type
    groups = pa.nulls(at, kind[2].type) if not any(caps) else pa.array([None if c is None else list(c.items()) for c in caps], kind[2].type)
    flat = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(flags, pa.bool_()), groups], fields=list(kind))
    ends = pa.array([None if row is None else o for row, o in zip(rows, offsets)] + [at], pa.int32())
    return pa.ListArray.from_arrays(ends, flat)


def python_explode(frags: Column, scope: Callable[[str], list[Fragment]]) -> Column:
    """explode() with a Python function, one Arrow batch at a time."""

    def column(batch: pa.Array) -> pa.Array:
        return to_arrow(
            [
                None if row is None else [g for f in row for g in (scope(f[0]) if f[1] else [f]) if g[0]]
                for row in to_python(batch)
            ]
        )

    return F.arrow_udf(column, FRAGMENTS)(frags)


def from_ranges(text: str, ranges: list[tuple[int, int]], caps: list[dict[str, str] | None] | None = None) -> list[Fragment]:
    """Covered parts of the text are in scope, gaps out; ranges are in characters and must not overlap."""
    out: list[Fragment] = []
    at = 0
    order = sorted(range(len(ranges)), key=lambda i: ranges[i][0])
    for i in order:
        a, b = ranges[i]
        if a < 0 or b > len(text):
            raise IndexError(f"range {a}..{b} is outside a text of length {len(text)}")
        out += [(text[at:a], False, None), (text[a:b], True, caps[i] if caps else None)]
        at = b
    out.append((text[at:], False, None))
    return [f for f in out if f[0]]
