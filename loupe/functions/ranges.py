"""Half-open ranges, as plain lists for Python code and as Spark columns.

The column forms take ARRAY<STRUCT<start, end>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Range = tuple[int, int]
RANGES = "array<struct<start: int, end: int>>"
SHATTER_LIMIT = 65_535


def collect(ranges: list[Range]) -> list[Range]:
    """Sorted by start; equal starts keep their order."""
    return sorted(ranges, key=lambda r: r[0])


def merge(ranges: list[Range]) -> list[Range]:
    """Ranges that overlap or touch become one."""
    out: list[Range] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def subtract(left: list[Range], right: list[Range]) -> list[Range]:
    """What of `left` no range of `right` covers, in one sweep over both."""
    out: list[Range] = []
    holes, i = merge(right), 0
    for a, b in collect(left):
        while i and holes[i - 1][1] > a:  # ranges of `left` may overlap
            i -= 1
        while i < len(holes) and holes[i][1] <= a:
            i += 1
        k = i
        while a < b and k < len(holes) and holes[k][0] < b:
            if holes[k][0] > a:
                out.append((a, holes[k][0]))
            a = max(a, holes[k][1])
            k += 1
        if a < b:
            out.append((a, b))
    return out


def shatter(start: int, end: int) -> list[Range]:
    """The range as ranges of length 1; a reversed one is empty."""
    if end - start > SHATTER_LIMIT:
        raise ValueError("range too long to shatter")
    return [(i, i + 1) for i in range(start, end)]


def _struct(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def merge_column(ranges: Column) -> Column:
    """merge() without leaving the JVM: a range starts a run where it lies beyond all ends before it."""
    ordered = F.array_sort(ranges)
    folded = F.aggregate(
        ordered,
        F.struct(
            F.slice(ordered, 1, 0).alias("done"),
            F.get(ordered, F.lit(0)).alias("open"),
        ),
        lambda acc, r: F.when(
            r["start"] <= acc["open"]["end"],
            F.struct(
                acc["done"].alias("done"),
                _struct(acc["open"]["start"], F.greatest(acc["open"]["end"], r["end"])).alias("open"),
            ),
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), r.alias("open"))),
        lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))),
    )
    return folded


def subtract_column(left: Column, right: Column) -> Column:
    """subtract() without leaving the JVM, for left ranges that don't overlap."""
    return F.aggregate(
        merge_column(right),
        F.array_sort(left),
        lambda kept, hole: F.filter(
            F.flatten(
                F.transform(
                    kept,
                    lambda r: F.array(
                        _struct(r["start"], F.least(r["end"], hole["start"])),
                        _struct(F.greatest(r["start"], hole["end"]), r["end"]),
                    ),
                )
            ),
            lambda r: r["start"] < r["end"],
        ),
    )


def shatter_column(start: Column, end: Column) -> Column:
    too_long = F.raise_error(F.lit("range too long to shatter")).cast(RANGES)
    pieces = F.transform(F.sequence(start, end - 1), lambda i: _struct(i.cast("int"), (i + 1).cast("int")))
    empty = F.array().cast(RANGES)
    return F.when(start >= end, empty).when(end - start > SHATTER_LIMIT, too_long).otherwise(pieces)
