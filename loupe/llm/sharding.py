"""Histogram sort: byte-balanced shards in key order with one exchange.

The exact number of bytes below candidate boundaries is counted over all partitions, and
the probes are refined between the two that enclose each wanted boundary until every
splitter is within tolerance or its bracket can't be divided any further.  The counting
rounds read a narrow table (key, tie-break, bytes) written once; the rows themselves move
once, to the partition of their shard.

Where there are more than COARSE boundaries, so many are refined over all partitions; the narrow table
is then exchanged by the intervals between them, with rows of equal key summed up before, and the
boundaries inside each are read off its running byte count.  So the driver holds COARSE x PROBES probes
at most, and 16 bytes a shard at the end.

The key is doc_id, ties are ordered by a hash of the text, so that even one repeated
doc_id can be split over shards; rows equal in both stay together, and a shard then
exceeds the tolerance by no more than such a group needs.

Defined results: a null doc_id sorts as the least key; null and empty texts count their
fixed overhead only; repeated rows stay, in one shard; a row longer than a shard is in one whole, and
the shards around it have fewer rows; an empty table gives no rows; an input column named `shard` is
replaced, all others pass unchanged.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import written

SHARD_BYTES = 32 << 20
ROW_BYTES = 16
TOLERANCE = 0.02
PROBES = 15
#: The driver refines at most so many boundaries; more are found within the intervals between these, by one task each.
COARSE = 4096
_TOP = np.uint64(1 << 63)


def _unsigned(column: pa.Array) -> np.ndarray:
    """Order-preserving uint64 of a bigint column; null is the least."""
    values = column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
    return values.view(np.uint64) ^ _TOP


class Splitters:
    """Sorted 128-bit boundaries, as arrays of high and low halves."""

    def __init__(self, keys: list[int]):
        self.high = np.array([k >> 64 for k in keys], dtype=np.uint64)
        self.low = np.array([k & (1 << 64) - 1 for k in keys], dtype=np.uint64)

    def interval(self, key: pa.Array, tie: pa.Array) -> np.ndarray:
        """How many boundaries are at or below each (key, tie)."""
        k, t = _unsigned(key), _unsigned(tie)
        lo, hi = np.searchsorted(self.high, k, "left"), np.searchsorted(self.high, k, "right")
        out = lo.copy()
        for a in np.unique(lo[lo < hi]):
            at = np.flatnonzero((lo == a) & (hi > lo))
            out[at] = a + np.searchsorted(self.low[a : hi[at[0]]], t[at], "right")
        return out


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sum of n by at, exact also beyond 2^53."""
    halves = (np.bincount(at, weights=x, minlength=size).astype(np.int64) for x in (n >> 32, n & 0xFFFFFFFF))
    high, low = halves
    return (high << 32) + low


def _below(narrow: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes below each probe; the driver gets one row for each interval between them."""
    cuts = Splitters(probes)

    def count(batches):
        total = np.zeros(len(probes) + 1, dtype=np.int64)
        for b in batches:
            total += _sums(cuts.interval(b.column(0), b.column(1)), b.column(2).to_numpy(), len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "bytes"])

    rows = narrow.mapInArrow(count, "i int, bytes bigint").groupBy("i").agg(F.sum("bytes")).collect()
    held = np.zeros(len(probes) + 1, dtype=np.int64)
    for i, n in rows:
        held[i] = n
    return np.cumsum(held)[:-1].tolist()


def _tie(text: str = "text"):
    return F.coalesce(F.xxhash64(text), F.lit(0))


def splitters(
    docs: DataFrame, shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE, probes: int = PROBES, coarse: int = COARSE
) -> list[int]:
    """Boundaries between shards; keys at or above the i-th are in a shard after i."""
    narrow = written(
        docs.select(
            F.col("doc_id").cast("long").alias("k"),
            _tie().alias("t"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("bytes"),
        ),
        "keys",
    )
    least, most, total = narrow.agg(
        F.min(F.coalesce("k", F.lit(-(1 << 63)))), F.max(F.coalesce("k", F.lit(-(1 << 63)))), F.sum("bytes")
    ).first()
    if total is None:
        return []
    shards = max(1, round(total / shard_bytes))
    slack = tolerance * total / shards
    first, last = (least + (1 << 63)) << 64, (most + (1 << 63) + 1) << 64
    step = -(-shards // coarse)
    found = _refined(narrow, [total * j // shards for j in range(step, shards, step)], first, last, total, slack, probes)
    if step > 1:
        found += _within(narrow, sorted(set(found)), total, shards)
    return sorted({x for x in found if x != first})


def _refined(narrow: DataFrame, goal: list[int], first: int, last: int, total: int, slack: float, probes: int) -> list[int]:
    """The boundary for each wanted number of bytes below it, by probes between the two that enclose it."""
    bracket = [(first, 0, last, total) for _ in goal]
    found: list[int | None] = [None] * len(goal)
    while None in found:
        tried = set()
        for j, (lo, _, hi, _) in enumerate(bracket):
            if found[j] is None:
                tried |= {lo + (hi - lo) * p // (probes + 1) for p in range(1, probes + 1)}
        cuts = sorted(tried)
        below = _below(narrow, cuts)
        for j, (lo, a, hi, b) in enumerate(bracket):
            if found[j] is not None:
                continue
            i = bisect_right(below, goal[j])  # below[i - 1] <= goal < below[i]
            if i > 0 and cuts[i - 1] > lo:
                lo, a = cuts[i - 1], below[i - 1]
            if i < len(cuts) and cuts[i] < hi:
                hi, b = cuts[i], below[i]
            bracket[j] = lo, a, hi, b
            near, off, held = min(((lo, goal[j] - a, a), (hi, b - goal[j], b)), key=lambda x: x[1])
            if off <= slack or hi - lo <= 1:
                found[j] = near if 0 < held < total else first  # no boundary without rows on both sides
    return found


def _within(narrow: DataFrame, coarse: list[int], total: int, shards: int) -> list[int]:
    """The boundaries nearest to all wanted numbers of bytes, from the running count in each interval of coarse ones."""
    cuts = Splitters(coarse)
    base = [0, *_below(narrow, coarse)]

    def place(key: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(cuts.interval(key, tie), pa.int32())

    def read(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        key, tie = (_unsigned(t[c].combine_chunks()) for c in ("k", "t"))
        by = np.lexsort((tie, key))
        key, tie, size = key[by], tie[by], t["bytes"].to_numpy()[by]
        below = base[t["c"][0].as_py()] + np.cumsum(size) - size
        end = below[-1] + size[-1]
        goal = np.array([total * j // shards for j in range(below[0] * shards // total, end * shards // total + 1)], np.int64)
        goal = goal[(goal > below[0]) & (goal < end)]
        at = np.minimum(np.searchsorted(below, goal), len(below) - 1)
        at = np.where((at > 0) & (goal - below[at - 1] <= np.abs(below[at] - goal)), at - 1, at)
        at = np.unique(at[at > 0])
        yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)) for x in (key, tie)], ["high", "low"])

    rows = (
        narrow.groupBy("k", "t").agg(F.sum("bytes").alias("bytes"))
        .withColumn("c", F.arrow_udf(place, "int")("k", "t"))
        .repartitionById(len(coarse) + 1, F.col("c"))
        .mapInArrow(read, "high bigint, low bigint")
        .toArrow()
    )
    high, low = (rows[c].to_numpy().view(np.uint64).tolist() for c in ("high", "low"))
    return [h << 64 | x for h, x in zip(high, low)]


def shard(docs: DataFrame, shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with `shard`, each shard one partition sorted by doc_id."""
    keys = splitters(docs, shard_bytes, tolerance)
    cuts = Splitters(keys)

    def column(key: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(cuts.interval(key, tie), pa.int32())

    own = F.arrow_udf(column, "int")(F.col("doc_id").cast("long"), _tie())
    return (
        docs.drop("shard")
        .withColumn("shard", own)
        .repartitionById(len(keys) + 1, F.col("shard"))
        .sortWithinPartitions("doc_id", _tie())
    )
