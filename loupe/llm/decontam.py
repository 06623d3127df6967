"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Items and documents are sequences of word tokens.  An item of m words may occur in a
document with up to k = max(1, floor(rate * m)) word edits (0 below MIN_FUZZY words).
Cut into k + 1 pieces, any such occurrence has one piece intact, so exact piece hits find
every candidate; Myers' bit-parallel recurrence then gives the least edit distance of the
item to any stretch of words around the hit.

Items go to the executors in groups of at most GROUP_WORDS words, one scan of the
documents each, so what is broadcast has a bound whatever the benchmark's size.

Defined results: items and documents without words (null or empty texts) match nothing;
items with equal words are searched for once and all reported, an item row with a null item_id as null;
repeated rows are reported each; of several stretches with the least distance the one that ends first is
reported; texts of any length are searched whole; an empty table
on either side gives an empty result; only doc_id, text, item_id are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X

RATE = 0.15
MIN_FUZZY = 8
GROUP_WORDS = 4_000_000
HITS = "array<struct<item_id: bigint, distance: int, end_token: int>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end_token", pa.int32())]))


def budget(words: int, rate: float = RATE) -> int:
    return max(1, int(words * rate)) if words >= MIN_FUZZY else 0


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of text, end of the first such substring)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Pieces of a group of items, by length and hash."""

    def __init__(self, items: list[tuple[int | None, list[int]]], rate: float):
        same: dict[tuple[int, ...], list[int | None]] = {}
        for i, w in items:
            if w:
                same.setdefault(tuple(w), []).append(i)
        self.items = [(ids, list(w), budget(len(w), rate)) for w, ids in same.items()]
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, words, k) in enumerate(self.items):
            k = min(k, len(words) - 1)
            cuts = [len(words) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                h = X.gram_hash(np.array(words[a:b], dtype=np.uint64), b - a)[0]
                rows.setdefault(b - a, []).append((int(h), n, a))
        self.pieces = {}
        for size, r in rows.items():
            r.sort()
            hashes = np.array([x[0] for x in r], dtype=np.uint64)
            table = np.zeros(1 << 20, dtype=bool)
            table[hashes >> np.uint64(44)] = True
            self.pieces[size] = (hashes, np.array([x[1:] for x in r], dtype=np.int64).reshape(-1, 2), table)

    def hits(self, texts: pa.Array) -> list[list[dict]]:
        t = X.Tokens(texts)
        seen: dict[tuple[int, int], set[int]] = {}
        for size, (hashes, owners, table) in self.pieces.items():
            g = X.gram_hash(t.hash, size)
            at = np.flatnonzero(table[g >> np.uint64(44)])
            lo, hi = np.searchsorted(hashes, g[at], "left"), np.searchsorted(hashes, g[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            row = np.searchsorted(t.offsets, at, side="right") - 1
            ok = at + size <= t.offsets[row + 1]
            for p, r, a, b in zip(at[ok].tolist(), row[ok].tolist(), lo[ok].tolist(), hi[ok].tolist()):
                for n, offset in owners[a:b].tolist():
                    seen.setdefault((r, n), set()).add(p - offset)
        out: list[list[dict]] = [[] for _ in range(t.rows)]
        for (row, n), starts in sorted(seen.items()):
            ids, words, k = self.items[n]
            a, b = int(t.offsets[row]), int(t.offsets[row + 1])
            best = None
            reach = -1
            for s in sorted(starts):  # windows that overlap are verified as one
                lo, hi = max(a, s - k), min(b, s + len(words) + k)
                if reach >= 0 and lo <= reach:
                    reach = max(reach, hi)
                    continue
                if reach >= 0:
                    best = self._better(best, words, t, begin, reach, a)
                begin, reach = lo, hi
            best = self._better(best, words, t, begin, reach, a)
            if best[0] <= k:
                out[row] += [{"item_id": i, "distance": best[0], "end_token": best[1]} for i in ids]
        return out

    @staticmethod
    def _better(best, words, t, lo, hi, base):
        d, end = best_match(words, t.hash[lo:hi].tolist())
        return min(best or (1 << 30, 0), (d, lo - base + end))

    def column(self, texts: pa.Array) -> pa.Array:
        texts = X.as_array(texts)
        out: list[list[dict]] = []
        for a, b in X.slices(texts):
            out += self.hits(texts.slice(a, b - a))
        return pa.array(out, type=_HITS)


def indexes(benchmark: DataFrame, rate: float = RATE, group_words: int = GROUP_WORDS) -> list[Index]:
    rows = benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    groups: list[list[tuple[int | None, list[int]]]] = [[]]
    held = 0
    for item, text in rows:
        words = X.Tokens(pa.array([text], type=pa.large_string())).hash.tolist()
        if held and held + len(words) > group_words:
            groups.append([])
            held = 0
        groups[-1].append((item, words))
        held += len(words)
    return [Index(g, rate) for g in groups]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, end_token), one row for each item that a document contains."""
    found = [
        docs.select("doc_id", F.explode(F.arrow_udf(i.column, HITS)("text")).alias("m")).select("doc_id", "m.*")
        for i in indexes(benchmark, rate, group_words)
    ]
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, group_words: int = GROUP_WORDS) -> DataFrame:
    """The rows of docs that contain no item within its budget."""
    for i in indexes(benchmark, rate, group_words):
        docs = docs.where(F.size(F.coalesce(F.arrow_udf(i.column, HITS)("text"), F.array())) == 0)
    return docs
