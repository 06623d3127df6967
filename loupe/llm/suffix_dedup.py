"""Repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A passage of at least `least` word tokens that occurs twice is found whole, wherever its
copies are.  Every window of `least` tokens has a minimizer, the smallest hash of its
anchor-grams; equal windows have equal minimizers, so windows are grouped by them:

1. Each document's minimizers are exchanged; those of one place only end there.  A minimizer that
   has several places within a task survives at once, and goes on as one record.
2. Stretches of consecutive windows with a surviving minimizer are cut out.  Each distinct stretch goes to
   the minimizer's bucket once from a task, as tokens, with its first and last place; the places
   stay behind in a narrow table.
3. In a bucket, distinct stretches are concatenated, each closed by its own mark; from
   the suffix array's Burrows-Wheeler transform, intervals are extended backwards breadth
   first, which gives the common-prefix lengths in increasing order, and the expansion
   stops at `least`: suffixes between undefined lengths share a whole window.
4. Runs of windows with several occurrences join the places of their stretch, and are merged to spans
   by document.

So what a passage of very many documents needs in one task is one record for each task that has seen it.
`keep` marks the spans whose windows are the first occurrence, in order of doc_id, of row
and of position; the others are what deduplication removes.  Tokens are compared by 32 of
their hash bits together with the 64-bit minimizer; rows and stretches are named by two 64-bit hashes.

Defined results: null and empty texts, and texts shorter than `least` tokens, have no
spans; identical rows (equal doc_id and text) count once; null doc_ids take part and sort
last; a passage repeated within one document counts as repeated; very long texts are read whole; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as X
from .exchange import Packed, by_bucket, parts, records, written

LEAST = 50
ANCHOR = 8

#: A place of a minimizer, or a mark that a task has found several.
_PLACE = np.dtype([("key", "u8"), ("rk", "i8"), ("several", "u1")])
HELD_PLACES, HELD_WORDS = 1 << 21, 1 << 23
_NONE = (1 << 63) - 1


def minimizers(tokens: X.Tokens, least: int = LEAST, anchor: int = ANCHOR):
    """(row, first window, number of windows, minimizer) of each stretch of windows with one minimizer.

    Windows are numbered by their first token within the row.
    """
    grams = X.gram_hash(tokens.hash, anchor)
    width = least - anchor + 1
    count = np.maximum(np.diff(tokens.offsets) - least + 1, 0)
    if not count.sum():
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    # least of `width` consecutive grams, by doubling
    span, low = 1, grams
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(grams) - width + 1], low[width - span : len(grams) - span + 1])
    at = X.ranges(tokens.offsets[:-1], count)
    row = np.repeat(np.arange(tokens.rows), count)
    value = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], (at - tokens.offsets[row])[first], np.diff(np.append(first, len(at))), value[first]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must occur once."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def bounded_lcp(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """LCP of neighbours in suffix order where it is under `least`, -1 elsewhere; entry i is of suffixes i-1 and i.

    Level by level: an interval of suffixes with a common prefix of length l is extended
    backwards by every symbol of its transform; the end of each extension, if it isn't
    known yet, has LCP l, and only such extensions are expanded further.
    """
    n = len(text)
    before = text[order - 1]  # the transform; text[-1] precedes the whole text
    step = np.empty(n, np.int64)  # where the suffix one symbol longer is
    step[np.argsort(before, kind="stable")] = np.arange(n)
    symbol = text[order]
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    starts = np.flatnonzero(np.diff(symbol, prepend=symbol[0] - 1))
    lo, hi = starts, np.append(starts[1:], n)
    lcp[hi[hi < n]] = 0
    for level in range(1, least):
        if not len(lo):
            break
        size = hi - lo
        at = X.ranges(lo, size)
        own = np.repeat(np.arange(len(lo)), size)
        to = step[at]
        if len(lo) > 1 or size[0] > 1:
            by = np.argsort(own * np.int64(n) + to)
            to, own = to[by], own[by]
        new = np.ones(len(to), bool)
        new[1:] = (own[1:] != own[:-1]) | (symbol[to[1:]] != symbol[to[:-1]])
        first = np.flatnonzero(new)
        lo, hi = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        open_ = lcp[hi] == -1
        lo, hi = lo[open_], hi[open_]
        lcp[hi] = level
    return lcp[:n]


def windows(stretches: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, stretch, offset) of every window; windows of one class are equal."""
    sizes = np.array([len(s) for s in stretches], dtype=np.int64)
    _, ids = np.unique(np.concatenate(stretches), return_inverse=True)
    text = np.empty(sizes.sum() + len(sizes), np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text[X.ranges(begin, sizes)] = ids + len(sizes)
    text[begin + sizes] = np.arange(len(sizes))  # a mark of its own closes each stretch
    order = suffix_array(text)
    cls = np.cumsum(bounded_lcp(text, order, least) >= 0)
    owner = np.searchsorted(begin, order, side="right") - 1
    offset = order - begin[owner]
    whole = offset + least <= sizes[owner]
    return cls[whole], owner[whole], offset[whole]


def span_hash(tokens: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each stretch of tokens."""
    power, inverse = X._powers(len(tokens))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(tokens + np.uint64(seed)) * power[: len(tokens)])])
        return X.mix((sums[end] - sums[start]) * inverse[start])


def _lists(rk: np.ndarray, keys: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(rk, list of its keys) in batches."""
    by = np.argsort(rk, kind="stable")
    rk, keys = rk[by], pa.array(keys[by].view(np.int64))
    cut = np.concatenate([[0], np.flatnonzero(np.diff(rk)) + 1, [len(rk)]]) if len(rk) else np.zeros(1, np.int64)
    for s in range(0, len(cut) - 1, 1 << 13):
        c = cut[s : s + (1 << 13) + 1]
        lists = pa.ListArray.from_arrays(pa.array(c - c[0], pa.int32()), keys.slice(c[0], c[-1] - c[0]))
        yield pa.array(rk[c[:-1]].copy()), lists


def _places(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    """(rk, keys): the minimizers of each document that occur in more than one place."""
    buckets = parts(docs)
    names = ["bucket", "blob", "rk", "keys"]

    def settled(held):
        """Batches of what a task has gathered: records for others, and what needs none."""
        key, rk, twice = (np.concatenate(x) for x in zip(*held))
        held.clear()
        by = np.lexsort((~twice, rk, key))  # identical rows are one place, twice if a row says so
        key, rk, twice = key[by], rk[by], twice[by]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (rk[1:] != rk[:-1])
        key, rk, twice = key[first], rk[first], twice[first]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(cut, len(key))) + np.maximum.reduceat(twice.astype(np.int64), cut)
        several = np.repeat(many > 1, np.diff(np.append(cut, len(key))))
        head = np.zeros(len(key), bool)
        head[cut] = True
        send = ~several | head
        r = np.empty(send.sum(), _PLACE)
        r["key"], r["rk"], r["several"] = key[send], rk[send], several[send]
        packed = Packed(buckets)
        for b in (*packed.add(r), *packed.done()):
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
        for a, b in _lists(rk[several], key[several]):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), a, b], names)

    def emit(batches):
        held, size = [], 0
        for b in batches:
            texts, rk = X.as_array(b.column(1)), b.column(0).to_numpy()
            for i, j in X.slices(texts):
                t = X.Tokens(texts.slice(i, j - i))
                row, first, count, value = minimizers(t, least, anchor)
                if not len(row):
                    continue
                # a stretch that holds its minimizer twice may repeat within itself, so it counts twice
                own = count + least - anchor
                grams = X.gram_hash(t.hash, anchor)[X.ranges(t.offsets[row] + first, own)]
                hits = grams == np.repeat(value, own)
                twice = np.add.reduceat(hits.astype(np.int64), np.cumsum(own) - own) > 1
                # so does a document with several stretches under one minimizer
                by = np.lexsort((row, value))
                same = (value[by][1:] == value[by][:-1]) & (row[by][1:] == row[by][:-1])
                twice[by[1:][same]] = True
                held.append((value, rk[i:j][row], twice))
                size += len(row)
                if size > HELD_PLACES:
                    yield from settled(held)
                    size = 0
        if held:
            yield from settled(held)

    def several(batches):
        r = records(batches, _PLACE)
        if not len(r):
            return
        r = r[np.lexsort((r["several"], r["rk"], r["key"]))]
        new = np.ones(len(r), bool)  # identical rows are one here, too
        new[1:] = (r["key"][1:] != r["key"][:-1]) | (r["rk"][1:] != r["rk"][:-1]) | (r["several"][1:] != r["several"][:-1])
        r = r[new]
        cut = np.concatenate([[0], np.flatnonzero(r["key"][1:] != r["key"][:-1]) + 1])
        many = np.diff(np.append(cut, len(r)))
        r = r[np.repeat(many > 1, many) & (r["several"] == 0)]
        for a, b in _lists(r["rk"].copy(), r["key"].copy()):
            yield pa.RecordBatch.from_arrays([a, b], ["rk", "keys"])

    sent = written(docs.select("rk", "text").mapInArrow(emit, "bucket int, blob binary, rk bigint, keys array<bigint>"), "minimizers")
    found = by_bucket(sent.where("bucket is not null").select("bucket", "blob"), buckets).mapInArrow(several, "rk bigint, keys array<bigint>")
    found = found.unionByName(sent.where("bucket is null").select("rk", "keys"))
    return found.groupBy("rk").agg(F.flatten(F.collect_list("keys")).alias("keys"))


_ROW = "key bigint, h1 bigint, h2 bigint, words binary, doc bigint, rk bigint, rk2 bigint, first bigint"
_LAST = "last_doc bigint, last_rk bigint, last_rk2 bigint, last_first bigint"
_NAMES = [x.split()[0] for x in f"{_ROW}, {_LAST}".split(", ")]


def _ends(place: tuple[np.ndarray, ...], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first and the last place of each of the groups 0, 1, ..."""
    by = np.lexsort((*place[::-1], group))
    begin = np.searchsorted(group[by], np.arange(group.max() + 1))
    return by[begin], by[np.append(begin[1:], len(by)) - 1]


def _stretches(docs: DataFrame, places: DataFrame, least: int, anchor: int) -> DataFrame:
    """Rows of two kinds: distinct stretches of a task with `words`, first and last place; places, without words."""

    def batch(columns, n):
        kinds = [pa.binary() if c == "words" else pa.int64() for c in _NAMES]
        full = [pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(full, _NAMES)

    def settled(held):
        key, h1, h2, doc, rk, rk2, first, size = (np.concatenate([x[k] for x in held]) for k in range(8))
        words = np.concatenate([x[8] for x in held])
        held.clear()
        begin = np.cumsum(size) - size
        by = np.lexsort((h2, h1, key))
        new = np.ones(len(by), bool)
        new[1:] = (key[by][1:] != key[by][:-1]) | (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        place = (doc, rk, rk2, first)
        lo, hi = _ends(place, group)
        for s in range(0, len(lo), 1 << 14):
            a, b = lo[s : s + (1 << 14)], hi[s : s + (1 << 14)]
            off = np.concatenate([[0], np.cumsum(size[a] * 4)]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(words[X.ranges(begin[a], size[a])])])
            yield batch([key[a], h1[a], h2[a], blob, *(x[a] for x in place), *(x[b] for x in place)], len(a))

    def cut(batches):
        held, weight = [], 0
        for b in batches:
            texts, keys = X.as_array(b.column(3)), b.column(4)
            ids = b.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
            rk, rk2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, j in X.slices(texts):
                t = X.Tokens(texts.slice(i, j - i))
                row, first, count, value = minimizers(t, least, anchor)
                lists = keys.slice(i, j - i)
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(j - i), np.asarray(lists.value_lengths().fill_null(0)))
                # (row, key) pairs are compared through one mixed value
                with np.errstate(over="ignore"):
                    wanted = np.unique(X.mix(flat + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    mine = X.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                at = np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))
                hit = wanted[at] == mine if len(wanted) else np.zeros(len(mine), bool)
                row, first, count, value = row[hit], first[hit], count[hit], value[hit]
                if not len(row):
                    continue
                size = count + least - 1
                begin = t.offsets[row] + first
                h1, h2 = (span_hash(t.hash, begin, begin + size, k).view(np.int64) for k in (1, 2))
                words = (t.hash >> np.uint64(32)).astype(np.uint32)[X.ranges(begin, size)]
                mine = (value.view(np.int64), h1, h2, ids[i:j][row], rk[i:j][row], rk2[i:j][row], first.astype(np.int64))
                yield batch([*mine[:3], None, *mine[3:], None, None, None, None], len(row))
                held.append((*mine, size, words))
                weight += len(words)
                if weight > HELD_WORDS:
                    yield from settled(held)
                    weight = 0
        if held:
            yield from settled(held)

    return docs.join(places, "rk").select("doc_id", "rk", "rk2", "text", "keys").mapInArrow(cut, f"{_ROW}, {_LAST}")


def _runs(stretches: DataFrame, buckets: int, least: int) -> DataFrame:
    """(key, h1, h2, from, to, origin...): runs of a distinct stretch's windows that occur in several places, and where first."""

    def find(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        key, h1, h2 = (table[c].to_numpy() for c in ("key", "h1", "h2"))
        lo = tuple(table[c].to_numpy() for c in ("doc", "rk", "rk2", "first"))
        hi = tuple(table[c].to_numpy() for c in ("last_doc", "last_rk", "last_rk2", "last_first"))
        by = np.lexsort((h2, h1, key))
        new = np.ones(len(by), bool)
        new[1:] = (key[by][1:] != key[by][:-1]) | (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        first, _ = _ends(lo, group)
        _, last = _ends(hi, group)
        lo, hi = tuple(x[first] for x in lo), tuple(x[last] for x in hi)
        wide = np.logical_or.reduce([a != b for a, b in zip(lo, hi)])  # the stretch itself has several places
        words = table["words"].combine_chunks() if table["words"].num_chunks > 1 else table["words"].chunk(0)
        texts = [np.frombuffer(words[i].as_buffer(), np.uint32) for i in first.tolist()]
        cls, owner, offset = windows(texts, least)
        count = np.bincount(cls) + np.bincount(cls, weights=wide[owner]).astype(np.int64)
        some = count[cls] > 1
        cls, owner, offset = cls[some], owner[some], offset[some]
        if not len(cls):
            return
        start = lo[3][owner] + offset
        by = np.lexsort((start, lo[2][owner], lo[1][owner], lo[0][owner], cls))
        head = np.ones(len(by), bool)
        head[1:] = cls[by][1:] != cls[by][:-1]
        origin = np.empty(len(by), np.int64)
        origin[by] = by[head][np.cumsum(head) - 1]
        by = np.lexsort((offset, owner))
        owner, offset, origin_owner, origin_start = owner[by], offset[by], owner[origin][by], start[origin][by]
        new = np.ones(len(by), bool)
        new[1:] = (
            (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (origin_owner[1:] != origin_owner[:-1])
            | (origin_start[1:] != origin_start[:-1] + 1)
        )
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(by)) - 1
        rows = first[owner[at]]
        out = [key[rows], h1[rows], h2[rows], offset[at], offset[end] + least, *(x[origin_owner[at]] for x in lo[:3]), origin_start[at]]
        for s in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[s : s + (1 << 16)]) for x in out], ["key", "h1", "h2", "from", "to", "o_doc", "o_rk", "o_rk2", "o_start"]
            )

    return stretches.repartition(buckets, "key").mapInArrow(
        find, "key bigint, h1 bigint, h2 bigint, from bigint, to bigint, o_doc bigint, o_rk bigint, o_rk2 bigint, o_start bigint"
    )


def spans(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start_token, end_token, keep, first_doc): repeated spans, merged where they overlap.

    first_doc is the least document that holds the first occurrence of any of the span's windows.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = keyed.select("*", F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64(F.lit(1), "doc_id", "text").alias("rk2"))
    cut = written(_stretches(keyed, _places(keyed, least, anchor), least, anchor), "stretches")
    runs = written(_runs(cut.where("words is not null"), parts(keyed), least), "runs")
    start = F.col("first") + F.col("from")
    found = (
        cut.where("words is null").select("key", "h1", "h2", "doc", "rk", "rk2", "first").join(runs, ["key", "h1", "h2"])
        .select(
            "doc", "rk", "rk2", start.cast("int").alias("start"), (F.col("first") + F.col("to")).cast("int").alias("end"),
            ((F.col("doc") == F.col("o_doc")) & (F.col("rk") == F.col("o_rk")) & (F.col("rk2") == F.col("o_rk2")) & (start == F.col("o_start"))).alias("keep"),
            "o_doc",
        )
        .distinct()  # of identical rows one
    )
    order = Window.partitionBy("doc", "rk", "rk2", "keep").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum((F.col("start") > F.coalesce("before", F.lit(-1))).cast("int")).over(order)  # touching spans merge
    return (
        found.withColumn("before", before)
        .withColumn("g", group)
        .groupBy("doc", "rk", "rk2", "keep", "g")
        .agg(F.min("start").alias("start_token"), F.max("end").alias("end_token"), F.min("o_doc").alias("o_doc"))
        .select(
            F.nullif("doc", F.lit(_NONE)).alias("doc_id"), "start_token", "end_token", "keep", F.nullif("o_doc", F.lit(_NONE)).alias("first_doc")
        )
    )
