"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Each document is its set of word n-grams.  Under one global order of grams (those found in
many documents last), two sets with Jaccard similarity of at least t share l grams among
the first |s| - ceil(t |s|) + l of each, for every l they have room for.  Every document
chooses its l by estimated cost: a longer prefix is read more, but demands more shared
grams before a pair is verified.  A pair is a candidate if the grams that both emitted
number at least the smaller of their two l, so nothing is lost by choosing separately.

1. One pass counts all grams (the order and the cost estimate) and hashes each document's whole
   set; documents with equal sets are one from here on.  Of a set that many documents have, only
   the first emits a prefix.  The most frequent grams are known by name, all others by the count of a
   cell of a table of at most LEVEL_CELLS bytes, in which grams of a few documents are left out.  A gram that
   is told from rare ones by its share of the documents alone has a list that grows with them, and pairs
   that grow with their square.
2. Prefixes are exchanged once by gram; lists of one set end there, the others give pairs.
   Lists of grams that keep company and promise more than TILE_PAIRS pairs are cut into blocks of
   sets, and each pair of blocks is a task's work of its own.
3. Pairs with enough matches are verified exactly on the texts, which are sent once to
   each block of pairs around a common neighbour.  There they become the number of links of
   each set and a spanning forest, so that what leaves is linear in the sets.

join() returns a row for each document: its class (the least doc_id that it is connected
to through similar documents), and its links, the number of other documents similar to
it.  Copies are counted, not expanded.  similar() gives the pairs of sets themselves.

Sets and rows are named by two independent 64-bit hashes; sets that agree in the first alone are
told apart and verified each.

Defined results: documents without words (null or empty texts) are similar to nothing and
their own class; documents of 1 to n-1 words have one gram; repeated rows are documents of
their own, similar to each other; null doc_ids take part, and a class without any doc_id
is null; ties need no breaking, as all pairs that reach the threshold count; very long texts are
read whole, their sets held in memory one at a time; an empty table gives an empty result; further
columns aren't read, and keep_one() passes them unchanged: of rows equal in doc_id and text
it keeps any one, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .exchange import PACKED, Packed, by_bucket, discard, parts, records, written

N = 3
THRESHOLD = 0.6
MAX_MATCHES = 8
HEAVY_SHARE = 0.0001
LOCAL_LEAST = 3
VERIFY_COST = 50.0
RARE_PARTNERS = 0.2
SIZE_STEP = 1.05
BLOCK_SETS = 1024
#: At most this many frequent grams, the most frequent, are known to all tasks; which they are changes no result.
HEAVY_MOST = 1 << 20
#: A set that at least this share of documents, and this many, have; there are at most 1 / share of them.
COPIES_SHARE, COPIES_LEAST = 0.00001, 64
TILE_PAIRS = 1 << 24
#: Grams are counted in so many cells for each bucket, in all; cells that are seldom hit are dropped, the others have places in so many bytes.
BUCKET_CELLS, LEVEL_CELLS = 1 << 22, 1 << 25

_POSTING = np.dtype([("key", "u8"), ("list", "u8"), ("set", "u8"), ("l", "u1"), ("size", "u1")])
#: `l` holds the side of a tile in its upper half.
_SENT = np.dtype([("list", "u8"), ("set", "u8"), ("l", "u1"), ("size", "u1")])
_GRAM_BITS = np.uint64(52)


class Levels:
    """How often grams occur, from 0 for the rarest to 255, by the first bits of a gram; shared cells make a gram seem more frequent, never less.

    A gram's level is the same wherever it is looked up, which is all that the order of grams needs.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.bits = (buckets * BUCKET_CELLS - 1).bit_length()
        self.place_bits = min(self.bits, LEVEL_CELLS.bit_length() - 1)
        self.places = -(-(1 << self.place_bits) // buckets)  # of a bucket
        self.cells = self.places << (self.bits - self.place_bits)
        self.table = np.zeros(0, np.uint8)

    def blobs(self, grams: np.ndarray, counts: np.ndarray) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
        """(buckets, cells packed, how many) of sorted grams: gaps by planes of bytes, about a byte a gram."""
        cell = np.repeat((grams >> (_GRAM_BITS - np.uint64(self.bits))).astype(np.int64), np.minimum(counts, 255))
        cuts = np.searchsorted(cell, np.arange(self.buckets + 1) * self.cells)
        full = np.flatnonzero(np.diff(cuts))
        for s in range(0, len(full), 64):
            some = full[s : s + 64].tolist()
            gaps = [np.diff(cell[cuts[i] : cuts[i + 1]], prepend=i * self.cells).astype("<u4") for i in some]
            yield some, [pa.compress(g.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) for g in gaps], list(map(len, gaps))

    def fill(self, table: DataFrame) -> None:
        """From the rows (bucket, blob, many) of all tasks; what the driver gets is LEVEL_CELLS bytes at most."""
        cells, places, shift = self.cells, self.places, self.bits - self.place_bits

        def count(batches):
            bucket, held = None, [np.zeros(0, np.int64)]
            for b in batches:
                for bucket, blob, many in zip(*(b.column(k).to_pylist() for k in range(3))):
                    raw = np.frombuffer(pa.decompress(blob, 4 * many, codec="zstd", asbytes=True), np.uint8)
                    held.append(np.cumsum(np.ascontiguousarray(raw.reshape(4, many).T).view("<u4").ravel().astype(np.int64)))
            if bucket is None:
                return
            n = np.minimum(np.bincount(np.concatenate(held), minlength=cells), 255).astype(np.uint8)
            # the least count that leaves two places of three empty
            reached = np.append(np.bincount(n, minlength=256)[::-1].cumsum()[::-1], 0)
            n[n < max(2, int(np.argmax(reached <= places // 3)))] = 0
            level = n.reshape(places, 1 << shift).max(1)
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([pa.compress(level.tobytes(), codec="zstd", asbytes=True)])], ["bucket", "blob"])

        rows = by_bucket(table, self.buckets).mapInArrow(count, "bucket bigint, blob binary").collect()
        self.table = np.zeros(self.places * self.buckets, np.uint8)
        for bucket, blob in rows:
            at = bucket * places
            self.table[at : at + places] = np.frombuffer(pa.decompress(bytes(blob), places, codec="zstd", asbytes=True), np.uint8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.table[(grams >> (_GRAM_BITS - np.uint64(self.place_bits))).astype(np.int64)].astype(np.int64)


def _sent(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), _SENT)
    for c in _SENT.names:
        out[c] = r[c]
    return out


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct grams of each row one after another, offsets); 52-bit grams."""
    for a, b in X.slices(texts):
        while a < b:
            c = min(b, a + 4096)
            t = X.Tokens(texts.slice(a, c - a))
            g, _, off = X.grams_by_row(t, n)
            row = np.repeat(np.arange(c - a, dtype=np.uint64), np.diff(off))
            key = np.unique(row << _GRAM_BITS | g >> np.uint64(12))
            grams = key & ((np.uint64(1) << _GRAM_BITS) - np.uint64(1))
            yield a, c, grams, np.searchsorted(key >> _GRAM_BITS, np.arange(c - a + 1, dtype=np.uint64))
            a = c


def set_hash(grams: np.ndarray, offsets: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each set, from the sum of its mixed members and its size."""
    with np.errstate(over="ignore"):
        salt = X.mix(np.array([2 * seed + 1], np.uint64))
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(grams + salt))])
        return X.mix(s[offsets[1:]] - s[offsets[:-1]] + X.mix(np.diff(offsets).astype(np.uint64)))


_RK = (F.xxhash64, lambda *c: F.xxhash64(F.lit(1), *c))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rk, rk2): the last two name a row by what it holds."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.select("*", *[f("doc_id", "text").alias(c) for c, f in zip(("rk", "rk2"), _RK)])


def census(docs: DataFrame, n: int, levels: Levels) -> DataFrame:
    """Rows of three kinds: (gram, count in a task) of locally repeated grams; (set, set2, size, doc_id, rk, rk2) of documents; (bucket, blob, many) of all grams."""
    schema = "set bigint, set2 bigint, size int, doc_id bigint, rk bigint, rk2 bigint, gram bigint, c bigint, bucket int, blob binary, many int"
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = {c: kinds[kind] for c, kind in map(str.split, schema.split(", "))}

    def batch(rows: int, **columns):
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, k) for c, k in kinds.items()], names=list(kinds))

    def scan(batches):
        held: list[np.ndarray] = []
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge():
            k = np.concatenate([keys, *held])
            c = np.concatenate([counts, np.ones(len(k) - len(keys), np.int64)])
            by = np.argsort(k)
            k, c = k[by], c[by]
            at = np.flatnonzero(np.diff(k, prepend=k[:1] + np.uint64(1)))
            return k[at], (np.add.reduceat(c, at) if len(at) else c)

        for b in batches:
            texts, ids, rk, rk2 = X.as_array(b.column(1)), b.column(0), b.column(2), b.column(3)
            for i, j, grams, off in gram_sets(texts, n):
                held.append(grams)
                size = np.diff(off)
                some = size > 0
                both = (pa.array(np.where(some, set_hash(grams, off, k).view(np.int64), 0), mask=~some) for k in (0, 1))
                own = {c: x.slice(i, j - i) for c, x in (("doc_id", ids), ("rk", rk), ("rk2", rk2))}
                yield batch(j - i, set=next(both), set2=next(both), size=pa.array(size, pa.int32()), **own)
            if sum(map(len, held)) > 1 << 21:
                keys, counts = merge()
                held = []
        if held or len(keys):
            keys, counts = merge()
            for some, blobs, many in levels.blobs(keys, counts):
                yield batch(len(some), bucket=pa.array(some, pa.int32()), blob=pa.array(blobs, pa.binary()), many=pa.array(many, pa.int32()))
            often = counts >= LOCAL_LEAST
            g, c = keys[often].astype(np.int64), counts[often]
            for s in range(0, len(g), 1 << 15):
                m = len(g[s : s + (1 << 15)])
                yield batch(m, gram=pa.array(g[s : s + m]), c=pa.array(c[s : s + m]))

    return _keyed(docs).mapInArrow(scan, schema)


def heavy_grams(table: DataFrame, docs: int, share: float = HEAVY_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of what is found in at least `share` of all documents, the HEAVY_MOST most frequent of them."""
    rows = (
        table.where("gram is not null").groupBy("gram").agg(F.sum("c").alias("c"))
        .where(F.col("c") >= max(LOCAL_LEAST, share * docs))
        .orderBy(F.desc("c"), "gram").limit(HEAVY_MOST).toPandas()
    )
    rows = rows.sort_values("gram")
    return rows.gram.to_numpy(dtype=np.int64).view(np.uint64), rows.c.to_numpy(dtype=np.int64)


class Copied:
    """The sets that very many documents have, and the row of each that stands for all."""

    def __init__(self, owners: DataFrame, docs: int):
        least = max(COPIES_LEAST, COPIES_SHARE * docs)
        # at most 1 / COPIES_SHARE rows
        rows = (
            owners.groupBy("set", "set2").agg(F.count("*").alias("n"), F.min("rk").alias("rk"))
            .where(F.col("n") >= least).orderBy("set", "set2").toPandas()
        )
        self.ids = rows[["set", "set2"]]
        both = rows["set"].to_numpy(dtype=np.int64).view(np.uint64), rows["set2"].to_numpy(dtype=np.int64).view(np.uint64)
        key = self._key(*both)
        by = np.argsort(key)
        self.key, self.rk = key[by], rows["rk"].to_numpy(dtype=np.int64)[by]

    @staticmethod
    def _key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return X.mix(one + X.mix(two))

    def firsts(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """For one task: which rows are to emit; a row that stands for copies does so once in the task."""
        done = np.zeros(len(self.key), bool)

        def emits(grams: np.ndarray, off: np.ndarray, rk: np.ndarray) -> np.ndarray:
            own = np.diff(off) > 0
            if len(self.key):
                key = self._key(set_hash(grams, off), set_hash(grams, off, 1))
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hot = np.flatnonzero(self.key[at] == key)
                own[hot] &= (self.rk[at[hot]] == rk[hot]) & ~done[at[hot]]
                once = np.zeros(len(own), bool)
                some = hot[own[hot]]
                once[some[np.unique(at[some], return_index=True)[1]]] = True
                own[hot] &= once[hot]
                done[at[once]] = True
            return own

        return emits


def families(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], copied: Copied, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """A label of each frequent gram, the same for grams that keep company, and the blocks that the label's sets are cut into.

    Postings go to buckets by this label, so that the many grams of a large group of copies
    meet in one place and their pairs are counted there, once, instead of being exchanged
    for each gram.  The label is the least gram of about the same frequency (by powers of
    two) in any document with the gram; what it is has no influence on the result.
    """
    grams, often = heavy
    level = np.log2(np.maximum(often, 1)).astype(np.int64)
    none = np.uint64((1 << 64) - 1)

    def scan(batches):
        label, many = np.full(len(grams), none), np.zeros(len(grams), np.int64)
        emits = copied.firsts()
        for b in batches:
            rk = b.column(1).to_numpy()
            for i, j, g, off in gram_sets(X.as_array(b.column(0)), n):
                at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                hit = np.flatnonzero(grams[at] == g)
                at, row = at[hit], (np.searchsorted(off, hit, side="right") - 1)
                own = emits(g, off, rk[i:j])
                at, row = at[own[row]], row[own[row]]
                many += np.bincount(at, minlength=len(grams))
                key = row * 64 + level[at]
                by = np.argsort(key, kind="stable")
                at, key = at[by], key[by]
                if not len(at):
                    continue
                first = np.flatnonzero(np.diff(key, prepend=-1))
                least = np.minimum.reduceat(grams[at], first)
                np.minimum.at(label, at, np.repeat(least, np.diff(np.append(first, len(at)))))
        seen = np.flatnonzero(label != none)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(label[seen].astype(np.int64)), pa.array(many[seen])], ["i", "label", "many"]
        )

    label, many = grams.copy(), np.zeros(len(grams))
    if len(grams):
        # one row for each frequent gram, of which there is a bounded number
        found = (
            docs.select("text", "rk").mapInArrow(scan, "i int, label bigint, many bigint")
            .groupBy("i").agg(F.min("label").alias("label"), F.sum("many").alias("many")).toPandas()
        )
        i = found.i.to_numpy()
        label[i], many[i] = found.label.to_numpy(dtype=np.int64).view(np.uint64), found.many.to_numpy()
    _, family = np.unique(label, return_inverse=True)
    work = np.bincount(family, weights=many * many) if len(grams) else np.zeros(0)
    return label, np.ceil(np.sqrt(np.maximum(work / TILE_PAIRS, 1))).astype(np.int64)[family]


def choose(cost: np.ndarray) -> np.ndarray:
    """The number of matches to demand: row by row, the l of least cost; cost[:, l - 1] is the postings read for l."""
    l = np.arange(1, cost.shape[1] + 1)
    return np.argmin(cost + VERIFY_COST * np.maximum(cost - l, 0) / l, axis=1) + 1


def prefixes(grams: np.ndarray, offsets: np.ndarray, heavy: np.ndarray, often: np.ndarray, levels: Levels, t: float, most: int):
    """(gram, row, l of each row, index of the gram if it is frequent or -1) of every posting that the rows emit."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    rank = levels.of(grams)
    index = np.full(len(grams), -1, np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
        hit = heavy[at] == grams
        rank[hit] = often[at[hit]]
        index[hit] = at[hit]
    order = np.argsort(row << 40 | rank, kind="stable")  # the grams of a row come sorted
    grams, estimate, index = grams[order], rank[order], index[order]
    need = np.ceil(t * size - 1e-9).astype(np.int64)
    base = size - need  # the l-prefix has base + l grams
    # a list is as long as counted; that of a rare gram has few others on average
    sums = np.concatenate([[0.0], np.cumsum(np.where(estimate > 1, estimate, RARE_PARTNERS))])
    ls = np.arange(1, most + 1)
    ends = offsets[:-1, None] + np.minimum(base[:, None] + ls, size[:, None])
    cost = sums[ends] - sums[offsets[:-1], None]
    cost[ls > np.maximum(need, 1)[:, None]] = np.inf
    chosen = choose(cost)
    count = np.where(size > 0, base + chosen, 0)
    at = X.ranges(offsets[:-1], count)
    owner = np.repeat(np.arange(len(size)), count)
    return grams[at], owner, chosen, index[at]


def tiled(r: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each posting once for each tile that its block of sets takes part in; blocks[i] is into how many posting i's list is cut."""
    cut = blocks > 1
    if not cut.any():
        return r
    whole, r, blocks = r[~cut], r[cut], blocks[cut]
    own = (r["set"] % blocks.astype(np.uint64)).astype(np.int64)
    own, other = np.repeat(own, blocks), X.ranges(np.zeros(len(r), np.int64), blocks)
    r = np.repeat(r, blocks)
    with np.errstate(over="ignore"):
        tile = X.mix((np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64) + np.uint64(1))
        r["key"] = X.mix(r["key"] ^ tile)
        r["list"] = X.mix(r["list"] ^ tile)
    r["l"] |= (np.sign(other - own) % 3 << 4).astype(np.uint8)  # 1 is the lower block of a tile, 2 the upper
    return np.concatenate([whole, r])


def partners(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(postings sorted by list, first partner, number of partners): all pairs of a list, or those across the sides of a tile."""
    side = r["l"] >> 4
    r = r[np.lexsort((r["l"], r["set"], side, r["list"]))]  # of sets that share a hash the least demand counts
    if not len(r):
        return r, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(len(r), bool)
    first[1:] = (r["list"][1:] != r["list"][:-1]) | (r["set"][1:] != r["set"][:-1])
    r = r[first]
    side = r["l"] >> 4
    cut = np.concatenate([[0], np.flatnonzero(r["list"][1:] != r["list"][:-1]) + 1])
    many = np.diff(np.append(cut, len(r)))
    end = np.repeat(cut + many, many)
    upper = np.repeat(np.add.reduceat((side == 2).astype(np.int64), cut), many)
    begin = np.where(side == 0, np.arange(len(r)) + 1, end - upper)
    return r, begin, np.where(side == 2, 0, end - begin)


def candidates(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], copied: Copied, levels: Levels, n: int, t: float, most: int) -> DataFrame:
    """(a, b) pairs of sets, a < b, with enough shared prefix grams."""
    docs = _keyed(docs)
    buckets = parts(docs)
    label, blocks = families(docs, heavy, copied, n)

    def emit(batches):
        out = Packed(buckets, _sent)
        emits = copied.firsts()
        for b in batches:
            rk = b.column(1).to_numpy()
            for i, j, grams, off in gram_sets(X.as_array(b.column(0)), n):
                own = emits(grams, off, rk[i:j])
                if not own.all():
                    size = np.diff(off)
                    grams = grams[np.repeat(own, size)]
                    off = np.concatenate([[0], np.cumsum(size[own])])
                g, owner, chosen, index = prefixes(grams, off, *heavy, levels, t, most)
                r = np.zeros(len(g), _POSTING)
                step = np.minimum(np.log(np.maximum(np.diff(off), 1)) / np.log(SIZE_STEP), 255).astype(np.uint8)
                r["key"] = g if not len(label) else np.where(index >= 0, label[index], g)
                r["list"], r["set"], r["l"], r["size"] = g, set_hash(grams, off)[owner], chosen[owner], step[owner]
                yield from out.add(tiled(r, np.where(index >= 0, blocks[index], 1)) if len(blocks) else r)
        yield from out.done()

    def pairs(batches):
        r = records(batches, _SENT)
        r = r[np.argsort(r["list"], kind="stable")]
        cut = np.flatnonzero(r["list"][1:] != r["list"][:-1]) + 1
        many = np.diff(np.concatenate([[0], cut, [len(r)]]))
        r, begin, later = partners(r[np.repeat(many > 1, many)])
        s, l, step = r["set"].copy().view(np.int64), (r["l"] & 15).astype(np.int64), r["size"].astype(np.int64)
        apart = int(np.log(1 / t) / np.log(SIZE_STEP)) + 2  # sizes of similar sets differ by fewer steps
        # rows are cut where about 2^19 pairs are full, so long lists don't need more memory than short ones
        total = np.cumsum(later)
        held: list[np.ndarray] = []
        done = np.zeros(0, _MATCH)
        a = 0
        while a < len(r):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 19), "right")))
            left = np.repeat(np.arange(a, b), later[a:b])
            right = X.ranges(begin[a:b], later[a:b])
            fits = (np.abs(step[left] - step[right]) < apart) | (step[left] == 255) | (step[right] == 255)
            left, right = left[fits], right[fits]
            x = np.empty(len(left), _MATCH)
            x["a"], x["b"] = np.minimum(s[left], s[right]), np.maximum(s[left], s[right])
            x["need"], x["c"] = np.minimum(l[left], l[right]), 1
            held.append(x)
            if sum(map(len, held)) > 1 << 19 or b == len(r):
                done, held = _merged([done, *held]), []
            if len(done) > 1 << 20 or b == len(r):
                yield from _match_batches(done)
                done = np.zeros(0, _MATCH)
            a = b

    matched = by_bucket(docs.select("text", "rk").mapInArrow(emit, PACKED), buckets).mapInArrow(
        pairs, "a bigint, b bigint, need int, c int"
    )
    return matched.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need")).where("c >= need").select("a", "b")


_MATCH = np.dtype([("a", "i8"), ("b", "i8"), ("need", "i4"), ("c", "i4")])


def _merged(held: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(held)
    x = x[np.lexsort((x["b"], x["a"]))]
    if not len(x):
        return x
    first = np.ones(len(x), bool)
    first[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
    at = np.flatnonzero(first)
    out = x[at].copy()
    out["c"] = np.add.reduceat(x["c"], at)
    out["need"] = np.minimum.reduceat(x["need"], at)
    return out


def _match_batches(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(x), 1 << 16):
        y = x[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(y[c].copy()) for c in ("a", "b", "need", "c")], ["a", "b", "need", "c"])


def forest(left: list[int], right: list[int]) -> dict[int, int]:
    """The least vertex of the component of each vertex that has an edge."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(left, right):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


PAIRS, LINKS = "a bigint, b bigint, jaccard double", "v bigint, root bigint, links bigint"


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, t: float, form: str = PAIRS) -> DataFrame:
    """The pairs of sets that reach t, or for each place where pairs are checked the links of each set and the root of its tree.

    A pair is checked where the least neighbour of `a` is; where that gathers more than
    BLOCK_SETS sets, the pairs are cut into tiles of about BLOCK_SETS by BLOCK_SETS.  The
    text of a set goes once to each place that needs it.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hub = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("hub"))
    keyed = pairs.join(hub, "a")
    tiles = keyed.groupBy("hub").agg(
        *[F.greatest(F.ceil(F.approx_count_distinct(c) / BLOCK_SETS), F.lit(1)).cast("int").alias(f"tiles_{c}") for c in ("a", "b")]
    )
    tile = [F.pmod(F.xxhash64(c), f"tiles_{c}") for c in ("a", "b")]
    buckets = parts(docs)
    places = 8 * buckets
    keyed = keyed.join(tiles, "hub").withColumn("tile", F.pmod(F.xxhash64("hub", *tile), F.lit(places)))
    keyed = written(keyed.select("tile", "a", "b"), "tiles")
    # one document of each set that is needed, and the tiles that need it
    chosen = (
        keyed.select("tile", F.explode(F.array("a", "b")).alias("set"))
        .groupBy("set").agg(F.collect_set("tile").alias("tiles"))
        .join(sets, "set")
    )
    # one plan at every size: what decides whether to broadcast is known only after a shuffle
    texts = _keyed(docs).select("rk", "rk2", "text").join(chosen.hint("merge"), ["rk", "rk2"])
    none = F.lit(None).cast("long")
    texts = texts.select(F.explode("tiles").alias("tile"), F.col("set").alias("a"), none.alias("b"), "text", "copies")
    rows = texts.unionByName(keyed.select("tile", "a", "b", F.lit(None).cast("string").alias("text"), none.alias("copies")))
    rows = rows.repartition(buckets, "tile").sortWithinPartitions("tile", F.col("b").asc_nulls_first())

    def results(found: tuple[list, list, list], copies: dict[int, int]) -> Iterator[pa.RecordBatch]:
        left, right, jaccard = found
        if form == PAIRS:
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(jaccard, pa.float64())], ["a", "b", "jaccard"]
            )
        elif left:
            root = forest(left, right)
            links = dict.fromkeys(root, 0)
            for a, b in zip(left, right):
                links[a] += copies[b]
                links[b] += copies[a]
            columns = [pa.array(list(x), pa.int64()) for x in (root, root.values(), (links[v] for v in root))]
            yield pa.RecordBatch.from_arrays(columns, ["v", "root", "links"])

    def check(batches):
        tile, sets_here, copies = None, {}, {}
        out: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            sets = {}
            texts = X.as_array(batch.column(3))
            have = np.flatnonzero(np.asarray(texts.is_valid()))
            if len(have):
                mine = texts.take(pa.array(have))
                for i, j, grams, off in gram_sets(mine, n):
                    for k in range(i, j):
                        sets[int(have[k])] = grams[off[k - i] : off[k - i + 1]]
            many = batch.column(4).to_pylist()
            for row, (tl, a, o) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if tl != tile:
                    yield from results(out, copies)
                    tile, sets_here, copies, out = tl, {}, {}, ([], [], [])
                if o is None:
                    sets_here[a], copies[a] = sets[row], many[row]
                    continue
                x, y = sets_here[a], sets_here[o]
                if len(x) < t * len(y) - 1e-9 or len(y) < t * len(x) - 1e-9:
                    continue
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                j = same / (len(z) - same)
                if j >= t - 1e-12:
                    for c, v in zip(out, (a, o, j)):
                        c.append(v)
        yield from results(out, copies)

    return rows.mapInArrow(check, form)


def _told_apart(owners: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """owners with `set` different for different sets; and (set, id) of the sets that shared a hash, None if there are none.

    The first of them keeps the hash, the others get one of both their hashes.
    """
    shared = owners.groupBy("set").agg(F.min("set2").alias("lo"), F.max("set2").alias("hi")).where("lo < hi").select("set", "lo")
    if shared.isEmpty():
        return owners.drop("set2"), None
    # Expected are n^2 / 2^65 of n sets, 70 of 5e10.
    own = F.when(F.col("lo").isNull() | (F.col("set2") == F.col("lo")), F.col("set")).otherwise(F.xxhash64("set", "set2"))
    owners = owners.join(shared, "set", "left").withColumn("id", own)
    names = owners.where("lo is not null").select("set", "id").distinct()
    return owners.select(F.col("id").alias("set"), *[c for c in owners.columns if c not in ("set", "set2", "id", "lo")]), names


class Similar:
    """owners (set, size, doc_id, rk, rk2), bare (doc_id of rows without words), and what verified() gives."""

    def __init__(self, docs: DataFrame, n: int, t: float, most: int, form: str):
        if not 0 < most < 16:
            raise ValueError("matches are demanded from 1 to 15")
        levels = Levels(parts(docs))
        table = written(census(docs, n, levels), "counts")
        levels.fill(table.where("blob is not null").select("bucket", "blob", "many"))
        self.table = written(table.where("blob is null").drop("bucket", "blob", "many"), "census")
        discard(table)
        rows = self.table.where("gram is null")
        self.count = rows.count()
        named = rows.where("set is not null").drop("gram", "c")
        self.bare = rows.where("set is null").select("doc_id")
        copied = Copied(named, self.count)
        found = written(candidates(docs, heavy_grams(self.table, self.count, HEAVY_SHARE), copied, levels, n, t, most), "candidates")
        self.owners, names = _told_apart(named)
        pairs = found
        if names is not None:
            for c in ("a", "b"):
                x = names.select(F.col("set").alias(c), F.col("id").alias("id"))
                pairs = pairs.join(x, c, "left").withColumn(c, F.coalesce("id", c)).drop("id")
            twins = names.select("set", F.col("id").alias("a")).join(names.select("set", F.col("id").alias("b")), "set")
            pairs = pairs.unionByName(twins.where("a != b").drop("set"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        self.sets = self.owners.groupBy("set").agg(
            F.min("rk").alias("rk"), F.min_by("rk2", "rk").alias("rk2"), F.count("*").alias("copies")
        )
        self.found = written(verified(docs, self.sets, pairs, n, t, form), "similar")
        discard(found)
        least = max(COPIES_LEAST, COPIES_SHARE * self.count)
        self.hot = written(self.sets.where(F.col("copies") >= least).select("set"), "copied")

    def with_set(self, rows: DataFrame, info: DataFrame) -> DataFrame:
        """rows left-joined with info by set; sets that very many rows have aren't shuffled by it."""
        hot = F.broadcast(self.hot)  # at most 1 / COPIES_SHARE sets
        flagged = rows.join(hot.withColumn("__lp_hot", F.lit(True)), "set", "left")
        many = flagged.where("__lp_hot").join(F.broadcast(info.join(hot, "set", "left_semi")), "set", "left")
        few = flagged.where("__lp_hot is null").join(info, "set", "left")
        return many.unionByName(few).drop("__lp_hot")


def similar(docs: DataFrame, n: int = N, t: float = THRESHOLD, most: int = MAX_MATCHES) -> tuple[DataFrame, DataFrame]:
    """(set, size, doc_id, rk, rk2) of the documents that have words, and (a, b, jaccard) of similar distinct sets."""
    s = Similar(docs, n, t, most, PAIRS)
    return s.owners, s.found


def join(docs: DataFrame, n: int = N, t: float = THRESHOLD, most: int = MAX_MATCHES) -> DataFrame:
    """(doc_id, class, links) of every row of docs."""
    s = Similar(docs, n, t, most, LINKS)
    links = s.found.groupBy("v").agg(F.sum("links").alias("links"))
    roots = components(s.found.select(F.col("v").alias("a"), F.col("root").alias("b"))).where("v != root")
    # a row for each set that has copies or links
    least = s.owners.groupBy("set").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    info = (
        least.join(links.withColumnRenamed("v", "set"), "set", "left")
        .join(roots.withColumnRenamed("v", "set"), "set", "left")
        .where("copies > 1 or links is not null")
        .select("set", F.coalesce("root", "set").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    info = written(info, "links")
    names = info.groupBy("root").agg(F.min("least").alias("class"))
    info = written(info.join(names, "root").select("set", "class", "links"), "classes")
    rows = s.with_set(s.owners.select("set", "doc_id"), info)
    own = F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("class"))
    return rows.select("doc_id", own.alias("class"), F.coalesce("links", F.lit(0)).alias("links")).unionByName(
        s.bare.select("doc_id", F.col("doc_id").alias("class"), F.lit(0).cast("long").alias("links"))
    )


def components(pairs: DataFrame) -> DataFrame:
    """(v, root): the least vertex of the component of every other vertex, by alternating large and small stars."""

    def stars(edges: DataFrame) -> DataFrame:
        """(u, v, m): m is the least of u and its neighbours."""
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        return edges.join(least, "u").withColumn("m", F.least("u", "m"))

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    u, v = F.greatest("a", "b"), F.least("a", "b")
    edges = written(pairs.where("a != b").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = stars(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        last, edges = edges, written(small.distinct(), "edges")
        discard(last)
        before, seen = seen, mark(edges)
        if before == seen:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD, most: int = MAX_MATCHES) -> DataFrame:
    """docs with one row of each group of similar documents: that of the least doc_id, nulls last."""
    s = Similar(docs, n, t, most, LINKS)
    roots = components(s.found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    roots = roots.unionByName(roots.select(F.col("root").alias("v"), "root")).distinct()
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "rk2")
    own = s.owners.groupBy("set").agg(F.min(best).alias("best"), F.count("*").alias("copies"))
    own = own.join(roots.withColumnRenamed("v", "set"), "set", "left").where("copies > 1 or root is not null")
    own = written(own.select("set", F.coalesce("root", "set").alias("root"), "best"), "groups")
    names = own.groupBy("root").agg(F.min("best").alias("best"))
    info = written(own.select("set", "root").join(names, "root").select("set", "best.rk", "best.rk2"), "best")
    # rows of groups of one document are left alone
    rows = s.with_set(s.owners.select("set", F.col("rk").alias("__lp_rk"), F.col("rk2").alias("__lp_rk2")), info)
    rows = rows.where("rk is not null").withColumn("__lp_best", F.expr("rk = __lp_rk and rk2 = __lp_rk2"))
    marks = written(rows.groupBy("__lp_rk", "__lp_rk2").agg(F.max("__lp_best").alias("__lp_best"), F.count("*").alias("__lp_n")), "marks")
    keys = ["__lp_rk", "__lp_rk2"]
    marked = docs.withColumns({k: f(F.col("doc_id").cast("long"), F.col("text")) for k, f in zip(keys, _RK)}).join(marks.hint("merge"), keys, "left")
    kept = marked.where("__lp_best is null or (__lp_best and __lp_n = 1)")
    if not marks.where("__lp_best and __lp_n > 1").isEmpty():
        # a partial aggregation, so that no task gets all of many identical rows
        kept = kept.unionByName(marked.where("__lp_best and __lp_n > 1").dropDuplicates(keys))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
