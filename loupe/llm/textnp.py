"""Whole-batch tokenisation with numpy.

A token is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of
the case-folded text.  Folding changes a character only if its UTF-8 length stays the
same, so byte offsets in the folded text are byte offsets in the text itself.  Tokens
are represented by 64-bit hashes, computed for a whole Arrow batch at once from prefix
sums of a polynomial in wrap-around arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_lo:_hi] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)

_pow = _inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        steps = np.full(size, _ODD, dtype=np.uint64)
        steps[0] = 1
        _pow = np.multiply.accumulate(steps)
        steps[1:] = _ODD_INV
        _inv = np.multiply.accumulate(steps)
    return _pow, _inv


def fold(texts: pa.Array) -> pa.Array:
    """Lower case wherever that keeps a character's UTF-8 length."""
    low = pc.utf8_lower(texts)
    same = pc.equal(pc.binary_length(low), pc.binary_length(texts))
    if pc.all(same).as_py() is not False:
        return low
    odd = {i for i, ok in enumerate(same.to_pylist()) if ok is False}
    out = low.to_pylist()
    for i in odd:
        out[i] = "".join(
            c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in texts[i].as_py()
        )
    return pa.array(out, type=texts.type)


def as_array(column: pa.ChunkedArray | pa.Array, kind: pa.DataType = pa.large_string()) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], type=column.type)
    return column if column.type == kind else column.cast(kind)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; null counts as the empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0 or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` bytes each, or one row if that is longer."""
    if texts.null_count:
        lengths = pc.fill_null(pc.binary_length(texts), 0)
    else:
        lengths = pc.binary_length(texts)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    a, n = 0, len(texts)
    while a < n:
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield a, b
        a = b


class Tokens:
    """Tokens of some rows: `hash`, byte spans `start`/`end`, and `offsets` by row."""

    __slots__ = ("data", "end", "hash", "offsets", "rows", "start", "text_offsets")

    def __init__(self, texts: pa.Array):
        data, off = buffers(fold(texts))
        self.data, self.text_offsets, self.rows = data, off, len(off) - 1
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            self.offsets = np.zeros(len(off), dtype=np.int64)
            return
        word = _IS_WORD[data]
        inner = off[(off > 0) & (off < n)]
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = word[:-1]
        before[inner] = False
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = word[1:]
        after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.offsets = np.searchsorted(self.start, off)
        self.hash = span_hash(data, self.start, self.end)

    def row_of_token(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start])


def token_hash(word: str) -> int:
    """The hash that Tokens gives to one word."""
    t = Tokens(pa.array([word], type=pa.large_string()))
    if len(t.hash) != 1:
        raise ValueError(f"not one token: {word!r}")
    return int(t.hash[0])


_GRAM = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def gram_hash(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; len(tokens) - n + 1 of them."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(m, np.uint64(n), dtype=np.uint64)
        for j in range(n):
            out = out * _GRAM[j % 4] + tokens[j : j + m]
            if j % 4 == 3:
                out ^= out >> np.uint64(29)
        return mix(out)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i], start[i] + 1, ..., count[i] values each."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    begin = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start.astype(np.int64) - begin, count)


def grams_by_row(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, first token of each, offsets by row); a row with 1 to n-1 tokens has one gram of them all."""
    counts = np.diff(tokens.offsets)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = ranges(tokens.offsets[:-1], per)
    hashes = np.empty(len(first), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(per)])
    full = np.repeat(counts >= n, per)
    whole = gram_hash(tokens.hash, n)
    hashes[full] = whole[first[full]]
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        a = tokens.offsets[row]
        hashes[offsets[row]] = gram_hash(tokens.hash[a : a + counts[row]], int(counts[row]))[0]
    return hashes, first, offsets
