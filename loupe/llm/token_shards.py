"""Token ids in training order, as fixed-stride binary shards.

Every document is encoded with a public byte-level BPE vocabulary, closed with the end
token and cut into sequences of `seq_len` ids; the last one is padded with the end token.
A keyed Feistel network with cycle-walking permutes the sequence numbers 0..N-1, and the
permuted number is the sequence's global slot.  Sequences are numbered in the order in which the
encoding tasks wrote them: the order of one materialisation is fixed by its files, while another one
under another split of the input is another order.  Rows move once, to the range of slots of
their shard, where records of equal size follow one another, so slot s is found at byte
(s mod sequences) * stride of file s div sequences, and reading resumes at any slot.

Encoding looks at each distinct piece of a batch once: pieces are found for the whole
batch with numpy, by the classes of the vocabulary's own pattern.  Texts with apostrophes
(contractions) or characters beyond the basic plane go through the tokenizer itself.

Defined results: null and empty texts give one sequence that holds the end token;
repeated rows are sequences of their own; null doc_ids are carried; an empty table gives
no rows and no files; very long texts are encoded whole; ties can't occur, as slots are distinct; further
columns aren't read.  The vocabulary must lie at the same path on every executor.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .exchange import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEQ_LEN = 1024
SHARD_SEQUENCES = 4096
KEY = 0x5EED
ROUNDS = 6
SLICE_BYTES = 1 << 20
CACHE_PIECES = 1 << 17
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACES = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point of the basic plane: 0 other, 1 letter, 2 number, 3 space."""
    kinds = {"L": 1, "N": 2}
    return np.array(
        [3 if c in _SPACES else kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(1 << 16)], dtype=np.uint8
    )


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pieces of the pattern begin; texts are cut at `offsets`."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    cls = _classes()[data]
    for lead, size in ((0xC0, 2), (0xE0, 3)):
        at = np.flatnonzero((data >= lead) & (data < lead + (0x20 if size == 2 else 0x10)))
        if len(at):
            tail = [data[at + i].astype(np.int32) & 63 for i in range(1, size)]
            code = (data[at] & (31 if size == 2 else 15)).astype(np.int32)
            for t in tail:
                code = code << 6 | t
            kind = _classes()[code]
            for i in range(size):
                cls[at + i] = kind
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.empty(n, dtype=bool)
    start[0] = True
    start[1:] = cls[1:] != cls[:-1]
    start |= edge[:-1]
    b = np.flatnonzero(start & (cls != 3))
    b = b[b > 0]
    b = b[(cls[b - 1] == 3) & ~edge[b]]
    # the last white-space character before something else, which may be wider than a byte
    last = b - 1
    for _ in range(2):
        inside = (data[last] & 0xC0) == 0x80
        last = last - inside
    start[last] = True
    start[b[data[last] == 32]] = False
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[int, list[int]] = {}
        self.ranks = ranks
        #: The first free id ends each text; ids take two bytes where all of them fit.
        self.end = max(ranks.values()) + 1
        self.type = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def _piece(self, raw: bytes) -> list[int]:
        one = self.ranks.get(raw)
        return [one] if one is not None else self.own._encode_single_piece(raw)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by row) with the end token after each text."""
        data, off = X.buffers(texts)
        n = len(off) - 1
        sums = np.concatenate([[0], np.cumsum((data == 39) | (data >= 0xF0))])
        slow = sums[off[1:]] > sums[off[:-1]]
        starts = piece_starts(data, off)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        row = np.searchsorted(off, starts, side="right") - 1
        fast = ~slow[row] if len(row) else np.zeros(0, dtype=bool)
        starts, ends, row = starts[fast], ends[fast], row[fast]
        hashes, first, inverse = np.unique(X.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        ids, known = [], self.known
        for h, i in zip(hashes.tolist(), first.tolist()):
            x = known.get(h)
            if x is None:
                x = known[h] = self._piece(data[starts[i] : ends[i]].tobytes())
            ids.append(x)
        each = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((t for x in ids for t in x), dtype=self.type, count=int(each.sum()))
        begin = np.cumsum(each) - each
        tokens = flat[X.ranges(begin[inverse], each[inverse])]
        count = np.bincount(row, weights=each[inverse], minlength=n).astype(np.int64)
        odd = {}
        for r in np.flatnonzero(slow).tolist():
            odd[r] = np.array(self.own.encode_ordinary(texts[r].as_py()), dtype=self.type)
            count[r] = len(odd[r])
        out_off = np.concatenate([[0], np.cumsum(count + 1)])
        out = np.full(out_off[-1], self.end, dtype=self.type)
        here = count.copy()
        here[list(odd)] = 0
        out[X.ranges(out_off[:-1], here)] = tokens
        for r, x in odd.items():
            out[out_off[r] : out_off[r] + len(x)] = x
        return out, out_off


def id_width(vocabulary: str = VOCABULARY) -> int:
    """Bytes of an id."""
    return _encoder(vocabulary).type.itemsize


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def permute(index: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of 0..size-1: a balanced Feistel network, walked until it lands inside."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = X.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
        x = index.astype(np.uint64)
        todo = np.arange(len(x))
        while len(todo):
            left, right = x[todo] >> half, x[todo] & mask
            for k in keys:
                left, right = right, left ^ (X.mix(right ^ k) & mask)
            x[todo] = left << half | right
            todo = todo[x[todo] >= np.uint64(size)]
    return x.astype(np.int64)


_ENCODED = pa.schema(
    [
        ("task", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("h2", pa.int64()),
        ("n", pa.int32()), ("tokens", pa.binary()),
    ]
)


def encoded(docs: DataFrame, seq_len: int = SEQ_LEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """(task, first, doc_id, h, h2, n, tokens): hashes of the text and little-endian ids; `first` counts the task's sequences so far.

    Once it is written, (task, first) names a row, also among identical ones.
    """

    def encode(batches):
        from pyspark import TaskContext

        task, first = TaskContext.get().partitionId(), 0
        coder = _encoder(vocabulary)
        for b in batches:
            texts = X.as_array(b.column(1))
            for i, j in X.slices(texts, SLICE_BYTES):
                tokens, off = coder.encode(texts.slice(i, j - i))
                n = np.diff(off)
                sequences = -(-n // seq_len)
                begin = first + np.cumsum(sequences) - sequences
                first += int(sequences.sum())
                raw = pa.Array.from_buffers(
                    pa.binary(), j - i, [None, pa.py_buffer((off * coder.type.itemsize).astype(np.int32)), pa.py_buffer(tokens)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(j - i, task, np.int32)), pa.array(begin), *(b.column(k).slice(i, j - i) for k in (0, 2, 3)),
                        pa.array(n, pa.int32()), raw,
                    ],
                    schema=_ENCODED,
                )

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).mapInArrow(
        encode, "task int, first bigint, doc_id bigint, h bigint, h2 bigint, n int, tokens binary"
    )


def materialise(
    docs: DataFrame, seq_len: int = SEQ_LEN, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(slot, shard, doc_id, part, n_tokens, record): one row a sequence, one partition a shard, in slot order."""
    spark, coder = docs.sparkSession, _encoder(vocabulary)
    width = coder.type.itemsize
    # Written, so that a task's sequence numbers can't change if it has to run again.
    table = written(encoded(docs, seq_len, vocabulary), "tokens")
    count = F.ceil(F.col("n") / seq_len)
    # One row for each task that wrote the table.
    tasks = table.groupBy("task").agg(F.sum(count).alias("c")).orderBy("task").collect()
    base, size = [], 0
    for task, c in tasks:
        base.append((task, size))
        size += c
    bases = F.broadcast(spark.createDataFrame(base, "task int, base long"))

    def slots(index: pa.Array) -> pa.Array:
        return pa.array(permute(index.to_numpy(zero_copy_only=False), size, key))

    part = F.col("part")
    rows = (
        table.join(bases, "task")
        .withColumn("part", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
        .withColumn("slot", F.arrow_udf(slots, "bigint")(F.col("base") + F.col("first") + part))
        .select(
            "slot",
            F.floor(F.col("slot") / shard_sequences).cast("int").alias("shard"),
            "doc_id",
            "part",
            F.least(F.lit(seq_len), F.col("n") - part * seq_len).alias("n_tokens"),
            F.substring("tokens", part * (width * seq_len) + 1, F.lit(width * seq_len)).alias("ids"),
        )
    )
    stride = width * seq_len
    return (
        rows.repartitionById(max(1, -(-size // shard_sequences)), F.col("shard"))
        .sortWithinPartitions("slot")
        .withColumn("record", F.rpad("ids", F.lit(stride), F.lit(coder.end.to_bytes(width, "little"))))
        .drop("ids")
    )


def write_shards(
    rows: DataFrame, folder: str, seq_len: int = SEQ_LEN, shard_sequences: int = SHARD_SEQUENCES, vocabulary: str = VOCABULARY
) -> None:
    """Files shard-NNNNNNNN.bin; each is written beside its place and then renamed, so a retried task leaves no part."""
    from pyarrow import fs

    target, path = fs.FileSystem.from_uri(folder)
    target.create_dir(path)
    stride = _encoder(vocabulary).type.itemsize * seq_len

    def write(batches):
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        out = name = None
        for b in batches:
            for slot, shard, record in zip(*(b.column(i).to_pylist() for i in range(3))):
                if name is None:
                    name = f"{root}/shard-{shard:08d}.bin"
                    out = store.open_output_stream(f"{name}.{attempt}")
                if len(record) != stride or slot // shard_sequences != shard:
                    raise ValueError(f"slot {slot} doesn't fit its shard")
                out.write(record)
        if out is not None:
            out.close()
            store.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    rows.select("slot", "shard", "record").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def read_from(
    folder: str, slot: int, seq_len: int = SEQ_LEN, shard_sequences: int = SHARD_SEQUENCES, vocabulary: str = VOCABULARY
) -> Iterator[np.ndarray]:
    """Sequences from `slot` on, in training order, from any file system that pyarrow knows."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    kind = _encoder(vocabulary).type
    stride = kind.itemsize * seq_len
    shard, at = divmod(slot, shard_sequences)
    while store.get_file_info(name := f"{root}/shard-{shard:08d}.bin").type == fs.FileType.File:
        with store.open_input_file(name) as f:
            f.seek(at * stride)
            while record := f.read(stride):
                yield np.frombuffer(record, dtype=kind)
        shard, at = shard + 1, 0
