"""Matroska containers: EBML elements of a binary column as a table of packets.

Element ids and sizes are variable-length integers; clusters hold SimpleBlocks and
BlockGroups, each block one to 256 packets under no, Xiph, EBML or fixed-size lacing.  A
packet has its track, its timestamp in nanoseconds (cluster and block time in the
segment's scale, frames of a lace spaced by the track's default duration where there is
one), its byte range in the container, and whether it is a key frame and has a cue.

Defined results: a null or empty container has no packets; one that is cut short gives the
packets that are whole; unknown elements and damaged blocks are skipped, and sizes that
overrun their parent end there; elements of unknown size end with the parent's level; a number of more
than eight bytes is damaged, and blocks whose cluster's time is, or whose own time is outside 64 bits,
are skipped; a duration outside 64 bits is null; packets of equal times keep the order of their bytes;
very long containers are parsed whole, in one task each; repeated rows are parsed each; an
empty table gives an empty result; only the two columns named are read, and a key column
named like a field of the packets is called key_ and its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EBML, SEGMENT, CLUSTER, INFO, TRACKS, CUES, SEEK = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x114D9B74
TAGS, CHAPTERS, ATTACHMENTS = 0x1254C367, 0x1043A770, 0x1941A469
TOP = frozenset((CLUSTER, INFO, TRACKS, CUES, SEEK, TAGS, CHAPTERS, ATTACHMENTS))
SCALE, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1
DURATION, REFERENCE = 0x9B, 0xFB
TRACK, NUMBER, KIND, CODEC, DEFAULT = 0xAE, 0xD7, 0x83, 0x86, 0x23E383
POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NONE, XIPH, FIXED, LACED = 0, 1, 2, 3

#: Packets of one container: track, codec, timestamp and duration in ns, start, size, key, cue, lace index.
Packet = tuple[int, str | None, int, int | None, int, int, bool, bool, int]
FIELDS = ("track", "codec", "timestamp", "duration", "start", "size", "key", "cue", "lace")
SCHEMA = (
    "array<struct<track: bigint, codec: string, timestamp: bigint, duration: bigint, start: bigint, size: bigint, "
    "key: boolean, cue: boolean, lace: int>>"
)
_TYPE = pa.list_(
    pa.struct(
        list(
            zip(
                FIELDS,
                (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32()),
            )
        )
    )
)


class Damaged(ValueError):
    """Bytes that are no valid element."""


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(id with its length marker, position behind)."""
    if at >= end or data[at] < 0x10:
        raise Damaged
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Damaged
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """(value, position behind); None is the unknown size."""
    if at >= end or not data[at]:
        raise Damaged
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Damaged
    bits = 7 * n
    value = int.from_bytes(data[at : at + n], "big") & (1 << bits) - 1
    return (None if value == (1 << bits) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, ends_at: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, content start, content end) of the children in [at, end).

    Contents are cut at `end`; an id of `ends_at` closes a parent of unknown size.
    """
    while at < end:
        begin = at
        try:
            kind, at = read_id(data, at, end)
            size, at = read_size(data, at, end)
        except Damaged:
            return
        if kind in ends_at:
            return
        if size is None:
            stop = end
            if kind in (CLUSTER, SEGMENT):  # ends where the next element of its level begins, or of one above
                stop = begin
                for _, _, _, e in elements(data, at, end, (TOP if kind == CLUSTER else frozenset()) | {EBML, SEGMENT}):
                    stop = e
                stop = max(stop, at)
            yield kind, begin, at, stop
            at = stop
        else:
            yield kind, begin, at, min(at + size, end)
            at += size


def number(data: bytes, a: int, b: int) -> int | None:
    """An unsigned integer, None if it is damaged."""
    return int.from_bytes(data[a:b], "big") if b - a <= 8 else None


def _fits(x: int | None) -> bool:
    return x is not None and -(1 << 63) <= x < 1 << 63


def frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block's payload."""
    if lacing == NONE:
        return [(at, end - at)]
    if at >= end:
        raise Damaged
    count = data[at] + 1
    at += 1
    if lacing == FIXED:
        each, rest = divmod(end - at, count)
        if rest:
            raise Damaged
        return [(at + i * each, each) for i in range(count)]
    sizes = []
    if lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= end:
                    raise Damaged
                x = data[at]
                at += 1
                n += x
                if x < 255:
                    break
            sizes.append(n)
    elif count > 1:
        n, at = read_size(data, at, end)
        if n is None:
            raise Damaged
        sizes.append(n)
        for _ in range(count - 2):
            before = at
            raw, at = read_size(data, at, end)
            bits = 7 * (at - before)
            # the middle of the range is zero; all ones is a difference like any other
            n += ((1 << bits) - 1 if raw is None else raw) - ((1 << bits - 1) - 1)
            sizes.append(n)
    left = end - at - sum(sizes)
    if left < 0 or any(n < 0 for n in sizes):
        raise Damaged
    out = []
    for n in [*sizes, left]:
        out.append((at, n))
        at += n
    return out


def packets(data: bytes | None) -> list[Packet]:
    """All packets, by their place in the container."""
    data = data or b""
    found: list[Packet] = []
    for kind, _, a, b in elements(data, 0, len(data)):
        if kind == SEGMENT:
            found += _segment(data, a, b)
    return found


def _segment(data: bytes, start: int, end: int) -> list[Packet]:
    scale, codecs, default = 1_000_000, {}, {}
    cues: set[tuple[int, int, int]] = set()
    clusters = []
    for kind, begin, a, b in elements(data, start, end, frozenset((EBML, SEGMENT))):
        if kind == INFO:
            for k, _, x, y in elements(data, a, b):
                if k == SCALE:
                    scale = number(data, x, y) or scale
        elif kind == TRACKS:
            for k, _, x, y in elements(data, a, b):
                if k == TRACK:
                    e = {kk: (xx, yy) for kk, _, xx, yy in elements(data, x, y)}
                    if NUMBER in e and (n := number(data, *e[NUMBER])) is not None:
                        if CODEC in e:
                            codecs[n] = data[slice(*e[CODEC])].rstrip(b"\0").decode("ascii", "replace")
                        if DEFAULT in e:
                            default[n] = number(data, *e[DEFAULT])
        elif kind == CUES:
            for k, _, x, y in elements(data, a, b):
                if k == POINT:
                    time, places = 0, []
                    for kk, _, xx, yy in elements(data, x, y):
                        if kk == CUE_TIME:
                            time = number(data, xx, yy)
                        elif kk == CUE_PLACE:
                            p = {k3: number(data, x3, y3) for k3, _, x3, y3 in elements(data, xx, yy)}
                            places.append((p.get(CUE_TRACK), p.get(CUE_CLUSTER)))
                    cues |= {(track, time, place) for track, place in places}
        elif kind == CLUSTER:
            clusters.append((begin - start, a, b))
    found: list[Packet] = []
    for place, a, b in clusters:
        time: int | None = 0
        for kind, _, x, y in elements(data, a, b):
            duration, key, block = None, True, None
            if kind == TIMESTAMP:
                time = number(data, x, y)
            elif kind == SIMPLE:
                block = (x, y)
            elif kind == GROUP:
                for k, _, xx, yy in elements(data, x, y):
                    if k == BLOCK:
                        block = (xx, yy)
                    elif k == DURATION:
                        duration = number(data, xx, yy)
                    elif k == REFERENCE:
                        key = False
            if block is None or time is None:
                continue
            try:
                track, p = read_size(data, *block)
                if track is None or p + 3 > block[1]:
                    raise Damaged
                offset = int.from_bytes(data[p : p + 2], "big", signed=True)
                flags = data[p + 2]
                laced = frames(data, p + 3, block[1], flags >> 1 & 3)
            except Damaged:
                continue
            if kind == SIMPLE:
                key = bool(flags & 0x80)
            base = (time + offset) * scale
            each = default.get(track)
            if duration is not None and len(laced) > 1 and each is None:
                each = duration * scale // len(laced)
            if not _fits(base) or not _fits(base + (len(laced) - 1) * (each or 0)):
                continue
            for i, (s, n) in enumerate(laced):
                length = each if each is not None else (duration * scale if duration is not None and len(laced) == 1 else None)
                length = length if _fits(length) else None
                found.append(
                    (track, codecs.get(track), base + i * (each or 0), length, s, n, key, i == 0 and (track, time + offset, place) in cues, i)
                )
    return found


def packet_column(container: Column) -> Column:
    def column(values: pa.Array) -> pa.Array:
        rows = [packets(v.as_py()) for v in values]
        flat = list(zip(*(p for r in rows for p in r))) or [()] * len(FIELDS)
        fields = [pa.array(c, t.type) for c, t in zip(flat, _TYPE.value_type)]
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, FIELDS))

    return F.arrow_udf(column, SCHEMA)(container)


def packet_table(df: DataFrame, key: str, container: str) -> DataFrame:
    """One row for each packet: the key column and FIELDS."""
    name = f"key_{key}" if key in FIELDS else key
    return df.select(F.col(key).alias(name), F.explode(packet_column(F.col(container))).alias("p")).select(name, "p.*")


# Writing, for tables that hold text and no media: each line is a packet of a subtitle track.


def vint(value: int, least: int = 1) -> bytes:
    n = least
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def unsigned(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, offset: int, parts: list[bytes], lacing: int, key: bool = True) -> bytes:
    """Content of a (Simple)Block."""
    head = vint(track) + offset.to_bytes(2, "big", signed=True) + bytes([0x80 * key | lacing << 1])
    if lacing == NONE:
        return head + parts[0]
    out = bytes([len(parts) - 1])
    sizes = [len(p) for p in parts]
    if lacing == XIPH:
        out += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == LACED and len(parts) > 1:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = 1
            while not -((1 << 7 * n - 1) - 1) <= b - a < (1 << 7 * n - 1):
                n += 1
            out += (b - a + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + out + b"".join(parts)


def text_container(text: str | None, lines_a_cluster: int = 32) -> bytes:
    """Matroska bytes with one packet a line; the kind of lacing and of block changes from block to block."""
    lines = [x.encode() for x in (text or "").split("\n")]
    tracks = element(TRACKS, element(TRACK, unsigned(NUMBER, 1) + unsigned(KIND, 17) + element(CODEC, b"S_TEXT/UTF8") + unsigned(DEFAULT, 40_000_000)))
    body = element(INFO, unsigned(SCALE, 1_000_000)) + tracks
    points = b""
    for c in range(0, len(lines), lines_a_cluster):
        time, mine = c * 40, lines[c : c + lines_a_cluster]
        points += element(POINT, unsigned(CUE_TIME, time) + element(CUE_PLACE, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, len(body))))
        content, i, turn = unsigned(TIMESTAMP, time), 0, 0
        while i < len(mine):
            lacing = turn % 4
            n = min((1, 3, 2, 4)[turn % 4], len(mine) - i)
            take = mine[i : i + n]
            if lacing == FIXED and len({len(x) for x in take}) > 1:
                lacing = XIPH
            raw = block(1, i * 40, take, lacing, turn % 8 < 4)
            content += element(SIMPLE, raw) if turn % 8 < 4 else element(GROUP, element(BLOCK, raw) + unsigned(DURATION, 40 * n))
            i, turn = i + n, turn + 1
        body += element(CLUSTER, content)
    return element(EBML, unsigned(0x4286, 1) + element(0x4282, b"matroska")) + element(SEGMENT, body + element(CUES, points))


def containers(docs: DataFrame) -> DataFrame:
    """(doc_id, container): the documents as media columns."""

    def column(texts: pa.Array) -> pa.Array:
        return pa.array([text_container(t) for t in texts.to_pylist()], pa.binary())

    return docs.select("doc_id", F.arrow_udf(column, "binary")("text").alias("container"))
