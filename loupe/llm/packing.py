"""Best-fit packing planned on the histogram of lengths.

Lengths are token ids under a public vocabulary plus the end token.  A text longer than `capacity`
gives full pieces and a rest.  Only the counts by length reach the driver: at most
`capacity` rows, whatever the corpus.  Best fit runs over them, longest first, placing
all pieces of one length at a time, and gives runs of slots; a piece finds its slot by
joining its length and its rank within the length to those runs.  Ranks are counted within
buckets of at most about RANK_ROWS pieces; the slots then join the texts' ids once.

The ids of a bin's pieces, each at its `start`, are the bin's content; a document's pieces in order are
its ids, from which the vocabulary gives back the text byte by byte.

Defined results: a null text counts as empty (the end token, length 1); repeated rows are
separate pieces; ties of rank are broken by doc_id (nulls first), then by hashes of the
text, and rows equal in all take their slots in either order; very long texts are encoded whole; null
doc_ids are carried; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import written
from .token_shards import VOCABULARY, encoded, id_width

CAPACITY = 2048
RANK_BUCKETS, RANK_ROWS = 64, 1 << 18
#: Runs are broadcast up to this many, and joined by an exchange beyond.
RUNS_MOST = 1 << 20


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, pieces a bin, offset in the bin).

    Bins of equal content are one entry (first bin, how many) under their remaining room, so
    the work follows the number of distinct lengths and not the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    open_rooms: list[int] = []
    runs, bins = [], 0

    def put(left: int, first: int, many: int) -> None:
        if left > 0 and many > 0:
            if left not in room:
                room[left] = []
                insort(open_rooms, left)
            room[left].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                for many, take in ((full, each), (1 if rest else 0, rest)):
                    if many:
                        runs.append((length, rank, rank + many * take, bins, take, 0))
                        put(capacity - take * length, bins, many)
                        rank, bins = rank + many * take, bins + many
                break
            r = open_rooms[at]
            first, many = room[r].pop()
            if not room[r]:
                del room[r]
                open_rooms.pop(at)
            each = r // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - r))
                put(r - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                first, many = first + full, many - full
            if many and left and left < each:
                runs.append((length, rank, rank + left, first, left, capacity - r))
                put(r - left * length, first, 1)
                left, first, many = 0, first + 1, many - 1
            put(r, first, many)
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, length, bin, start, ids): every piece's bin, its place within, and its ids, little-endian."""
    spark, width = docs.sparkSession, id_width(vocabulary)
    table = written(encoded(docs, capacity, vocabulary), "tokens")
    count = F.ceil(F.col("n") / capacity)
    rows = table.agg(F.sum(count)).first()[0] or 0
    buckets = max(RANK_BUCKETS, int(rows) // RANK_ROWS)
    pieces = (
        table.select("task", "first", "doc_id", "h", "h2", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
        .withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long"))
        .withColumn("b", F.pmod(F.xxhash64("task", "first", "piece"), F.lit(buckets)))
    )
    cells = written(pieces.groupBy("length", "b").agg(F.count("*").alias("c")), "cells")
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("c")).collect()}  # capacity rows at most
    runs = plan(counts, capacity)
    runs_table = spark.createDataFrame(runs, "l long, lo long, hi long, first_bin long, each long, offset long")
    base = F.sum("c").over(Window.partitionBy("length").orderBy("b")) - F.col("c")
    order = Window.partitionBy("length", "b").orderBy("doc_id", "h", "h2", "piece")
    ranked = (
        pieces.withColumn("r", F.row_number().over(order) - 1)
        .join(cells.select("length", "b", base.alias("base")), ["length", "b"])
        .withColumn("r", F.col("r") + F.col("base"))
    )
    within = F.col("r") - F.col("lo")
    few = F.broadcast(runs_table) if len(runs) <= RUNS_MOST else runs_table
    slots = (
        ranked.join(few, F.expr("length = l and r >= lo and r < hi"))
        .select(
            "task", "first",
            F.struct(
                "piece", "length",
                (F.col("first_bin") + F.floor(within / F.col("each"))).alias("bin"),
                (F.col("offset") + within % F.col("each") * F.col("length")).alias("start"),
            ).alias("slot"),
        )
        .groupBy("task", "first").agg(F.collect_list("slot").alias("slots"))
    )
    ids = F.substring("tokens", (F.col("s.piece") * (capacity * width) + 1).cast("int"), (F.col("s.length") * width).cast("int"))
    return (
        table.select("task", "first", "doc_id", "tokens").join(slots, ["task", "first"])
        .select("doc_id", "tokens", F.explode("slots").alias("s"))
        .select("doc_id", "s.piece", "s.length", "s.bin", "s.start", ids.alias("ids"))
    )
