"""Tables in the shared folder, and exchanges of packed numpy records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loupe-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.loupe_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.loupe_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


BUCKET_BYTES = 32 << 20


def parts(df: DataFrame) -> int:
    """Partitions for an exchange of what df holds: as the session says, and more where its input asks for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a plan without statistics claims to be endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES if size < 1 << 60 else 1)


class Packed:
    """Records with a uint64 `key`, cut by bucket into blobs of another dtype: rows (bucket int, blob binary)."""

    def __init__(self, buckets: int, wire: Callable[[np.ndarray], np.ndarray] = lambda r: r, flush: int = 1 << 20):
        self.wire, self.buckets, self.flush = wire, buckets, flush
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(records)
        self.size += len(records)
        if self.size >= self.flush:
            yield from self.done()

    def done(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        records = np.concatenate(self.held)
        self.held, self.size = [], 0
        bucket = (records["key"] % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        records, bucket = self.wire(records[order]), bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts = np.concatenate([[0], cuts])
        blobs = [x.tobytes() for x in np.split(records, cuts)]
        for a in range(0, len(blobs), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts[a : a + 64]], pa.int32()), pa.array(blobs[a : a + 64], pa.binary())],
                ["bucket", "blob"],
            )


PACKED = "bucket int, blob binary"


def by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    """One partition for each bucket."""
    return packed.repartitionById(buckets, F.col("bucket"))


def records(batches: Iterable[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of a partition."""
    blobs = [np.frombuffer(x.as_buffer(), dtype=dtype) for b in batches for x in b.column(1)]
    return np.concatenate(blobs) if blobs else np.zeros(0, dtype=dtype)
