"""Requests over streams.  All operators are row-local, so the batch expressions serve as they are."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.request import Request
from ..sources.tables import shared_folder


def rewrite_stream(spark: SparkSession, path: str, request: Request, columns: list[str], column: str = "text") -> DataFrame:
    """Rewrite everything under path as a stream of files until none is left; the result is read from the sink."""
    target = f"{shared_folder(spark)}/loupe-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # a stream reads folders; a single file is found in its own by name
    single = os.path.isfile(path.removeprefix("file://"))
    source = spark.readStream.schema(schema)
    if single:
        source = source.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    stream = request.run(source.parquet(path).select(*columns), column)
    done = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{target}/state")
        .trigger(availableNow=True).start(f"{target}/rows")
    )
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")
