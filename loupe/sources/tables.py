"""Tables as input of row-wise work."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SMALL_SPLIT = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loupe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small file out over all cores; anything else is returned as it is.

    A Parquet file of one row group is one task's work however many splits it has.  So what is
    only read, projected and filtered so far, and has less than SMALL_SPLIT bytes for each core,
    is dealt out by rows; that moves a few MB at most.  Larger tables have row groups enough.
    """
    if df.isStreaming:
        return df
    plan = node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):  # not by the plan's text: a literal in it may have line breaks
        node = node.child()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if node.nodeName() != "LogicalRelation":
        return df
    return df.repartition(cores) if cores > 1 and int(plan.stats().sizeInBytes()) < cores * SMALL_SPLIT else df
