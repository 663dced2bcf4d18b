"""Tables of the steps between, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors see, below spark.checkpoint.dir; a temporary one on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rxlattice-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str) -> DataFrame:
    """`df` written to a new folder and read back: computed once, however many steps read it."""
    path = folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of stored tables whose rows a task gets in `spread`.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over partitions whose number grows with the tables that it reads.

    Windows and aggregates by these keys (or more) then work where the rows are, and a task's memory stays the same
    however large the tables get; adaptive coalescing, which small tables are left to, sizes tasks by compressed bytes. Sources
    that don't know their size count as empty.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    parts = -(-sum(n for n in sizes if n < 1 << 60) // SPREAD_BYTES)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)
