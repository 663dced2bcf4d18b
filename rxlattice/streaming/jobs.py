"""Structured Streaming jobs over an event log: recent rows, windows, duplicates, state per patient.

Every job takes a streaming DataFrame; `run` drains what is there and returns what was written.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import struct
from ..tables import folder


#: In update mode so many batches are written before their rows are merged to one a key.
COMPACT = 20
#: The state store whose state lies on disk, not in the heap.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Metadata of a column of which the least value of all batches counts, not that of the latest batch.
LEAST = {"merge": "least"}


def _merged(rows: DataFrame, keys: tuple[str, ...], least: list[str]) -> DataFrame:
    """Of each key the row of the latest batch, with the least value of the columns `least`."""
    kept = [c for c in rows.columns if c not in (*keys, *least, "batch")]
    last = [F.max_by(F.struct(*kept), "batch").alias("_last")] if kept else []
    got = rows.groupBy(*keys).agg(*last, *(F.min(c).alias(c) for c in least), F.max("batch").alias("batch"))
    return got.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in kept), *least, "batch").select(*rows.columns)


def drain(stream: DataFrame, kind: str, mode: str = "append", keys: tuple[str, ...] = (), progress: list[dict] | None = None) -> DataFrame:
    """Process all that is available and return the rows written.

    Each batch has a folder of its own, so a batch that is run again replaces what it wrote. Complete mode keeps
    the last state only. In update mode a key is written by each batch that touches it and its last row counts,
    but the least value of all batches in columns whose metadata is LEAST; every COMPACT batches the folders are
    merged to one row a key, so what is read follows the keys, not the batches. `progress` gets each batch's report.
    """
    spark = stream.sparkSession
    out, state = folder(spark, kind), folder(spark, f"{kind}-state")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    least = [f.name for f in stream.schema.fields if f.metadata == LEAST]

    def written(upto: int) -> list[str]:
        """The merged folder before a batch, and those of the batches since."""
        first = upto // COMPACT * COMPACT
        return [*([f"{out}/merged-{first}"] if first else []), *(f"{out}/batch-{k}" for k in range(first, upto))]

    def keep(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
            return
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")
        if mode == "update" and (batch_id + 1) % COMPACT == 0:
            before = [*written(batch_id), f"{out}/batch-{batch_id}"]
            _merged(spark.read.schema(schema).parquet(*before), keys, least).write.mode("overwrite").parquet(f"{out}/merged-{batch_id + 1}")

    had = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        job = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
        job.awaitTermination()
    finally:
        spark.conf.set(_STORE[0], had)
    if progress is not None:
        progress += [dict(p) for p in job.recentProgress]
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(out)
    # A batch without rows may still be counted, so the highest folder tells how many there were.
    paths = [p for p in (written(_batches(spark, out)) if mode == "update" else [f"{out}/batch-*"])]
    rows = spark.read.schema(schema).parquet(*paths)
    return (_merged(rows, keys, least) if mode == "update" else rows).select(*stream.columns)


def _batches(spark: SparkSession, out: str) -> int:
    """How many batches have written their folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return max((int(n.removeprefix("batch-")) + 1 for n in names if n.startswith("batch-")), default=0)


def run(stream: DataFrame, kind: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    return drain(stream, kind, mode, keys)


def recent(log: DataFrame, level: str) -> DataFrame:
    """Rows of a level, as they come."""
    return log.where(F.col("event_type") == level)


def windows(log: DataFrame, length: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows and disagreement rate per window, tumbling or sliding."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return log.withWatermark("ts", delay).groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("disagree").cast("double")).alias("disagree_rate")).select(F.col("window.start").alias("start"), "n", "disagree_rate")


def without_repeats(log: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """The first of rows that repeat a key within the watermark's delay."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


#: So long rows are waited for, by event time; rows of windows that have ended longer ago are dropped.
IDLE = "2 days"


def preferred(log: DataFrame, keys: list[str], order: str, delay: str = IDLE) -> DataFrame:
    """Of rows that repeat a key the one of least `order`, whenever it comes within `delay` (update mode).

    `log` has the event time `ts`. The state holds a key's least value in each window of `delay`, until the window has
    ended by the watermark, so it holds the keys of the latest days, not all that ever were; the sink takes the
    least of a key's windows. A null order counts only where a key has no other.
    """
    least = log.withWatermark("ts", delay).groupBy(F.window("ts", delay), *keys).agg(F.min(order).alias("_least"))
    return least.select(*keys, F.col("_least").alias(order, metadata=LEAST))


def means(log: DataFrame, keys: list[str], column: str, length: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Mean of a column per window and key: the snapshots that trends are found in."""
    by = log.withWatermark("ts", delay).groupBy(F.window("ts", length), *keys).agg(F.avg(column).alias("v"))
    return by.select(F.col("window.start").alias("start"), *keys, "v")


_ACTIVE = struct("user_id long, last_ts timestamp, n_seen long, n_active long")
_STATE = T.StructType([T.StructField("n_seen", T.LongType()), T.StructField("last", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])
#: Users whose latest event is so long ago leave the state; rows that come later than that are dropped.
KEEP = "400 days"


def _active(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Intervals still open at the latest event of a user, of this batch or an earlier one; ended ones leave the state."""
    if state.hasTimedOut:
        state.remove()
        return
    seen, last, ends = state.get if state.exists else (0, 0, [])
    found = [np.asarray(ends, np.int64)]
    for rows in batches:
        seen += len(rows)
        found.append(rows["ends_at"].to_numpy(np.int64))
        last = max(last, int(rows["ts"].max().timestamp() * 1_000_000))
    open_ = np.concatenate(found)
    open_ = np.sort(open_[open_ * 1_000_000 > last])
    state.update((seen, last, open_.tolist()))
    state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame({"user_id": [key[0]], "last_ts": [pd.Timestamp(last, unit="us")], "n_seen": [seen], "n_active": [len(open_)]})


def active_state(log: DataFrame) -> DataFrame:
    """Per user how many intervals [ts, ends_at] are open at its latest event (ends_at: epoch seconds).

    Late rows count as seen and, if still open, as active; they don't turn the latest event back.
    """
    return log.withWatermark("ts", KEEP).groupBy("user_id").applyInPandasWithState(_active, _ACTIVE, _STATE, "update", "EventTimeTimeout")


def feature_counts(log: DataFrame, idle: str = "14 days", delay: str = IDLE) -> DataFrame:
    """Counts per user and window of `idle` (update mode): a user who is idle for so long leaves the state.

    The sum over a user's windows is the count of all rows.
    """
    by = log.withWatermark("ts", delay).groupBy(F.window("ts", idle), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return by.select("user_id", F.col("window.start").alias("since"), "n", "last")


def upsert_features(log: DataFrame, kind: str = "features", idle: str = "14 days", delay: str = IDLE, progress: list[dict] | None = None) -> DataFrame:
    """Counts per user, refreshed batch by batch: a batch writes only the users that it touches."""
    counts = drain(feature_counts(log, idle, delay), kind, "update", ("user_id", "since"), progress)
    return counts.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last_ts"))
