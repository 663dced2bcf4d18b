"""Conversations in turn order, cut into segments of bounded size.

Rows are dealt by ranges of (conversation, turn), so that one conversation may lie in many tasks. Each task cuts
its run of rows into segments, one row each with its turns as an array. A segment that surely holds its whole
conversation is marked `whole` and needs no other row; the segments of all other conversations (those at the
edges of a task's range and the long ones) are put in order again by `in_order`, which hands them to a task as a
sorted stream: what the task keeps doesn't grow with a conversation.

Order: turn (nulls first), then role, then text by its first 64 code points, then by its hash. Equal rows are
spread by their place in the table they are read from, so a group of copies is no single task's work; `rows`
should therefore be read from a table and not come from a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A segment ends with so many turns or, after a turn, with so many bytes of text.
SEGMENT_TURNS, SEGMENT_BYTES = 1024, 1 << 17

SCHEMA = "conv_id long, seg long, whole boolean, turns array<struct<turn: long, role: string, text: string>>"
_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_ARROW = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(_TURN))])


def _cut(most_turns: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        conv, size, first, done, bytes_done = None, 0, True, [], 0

        def close(whole: bool) -> None:
            nonlocal seg, held, size, bytes_done
            done.append({"conv_id": conv, "seg": seg, "whole": whole, "turns": held})
            seg, held, bytes_done, size = seg + 1, [], bytes_done + size, 0

        open_start = True  # the conversation may have begun in the task before, or has been cut here
        for batch in batches:
            for row in batch.to_pylist():
                if first:
                    first = False
                elif row["conv_id"] != conv:
                    close(not open_start)
                    open_start = False
                elif len(held) >= most_turns or size >= most_bytes:
                    close(False)
                    open_start = True
                conv = row.pop("conv_id")
                held.append(row)
                size += len(row["text"] or "")
                if bytes_done >= 1 << 22 or len(done) >= 4096:
                    yield pa.RecordBatch.from_pylist(done, _ARROW)
                    done.clear()
                    bytes_done = 0
        if held:
            close(False)
        yield pa.RecordBatch.from_pylist(done, _ARROW)

    return run


def segments(rows: DataFrame, most_turns: int = SEGMENT_TURNS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A written table of the segments of `rows` (conv_id, turn, role, text); see SCHEMA.

    Null ids are one conversation, null turns come first, null roles and texts stay null; repeated rows all
    stay; an empty table gives no segment; other columns are ignored.
    """
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_place"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first(), F.xxhash64("text").asc(), F.col("_place").asc()]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    return materialize(dealt.mapInArrow(_cut(most_turns, most_bytes), SCHEMA), "segments")


def conversation() -> F.Column:
    """The conversation as a key that is never null."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))


def in_order(rows: DataFrame, last_first: bool = False) -> DataFrame:
    """`rows` (conv_id, seg, ..) dealt by conversation, each one's segments in order inside a task."""
    seg = F.col("seg").desc() if last_first else F.col("seg").asc()
    return rows.repartition(conversation()).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), seg)


def fold(rows: DataFrame, start: Callable, add: Callable, finish: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """One row per conversation from its segments (conv_id, seg, whole, ..) in order.

    `start()` makes the state of a conversation, `add(state, row)` takes in one segment and `finish(state)` gives
    the result's columns. Whole segments are folded where they lie, the others as a sorted stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []
        for batch in batches:
            for i in range(0, batch.num_rows, 32):  # a few rows at a time: they hold whole segments
                for row in batch.slice(i, 32).to_pylist():
                    if state is None or row["conv_id"] != conv:
                        if state is not None:
                            done.append({"conv_id": conv} | finish(state))
                        conv, state = row["conv_id"], start()
                    add(state, row)
            yield pa.RecordBatch.from_pylist(done, arrow)
            done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv} | finish(state)], arrow)

    return rows.where("whole").mapInArrow(run, schema).unionByName(in_order(rows.where("not whole")).mapInArrow(run, schema))
