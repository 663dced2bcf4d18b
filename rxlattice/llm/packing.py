"""Sum-of-squares online packing of documents into windows of a fixed number of ids.

Every task packs the documents of its own partition as they come, so nothing is shuffled. A level array
counts the open windows at each fill level; a document goes where the sum of the squared counts grows
least (a new window counts as level 0). A document of more than a window first fills whole windows.

At a partition's end the fuller open windows stay as the rule left them and only their gaps are filled, with
pieces cut from the emptiest ones. What is left at last is cut at powers of two, so that no sequence needs
padding. `moved` marks the pieces that this end laid anew: gaps of the fuller windows alone, so the fewest ids.

Defined cases: a null text is empty and holds the end id only; repeated rows are packed each on its own;
an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .tokens import END_ID, crc32, encoder, vocabulary

WINDOW = 4096

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, moved boolean"
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.bool_()) for c in SCHEMA.split(", ")])

#: (doc_id, start, ids, ids of the whole document, whether the end of a partition laid it anew)
Piece = tuple[int | None, int, np.ndarray, int, bool]


@dataclass
class SumOfSquares:
    """Open windows by fill level. `full` gets each window that is done, as its list of pieces."""

    size: int = WINDOW
    full: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.count = np.zeros(self.size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level(self, length: int) -> int:
        """The level that takes a piece of `length` at the least sum of squares; the fuller one of equals."""
        here, then = self.count[: self.size - length + 1], self.count[length:]
        change = 2 * then + 1 - 2 * here + 1
        change[-1] -= 2 * then[-1] + 1  # a window that gets full is open no more
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        change[0] -= 1  # no window leaves level 0
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.full.append([(doc_id, at, ids[at : at + self.size], total, False)])
            at += self.size
        if at == total:
            return
        length = total - at
        level = self.level(length)
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append((doc_id, at, ids[at:], total, False))
        if level + length == self.size:
            self.full.append(window)
        else:
            self.count[level + length] += 1
            self.open.setdefault(level + length, []).append(window)

    def finish(self) -> None:
        """Fill the fuller open windows with pieces of the emptiest ones; cut the last rest at powers of two."""
        left = [(level, w) for level, ws in sorted(self.open.items()) for w in ws]
        self.open.clear()
        self.count[:] = 0
        spare: list[Piece] = []
        while left:
            level, window = left.pop()
            gap = self.size - level
            while gap and (spare or left):
                if not spare:
                    spare = left.pop(0)[1]
                gap -= self._take(spare, gap, window)
            if gap:  # nothing is left to fill it
                self._powers(window)
            else:
                self.full.append(window)
        self._powers(spare)

    def _take(self, spare: list[Piece], most: int, window: list[Piece]) -> int:
        """Move up to `most` ids of the last spare piece to `window`; how many."""
        doc_id, start, ids, total, _ = spare.pop()
        take = min(most, len(ids))
        window.append((doc_id, start, ids[:take], total, True))
        if take < len(ids):
            spare.append((doc_id, start + take, ids[take:], total, True))
        return take

    def _powers(self, spare: list[Piece]) -> None:
        spare = spare[::-1]
        while rest := sum(len(p[2]) for p in spare):
            window: list[Piece] = []
            room = 1 << (min(rest, self.size).bit_length() - 1)
            while room:
                room -= self._take(spare, room, window)
            self.full.append(window)


def _pack(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, SumOfSquares(size)
        sequence = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in packer.full:
                offset = 0
                for doc_id, start, ids, total, moved in window:
                    rows.append((doc_id, start, len(ids), crc32(ids), total, sequence, offset, moved))
                    offset += len(ids)
                sequence += 1
            packer.full.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW) if rows else pa.RecordBatch.from_pylist([], _ARROW)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist(), END_ID)):
                packer.add(doc_id, ids)
            yield done()
        packer.finish()
        yield done()

    return run


def pack(docs: DataFrame, vocab: str | None = None, size: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, moved."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(vocab or vocabulary(), size), SCHEMA)
