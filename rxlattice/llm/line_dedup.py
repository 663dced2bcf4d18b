"""Line dedup by overlapping three-line windows.

Lines with a word, trimmed of blanks at both ends, are counted from 0 in a document; each run of three
of them is a window. The first occurrence of a window is the one of least (doc_id, position). Every later
one is repeated text: the lines that such windows cover, merged where they overlap, go from the text.
Windows are told apart by two independent 64-bit hashes, 128 bits in all.

Defined cases: texts that are null, blank or have fewer than three lines with words stay as they are;
lines without words are in no window and stay; rows with a null doc_id stay as they are; rows that repeat
one doc_id and text are the same occurrence, so a repetition by them removes nothing; an empty table
gives an empty result; all columns pass through and two counts are added as the last ones, n_lines and
n_removed, with leading underscores where `docs` has columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, materialize, tune
from .text import Words, chunks, combine, span_hash

LINES = 3


#: Base of the second hash of lines.
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def line_windows(texts: list[bytes], width: int = LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window (doc index, position, hash, second hash), and the number of lines with words of each text."""
    words = Words(texts, lower=False)
    breaks = np.concatenate((np.flatnonzero(words.data == 0x0A), words.doc_at[1:] - 1))
    breaks.sort()
    line = np.searchsorted(breaks, words.start)
    head = np.flatnonzero(np.diff(line, prepend=-1))
    tail = np.append(head[1:], len(line))[: len(head)] - 1
    docs = words.doc[head]
    per = np.bincount(docs, minlength=len(texts)).astype(np.int64)
    windows, second = (combine(span_hash(words.data, words.start[head], words.end[tail], *base), width) for base in ((), (_SECOND,)))
    n = len(windows)
    inside = docs[:n] == docs[width - 1 :] if n else np.empty(0, bool)
    position = np.arange(len(docs)) - (np.cumsum(per) - per)[docs]
    return docs[:n][inside], position[:n][inside], windows[inside], second[inside], per


_WINDOW = pa.schema([("hash", pa.int64()), ("second", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            for first, texts in chunks(batch["text"].to_pylist()):
                docs, position, hashes, second, _ = line_windows(texts, width)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(second.view(np.int64)), pa.array(ids[first + docs]), pa.array(position)], schema=_WINDOW)

    return run


def _cut(schema: pa.Schema, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, again = dict(zip((f.name for f in batch["row"].type), batch["row"].flatten())), batch["again"].to_pylist()
            texts = rows["text"].to_pylist()
            n_lines, n_removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for first, data in chunks(texts):
                docs, position, hashes, _, per = line_windows(data, width)
                n_lines[first : first + len(data)] = per
                at = np.searchsorted(docs, np.arange(len(data) + 1))
                for i in range(len(data)):
                    if not again[first + i]:
                        continue
                    own = dict(zip(position[at[i] : at[i + 1]].tolist(), hashes[at[i] : at[i + 1]].view(np.int64).tolist()))
                    gone = {p + k for x in again[first + i] if own.get(p := x["pos"]) == x["hash"] for k in range(width)}
                    kept, line = [], -1
                    for raw in texts[first + i].split("\n"):
                        line += (full := bool(raw.strip(" \t\n\v\f\r")))
                        if not (full and line in gone):
                            kept.append(raw)
                    if gone:
                        texts[first + i] = "\n".join(kept)
                        n_removed[first + i] = len(gone)
            columns = [*(rows | {"text": pa.array(texts, pa.string())}).values(), pa.array(n_lines), pa.array(n_removed)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def dedup_lines(docs: DataFrame, width: int = LINES) -> DataFrame:
    """The columns of `docs`, text without its repeated lines, and its lines and those removed (see `count_names`)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    windows = materialize(rows.mapInArrow(_windows(width), "hash long, second long, doc_id long, pos long"), "windows")
    place, key = F.struct("doc_id", "pos"), ["hash", "second"]
    repeated = windows.groupBy(*key).agg(F.min(place).alias("f"), F.max(place).alias("l"), F.count(F.lit(1)).alias("n")).where("f < l")
    firsts = materialize(repeated.select(*key, F.col("f.doc_id").alias("fd"), F.col("f.pos").alias("fp"), "n"), "repeated")
    later = join_hot(windows, firsts, key, "n").where("doc_id > fd or (doc_id = fd and pos > fp)")
    again = later.select("doc_id", "pos", "hash").distinct().groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("pos", "hash")).alias("again"))
    schema = T.StructType([docs.schema[c] if c != "text" else T.StructField("text", T.StringType()) for c in docs.columns] + [T.StructField(c, T.LongType()) for c in count_names(docs)])
    # The rows travel as one struct, so that no column of theirs can clash with those of the join.
    joined = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(*(F.col(c).cast(schema[c].dataType).alias(c) for c in docs.columns)).alias("row")).join(again, "_doc", "left").select("row", "again")
    return joined.mapInArrow(_cut(to_arrow_schema(schema), width), schema)


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the two counts that `dedup_lines` adds to `docs`."""
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("n_lines", "n_removed"):
        while name in taken:
            name = f"_{name}"
        names.append(name)
    return names[0], names[1]
