"""Fill-in-middle over seekable compressed texts.

`write_texts` stores every text as independent zstandard frames of about `FRAME` bytes, cut between code points,
with counts up to each frame's end: lines ended, code points and bytes. The place after the k-th line lies in the
frame whose count reaches k first; only that frame is decompressed to find it. `transform` picks two places by
hashes and writes the output as frames again: those that lie between the places are copied as they are, only the
cut ones and the markers are compressed anew. `read_back` streams frames in order: all of the output for its digest
and its markers, then prefix, middle and suffix, found by the byte counts, for the digest of the text rebuilt.
A task holds one document's compressed frames and one or two frames of plain text.

Defined cases: a null text is empty; an empty text and one that holds a marker stay plain; a null doc_id is the
empty decimal in the hashes; repeated rows are treated alike; a text without a newline is one line; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

#: Plain bytes of a frame.
FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = MARKERS = (b"<P>", b"<S>", b"<M>")
#: Of a hundred texts so many are transformed, and of a hundred of these so many get the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7

_FRAMES = "frames array<binary>, lines array<long>, chars array<long>, bytes array<long>"
TEXTS = f"doc_id long, n long, marked boolean, {_FRAMES}"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>, bytes array<long>"
READ = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Frames:
    """Frames of one text with their counts; `spans` decompresses a frame at a time."""

    def __init__(self, frames: list[bytes], ends: list[int]):
        self.frames, self.ends = frames, ends
        self._last: tuple[int, bytes] = (-1, b"")

    @property
    def size(self) -> int:
        return self.ends[-1] if self.ends else 0

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def plain(self, i: int) -> bytes:
        if self._last[0] != i:
            self._last = i, zstandard.ZstdDecompressor().decompress(self.frames[i], self.ends[i] - self.start(i))
        return self._last[1]

    def span(self, begin: int, end: int) -> Iterator[bytes]:
        """The bytes from `begin` to `end`, a frame at a time."""
        i = bisect_right(self.ends, begin)
        while begin < end:
            first = self.start(i)
            yield self.plain(i)[begin - first : end - first]
            begin, i = self.ends[i], i + 1


class Writer:
    """Frames of about FRAME bytes from pieces of bytes; whole frames can be added as they are."""

    def __init__(self, size: int = FRAME):
        self.size, self.held = size, bytearray()
        self.frames: list[bytes] = []
        self.ends: list[int] = []
        self._pack = zstandard.ZstdCompressor(level=3).compress

    def _put(self, frame: bytes, n: int) -> None:
        self.frames.append(frame)
        self.ends.append((self.ends[-1] if self.ends else 0) + n)

    def add(self, data: bytes) -> None:
        self.held += data
        if len(self.held) >= self.size:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self._put(self._pack(bytes(self.held)), len(self.held))
            self.held.clear()

    def copy(self, frame: bytes, n: int) -> None:
        self.flush()
        self._put(frame, n)


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about `size` bytes, cut between code points."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def _store(size: int):
    schema = _arrow(TEXTS)

    def one(doc_id: int | None, text: str | None) -> dict:
        data = (text or "").encode("utf-8", "surrogatepass")
        writer, lines, chars = Writer(size), [], []
        for piece in _pieces(data, size):
            writer.add(piece)
            writer.flush()
            lines.append((lines[-1] if lines else 0) + piece.count(b"\n"))
            chars.append((chars[-1] if chars else 0) + _chars(piece))
        n = (lines[-1] if lines else 0) + (bool(data) and not data.endswith(b"\n"))
        return {"doc_id": doc_id, "n": n, "marked": any(m in data for m in MARKERS), "frames": writer.frames, "lines": lines, "chars": chars, "bytes": writer.ends}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"]
            for i in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([one(ids[k], texts[k].as_py()) for k in range(i, min(i + 64, batch.num_rows))], schema)

    return run


def write_texts(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """A written table of the texts of `docs` as frames with their counts (see TEXTS)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_store(size), TEXTS), "texts")


def hashes(doc_id: int | None, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _place(text: Frames, row: dict, k: int) -> tuple[int, int]:
    """(bytes, code points) of the first k lines."""
    if k == 0:
        return 0, 0
    i = bisect_left(row["lines"], k)
    if i == len(row["lines"]):  # the last line has no newline
        return text.size, row["chars"][-1]
    data, at = text.plain(i), -1
    for _ in range(k - (row["lines"][i - 1] if i else 0)):
        at = data.index(b"\n", at + 1)
    return text.start(i) + at + 1, (row["chars"][i - 1] if i else 0) + _chars(data[: at + 1])


def _copy(writer: Writer, text: Frames, begin: int, end: int) -> None:
    """Append a span: frames that lie in it whole as they are, cut ones anew."""
    i = bisect_right(text.ends, begin)
    while begin < end:
        first, last = text.start(i), text.ends[i]
        if begin == first and last <= end and last - first >= writer.size:
            writer.copy(text.frames[i], last - first)
        else:
            writer.add(text.plain(i)[begin - first : end - first])
        begin, i = last, i + 1


def _transform(rate: int, suffix_first: int, seed: int, size: int):
    schema = _arrow(OUTPUT)

    def one(row: dict) -> dict:
        text, n = Frames(row["frames"], row["bytes"]), row["n"]
        h1, h2, h3, h4 = hashes(row["doc_id"], seed)
        writer, form, prefix, middle = Writer(size), "plain", None, None
        if not text.size or row["marked"] or h3 % 100 >= rate:
            _copy(writer, text, 0, text.size)
        else:
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            (a, a_chars), (b, b_chars) = _place(text, row, low), _place(text, row, high)
            prefix, middle = a_chars, b_chars - a_chars
            form = "spm" if h4 % 100 < suffix_first else "psm"
            first, second = [(PREFIX, 0, a), (SUFFIX, b, text.size)][:: -1 if form == "spm" else 1]
            for marker, begin, end in (first, second, (MIDDLE, a, b)):
                writer.add(marker)
                _copy(writer, text, begin, end)
        writer.flush()
        return {"doc_id": row["doc_id"], "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "frames": writer.frames, "bytes": writer.ends}

    return _by_rows(one, schema)


def _by_rows(one, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([one(row) for row in batch.slice(i, 64).to_pylist()], schema)

    return run


def transform(texts: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, size: int = FRAME) -> DataFrame:
    """Outputs as frames (see OUTPUT) from a table of `write_texts`."""
    return texts.mapInArrow(_transform(rate, suffix_first, seed, size), OUTPUT)


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The bytes of the text that gave this output, found by its markers alone."""
    if form == "plain":
        yield from output.span(0, output.size)
        return
    at = {m: p for m, p in _markers(output)}
    ends = sorted(at.values())[1:] + [output.size]
    for marker in (PREFIX, MIDDLE, SUFFIX):
        begin = at[marker] + len(marker)
        yield from output.span(begin, next(e for e in ends if e >= begin))


def _markers(output: Frames) -> Iterator[tuple[bytes, int]]:
    """Each marker with the place where it begins; the last bytes of a frame are looked at with the next one."""
    held, at = b"", 0
    for data in output.span(0, output.size):
        data = held + data
        for marker in MARKERS:
            if (p := data.find(marker)) >= 0:
                yield marker, at + p
        held = data[-2:]
        at += len(data) - len(held)


def _read(row: dict) -> dict:
    output, whole, back = Frames(row["frames"], row["bytes"]), hashlib.sha256(), hashlib.sha256()
    for data in output.span(0, output.size):
        whole.update(data)
    for data in restored(output, row["form"]):
        back.update(data)
    return {k: row[k] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars")} | {"output_sha256": whole.hexdigest(), "restored_sha256": back.hexdigest()}


def read_back(outputs: DataFrame) -> DataFrame:
    """Digests of each output and of the text rebuilt from it (see READ)."""
    return outputs.mapInArrow(_by_rows(_read, _arrow(READ)), READ)


def _join(row: dict) -> dict:
    output = Frames(row["frames"], row["bytes"])
    return {"doc_id": row["doc_id"], "form": row["form"], "output": b"".join(output.span(0, output.size)).decode("utf-8", "surrogatepass")}


def output_texts(outputs: DataFrame) -> DataFrame:
    """The outputs as texts: doc_id, form, output."""
    schema = "doc_id long, form string, output string"
    return outputs.mapInArrow(_by_rows(_join, _arrow(schema)), schema)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """Digests of the outputs of all `docs`, from the store of their texts."""
    return read_back(transform(write_texts(docs)))
