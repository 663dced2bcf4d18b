"""Content-addressed store for token ids.

A rolling hash over the last ids cuts each document's id stream into chunks, so equal passages give
equal chunks wherever they stand. A chunk's address is the hash of its bytes; `chunks/` holds every
address once, `recipes/` holds one row per document in ascending doc_id order with the addresses, the
lengths and the root of a Merkle tree over them.

Reading back verifies every stored chunk against its address once and every recipe against its root.
The crc32 of a whole document is then put together from its chunks' crc32, so ids aren't shuffled again.

Defined cases: a null text is empty and holds the end id only; repeated doc_ids stay separate documents;
an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize, shared_dir, tune
from .text import chunks, mix
from .tokens import END_ID, crc32, encoder, vocabulary

#: Chunk lengths in ids: least, usual (a power of two) and greatest; ids that the rolling hash sees.
LEAST, USUAL, MOST, WINDOW = 64, 256, 1024, 16
#: Addresses that a task remembers, so as to send a repeated chunk once.
SEEN = 200_000
ADDRESS_BYTES = 16

_ROLL = np.uint64(0x9FB21C651E98DF25)
_CRC_POLY = 0xEDB88320

_STAGED = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("addresses", T.ArrayType(T.BinaryType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("root", T.BinaryType()),
        T.StructField("fresh", T.ArrayType(T.StructType([T.StructField("address", T.BinaryType()), T.StructField("payload", T.BinaryType())]))),
    ]
)
_STAGED_ARROW = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("addresses", pa.list_(pa.binary())),
        ("lengths", pa.list_(pa.int32())),
        ("root", pa.binary()),
        ("fresh", pa.list_(pa.struct([("address", pa.binary()), ("payload", pa.binary())]))),
    ]
)


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=ADDRESS_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; an odd last node moves up unchanged."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [address(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids asks for a cut.

    The window is doubled step by step. It may reach back into a document before, but only where a chunk
    would be too short to be cut, as WINDOW is less than LEAST.
    """
    rolled, width = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while width < WINDOW:
        wider = rolled.copy()
        wider[width:] += rolled[:-width] * np.uint64(pow(int(_ROLL), width, 1 << 64))
        rolled, width = wider, 2 * width
    return np.flatnonzero((mix(rolled) & np.uint64(USUAL - 1)) == 0) + 1


def cuts(n: int, wanted: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids, from the cuts that its rolling hash asks for."""
    ends, at = [], 0
    for mark in [*wanted, n]:
        while mark - at > MOST:
            at += MOST
            ends.append(at)
        if mark - at >= LEAST or mark == n and mark > at:
            at = mark
            ends.append(at)
    return ends


def _stage(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_chunk
        seen: set[bytes] = set()
        for batch in batches:
            uids, doc_ids = batch["uid"].to_pylist(), batch["doc_id"].to_pylist()
            for first, texts in chunks(batch["text"].to_pylist()):
                ids, lengths = encode(texts, END_ID)
                if ids.max(initial=0) >= 1 << 16:
                    raise ValueError(f"id {ids.max()} doesn't fit two bytes: the store takes vocabularies of up to 65,536 ids")
                narrow, wanted = ids.astype("<u2"), marks(ids)
                stops = np.cumsum(lengths)
                edges = np.searchsorted(wanted, np.concatenate(([0], stops)), side="right")
                rows = []
                for i, (n, stop) in enumerate(zip(lengths.tolist(), stops.tolist())):
                    start = stop - n
                    ends = cuts(n, (wanted[edges[i] : edges[i + 1]] - start).tolist())
                    payloads = [narrow[start + a : start + b].tobytes() for a, b in zip([0, *ends], ends)]
                    leaves = [address(p) for p in payloads]
                    fresh = []
                    for leaf, payload in zip(leaves, payloads):
                        if leaf not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(leaf)
                            fresh.append({"address": leaf, "payload": payload})
                    rows.append((uids[first + i], doc_ids[first + i], n, leaves, np.diff([0, *ends]).tolist(), merkle_root(leaves), fresh))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STAGED_ARROW.types)], schema=_STAGED_ARROW)

    return run


@dataclass
class Store:
    """Where a store's tables lie."""

    path: str

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("address binary, payload binary").parquet(f"{self.path}/chunks")

    def recipes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part int, uid long, doc_id long, n_tokens long, addresses array<binary>, lengths array<int>, root binary").parquet(f"{self.path}/recipes")


def write_store(docs: DataFrame, vocab: str | None = None) -> Store:
    """Encode every whole text and write chunks and recipes. Vocabularies of up to 65,536 ids fit."""
    spark = tune(docs.sparkSession)
    vocab = vocab or vocabulary()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = materialize(rows.mapInArrow(_stage(vocab), _STAGED), "ids")
    store = Store(shared_dir(spark, "store"))
    # Tasks have sent a chunk once each; what several tasks found is made one here, by a partial aggregate first.
    staged.select(F.inline("fresh")).groupBy("address").agg(F.max("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{store.path}/chunks")
    (
        staged.drop("fresh").repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid")
        .select(F.spark_partition_id().alias("part"), "uid", "doc_id", "n_tokens", "addresses", "lengths", "root")
        .write.option("compression", "zstd").parquet(f"{store.path}/recipes")
    )
    drop(staged)
    return store


def _times(a: int, b: np.ndarray) -> np.ndarray:
    """a * b modulo the crc polynomial, in reflected bit order."""
    out, b = np.zeros_like(b), b.copy()
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(_CRC_POLY), b >> np.uint64(1))
    return out


_SHIFTS: list[np.ndarray] = []


def _shift(bit: int) -> np.ndarray:
    """4 x 256 table: what each byte of a crc turns into when 2**bit zero bytes follow."""
    while len(_SHIFTS) <= bit:
        power = 1 << 23  # x to the 8: one byte
        for _ in range(len(_SHIFTS)):
            power = int(_times(power, np.array([power], np.uint64))[0])
        _SHIFTS.append(np.stack([_times(power, np.arange(256, dtype=np.uint64) << np.uint64(8 * k)) for k in range(4)]))
    return _SHIFTS[bit]


def crc_shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each crc32 adds to the crc32 of a longer stream that has `zeros` bytes after it."""
    out, left = crc.astype(np.uint64), zeros.astype(np.int64)
    for bit in range(int(left.max()).bit_length() if len(left) else 0):
        odd = np.flatnonzero(left >> bit & 1)
        old, table = out[odd], _shift(bit)
        new = table[0][(old & np.uint64(255)).astype(np.int64)]
        for k in (1, 2, 3):
            new = new ^ table[k][(old >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)]
        out[odd] = new
    return out


_CHUNK_INFO = pa.schema([("address", pa.binary()), ("n", pa.int64()), ("crc", pa.int64()), ("sound", pa.bool_())])


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(a, len(p) // 2, crc32(np.frombuffer(p, "<u2")), address(p) == a) for a, p in zip(batch["address"].to_pylist(), batch["payload"].to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CHUNK_INFO.types)], schema=_CHUNK_INFO) if rows else pa.RecordBatch.from_pylist([], _CHUNK_INFO)


_REF = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("uid", T.LongType()), ("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("rooted", T.BooleanType()), ("address", T.BinaryType()), ("behind", T.LongType()))])
_REF_ARROW = pa.schema([("part", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("rooted", pa.bool_()), ("address", pa.binary()), ("behind", pa.int64())])


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            rooted = merkle_root(r["addresses"]) == r["root"]
            behind = r["n_tokens"]
            for leaf, n in zip(r["addresses"], r["lengths"]):
                behind -= n
                rows.append((r["part"], r["uid"], r["doc_id"], r["n_tokens"], rooted, leaf, behind))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _REF_ARROW.types)], schema=_REF_ARROW) if rows else pa.RecordBatch.from_pylist([], _REF_ARROW)


def _shifted(crc: pd.Series, behind: pd.Series) -> pd.Series:
    return pd.Series(crc_shifted(crc.to_numpy(), behind.to_numpy() * 4).astype(np.int64))


def read_documents(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified: everything from the store's files."""
    shifted = F.pandas_udf(_shifted, "long")
    info = store.chunks(spark).mapInArrow(_inspect, "address binary, n long, crc long, sound boolean")
    refs = store.recipes(spark).mapInArrow(_refs, _REF)
    documents = (
        refs.join(info, "address", "left")
        .withColumn("crc", shifted(F.coalesce("crc", F.lit(0)), "behind"))
        .groupBy("part", "uid", "doc_id", "n_tokens", "rooted")
        .agg(F.sum("n").alias("read"), F.expr("bit_xor(crc)").alias("ids_crc32"), F.count(F.lit(1)).alias("n_chunks"), F.expr("bool_and(coalesce(sound, false))").alias("sound"))
        .select("part", "uid", "doc_id", F.coalesce("read", F.lit(0)).cast("long").alias("n_tokens"), "ids_crc32", "n_chunks", (F.col("rooted") & F.col("sound") & (F.col("read") == F.col("n_tokens"))).alias("verified"))
    )
    documents = materialize(documents, "read")
    # One row per recipe file reaches the driver, to say how many ids lie before each file.
    totals = documents.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, at = [], 0
    for row in totals:
        before.append((row["part"], at))
        at += row["n"]
    offsets = spark.createDataFrame(before, "part int, before long")
    running = "sum(n_tokens) over (partition by part order by doc_id, uid rows between unbounded preceding and 1 preceding)"
    return documents.withColumn("within", F.expr(f"coalesce({running}, 0)")).join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32", "n_chunks", "verified")


def read_ids(spark: SparkSession, store: Store, doc_ids: DataFrame) -> DataFrame:
    """doc_id, uid, ids: the documents named by `doc_ids` (column doc_id), put together again."""
    wanted = store.recipes(spark).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = wanted.select("uid", "doc_id", F.posexplode("addresses").alias("pos", "address")).join(store.chunks(spark), "address")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in sorted(ps, key=lambda p: p["pos"])), "<u2").astype(np.int32).tolist() for ps in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["uid"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "uid", "ids"])

    return parts.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("pos", "payload")).alias("parts")).mapInArrow(join, "doc_id long, uid long, ids array<int>")
