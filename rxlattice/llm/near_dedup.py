"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

A text's set is that of its distinct five-word shingles. Its signature has 32 symbols of 16 bits, each
from the least value of one hash over the set. Two signatures that differ in at most `DISTANCE` = 15
symbols must, by the pigeonhole principle, differ in at most one symbol of some of the 8 chunks of 4
symbols; every chunk is therefore looked up under its 4 keys with one symbol left out, which enumerates
all allowed chunk errors. Two sets at the least similarity to be linked (0.85) share no key at all once
in about 5e7 pairs, and differ in more than 15 symbols in 3.5e-6 of the pairs. At 0.8, the least that may be
asked for (the pipeline does), these are 1.1e-6 and 1.4e-4. Sets found by a shared key are compared in full, so no wrong link gets in.

Texts with equal sets form a class; only its smallest doc_id is looked up. Classes with a key in common
are first compared with one leader each, and what is linked is put into components. Only keys that still
hold more than one component go on. Shingles that lie in one component only bound what a class can share
with another one, which settles most classes without a comparison; the rest meets a leader of another
component, then all classes of other components that the bounds allow, compared where they meet. So a large
group of near copies costs a pass over its members; only copies that a key joins but no link does are held
against each other, and no pair of them is written.

Defined cases: texts that are null, empty or blank have an empty set and stay alone; a null doc_id is
dropped from linking and keeps a null component; rows with one doc_id count as one document, whose text for comparing is that of least hash; an empty table
gives an empty result; other columns are ignored.

Keys and leaders that a large share of all classes has are met by broadcast or by salted copies. The tables
of the steps between are deleted as soon as nothing reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, join_salted, materialize, tune
from .components import components
from .text import Words, chunks, mix, shingle_sets

SYMBOLS, CHUNK, BITS, DISTANCE = 32, 4, 16, 15
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85

_A = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(101, 101 + SYMBOLS, dtype=np.uint64))

_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("symbols", pa.list_(pa.int32()))])


def signatures(docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x SYMBOLS symbols of the sets given as (doc index, hash), ascending; sets without members are 0."""
    out = np.zeros((n, SYMBOLS), np.int32)
    if len(docs):
        heads = np.flatnonzero(np.diff(docs, prepend=-1))
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(hashes * _A[k] + _B[k], heads)
            out[docs[heads], k] = (mix(least) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        for first, texts in chunks(batch["text"].to_pylist()):
            docs, hashes = shingle_sets(Words(texts))
            n = len(texts)
            size = np.bincount(docs, minlength=n)
            at = np.concatenate(([0], np.cumsum(size)))
            sets = [hashlib.blake2b(hashes[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if size[i] else None for i in range(n)]
            symbols = signatures(docs, hashes, n).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * SYMBOLS + 1, SYMBOLS, dtype=np.int32)), pa.array(symbols))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + n], pa.int64()), batch["text_id"].slice(first, n), pa.array(size, pa.int64()), pa.array(sets, pa.binary()), lists], schema=_SIGNED)


def _keys() -> F.Column:
    """The keys of a signature: each chunk with one of its symbols left out."""
    keys = []
    for chunk in range(SYMBOLS // CHUNK):
        for out in range(CHUNK):
            kept = [F.col("symbols")[chunk * CHUNK + k] for k in range(CHUNK) if k != out]
            keys.append(F.xxhash64(F.lit(chunk * CHUNK + out), *kept))
    return F.array(*keys)


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["left"].to_pylist(), batch["right"].to_pylist()
            sets: dict[str, np.ndarray] = {}
            for _, texts in chunks(new := list(dict.fromkeys([*left, *right]))):
                docs, hashes = shingle_sets(Words(texts))
                at = np.searchsorted(docs, np.arange(len(texts) + 1))
                sets.update((new[len(sets)], hashes[at[i] : at[i + 1]]) for i in range(len(texts)))
            linked = []
            for a, b in zip(left, right):
                shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                linked.append(100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Which of the pairs (a, b) of doc_ids are linked, by their full shingle sets."""
    lefts, rights = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(side)) for k, side in (("a", "left"), ("b", "right")))
    got = join_salted(pairs, lefts, "a", "b").join(rights, "b")
    checked = got.select("a", "b", "left", "right").mapInArrow(_compare(percent), "a long, b long, linked boolean")
    return checked.where("linked").select("a", "b")


def _open(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, slot, class_id, component) of the keys whose classes lie in more than one component."""
    owned = shared.select("key", "slot", "class_id").join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
    owned = materialize(owned.select("key", "slot", "class_id", F.coalesce("component", "class_id").alias("component")), "owned")
    keys = owned.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n")).where("c1 < c2").select("key", "n")
    keys = materialize(keys, "openkeys")
    found = materialize(join_hot(owned, keys, "key", "n").drop("n"), "open")
    drop(owned, keys)
    return found


def _possible(percent: int) -> F.Column:
    """Whether two sets of n_a and n_b shingles, common_a and common_b of them not their own, could be linked."""
    most = F.least("common_a", "common_b")
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def _linked(percent: int) -> F.Column:
    """Whether two sets are linked, exactly: shingles outside others_a or others_b aren't in both."""
    shared = F.size(F.array_intersect("others_a", "others_b"))
    return (100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))


def _close() -> F.Column:
    """Whether two signatures lie within the distance."""
    return F.size(F.filter(F.arrays_zip("symbols_a", "symbols_b"), lambda x: x["symbols_a"] != x["symbols_b"])) <= DISTANCE


def _limits(still: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(class_id, n, common, others) of open classes that some other component could be linked with.

    A shingle that no other component has can't be shared across components. `others` holds the rest, `common` of them;
    a class of too few drops out: at most it equals a set of just those. This is exact, and it settles
    heavily edited copies without comparing them with anything.
    """
    members = still.select(F.col("class_id").alias("doc_id"), "component").distinct()
    rows = materialize(texts.join(members, "doc_id").select("doc_id", "component", "text").mapInArrow(_explode, "class_id long, component long, shingle long"), "shingles")
    wide = rows.groupBy("shingle").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("shingle", F.lit(1).alias("wide"))
    seen = rows.join(wide, "shingle", "left")
    counts = seen.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.count("wide").alias("common"), F.collect_list(F.when(F.col("wide") == 1, F.col("shingle"))).alias("others"))
    found = materialize(counts.where(100 * F.col("common") >= percent * F.col("n")), "limits")
    drop(rows)
    return found


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, comps = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "component"))
        for first, texts in chunks(batch["text"].to_pylist()):
            docs, hashes = shingle_sets(Words(texts))
            at = first + docs
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(comps[at]), pa.array(hashes.view(np.int64))], names=["class_id", "component", "shingle"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the group), kept, class_id, class_size.

    The rule of linking is 100 * intersection >= percent * union; percent must be 80 or more.
    """
    if percent < 80:
        raise ValueError("the signatures are laid out for similarities of 0.8 or more")
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = rows.withColumn("text_id", F.xxhash64("text"))
    signed = materialize(hashed.mapInArrow(_sign, "doc_id long, text_id long, n_shingles long, set_id binary, symbols array<int>"), "signatures")

    filled = one_text(signed).where("n_shingles > 0")
    classes = filled.groupBy("set_id").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("class_size"))
    classes = materialize(classes, "classes")
    symbols = filled.join(classes, F.col("doc_id") == F.col("class_id")).where(filled.set_id == classes.set_id).select("class_id", "symbols").dropDuplicates(["class_id"])
    keyed = materialize(symbols.select("class_id", F.posexplode(_keys()).alias("slot", "key")), "keys")
    # A key of one class links nothing.
    leaders = materialize(keyed.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high"), "leaders")
    shared = materialize(join_hot(keyed, leaders, "key", "n").drop("n"), "shared")
    drop(keyed, leaders)

    wanted = shared.select(F.col("class_id").alias("doc_id")).distinct()
    texts = materialize(hashed.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", "text_id").alias("text")), "texts")

    # The leader that a class shares most keys with is the likeliest to be linked.
    pairs = shared.where("class_id > low").groupBy(F.col("low").alias("a"), F.col("class_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    tried = materialize(best, "tried")
    edges = materialize(confirm(tried, texts, percent), "edges")
    comps = components(edges)
    still = _open(shared, comps)
    drop(comps)
    limits = _limits(still, texts, percent)
    sig = materialize(symbols.join(limits, "class_id").select("class_id", "symbols", "n", "common", "others"), "bounded")

    # Each class meets the hub of each of its keys: the class with the greatest share of common shingles.
    rated = materialize(still.join(limits.drop("others"), "class_id"), "rated")
    hub = F.max_by(F.struct("class_id", "component"), F.struct(F.col("common") / F.col("n"), -F.col("class_id")))
    hubs = materialize(rated.groupBy("key").agg(hub.alias("hub"), F.count(F.lit(1)).alias("n_key")), "hubs")
    met = join_hot(rated, hubs, "key", "n_key").where("component <> hub.component").select("class_id", F.col("hub.class_id").alias("other")).distinct()
    pairs = met.select(F.least("class_id", "other").alias("a"), F.greatest("class_id", "other").alias("b")).distinct()
    left, right = (sig.select(*(F.col(c).alias(f"{c}_{s}") for c in sig.columns if c != "others")) for s in "ab")
    pairs = pairs.join(left, F.col("a") == F.col("class_id_a")).join(right, F.col("b") == F.col("class_id_b")).where(_possible(percent) & _close())
    new = materialize(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), "pairs")
    more = materialize(confirm(new, texts, percent), "edges")
    linked = edges.unionByName(more)
    drop(still, limits, rated, hubs)

    # What is still open meets all classes of other components, each pair under the first key that it shares. The
    # sets are compared inside the join, so that only linked pairs leave it.
    comps = components(linked)
    still = _open(shared, comps)
    drop(comps)
    rows = still.join(sig.withColumn("keys", _keys()), "class_id")
    left, right = (rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "key")) for s in "ab")
    apart = (F.col("class_id_a") < F.col("class_id_b")) & (F.col("component_a") != F.col("component_b"))
    earlier = F.exists(F.arrays_zip(F.slice("keys_a", F.lit(1), F.col("slot_a")), F.slice("keys_b", F.lit(1), F.col("slot_a"))), lambda x: x["0"] == x["1"])
    met = left.join(right, (left.key == right.key) & apart & _possible(percent) & _close() & ~earlier & _linked(percent))
    last = materialize(met.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).join(tried.unionByName(new), ["a", "b"], "left_anti"), "pairs")
    most = materialize(confirm(last, texts, percent), "edges")
    comps = components(linked.unionByName(most))
    drop(still, sig, shared, texts, tried, edges, new, more, last, most)

    classes = classes.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id")).drop("component")
    found = one_set(signed).join(classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def _mixed(signed: DataFrame) -> DataFrame:
    """(doc_id, own) of the doc_ids whose rows have different texts; own: set and text of least hash."""
    own = F.min(F.struct("text_id", "set_id", "n_shingles")).alias("own")
    found = signed.where("doc_id is not null").groupBy("doc_id").agg(own, F.max("text_id").alias("most"))
    return found.where("own.text_id < most").select("doc_id", "own")


def one_text(signed: DataFrame) -> DataFrame:
    """The rows with a doc_id, but of rows that repeat one with different texts those of the least hash only."""
    rows, mixed = signed.where("doc_id is not null"), _mixed(signed)
    return rows if mixed.isEmpty() else rows.join(mixed, "doc_id", "left").where("own is null or text_id = own.text_id").drop("own")


def one_set(signed: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id of every row; rows that repeat a doc_id have the set of that least hash."""
    rows, mixed = signed.select("doc_id", "n_shingles", "set_id"), _mixed(signed)
    if mixed.isEmpty():
        return rows
    both = rows.join(mixed, "doc_id", "left")
    return both.select("doc_id", *(F.when(F.col("own").isNull(), F.col(c)).otherwise(F.col(f"own.{c}")).alias(c) for c in ("n_shingles", "set_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` but for near copies: of each group the smallest doc_id stays.

    Only the rows to go are joined; every other row passes, null doc_ids and repeated rows included.
    """
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
