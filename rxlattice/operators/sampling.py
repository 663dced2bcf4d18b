"""Samples with exact sizes by hash rank: the same ids every time, on any number of executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved
from .knowledge import small


def hash_key(id_: str, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.col(id_).cast("string"), F.lit(str(seed))), 256)


def hash_place(df: DataFrame, keys: list[str], id_: str, seed: int = 42, digits: int = 3) -> DataFrame:
    """`df` with _n, the place of a row in its group by (hash, id), without one task per group.

    Rows are ranked inside slices of the hash (16 ** digits for each group); the slices' sizes, a small
    table, say how many rows come before. A group with a third of all rows is spread over its slices.
    """
    rows = df.withColumn("_h", hash_key(id_, seed)).withColumn("_s", F.substring("_h", 1, digits))
    sizes = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_s").alias("_slice"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_h", id_)))
    same = F.col("_s") == F.col("_slice")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(sizes, same).select(*df.columns, (F.col("_in") + F.col("_before")).alias("_n"))


def largest_remainder(sizes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Quotas per stratum (columns keys, n) that add up to `total`: floors, then the largest fractions.

    Strata are few; they are ranked in one window after aggregation.
    """
    all_ = sizes.agg(F.sum("n").alias("all_n"))
    share = sizes.crossJoin(F.broadcast(all_)).withColumn("exact", F.lit(total) * F.col("n") / F.col("all_n")).withColumn("low", F.floor("exact"))
    left = F.lit(total) - F.sum("low").over(Window.partitionBy())
    order = Window.orderBy((F.col("exact") - F.col("low")).desc(), *keys)
    return share.withColumn("left", left).withColumn("place", F.row_number().over(order)).select(*keys, "n", (F.col("low") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))


def quota_sample(df: DataFrame, quotas: DataFrame, keys: list[str], id_: str, seed: int = 42) -> DataFrame:
    """The `quota` rows of least hash of each stratum; `df` is read twice.

    Rows are counted by slices of the hash first (written once), and only rows of slices that begin before the quota is
    full are ranked, so what is shuffled and sorted follows the quotas, not the strata.
    """
    rows = df.withColumn("_h", hash_key(id_, seed)).withColumn("_s", F.substring("_h", 1, 3))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    slices = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c")).select(*keys, "_s", F.coalesce(before, F.lit(0)).alias("_before"))
    begun = saved(slices.join(small(quotas.select(*keys, "quota")), keys).where("_before < quota"), "slices")
    place = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_h", id_)) + F.col("_before")
    near = rows.join(small(begun), [*keys, "_s"]).withColumn("_n", place).where("_n <= quota")
    return near.select(*keys, *(c for c in df.columns if c not in keys))


def stratified(df: DataFrame, keys: list[str], total: int, id_: str, seed: int = 42) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return quota_sample(df, largest_remainder(sizes, keys, total), keys, id_, seed)


def golden(df: DataFrame, level: str, positive: str, shares: dict[str, float], total: int, least: float, id_: str, seed: int = 42) -> DataFrame:
    """`total` rows in fixed shares by level; of each level at least the share `least` has `positive` = 1.

    A level with too few rows gives all of them; too few of one kind are made up by the other. `df` is written once, as
    quotas and sample both come from it.
    """
    df = saved(df, "golden")
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError("the shares must add up to 1")
    target = F.create_map(*(F.lit(x) for k, v in shares.items() for x in (k, int(total * v))))[F.col(level)]
    n = df.groupBy(level).agg(F.count_if(F.col(positive) == 1).alias("_np"), F.count_if(F.col(positive) == 0).alias("_nn")).withColumn("_t", target).where("_t is not null")
    want = F.least(F.col("_np"), F.col("_t").cast("long"), F.greatest(F.floor(F.col("_t") * least), F.col("_t") - F.col("_nn")))
    quotas = n.withColumn("_w", want).select(level, F.inline(F.array(F.struct(F.lit(1).alias(positive), F.col("_w").alias("quota")), F.struct(F.lit(0).alias(positive), (F.col("_t") - F.col("_w")).alias("quota")))))
    return quota_sample(df, quotas, [level, positive], id_, seed)


def split(df: DataFrame, label: str, id_: str, shares: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 42) -> DataFrame:
    """Split within each class by hash rank; cut points are floors, the last part takes the rest."""
    ranked = hash_place(df, [label], id_, seed).join(small(df.groupBy(label).agg(F.count(F.lit(1)).alias("_all"))), label)
    out, at = None, 0.0
    for share, name in zip(shares[:-1], names):
        at += share
        inside = F.col("_n") <= F.floor(F.lit(at) * F.col("_all") + 1e-9)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return ranked.withColumn("split", out.otherwise(names[-1])).drop("_n", "_all")


def disjoint(validation: DataFrame, training: DataFrame, id_: str = "patient_id") -> DataFrame:
    return validation.join(training.select(id_).distinct(), id_, "left_anti")


def id_overlap(a: DataFrame, b: DataFrame, id_: str = "patient_id") -> DataFrame:
    """Ids in both, in the first only, in the second only."""
    x, y = a.select(id_).distinct().withColumn("in_a", F.lit(True)), b.select(id_).distinct().withColumn("in_b", F.lit(True))
    j = x.join(y, id_, "full_outer")
    return j.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("n_only_a"), F.count_if(F.col("in_a").isNull()).alias("n_only_b"))


def compatibility(a: DataFrame, b: DataFrame, code: str) -> DataFrame:
    """Whether two vocabularies (code, idx) give equal columns: their sizes, codes in one only, codes that moved."""
    x, y = a.select(code, F.col("idx").alias("_a")), b.select(code, F.col("idx").alias("_b"))
    lost, moved = F.col("_a").isNull() | F.col("_b").isNull(), F.col("_a") != F.col("_b")
    got = x.join(y, code, "full").agg(F.count("_a").alias("n_first"), F.count("_b").alias("n_second"), F.count_if(lost).alias("n_missing"), F.count_if(moved).alias("n_moved"))
    return got.withColumn("compatible", (F.col("n_missing") == 0) & (F.col("n_moved") == 0))


def class_weights(df: DataFrame, label: str, costs: dict[int, float] | None = None) -> DataFrame:
    """Balanced weight n / (k * n_c) of each class, the same times its cost (1 if not given), and the share of others to it."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = per.agg(F.sum("n_class").alias("n_all"), F.count(F.lit(1)).alias("k"))
    balanced, cost = F.col("n_all") / (F.col("k") * F.col("n_class")), F.lit(1.0)
    for value, factor in (costs or {}).items():
        cost = F.when(F.col(label) == value, F.lit(float(factor))).otherwise(cost)
    return per.crossJoin(F.broadcast(total)).select(label, "n_class", balanced.alias("balanced"), (balanced * cost).alias("costed"), ((F.col("n_all") - F.col("n_class")) / F.col("n_class")).alias("others_per_one"))


def dense_index(counts: DataFrame, code: str, reserved: int = 1) -> DataFrame:
    """Index of codes by (count descending, code), from `reserved` on, without one task for all.

    Rows are dealt by ranges of (count, code), so that the many codes of one small count lie in many tasks; each
    range ranks its own, and the ranges' sizes, a row a partition, say how many come before.
    """
    # Written once: ranges that are drawn anew for each use wouldn't be the same.
    rows = saved(counts.select(code, "n").repartitionByRange(F.col("n").desc(), F.col(code)).withColumn("_part", F.spark_partition_id()), "vocabulary")
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(F.col("n").desc(), code)))
    ends = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(ends.select("_part", before.alias("_before"))), "_part").select(code, "n", (F.col("_before") + F.col("_in") - 1 + reserved).cast("long").alias("idx"))


def negative_pairs(pos: DataFrame, known: DataFrame, per: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`per` unknown pairs (id_lo, id_hi) for each positive one, all distinct, by hash order.

    Each end of a positive draws about half of its negatives, all positives of an id together: as many hash buckets of
    about eight of the ids of `known` as a quarter more than is wanted takes, so few more pairs are formed than are
    kept. Buckets are four times as large in each further round for ids that fell short, to all ids in the end. For
    ids without an unknown partner left, pairs of other ids are taken in the same way. There are fewer only where no
    unknown pair of ids is left.
    """
    ids = save(known.select(F.explode(F.array("id_lo", "id_hi")).alias("id")).distinct())
    n_ids = max(1, ids.count())
    most = max(1, n_ids // 8)
    buckets, own_ends, owner = most, True, ["own"]
    # Of an odd number either end may draw the greater half.
    half = F.floor((F.lit(per) + F.pmod(F.xxhash64("id_lo", "id_hi"), F.lit(2))) / 2)
    sides = F.array(F.struct(F.col("id_lo").alias("own"), half.alias("wanted")), F.struct(F.col("id_hi").alias("own"), (F.lit(per) - half).alias("wanted")))
    short = save(pos.select(F.inline(sides)).groupBy("own").agg(F.sum("wanted").alias("wanted")).where("wanted > 0"))
    parts: list[DataFrame] = []
    turn = 0
    while True:
        partners = ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        if own_ends:
            draws = F.least(F.ceil(F.col("wanted") * (1.25 * buckets / n_ids)), F.lit(buckets))
            ends = short.select("*", F.col("own").alias("end"), F.explode(F.sequence(F.lit(1).cast("long"), draws.cast("long"))).alias("draw"))
        else:
            ends = short.withColumn("bucket", F.pmod(F.xxhash64(*owner, F.lit(turn)), F.lit(buckets))).join(partners.withColumnRenamed("id", "end"), "bucket").drop("bucket").withColumn("draw", F.lit(1).cast("long"))
        drawn = ends.withColumn("bucket", F.pmod(F.xxhash64(*owner, "end", "draw", F.lit(turn)), F.lit(buckets)))
        met = drawn.join(partners, "bucket").where("end <> id").select(*owner, "wanted", F.least("end", "id").alias("id_lo"), F.greatest("end", "id").alias("id_hi"))
        for seen in (known, *parts):
            met = met.join(seen.select("id_lo", "id_hi"), ["id_lo", "id_hi"], "left_anti")
        # A pair goes to one of the ids that drew it, and each of these takes what it wants; the hash isn't shuffled.
        h = F.xxhash64(*owner, "id_lo", "id_hi")
        first = met.groupBy("id_lo", "id_hi").agg(F.min(F.struct(h.alias("h"), *owner, "wanted")).alias("o"))
        place = F.row_number().over(Window.partitionBy(*owner).orderBy("h", "id_lo", "id_hi"))
        got = save(first.select("id_lo", "id_hi", *(f"o.{c}" for c in (*owner, "wanted"))).repartition(*owner).withColumn("h", h).withColumn("place", place).where("place <= wanted").select("id_lo", "id_hi", *owner))
        added = got.groupBy(*owner).agg(F.count(F.lit(1)).alias("n"))
        short = save(short.join(added, owner, "left").select(*owner, (F.col("wanted") - F.coalesce("n", F.lit(0))).alias("wanted")).where("wanted > 0"))
        parts.append(got)
        exhausted = buckets == 1 and got.isEmpty()
        if short.isEmpty() or (exhausted and not own_ends):
            return reduce(DataFrame.unionByName, parts).select("id_lo", "id_hi")
        buckets, own_ends, turn = most if exhausted else max(1, buckets // 4), own_ends and not exhausted, turn + 1


def multihot(events: DataFrame, vocab: DataFrame, code: str, id_: str = "patient_id") -> DataFrame:
    """Distinct (id, idx) of events; codes outside the vocabulary are index 0."""
    return events.join(vocab.select(code, "idx"), code, "left").select(id_, F.coalesce("idx", F.lit(0)).cast("long").alias("idx")).distinct()


def dataset_stats(coo: DataFrame, size: DataFrame, id_: str = "patient_id") -> DataFrame:
    """Rows, non-zeros, density, share of rows with an unknown code; `size` is one row with n_columns."""
    per = coo.groupBy(id_).agg(F.count(F.lit(1)).alias("nnz"), F.count_if(F.col("idx") == 0).alias("oov"))
    return per.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("nnz").alias("nnz"), F.avg((F.col("oov") > 0).cast("double")).alias("oov_rate")).crossJoin(F.broadcast(size)).select("n_rows", "nnz", F.try_divide(F.col("nnz"), F.col("n_rows") * F.col("n_columns")).alias("density"), "oov_rate")


def encode_history(events: DataFrame, vocab: DataFrame, code: str, place: str, most: float, id_: str = "patient_id") -> DataFrame:
    """One row per id for scoring: columns (ascending), known and unknown codes, and a scaled count of places.

    Codes outside the vocabulary share column 0; `most` is the greatest count of places in training, so a scaled count
    may lie above 1. An id without a known code has column 0 alone. Events without a code count for places only.
    """
    coded = events.select(id_, code, place).join(vocab.select(code, "idx"), code, "left")
    known = F.col(code).isNotNull()
    got = coded.groupBy(id_).agg(
        F.array_sort(F.collect_set(F.when(known, F.coalesce("idx", F.lit(0)).cast("long")))).alias("columns"), F.countDistinct(F.when(F.col("idx").isNotNull(), F.col(code))).alias("n_known"),
        F.countDistinct(F.when(known & F.col("idx").isNull(), F.col(code))).alias("n_unknown"), F.countDistinct(place).alias("n_places"),
    )
    return got.select(id_, "columns", "n_known", "n_unknown", (F.col("n_places") / float(most)).alias("places"))
