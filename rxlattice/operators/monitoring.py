"""Drift, performance and alert operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

EPS = 1e-6


def psi_of(j: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of (c - r) * ln(c / r) over shares r and c, both at least EPS."""
    r, c = F.greatest(F.col("r"), F.lit(EPS)), F.greatest(F.col("c"), F.lit(EPS))
    return j.groupBy(*keys).agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def psi_continuous(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """PSI over the reference's quantile bins; edges are made unique, ends are open.

    The edges are one row with an array of at most bins - 1 values, sent to every task.
    """
    probs = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    edges = F.broadcast(reference.agg(F.array_distinct(F.percentile(column, probs)).alias("edges")))
    place = F.size(F.filter("edges", lambda e: e <= F.col(column)))
    both = reference.select(column, F.lit(1).alias("is_ref")).unionByName(current.select(column, F.lit(0).alias("is_ref"))).where(F.col(column).isNotNull())
    counts = both.crossJoin(edges).groupBy(place.alias("bin")).agg(F.sum("is_ref").alias("a"), F.sum(1 - F.col("is_ref")).alias("b"))
    whole = Window.partitionBy()
    return psi_of(counts.select((F.col("a") / F.sum("a").over(whole)).alias("r"), (F.col("b") / F.sum("b").over(whole)).alias("c")), [])


def psi_categorical(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    both = reference.select(column, F.lit(1).alias("is_ref")).unionByName(current.select(column, F.lit(0).alias("is_ref")))
    counts = both.groupBy(column).agg(F.sum("is_ref").alias("a"), F.sum(1 - F.col("is_ref")).alias("b"))
    whole = Window.partitionBy()
    return psi_of(counts.select((F.col("a") / F.sum("a").over(whole)).alias("r"), (F.col("b") / F.sum("b").over(whole)).alias("c")), [])


def psi_status(psi: Column) -> Column:
    return F.when(psi >= 0.2, "drift").when(psi >= 0.1, "watch").otherwise("stable")


def drift_report(reference: DataFrame, current: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """feature, psi, status and whether two or more features have drifted."""
    rows = None
    for kind, columns in ((psi_continuous, continuous), (psi_categorical, categorical)):
        for c in columns:
            part = kind(reference, current, c).select(F.lit(c).alias("feature"), "psi")
            rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("status", psi_status(F.col("psi")))
    return rows.withColumn("retrain", F.sum((F.col("status") == "drift").cast("int")).over(Window.partitionBy()) >= 2)


def column_kinds(reference: DataFrame, columns: list[str], most: int = 20) -> tuple[list[str], list[str]]:
    """(continuous, categorical) columns: numeric ones with more than `most` distinct values are continuous.

    One row with a number for each column comes to the driver.
    """
    numeric = [f.name for f in reference.schema.fields if f.name in columns and isinstance(f.dataType, NumericType)]
    row = reference.agg(*(F.countDistinct(c).alias(c) for c in numeric)).first() if numeric else {}
    continuous = [c for c in columns if c in numeric and row[c] > most]
    return continuous, [c for c in columns if c not in continuous]


def auto_drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """`drift_report` with the kind of each column found from the reference."""
    return drift_report(reference, current, *column_kinds(reference, columns))


def rule_alerts(drift: DataFrame, declining: DataFrame, disagreeing: DataFrame, n_new_rules: DataFrame) -> DataFrame:
    """kind, severity, subject, n of all four rules, unioned.

    drift: a drift report; two drifted features are critical, else a watched one is a warning. declining: subject
    and n of falling series, critical. disagreeing: subject, n, rate; 0.15 is a warning, 0.30 critical.
    n_new_rules: one row with n, information if above 0.
    """
    d = drift.agg(F.count_if(F.col("status") == "drift").alias("bad"), F.count_if(F.col("status") == "watch").alias("watched"))
    severity = F.when(F.col("bad") >= 2, "critical").when((F.col("bad") < 2) & (F.col("watched") > 0), "warning")
    parts = [
        d.select(F.lit("drift").alias("kind"), severity.alias("severity"), F.lit("features").alias("subject"), F.when(F.col("bad") >= 2, F.col("bad")).otherwise(F.col("watched")).alias("n")),
        declining.select(F.lit("decline").alias("kind"), F.lit("critical").alias("severity"), "subject", "n"),
        disagreeing.select(F.lit("disagreement").alias("kind"), F.when(F.col("rate") >= 0.30, "critical").when(F.col("rate") >= 0.15, "warning").alias("severity"), "subject", "n"),
        n_new_rules.select(F.lit("knowledge").alias("kind"), F.when(F.col("n") > 0, "info").alias("severity"), F.lit("rules").alias("subject"), "n"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("severity is not null")


def subgroups(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Each row once for every subgroup that it is in."""
    tags = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in groups.items())))
    return df.withColumn("subgroup", F.explode(tags))


def subgroup_performance(df: DataFrame, groups: dict[str, Column], threshold: float = 0.5, least: int = 30) -> DataFrame:
    from .metrics import confusion

    got = confusion(subgroups(df, groups), threshold, ("subgroup",)).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return got.where(F.col("n") >= least)


def degradation(current: DataFrame, baseline: DataFrame, metrics: list[str], warning: float = 0.05, critical: float = 0.10) -> DataFrame:
    """Metrics that fell below the baseline's by `warning` or more (columns subgroup and the metrics)."""
    long = [d.unpivot(["subgroup"], metrics, "metric", v) for d, v in ((current.select("subgroup", *metrics), "now"), (baseline.select("subgroup", *metrics), "base"))]
    j = long[0].join(long[1], ["subgroup", "metric"]).withColumn("fall", F.col("base") - F.col("now"))
    return j.withColumn("alert", F.when(F.col("fall") >= critical, "critical").when(F.col("fall") >= warning, "warning").otherwise("none"))


def declines(snapshots: DataFrame, value: str, order: str, keys: list[str]) -> DataFrame:
    """Snapshots whose value is the last of three that fell strictly."""
    w = Window.partitionBy(*keys).orderBy(order)
    return snapshots.withColumn("v1", F.lag(value, 1).over(w)).withColumn("v2", F.lag(value, 2).over(w)).where((F.col(value) < F.col("v1")) & (F.col("v1") < F.col("v2"))).drop("v1", "v2")


def latency_histogram(df: DataFrame, column: str, bounds: list[float], keys: list[str]) -> DataFrame:
    """Cumulated counts at or below each upper bound."""
    le = F.explode(F.array(*(F.lit(float(b)) for b in bounds)))
    return df.select(*keys, column, le.alias("le")).groupBy(*keys, "le").agg(F.count_if(F.col(column) <= F.col("le")).alias("n"))


def disagreement(log: DataFrame, keys: list[Column]) -> DataFrame:
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("disagree").cast("double")).alias("disagree_rate"))
