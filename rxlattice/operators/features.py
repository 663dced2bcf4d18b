"""Patient features: counts, duplicates, risk flags, temporal shape, co-prescription graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.normalize import atc_level
from ..tables import spread

# Ingredient keywords and ATC prefixes of the risk groups.
HIGH_RISK = (
    ["warfarin", "methotrexate", "lithium", "digoxin", "amiodarone", "phenytoin", "cyclosporine", "tacrolimus", "sirolimus", "theophylline", "insulin", "clozapine", "carbamazepine", "valproate", "phenobarbital"],
    ["B01AA03", "L01BA01", "N05AN01", "C01AA05", "C01BD01", "N03AB02", "L04AD01", "L04AD02", "L04AA18", "R03DA04"],
)
RENAL_RISK = (
    ["ibuprofen", "naproxen", "diclofenac", "celecoxib", "ketorolac", "indomethacin", "meloxicam", "piroxicam", "gentamicin", "tobramycin", "amikacin", "vancomycin", "lithium", "cisplatin", "acyclovir", "tenofovir", "cyclosporine", "tacrolimus"],
    ["M01A", "N05AN01", "J01GB", "L04AD"],
)
HEPATIC_RISK = (
    ["methotrexate", "valproate", "valproic", "isoniazid", "amiodarone", "phenytoin", "carbamazepine", "ketoconazole", "itraconazole", "acetaminophen", "paracetamol"],
    ["L01BA01", "N03AG01", "J04AC01", "C01BD01", "N03AB02"],
)
K_SPARING = ["spironolactone", "eplerenone", "amiloride", "triamterene", "canrenone", "finerenone"]
NSAID = [
    "ibuprofen", "dexibuprofen", "naproxen", "diclofenac", "aceclofenac", "celecoxib", "etoricoxib", "meloxicam", "lornoxicam", "piroxicam", "tenoxicam", "ketoprofen", "dexketoprofen", "loxoprofen",
    "zaltoprofen", "flurbiprofen", "etodolac", "nabumetone", "sulindac", "indomethacin", "mefenamic", "talniflumate", "morniflumate", "nimesulide", "ketorolac", "pelubiprofen", "polmacoxib", "fenbufen",
]


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words; one pattern, so that long lists stay one expression."""
    return c.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def starts_any(c: Column, prefixes: list[str]) -> Column:
    return c.rlike(f"^(?:{'|'.join(map(re.escape, prefixes))})") if prefixes else F.lit(False)


def in_group(name: Column, atc: Column, group: tuple[list[str], list[str]]) -> Column:
    """Whether a drug is in a risk group, by a keyword in its name or an ATC prefix."""
    return contains_any(F.lower(F.coalesce(name, F.lit(""))), group[0]) | starts_any(F.coalesce(atc, F.lit("")), group[1])


def risk_flags(rx: DataFrame, keys: list[str]) -> DataFrame:
    name, atc = F.col("product_name"), F.col("atc_code")
    return rx.groupBy(*keys).agg(*(F.bool_or(in_group(name, atc, g)).alias(n) for n, g in (("high_risk", HIGH_RISK), ("renal_risk", RENAL_RISK), ("hepatic_risk", HEPATIC_RISK))))


def component_flags(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The risk flags by components' names alone (column component), for sources without product names or codes."""
    c = F.lower("component")
    return parts.groupBy(*keys).agg(*(F.bool_or(contains_any(c, g[0])).alias(n) for n, g in (("high_risk", HIGH_RISK), ("renal_risk", RENAL_RISK), ("hepatic_risk", HEPATIC_RISK))))


def whammy_classes(component: Column) -> tuple[Column, Column, Column]:
    """(ACE inhibitor or ARB, potassium-sparing diuretic, NSAID) by the component's name."""
    c = F.lower(component)
    return c.rlike(r"pril(\s|$)") | c.contains("sartan"), contains_any(c, K_SPARING), contains_any(c, NSAID)


def triple_whammy(parts: DataFrame, keys: list[str]) -> DataFrame:
    """All three classes among a group's components (column component)."""
    a, k, n = whammy_classes(F.col("component"))
    return parts.groupBy(*keys).agg(F.bool_or(a).alias("acei_arb"), F.bool_or(k).alias("k_sparing"), F.bool_or(n).alias("nsaid")).withColumn("triple_whammy", F.col("acei_arb") & F.col("k_sparing") & F.col("nsaid"))


def duplicate_counts(rx: DataFrame, keys: list[str], column: str | Column, name: str) -> DataFrame:
    """How many values of `column` stand in two or more lines of a group."""
    value = F.col(column) if isinstance(column, str) else column
    lines = rx.groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return lines.groupBy(*keys).agg(F.count_if((F.col("_n") >= 2) & F.col("_v").isNotNull()).alias(name))


def duplicate_atc(rx: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicates at ATC levels 5, 4 and 3, in one pass by grouping sets over the prefixes.

    Lines are shuffled once, by `keys`, and counted per full code first, so the sets are built from few rows.
    """
    codes = spread(rx.where("atc_code is not null").select(*keys, "atc_code"), *keys).groupBy(*keys, "atc_code").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), atc_level(F.col("atc_code"), k).alias("prefix")) for k in (5, 4, 3))))
    sums = codes.select(*keys, "n", levels.alias("l")).groupBy(*keys, "l.level", "l.prefix").agg(F.sum("n").alias("n"))
    return sums.groupBy(*keys).agg(*(F.count_if((F.col("level") == k) & (F.col("n") >= 2)).alias(f"dup_atc{k}") for k in (5, 4, 3)))


def distinct_class_duplicates(rx: DataFrame, keys: list[str], cls: str = "class_no", drug: str = "drug_id") -> DataFrame:
    """Classes with two or more distinct drugs, and the most distinct drugs of one class."""
    per = rx.where(F.col(cls).isNotNull() & (F.trim(cls) != "")).groupBy(*keys, cls).agg(F.countDistinct(drug).alias("n"))
    return per.groupBy(*keys).agg(F.count_if(F.col("n") >= 2).alias("dup_classes"), F.max("n").alias("max_per_class"))


def temporal_features(rx: DataFrame, split_day: int = 44) -> DataFrame:
    """Shape of a patient's time: early and late drugs, new drugs, institutions' entropy, durations.

    The lines are shuffled once, by patient; the windows and the one aggregate work where they then are.
    """
    person, drug, place = (Window.partitionBy("patient_id", *more) for more in ((), ("drug_id",), ("institution_id",)))
    here = F.col("institution_id").isNotNull()
    rows = spread(rx.select("patient_id", "drug_id", "institution_id", "start_date", "total_days"), "patient_id").withColumn("_late", F.datediff("start_date", F.min("start_date").over(person)) > split_day).withColumn("_all", F.count_if(here).over(person))
    rows = rows.withColumns({"_in_late": F.bool_or("_late").over(drug), "_in_early": F.bool_or(~F.col("_late")).over(drug), "_drug": F.row_number().over(drug.orderBy("start_date")) == 1})
    rows = rows.withColumns({"_share": F.count(F.lit(1)).over(place) / F.col("_all"), "_place": (F.row_number().over(place.orderBy("start_date")) == 1) & here})
    got = rows.groupBy("patient_id").agg(
        F.count_if(F.col("_drug") & F.col("_in_early")).alias("early_drugs"), F.count_if(F.col("_drug") & F.col("_in_late")).alias("late_drugs"), F.count_if(F.col("_drug") & F.col("_in_late") & ~F.col("_in_early")).alias("new_drugs"),
        F.coalesce(F.sum(F.when(F.col("_place"), -F.col("_share") * F.log2("_share"))), F.lit(0.0)).alias("institution_entropy"), F.coalesce(F.max(F.when(F.col("_place"), F.col("_share"))), F.lit(0.0)).alias("max_share"),
        F.count(F.lit(1)).alias("n_lines"), F.avg("total_days").alias("mean_days"), F.count_if(F.col("total_days") >= 30).alias("long_lines"),
    )
    return got.withColumn("drug_trend", F.col("late_drugs") - F.col("early_drugs")).withColumn("long_ratio", F.col("long_lines") / F.col("n_lines"))


def coprescription_edges(rx: DataFrame) -> DataFrame:
    """Drugs that a patient gets on one day: count of each pair and weight log1p(n) / max."""
    days = rx.select("patient_id", "start_date", "drug_id").distinct()
    pairs = days.withColumnRenamed("drug_id", "drug_a").join(days.withColumnRenamed("drug_id", "drug_b"), ["patient_id", "start_date"]).where("drug_a < drug_b")
    edges = pairs.groupBy("drug_a", "drug_b").agg(F.count(F.lit(1)).alias("n"))
    most = edges.agg(F.max(F.log1p("n")).alias("m"))
    return edges.crossJoin(F.broadcast(most)).select("drug_a", "drug_b", "n", (F.log1p("n") / F.col("m")).alias("weight"))


def node_features(rx: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each drug log1p of its degree and of its line count; drugs without an edge have degree 0."""
    ends = edges.select(F.explode(F.array("drug_a", "drug_b")).alias("drug_id")).groupBy("drug_id").agg(F.count(F.lit(1)).alias("degree"))
    lines = rx.groupBy("drug_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.join(ends, "drug_id", "left").select("drug_id", F.log1p(F.coalesce("degree", F.lit(0))).alias("log_degree"), F.log1p("n_lines").alias("log_frequency"))


def graph_quality(nodes: DataFrame) -> DataFrame:
    degree = F.expm1("log_degree")
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg((F.col("log_degree") == 0).cast("double")).alias("isolated_ratio"), F.avg(degree).alias("mean_degree"))


def robust_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median and interquartile range (0 counts as 1) of each column, exact, in one pass."""
    aggs = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [q[1].alias(f"{c}_median"), F.when(q[2] - q[0] == 0, 1.0).otherwise(q[2] - q[0]).alias(f"{c}_iqr")]
    return df.agg(*aggs)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their median over their range; nulls count as the median."""
    stats = robust_stats(df, columns)
    scaled = [((F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median")) - F.col(f"{c}_median")) / F.col(f"{c}_iqr")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.crossJoin(F.broadcast(stats)).select(*scaled)


def robust_unscale(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    back = [(F.col(c) * F.col(f"{c}_iqr") + F.col(f"{c}_median")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.crossJoin(F.broadcast(stats)).select(*back)


def feature_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample variance of each column and Pearson's r of each pair, long, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)), *(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    facts = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(f"v{i}").alias("value")) for i, c in enumerate(columns)]
    facts += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("value")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*facts)))


def select_features(df: DataFrame, columns: list[str], protected: tuple[str, ...] = (), limit: float = 0.95) -> list[str]:
    """Columns that vary and aren't near copies of an earlier one; protected ones stay.

    The statistics are one row over the number of columns squared; the greedy pass over them is local.
    """
    facts = {(r["a"], r["b"]): r["value"] for r in feature_correlations(df, columns).collect()}
    kept: list[str] = []
    for c in columns:
        if c in protected:
            kept.append(c)
        elif (facts[c, c] or 0) > 0 and all(abs(facts.get((k, c)) or 0) <= limit for k in kept):
            kept.append(c)
    return kept


def numeric_columns(df: DataFrame, leave: tuple[str, ...] = ()) -> list[str]:
    """Columns that a scaler or selector works on: the numeric ones but for ids and labels."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in leave]


def apply_selection(df: DataFrame, kept: list[str], metadata: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Metadata columns that exist, then the selected features; a feature that is missing raises."""
    if gone := [c for c in kept if c not in df.columns]:
        raise ValueError(f"missing features: {', '.join(gone)}")
    return df.select(*(c for c in metadata if c in df.columns), *kept)
