"""Validation and data quality: one aggregate over the table, one row per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_bad, n_rows) for each named condition, from a single pass."""
    names = list(rules)
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)))
    return row.select("n_rows", F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("n_bad")) for i, n in enumerate(names))))).select("rule", "n_bad", "n_rows")


def header_rules(key: str, patient: str, day: str, status: str, allowed: list[str]) -> dict[str, Column]:
    return {
        "key_missing": F.col(key).isNull(),
        "patient_missing": F.col(patient).isNull(),
        "bad_date": ~F.coalesce(F.col(day), F.lit("")).rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"),
        "bad_status": ~F.coalesce(F.col(status), F.lit("")).isin(*allowed),
    }


def line_rules(code: str, second: str, days: str, amount: str) -> dict[str, Column]:
    return {"no_code": F.col(code).isNull() & F.col(second).isNull(), "days_not_positive": F.col(days) <= 0, "amount_negative": F.col(amount) < 0, "days_too_long": F.col(days) > 365}


def _outside(column: str, allowed: list[str]) -> Column:
    return ~F.coalesce(F.col(column), F.lit("")).isin(*allowed)


def _bad_day(column: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit("")).rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$")


def diagnosis_rules(code: str, sex: str, day: str) -> dict[str, Column]:
    return {"bad_sex": _outside(sex, ["1", "2"]), "bad_date": _bad_day(day), "bad_code": ~F.coalesce(F.col(code), F.lit("A00")).rlike(r"^[A-Z]\d{2}")}


def outpatient_rules(days: str, day: str, sex: str, payment: str, payments: list[str]) -> dict[str, Column]:
    return {"days_not_positive": F.coalesce(F.col(days), F.lit(0)) <= 0, "bad_date": _bad_day(day), "bad_sex": _outside(sex, ["1", "2"]), "bad_payment": _outside(payment, payments)}


def institution_rules(kind: str, year: str, kinds: list[str]) -> dict[str, Column]:
    return {"bad_kind": _outside(kind, kinds), "bad_year": ~F.coalesce(F.col(year), F.lit("0000")).rlike(r"^\d{4}$")}


def null_violations(df: DataFrame, required: list[str], most: float = 0.05) -> DataFrame:
    """Required columns with a larger share of nulls than `most`."""
    return null_rates(df, required).where(F.col("null_rate") > most)


def cohort_size(df: DataFrame, id_: str, requested: int) -> DataFrame:
    """Whether a sample has as many distinct ids as were asked for."""
    return df.agg(F.countDistinct(id_).alias("n_ids"), F.lit(requested).alias("requested")).withColumn("enough", F.col("n_ids") >= F.col("requested"))


def validity(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations (a row may count twice) and rows with any, with the pass rule of 0.95."""
    bad = F.lit(0)
    for c in rules.values():
        bad = bad + F.coalesce(c, F.lit(False)).cast("int")
    got = df.select(bad.alias("bad")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bad").alias("n_violations"), F.count_if(F.col("bad") > 0).alias("n_bad_rows"))
    rate = F.when(F.col("n_rows") == 0, 0.0).otherwise(1 - F.col("n_violations") / F.col("n_rows"))
    return got.withColumn("valid_rate", rate).withColumn("passed", rate >= 0.95)


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_rate")) for i, c in enumerate(columns)))))


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, and their share."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    got = per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    return got.select("n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_surplus"), ((F.col("n_rows") - F.col("n_keys")) / F.col("n_rows")).alias("duplicate_rate"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require(df: DataFrame, required: list[str]) -> DataFrame:
    if gone := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df
