"""From raw claim tables to drug records: header lookups, code fallbacks, strict dates, windows of months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import with_interval


def filled(*columns: str) -> Column:
    """The first of several texts that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns))


def header_facts(headers: DataFrame) -> DataFrame:
    """claim, patient_id, institution_id, start_text, main_diag of each claim; of repeated headers the least."""
    facts = F.min(F.struct("patient_id", "institution_id", "start_text", "main_diag")).alias("h")
    return headers.where("claim is not null").groupBy("claim").agg(facts).select("claim", "h.*")


def first_diagnosis(diagnoses: DataFrame) -> DataFrame:
    """claim, first_diag: the diagnosis line of least place (columns claim, place, code)."""
    return diagnoses.where(F.trim("code") != "").groupBy("claim").agg(F.min_by("code", F.struct("place", "code")).alias("first_diag"))


def inpatient_records(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Records of treatment lines (claim, line, code, days): patient, institution and start come from the header.

    Lines without a header, a readable start or a code drop.
    """
    joined = lines.join(header_facts(headers), "claim")
    return with_interval(joined, codes=("code",)).select("claim", "line", "patient_id", "institution_id", "drug_code", "start_date", "end_date", "total_days", F.col("main_diag").alias("diag_code"))


def outpatient_records(lines: DataFrame, headers: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Records of outpatient lines (claim, line, generic_code, revised_code, days).

    The generic code comes first, the revised one where it is blank; the diagnosis is the header's, else the
    claim's first one.
    """
    joined = lines.join(header_facts(headers), "claim").join(first_diagnosis(diagnoses), "claim", "left")
    rows = with_interval(joined, codes=("generic_code", "revised_code"))
    return rows.select("claim", "line", "patient_id", "institution_id", "drug_code", "start_date", "end_date", "total_days", filled("main_diag", "first_diag").alias("diag_code"))


def strict_records(rows: DataFrame) -> DataFrame:
    """Records written as text read again: a bad start raises, a missing end is derived from the days."""
    bad = F.raise_error(F.concat(F.lit("not a date: "), F.coalesce("start_text", F.lit("null")))).cast("date")
    start = F.coalesce(F.expr("cast(try_to_timestamp(start_text, 'yyyyMMdd') as date)"), bad)
    end = F.expr("cast(try_to_timestamp(end_text, 'yyyyMMdd') as date)")
    days = F.greatest(F.lit(1), F.coalesce(F.col("total_days"), F.lit(1)))
    got = rows.withColumn("start_date", start).withColumn("end_date", end)
    return got.withColumn("end_date", F.when(F.col("end_date") >= F.col("start_date"), F.col("end_date")).otherwise(F.date_add("start_date", days - 1))).drop("start_text", "end_text")


def buffered(months: list[str], before: int, after: int) -> tuple[dt.date, dt.date]:
    """First and last day of some months (yyyymm) with so many months added before and after."""
    if not months:
        raise ValueError("no month")
    number = [int(m[:4]) * 12 + int(m[4:6]) - 1 for m in months]

    def first(n: int) -> dt.date:
        return dt.date(n // 12, n % 12 + 1, 1)

    return first(min(number) - before), first(max(number) + after + 1) - dt.timedelta(1)


def by_config(df: DataFrame, config: dict[str, list], wanted: dict[str, str]) -> DataFrame:
    """Rows whose columns have values listed in the configuration (`wanted`: column to key); unknown keys raise."""
    if gone := sorted(set(wanted.values()) - set(config)):
        raise KeyError(f"not in the configuration: {', '.join(gone)}")
    for column, key in wanted.items():
        df = df.where(F.col(column).isin(*config[key]))
    return df


def ordered(history: DataFrame, *keys: str) -> DataFrame:
    """Each row's place in its patient's history under a total order, in `place`."""
    return history.withColumn("place", F.row_number().over(Window.partitionBy("patient_id").orderBy(*keys)))


def check_lookback(days: int, fitted: int | None = None) -> int:
    """A lookback of 7 to 1825 days, equal to the one that a model was fitted with."""
    if not 7 <= days <= 1825:
        raise ValueError(f"a lookback of {days} days isn't within 7..1825")
    if fitted is not None and fitted != days:
        raise ValueError(f"the model was fitted with a lookback of {fitted} days, not {days}")
    return days


def event_projection(text: DataFrame, id_: str, codes: tuple[str, ...], day: str) -> DataFrame:
    """patient_id, drug_code, prescription_date from texts: trimmed, the first code that isn't blank, yyyyMMdd dates.

    Rows with a blank id, no code or a date that can't be read drop; `history_contract` counts them.
    """
    code = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in codes))
    date = F.to_date(F.try_to_timestamp(F.trim(day), F.lit("yyyyMMdd")))
    got = text.select(F.nullif(F.trim(F.col(id_).cast("string")), F.lit("")).alias("patient_id"), code.alias("drug_code"), date.alias("prescription_date"))
    return got.where("patient_id is not null and drug_code is not null and prescription_date is not null")
