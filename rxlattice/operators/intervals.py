"""Interval operators over drug lines (closed day intervals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import spread

#: Days of a time bucket; a line lies in every bucket that it touches.
BUCKET_DAYS = 90
_EPOCH = "1970-01-01"


def overlap_days(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Days that two closed intervals share; 0 if none."""
    return F.greatest(F.lit(0), F.datediff(F.least(end_a, end_b), F.greatest(start_a, start_b)) + 1)


def with_interval(lines: DataFrame, start: str = "start_text", days: str = "days", codes: tuple[str, ...] = ("code",)) -> DataFrame:
    """Line to interval: strict yyyyMMdd start, at least one day, first code that isn't blank; others drop."""
    code = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in codes))
    total = F.greatest(F.lit(1), F.coalesce(F.expr(f"try_cast({days} as int)"), F.lit(1)))
    out = lines.withColumn("start_date", F.expr(f"cast(try_to_timestamp({start}, 'yyyyMMdd') as date)")).withColumn("total_days", total)
    out = out.withColumn("end_date", F.date_add("start_date", F.col("total_days") - 1)).withColumn("drug_code", code)
    return out.where("start_date is not null and drug_code is not null")


def repair_end(rx: DataFrame) -> DataFrame:
    """A missing end, or one before the start, is rebuilt from total_days."""
    bad = F.col("end_date").isNull() | (F.col("end_date") < F.col("start_date"))
    return rx.withColumn("end_date", F.when(bad, F.date_add("start_date", F.col("total_days") - 1)).otherwise(F.col("end_date")))


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit(_EPOCH).cast("date")) / width).cast("int")


def overlaps(rx: DataFrame, min_days: int = 7, carry: tuple[str, ...] = (), width: int = BUCKET_DAYS) -> DataFrame:
    """Every occurrence of two drugs of a patient that overlap by `min_days` or more.

    The equi key is (patient, time bucket): a line is copied to each bucket it touches and a pair counts in
    the bucket of the later start only. A patient with a long history is thus many small groups, and the
    residual condition sees lines of about the same time. `carry`: columns kept for both sides, as c_a, c_b.
    """
    cols = list(dict.fromkeys(["patient_id", "drug_id", "start_date", "end_date", *carry]))
    buckets = F.explode(F.sequence(_bucket(F.col("start_date"), width), _bucket(F.col("end_date"), width)))
    base = rx.where("end_date >= start_date").select(*cols, buckets.alias("bucket"))
    a = base.select("patient_id", "bucket", *(F.col(c).alias(f"{c}_a") for c in cols[1:]))
    b = base.select("patient_id", "bucket", *(F.col(c).alias(f"{c}_b") for c in cols[1:]))
    start, end = F.greatest("start_date_a", "start_date_b"), F.least("end_date_a", "end_date_b")
    joined = a.join(b, ["patient_id", "bucket"]).where((F.col("drug_id_a") < F.col("drug_id_b")) & (F.datediff(end, start) + 1 >= min_days) & (_bucket(start, width) == F.col("bucket")))
    kept = [f"{c}_{s}" for c in carry for s in "ab"]
    return joined.select("patient_id", F.col("drug_id_a").alias("drug_a"), F.col("drug_id_b").alias("drug_b"), start.alias("overlap_start"), end.alias("overlap_end"), (F.datediff(end, start) + 1).alias("overlap_days"), *kept)


def overlap_pairs(occurrences: DataFrame) -> DataFrame:
    """One row per patient and unordered pair of drugs."""
    return occurrences.groupBy("patient_id", "drug_a", "drug_b").agg(F.count(F.lit(1)).alias("n_occurrences"), F.max("overlap_days").alias("max_overlap_days"), F.min("overlap_start").alias("first_overlap"))


def first_overlap(occurrences: DataFrame) -> DataFrame:
    """The first occurrence of each pair: least (start, end); a total order over what is put out."""
    first = F.min(F.struct("overlap_start", "overlap_end")).alias("f")
    return occurrences.groupBy("patient_id", "drug_a", "drug_b").agg(first).select("patient_id", "drug_a", "drug_b", F.col("f.overlap_start").alias("overlap_start"), F.col("f.overlap_end").alias("overlap_end"))


def touching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Patients with a row of `a` and a row of `b` that share a day (columns start_date, end_date)."""
    left, right = a.select("patient_id", F.col("start_date").alias("s1"), F.col("end_date").alias("e1")), b.select("patient_id", F.col("start_date").alias("s2"), F.col("end_date").alias("e2"))
    return left.join(right, "patient_id").where("s1 <= e2 and s2 <= e1").select("patient_id").distinct()


def active_on(rx: DataFrame, day: str) -> DataFrame:
    """Lines (not distinct drugs) active on a day, per patient."""
    on = F.lit(day).cast("date")
    return rx.groupBy("patient_id").agg(F.count_if((F.col("start_date") <= on) & (on <= F.col("end_date"))).alias("active_lines"))


def max_concurrent(rx: DataFrame) -> DataFrame:
    """Most lines of a patient on one day: +1 at a start, -1 after an end, summed over days.

    Events are added up per patient and day first, so the running sum sees one row a day.
    """
    events = rx.select("patient_id", F.explode(F.array(F.struct(F.col("start_date").alias("day"), F.lit(1).alias("d")), F.struct(F.date_add("end_date", 1).alias("day"), F.lit(-1).alias("d")))).alias("e"))
    daily = events.groupBy("patient_id", F.col("e.day").alias("day")).agg(F.sum("e.d").alias("d"))
    running = F.sum("d").over(Window.partitionBy("patient_id").orderBy("day"))
    return daily.withColumn("n", running).groupBy("patient_id").agg(F.max("n").alias("max_concurrent"))


def concurrency(rx: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """max_concurrent, avg_concurrent and days of each patient: lines active on a day, weighted by time.

    Lines are clipped to the window since..until (closed), and its days without a line count as 0. Without a window
    it is the patient's own, from the first start to the last end. A sweep over starts and the days after ends gives
    the number of lines between two events; each counts with the days that it lasts. Patients without a line in the
    window have no row; a missing end is an open one in a window and else ends with its start.
    """
    low, high = (F.lit(d).cast("date") if d else None for d in (since, until))
    end = F.coalesce("end_date", high if high is not None else F.col("start_date"))
    start = F.greatest("start_date", low) if low is not None else F.col("start_date")
    end = F.least(end, high) if high is not None else end
    clipped = rx.select("patient_id", start.alias("s"), end.alias("e")).where("s <= e")
    events = clipped.select("patient_id", F.explode(F.array(F.struct(F.col("s").alias("day"), F.lit(1).alias("d")), F.struct(F.date_add("e", 1).alias("day"), F.lit(-1).alias("d")))).alias("v"))
    daily = events.groupBy("patient_id", F.col("v.day").alias("day")).agg(F.sum("v.d").alias("d"))
    w = Window.partitionBy("patient_id").orderBy("day")
    steps = daily.select("patient_id", "day", F.sum("d").over(w).alias("n"), F.lead("day").over(w).alias("next"))
    got = steps.groupBy("patient_id").agg(F.max("n").alias("max_concurrent"), F.sum(F.col("n") * F.coalesce(F.datediff("next", "day"), F.lit(0))).alias("line_days"), F.min("day").alias("first"), F.max("day").alias("after"))
    first, after = low if low is not None else F.col("first"), F.date_add(high, 1) if high is not None else F.col("after")
    days = F.datediff(after, first).cast("long")
    return got.select("patient_id", "max_concurrent", (F.col("line_days") / days).alias("avg_concurrent"), days.alias("days"))


def observation_window(rx: DataFrame, days: int = 90) -> DataFrame:
    """First start and last end of a patient, the end no later than `days` after the start."""
    got = rx.groupBy("patient_id").agg(F.min("start_date").alias("window_start"), F.max("end_date").alias("last_end"))
    return got.select("patient_id", "window_start", F.least("last_end", F.date_add("window_start", days - 1)).alias("window_end"))


def covered_days(rx: DataFrame, keys: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Adherence: supplied days, covered days (merged intervals), span, MPR and PDC."""
    rx = spread(rx.select(*keys, "start_date", "end_date", "total_days"), *keys)
    w = Window.partitionBy(*keys).orderBy("start_date", "end_date")
    before = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_date") > before), F.datediff("end_date", "start_date") + 1).otherwise(F.greatest(F.lit(0), F.datediff("end_date", before)))
    got = rx.withColumn("new_days", new).groupBy(*keys).agg(F.sum("total_days").alias("supplied"), F.sum("new_days").alias("covered"), (F.datediff(F.max("end_date"), F.min("start_date")) + 1).alias("span"))
    return got.select(*keys, "supplied", "covered", F.col("span").cast("long").alias("span"), (F.col("supplied") / F.col("span")).alias("mpr"), (F.col("covered") / F.col("span")).alias("pdc"))
