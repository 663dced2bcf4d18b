"""Queries for history reads, previews, subsets and views of the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import atc_level
from ..operators import ingest as ing
from ..operators import intervals as iv
from ..operators import rules as ru
from ..operators import sampling as sp
from ..sources import files
from ..streaming import jobs
from .binding import DEMO, MEDS, RX, demographics, rx, rx_meds, table
from .registry import query
from .storage import event_stream

WITH = f"WITH {RX}"


@query("history_full_window", f"{WITH} SELECT patient_id, bill_no, line_no, drug_id, institution_id, start_date, total_days FROM rx WHERE start_date BETWEEN DATE '1999-03-31' - 90 AND DATE '1999-03-31'", dates=("start_date",))
def _(spark, sf):
    """The window of the whole cohort, without an id set."""
    return files.history(rx(spark, sf), "1999-03-31", 91).select("patient_id", "bill_no", "line_no", "drug_id", "institution_id", "start_date", "total_days")


@query("event_projection", f"{WITH} SELECT CAST(patient_id AS VARCHAR) AS patient_id, CASE WHEN drug_id % 5 = 0 THEN CAST(institution_id AS VARCHAR) ELSE CAST(drug_id AS VARCHAR) END AS drug_code, start_date AS prescription_date, count(*) AS n FROM rx WHERE drug_id % 19 <> 0 GROUP BY ALL", dates=("prescription_date",))
def _(spark, sf):
    """Events from texts: trimmed codes, the second code where the first is blank, readable dates only."""
    day = F.when(F.col("drug_id") % 19 == 0, "2024-13-01").otherwise(F.date_format("start_date", "yyyyMMdd"))
    first = F.when(F.col("drug_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("drug_id").cast("string"), F.lit(" ")))
    text = rx(spark, sf).select(F.concat(F.lit(" "), F.col("patient_id").cast("string")).alias("patient_id"), first.alias("code"), F.col("institution_id").cast("string").alias("other"), day.alias("day"))
    return ing.event_projection(text, "patient_id", ("code", "other"), "day").groupBy("patient_id", "drug_code", "prescription_date").agg(F.count(F.lit(1)).alias("n"))


@query("table_preview", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY 1, 2, 3 LIMIT 25 OFFSET 100")
def _(spark, sf):
    """The fifth page of 25 rows of a table in the order of its keys."""
    return files.preview(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"], 25, 100)


@query("distinct_values", "SELECT DISTINCT l_returnflag AS value FROM lineitem ORDER BY 1 LIMIT 50")
def _(spark, sf):
    return files.distinct_values(table(spark, sf, "lineitem"), "l_returnflag", 50)


@query("subset_demographics", f"{WITH}, {DEMO} SELECT DISTINCT patient_id, age, sex_type, region FROM demo WHERE region < 5 AND patient_id IN (SELECT patient_id FROM rx WHERE start_date <= DATE '1999-06-30' AND end_date >= DATE '1999-06-01')")
def _(spark, sf):
    """The demographics that go with a subset export: those of its patients, once each."""
    people = demographics(spark, sf)
    lines = files.subset(rx(spark, sf), "1999-06-01", "1999-06-30", people.where("region < 5"))
    return people.join(lines.select("patient_id").distinct(), "patient_id", "left_semi").select("patient_id", "age", "sex_type", "region").distinct()


@query("split_80_20", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY sha256(doc_id || '|42'), doc_id) AS n, count(*) OVER (PARTITION BY toxic) AS a FROM labels) SELECT doc_id, toxic, CASE WHEN n <= floor(0.8::DOUBLE * a + 1e-9) THEN 'train' ELSE 'val' END AS split FROM r")
def _(spark, sf):
    return sp.split(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id", (0.8, 0.2), ("train", "val"))


@query("switch_or_dup_atc", f"""WITH {RX}, {MEDS}, o AS (SELECT a.patient_id, substr(a.med_atc, 1, 4) = substr(b.med_atc, 1, 4) AS same_class, date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1 AS d
  FROM rxm a JOIN rxm b ON a.patient_id = b.patient_id AND a.drug_id < b.drug_id AND a.start_date <= b.end_date AND b.start_date <= a.end_date)
  SELECT CASE WHEN d BETWEEN 1 AND 6 THEN 'switch' WHEN d >= 30 AND same_class THEN 'duplicate' ELSE 'overlap' END AS kind, CAST(count(*) AS BIGINT) AS n, count(DISTINCT patient_id) AS n_patients FROM o GROUP BY 1""")
def _(spark, sf):
    """Switch or duplicate by the third level of the medicines' codes."""
    lines = rx_meds(spark, sf).withColumn("atc3", atc_level(F.col("med_atc"), 3))
    o = iv.overlaps(lines, min_days=1, carry=("atc3",))
    kind = ru.switch_or_duplicate(F.col("overlap_days"), F.col("atc3_a") == F.col("atc3_b"))
    return o.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"))


@query("stream_sliding", "WITH w AS (SELECT date_trunc('hour', ts) - to_hours(CAST(h AS BIGINT)) AS s, CAST((event_id * 7) % 10 < 3 AS DOUBLE) AS d FROM events, range(24) r(h)) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, CAST(count(*) AS BIGINT) AS n, avg(d) AS disagree_rate FROM w GROUP BY 1")
def _(spark, sf):
    """The rolling day, an hour apart, as a stream."""
    got = jobs.run(jobs.windows(event_stream(spark, sf), "24 hours", "1 hour"), "sliding", "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "disagree_rate")
