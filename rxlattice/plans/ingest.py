"""Queries from raw tables to records, and of training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import ingest as ing
from ..operators import knowledge as kn
from ..operators import quality as qu
from ..operators import sampling as sp
from ..sources import files
from ..sources.extract import partition_values
from ..tables import folder
from .binding import RX, rx, table
from .registry import query

WITH = f"WITH {RX}"

#: Raw headers: some dates can't be read, some have no main diagnosis. Diagnosis lines: three a claim, the first blank for some.
_HEADS = """heads AS (SELECT o_orderkey AS claim, o_custkey AS patient_id, o_orderkey % 97 AS institution_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'M' || (o_orderkey % 40) END AS main_diag FROM orders),
  firsts AS (SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 2 = 0 THEN 'E' || (o_orderkey % 11) ELSE 'D' || (o_orderkey % 7) END AS first_diag FROM orders)"""


def _heads(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey as claim", "o_custkey as patient_id", "o_orderkey % 97 as institution_id", "case when o_orderkey % 29 = 0 then '2021-13-40' else date_format(o_orderdate, 'yyyyMMdd') end as start_text", "case when o_orderkey % 5 = 0 then ' ' else concat('M', o_orderkey % 40) end as main_diag")


def _diagnoses(spark, sf):
    lines = "array(struct(1 as place, if(o_orderkey % 2 = 0, ' ', concat('D', o_orderkey % 7)) as code), struct(3 as place, 'Z9' as code), struct(2 as place, concat('E', o_orderkey % 11) as code))"
    return table(spark, sf, "orders").selectExpr("o_orderkey as claim", f"inline({lines})")


def _lines(spark, sf, status):
    return table(spark, sf, "lineitem").where(F.col("l_linestatus") == status).selectExpr(
        "l_orderkey as claim", "l_linenumber as line", "concat('W', l_partkey) as code", "if(l_partkey % 4 = 0, '  ', concat('G', l_partkey)) as generic_code", "if(l_partkey % 12 = 0, '', concat('R', l_partkey)) as revised_code",
        "if(l_partkey % 3 = 0, 'x', cast(cast(l_quantity as int) - 2 as string)) as days",
    )


_DAYS = "CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE greatest(1, CAST(l_quantity AS INT) - 2) END"


@query("inpatient_records", f"WITH {_HEADS} SELECT l_orderkey AS claim, l_linenumber AS line, patient_id, institution_id, 'W' || l_partkey AS drug_code, start_date, start_date + CAST({_DAYS} AS INT) - 1 AS end_date, CAST({_DAYS} AS INT) AS total_days, coalesce(main_diag, ' ') AS diag_code FROM lineitem JOIN heads ON claim = l_orderkey WHERE l_linestatus = 'F' AND start_date IS NOT NULL", dates=("start_date", "end_date"))
def _(spark, sf):
    return ing.inpatient_records(_lines(spark, sf, "F"), _heads(spark, sf))


@query("outpatient_records", f"WITH {_HEADS} SELECT l_orderkey AS claim, l_linenumber AS line, patient_id, institution_id, CASE WHEN l_partkey % 4 = 0 THEN 'R' ELSE 'G' END || l_partkey AS drug_code, start_date, start_date + CAST({_DAYS} AS INT) - 1 AS end_date, CAST({_DAYS} AS INT) AS total_days, coalesce(main_diag, first_diag) AS diag_code FROM lineitem JOIN heads ON heads.claim = l_orderkey JOIN firsts ON firsts.claim = l_orderkey WHERE l_linestatus = 'O' AND start_date IS NOT NULL AND l_partkey % 12 <> 0", dates=("start_date", "end_date"))
def _(spark, sf):
    return ing.outpatient_records(_lines(spark, sf, "O"), _heads(spark, sf), _diagnoses(spark, sf))


@query("strict_records", f"{WITH} SELECT bill_no, line_no, drug_id, start_date, CASE WHEN drug_id % 3 = 0 THEN start_date + total_days - 1 ELSE end_date END AS end_date FROM rx", dates=("start_date", "end_date"))
def _(spark, sf):
    end = F.when(F.col("drug_id") % 6 == 0, F.lit("")).when(F.col("drug_id") % 3 == 0, F.date_format(F.date_sub("start_date", 3), "yyyyMMdd")).otherwise(F.date_format("end_date", "yyyyMMdd"))
    text = rx(spark, sf).select("bill_no", "line_no", "drug_id", "total_days", F.date_format("start_date", "yyyyMMdd").alias("start_text"), end.alias("end_text"))
    return ing.strict_records(text).drop("total_days")


@query("buffered_window", f"{WITH} SELECT patient_id, CAST(count(*) AS BIGINT) AS n FROM rx WHERE start_date BETWEEN DATE '1997-11-01' AND DATE '1998-05-31' GROUP BY 1")
def _(spark, sf):
    low, high = ing.buffered(["199802", "199804", "199801"], 2, 1)
    return rx(spark, sf).where(F.col("start_date").between(F.lit(low), F.lit(high))).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


_CONFIG = {"urgent": ["1-URGENT", "2-HIGH"], "done": ["F"], "all": ["F", "O", "P"]}


@query("config_filter", "SELECT o_custkey AS patient_id, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' GROUP BY 1")
def _(spark, sf):
    kept = ing.by_config(table(spark, sf, "orders"), _CONFIG, {"o_orderpriority": "urgent", "o_orderstatus": "done"})
    return kept.groupBy(F.col("o_custkey").alias("patient_id")).agg(F.count(F.lit(1)).alias("n"))


@query("institution_year", "SELECT s_suppkey AS institution_id, s_name AS name FROM supplier WHERE 1995 + s_suppkey % 3 = 1996")
def _(spark, sf):
    master = table(spark, sf, "supplier").selectExpr("s_suppkey as institution_id", "s_name as name", "cast(1995 + s_suppkey % 3 as string) as std_yyyy")
    return master.where("std_yyyy = '1996'").drop("std_yyyy")


@query("latest_day", "SELECT CAST(max(ts)::DATE AS VARCHAR) AS day FROM events")
def _(spark, sf):
    """The latest day of a table that is partitioned by day, by the names of its folders."""
    path = folder(spark, "dated")
    files.write_dated(table(spark, sf, "events"), path, "ts")
    return spark.createDataFrame([(partition_values(spark, path, "dt")[-1],)], "day string")


@query("ordered_history", f"{WITH} SELECT patient_id, bill_no, line_no, drug_id, institution_id, total_days, row_number() OVER (PARTITION BY patient_id ORDER BY start_date, drug_id, bill_no, line_no, institution_id, total_days) AS place FROM rx")
def _(spark, sf):
    history = ing.ordered(rx(spark, sf), "start_date", "drug_id", "bill_no", "line_no", "institution_id", "total_days")
    return history.select("patient_id", "bill_no", "line_no", "drug_id", "institution_id", "total_days", F.col("place").cast("long").alias("place"))


# ---- validation of the other raw tables


@query("validate_diagnosis", "WITH d AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'x1' ELSE 'K12' END AS code, CAST(o_orderkey % 4 AS VARCHAR) AS sex, CASE WHEN o_orderkey % 13 = 0 THEN '2021-1-1' ELSE strftime(o_orderdate, '%Y%m%d') END AS day FROM orders) SELECT 'bad_sex' AS rule, CAST(count(*) FILTER (sex NOT IN ('1', '2')) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_rows FROM d UNION ALL SELECT 'bad_date', count(*) FILTER (NOT regexp_full_match(day, '[0-9]{8}')), count(*) FROM d UNION ALL SELECT 'bad_code', count(*) FILTER (code = 'x1'), count(*) FROM d")
def _(spark, sf):
    d = table(spark, sf, "orders").selectExpr("if(o_orderkey % 4 = 0, 'x1', 'K12') as code", "cast(o_orderkey % 4 as string) as sex", "if(o_orderkey % 13 = 0, '2021-1-1', date_format(o_orderdate, 'yyyyMMdd')) as day")
    return qu.long_counts(d, qu.diagnosis_rules("code", "sex", "day"))


@query("validate_outpatient", "WITH d AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity - 2 END AS days, CAST(1 + l_partkey % 2 AS VARCHAR) AS sex, CAST(l_linenumber % 3 AS VARCHAR) AS pay, strftime(l_shipdate, '%Y%m%d') AS day FROM lineitem) SELECT 'days_not_positive' AS rule, CAST(count(*) FILTER (coalesce(days, 0) <= 0) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_rows FROM d UNION ALL SELECT 'bad_date', 0, count(*) FROM d UNION ALL SELECT 'bad_sex', 0, count(*) FROM d UNION ALL SELECT 'bad_payment', count(*) FILTER (pay = '2'), count(*) FROM d")
def _(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("if(l_partkey % 5 = 0, null, l_quantity - 2) as days", "cast(1 + l_partkey % 2 as string) as sex", "cast(l_linenumber % 3 as string) as pay", "date_format(l_shipdate, 'yyyyMMdd') as day")
    return qu.long_counts(d, qu.outpatient_rules("days", "day", "sex", "pay", ["0", "1"]))


@query("validate_institution", "WITH d AS (SELECT CAST(s_nationkey AS VARCHAR) AS kind, CASE WHEN s_suppkey % 3 = 0 THEN '96' ELSE '1996' END AS year FROM supplier) SELECT 'bad_kind' AS rule, CAST(count(*) FILTER (kind NOT IN ('1', '2', '3', '11')) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_rows FROM d UNION ALL SELECT 'bad_year', count(*) FILTER (year = '96'), count(*) FROM d")
def _(spark, sf):
    d = table(spark, sf, "supplier").selectExpr("cast(s_nationkey as string) as kind", "if(s_suppkey % 3 = 0, '96', '1996') as year")
    return qu.long_counts(d, qu.institution_rules("kind", "year", ["1", "2", "3", "11"]))


@query("null_violations", "SELECT 'k' AS column, avg(CAST(o_orderkey % 17 = 0 AS DOUBLE)) AS null_rate FROM orders UNION ALL SELECT 'p', avg(CAST(o_orderkey % 40 = 0 AS DOUBLE)) FROM orders WHERE false GROUP BY ALL HAVING count(*) > 0")
def _(spark, sf):
    """Required columns with more than 5 % of nulls: one of seventeen is too many, one of forty is not."""
    o = table(spark, sf, "orders").selectExpr("if(o_orderkey % 17 = 0, null, o_orderkey) as k", "if(o_orderkey % 40 = 0, null, o_custkey) as p")
    return qu.null_violations(o, ["k", "p"])


@query("cohort_sanity", f"{WITH} SELECT count(DISTINCT patient_id) AS n_ids, 20 AS requested, count(DISTINCT patient_id) >= 20 AS enough FROM rx")
def _(spark, sf):
    return qu.cohort_size(rx(spark, sf), "patient_id", 20)


# ---- training sets

_WEEKS = "w AS (SELECT patient_id, CAST(date_trunc('week', start_date) AS DATE) AS week, count(DISTINCT drug_id) AS n_drugs FROM rx GROUP BY 1, 2)"


@query("training_frame", f"{WITH}, {_WEEKS}, l AS (SELECT DISTINCT week FROM w ORDER BY week DESC LIMIT 8), n AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY week DESC) AS n FROM w WHERE week IN (SELECT week FROM l)) SELECT patient_id, week, n_drugs FROM n WHERE n = 1", dates=("week",))
def _(spark, sf):
    """The last eight weekly partitions, each patient once, with its latest row."""
    weekly = rx(spark, sf).groupBy("patient_id", F.trunc("start_date", "week").alias("week")).agg(F.countDistinct("drug_id").alias("n_drugs"))
    last = weekly.select("week").distinct().orderBy(F.desc("week")).limit(8)
    return kn.first_by(weekly.join(F.broadcast(last), "week", "left_semi"), ["patient_id"], [F.col("week").desc()]).select("patient_id", "week", "n_drugs")


@query("label_sources", f"""{WITH}, c AS (SELECT patient_id, class_no, count(DISTINCT drug_id) AS n FROM rx GROUP BY 1, 2), l AS (SELECT 'institutions' AS source, patient_id, CAST(count(DISTINCT institution_id) >= 30 AS INT) AS label FROM rx GROUP BY 2
  UNION ALL SELECT 'diagnosis', patient_id, max(CAST(diag_code LIKE 'K9%' OR diag_code LIKE 'N1%' AS INT)) FROM rx GROUP BY 2 UNION ALL SELECT 'duplication', patient_id, CAST(count(*) FILTER (n >= 2) >= 12 AS INT) FROM c GROUP BY 2) SELECT source, label, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1, 2""")
def _(spark, sf):
    from ..operators.labels import LABEL_SOURCES, training_labels

    r = rx(spark, sf)
    rows = None
    for source in LABEL_SOURCES:
        part = training_labels(r, source).select(F.lit(source).alias("source"), "label")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


_SET = f"{WITH}, v AS (SELECT drug_id, row_number() OVER (ORDER BY n DESC, drug_id) AS idx FROM (SELECT drug_id, count(*) AS n FROM rx GROUP BY 1)), y AS (SELECT patient_id, CAST(count(DISTINCT institution_id) >= 30 AS INT) AS label FROM rx GROUP BY 1), m AS (SELECT DISTINCT patient_id, idx FROM rx JOIN v USING (drug_id))"


@query("sparse_dataset", _SET + " SELECT patient_id, label, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS columns, CAST(count(*) AS BIGINT) AS nnz FROM m JOIN y USING (patient_id) GROUP BY 1, 2")
def _(spark, sf):
    """The set as it is written, one row a patient with ascending columns, read back from its files."""
    r = rx(spark, sf)
    vocab = sp.dense_index(r.groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")), "drug_id")
    coo = sp.multihot(r, vocab, "drug_id")
    from ..operators.labels import distinct_count_label

    path = folder(spark, "dataset")
    files.write_dataset(coo.withColumn("value", F.lit(1.0)), distinct_count_label(r, "institution_id", 30), path)
    rows = files.read_dataset(spark, path)
    return rows.select("patient_id", "label", F.array_join(F.col("columns").cast("array<string>"), ",").alias("columns"), F.size("columns").cast("long").alias("nnz"))


@query("set_compatibility", f"""{WITH}, a AS (SELECT drug_id, row_number() OVER (ORDER BY n DESC, drug_id) AS idx FROM (SELECT drug_id, count(*) AS n FROM rx WHERE start_date < DATE '1998-01-01' GROUP BY 1)), b AS (SELECT drug_id, row_number() OVER (ORDER BY n DESC, drug_id) AS idx FROM (SELECT drug_id, count(*) AS n FROM rx WHERE start_date >= DATE '1998-01-01' GROUP BY 1))
  SELECT CAST(count(a.idx) AS BIGINT) AS n_first, CAST(count(b.idx) AS BIGINT) AS n_second, CAST(count(*) FILTER (a.idx IS NULL OR b.idx IS NULL) AS BIGINT) AS n_missing, CAST(count(*) FILTER (a.idx <> b.idx) AS BIGINT) AS n_moved, count(*) FILTER (a.idx IS NULL OR b.idx IS NULL OR a.idx <> b.idx) = 0 AS compatible FROM a FULL JOIN b USING (drug_id)""")
def _(spark, sf):
    r = rx(spark, sf)
    halves = [sp.dense_index(r.where(f"start_date {op} date '1998-01-01'").groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")), "drug_id") for op in ("<", ">=")]
    return sp.compatibility(*halves, "drug_id")


@query("selected_features", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem")
def _(spark, sf):
    """Numeric columns are found, a constant and a copy are dropped, the ids stay beside what is kept."""
    ids = ("l_orderkey", "l_linenumber")
    lines = table(spark, sf, "lineitem").select(*ids, "l_quantity", (F.col("l_quantity") * 3).alias("triple"), F.lit(7).alias("constant"), "l_discount", "l_tax", "l_comment" if "l_comment" in table(spark, sf, "lineitem").columns else F.lit("x").alias("l_comment"))
    return ft.apply_selection(lines, ft.select_features(lines, ft.numeric_columns(lines, ids)), ids)
