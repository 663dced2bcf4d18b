"""Smaller queries: joins, reports and second uses of the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import features as ft
from ..operators import intervals as iv
from ..operators import knowledge as kn
from ..operators import metrics as me
from ..operators import rules as ru
from ..operators import sampling as sp
from ..sources.files import table_kind
from ..tables import saved
from .binding import DEMO, MEDS, OCC, RX, SCORED, demographics, rx, rx_meds, scored, table
from .claims import _FEATURES, _LEVEL, _is, graded
from .evaluation import _CURVE
from .registry import query

WITH = f"WITH {RX}"
OCC_ALL = f"{RX}, {OCC}"


@query("adr_match", f"{WITH}, p(pattern, adr) AS (VALUES ('E1', 'a'), ('K', 'b'), ('N5', 'c'), ('N', 'd')) SELECT adr, CAST(count(*) AS BIGINT) AS n, count(DISTINCT patient_id) AS n_patients FROM rx JOIN p ON starts_with(diag_code, pattern) GROUP BY 1")
def _(spark, sf):
    patterns = F.broadcast(spark.createDataFrame([("E1", "a"), ("K", "b"), ("N5", "c"), ("N", "d")], "pattern string, adr string"))
    return rx(spark, sf).join(patterns, F.col("diag_code").startswith(F.col("pattern"))).groupBy("adr").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"))


@query("feature_merge", f"{WITH}, {DEMO}, a AS (SELECT patient_id, count(DISTINCT drug_id) AS n_drugs FROM rx GROUP BY 1), b AS (SELECT patient_id, count(*) AS n_late FROM rx WHERE start_date >= DATE '2001-01-01' GROUP BY 1) SELECT d.patient_id, coalesce(n_drugs, 0) AS n_drugs, coalesce(n_late, 0) AS n_late, age FROM demo d LEFT JOIN a ON a.patient_id = d.patient_id LEFT JOIN b ON b.patient_id = d.patient_id")
def _(spark, sf):
    r = rx(spark, sf)
    both = r.groupBy("patient_id").agg(F.countDistinct("drug_id").alias("n_drugs"), F.count_if(F.col("start_date") >= "2001-01-01").alias("n_late"))
    return demographics(spark, sf).select("patient_id", "age").join(both, "patient_id", "left").select("patient_id", F.coalesce("n_drugs", F.lit(0)).alias("n_drugs"), F.coalesce("n_late", F.lit(0)).alias("n_late"), "age")


@query("parity_counts", f"{WITH}, m AS (SELECT patient_id, drug_id, CASE WHEN drug_id % 9 <> 0 THEN class_no END AS code FROM rx), n AS (SELECT patient_id, coalesce(code, CAST(drug_id AS VARCHAR)) AS c, bool_or(code IS NOT NULL) AS mapped, count(*) AS n FROM m GROUP BY 1, 2) SELECT patient_id, CAST(count(*) AS BIGINT) AS drug_count, CAST(count(*) FILTER (mapped AND n >= 2) AS BIGINT) AS dup_count FROM n GROUP BY 1")
def _(spark, sf):
    code = F.when(F.col("drug_id") % 9 != 0, F.col("class_no"))
    m = rx(spark, sf).select("patient_id", F.coalesce(code, F.col("drug_id").cast("string")).alias("c"), code.isNotNull().alias("mapped"))
    n = m.groupBy("patient_id", "c").agg(F.bool_or("mapped").alias("mapped"), F.count(F.lit(1)).alias("n"))
    return n.groupBy("patient_id").agg(F.count(F.lit(1)).alias("drug_count"), F.count_if(F.col("mapped") & (F.col("n") >= 2)).alias("dup_count"))


@query("strict_days", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_partkey % 3 WHEN 0 THEN 1 ELSE greatest(1, CAST(l_quantity AS INT)) END AS INT) AS days FROM lineitem")
def _(spark, sf):
    raw = F.when(F.col("l_partkey") % 3 == 0, F.lit(" ")).when(F.col("l_partkey") % 3 == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0"))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nz.strict_days(raw).alias("days"))


@query("component_repair", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN len(string_split(p_name, ' ')) ELSE 1 END AS INT) AS n FROM part")
def _(spark, sf):
    words = F.split("p_name", " ")
    first = F.array(F.element_at(words, 1))
    known = F.when(F.col("p_partkey") % 2 == 0, words).otherwise(first)
    return table(spark, sf, "part").select("p_partkey", F.size(nz.repaired_components(first, words, known)).alias("n"))


@query("code_cells", "SELECT p_partkey, upper(replace(p_brand, '#', '')) || ',' || upper(split_part(p_type, ' ', 1)) AS codes FROM part")
def _(spark, sf):
    cell = F.concat(F.regexp_replace("p_brand", "#", "."), F.lit("; "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("*,"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(",", nz.code_list(cell)).alias("codes"))


@query("claim_left_join", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(count(o_orderkey) AS BIGINT) AS n_matched FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    heads = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "n", F.when(F.col("o_orderkey").isNotNull(), F.col("n")).otherwise(0).alias("n_matched"))


@query("institution_attach", f"{WITH} SELECT CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (s_name IS NULL) AS BIGINT) AS n_unmatched FROM rx LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON s_suppkey = institution_id")
def _(spark, sf):
    places = table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").selectExpr("s_suppkey as institution_id", "s_name")
    return rx(spark, sf).select("institution_id").join(places, "institution_id", "left").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("s_name").isNull()).alias("n_unmatched"))


@query("touching_pairs", f"{WITH} SELECT DISTINCT a.patient_id FROM rx a JOIN rx b ON a.patient_id = b.patient_id AND a.atc_code LIKE 'E%' AND b.atc_code LIKE 'L%' AND a.start_date <= b.end_date AND b.start_date <= a.end_date")
def _(spark, sf):
    r = rx(spark, sf).select("patient_id", "start_date", "end_date", "atc_code")
    return iv.touching(r.where(F.col("atc_code").startswith("E")), r.where(F.col("atc_code").startswith("L")))


@query("unmapped_drugs", f"{WITH} SELECT drug_id, CAST(count(*) AS BIGINT) AS n FROM rx WHERE drug_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 1")
def _(spark, sf):
    known = table(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("drug_id"))
    return rx(spark, sf).groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")).join(known, "drug_id", "left_anti")


@query("five_buckets", _FEATURES + _LEVEL + ", b AS (SELECT count(*) AS n, count(*) FILTER (risk_level = 'Red') AS r, count(*) FILTER (yellow_subtype = 'Y_DDI_MAJOR') AS c, count(*) FILTER (yellow_subtype = 'Y_TRIPLE') AS t, count(*) FILTER (risk_level = 'Yellow' AND yellow_subtype NOT IN ('Y_DDI_MAJOR', 'Y_TRIPLE')) AS m FROM typed) SELECT CAST(r AS BIGINT) AS immediate, CAST(c AS BIGINT) AS calls, CAST(t AS BIGINT) AS messages, CAST(m AS BIGINT) AS monitored, CAST(greatest(0, n - r - c - t - m) AS BIGINT) AS rest FROM b")
def _(spark, sf):
    sub, level = F.col("yellow_subtype"), F.col("risk_level")
    b = graded(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(level == "Red").alias("immediate"), F.count_if(sub == "Y_DDI_MAJOR").alias("calls"), F.count_if(sub == "Y_TRIPLE").alias("messages"), F.count_if((level == "Yellow") & ~sub.isin("Y_DDI_MAJOR", "Y_TRIPLE")).alias("monitored"))
    return b.select("immediate", "calls", "messages", "monitored", F.greatest(F.lit(0), F.expr("n - immediate - calls - messages - monitored")).cast("long").alias("rest"))


@query("patient_dedup", _FEATURES + _LEVEL + ", p AS (SELECT CASE WHEN patient_id % 50 = 0 THEN NULL ELSE patient_id END AS pid, bucket, patient_id AS k, risk_level FROM typed), n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY bucket DESC) AS n FROM p) SELECT pid, k, bucket, risk_level FROM n WHERE pid IS NULL OR n = 1")
def _(spark, sf):
    p = graded(spark, sf).select(F.when(F.col("patient_id") % 50 != 0, F.col("patient_id")).alias("pid"), F.col("patient_id").alias("k"), "bucket", "risk_level")
    return kn.first_by(p.where("pid is not null"), ["pid"], [F.col("bucket").desc()]).unionByName(p.where("pid is null"))


@query("chart_histograms", f"{WITH}, {DEMO}, d AS (SELECT patient_id, count(DISTINCT drug_id) AS n FROM rx GROUP BY 1) SELECT 'drugs' AS chart, CAST(n // 10 * 10 AS BIGINT) AS low, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 2 UNION ALL SELECT 'age', CAST(age // 10 * 10 AS BIGINT), count(*) FROM demo GROUP BY 2")
def _(spark, sf):
    d = rx(spark, sf).groupBy("patient_id").agg(F.countDistinct("drug_id").alias("v")).select(F.lit("drugs").alias("chart"), F.expr("v div 10 * 10").alias("low"))
    a = demographics(spark, sf).select(F.lit("age").alias("chart"), F.expr("age div 10 * 10").cast("long").alias("low"))
    return d.unionByName(a).groupBy("chart", "low").agg(F.count(F.lit(1)).alias("n"))


@query("last_trend", "WITH d AS (SELECT event_type, CAST(ts::DATE AS VARCHAR) AS day, avg(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS n FROM d) SELECT event_type, day, v FROM n WHERE n <= 5")
def _(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("v"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))).where("n <= 5").drop("n")


@query("first_ids", f"{WITH} SELECT DISTINCT patient_id FROM rx WHERE start_date >= DATE '1998-03-01' ORDER BY patient_id LIMIT 50")
def _(spark, sf):
    return rx(spark, sf).where("start_date >= date '1998-03-01'").select("patient_id").distinct().orderBy("patient_id").limit(50)


@query("stage2_sample", _FEATURES + _LEVEL + ", s AS (SELECT patient_id, bucket, CASE WHEN risk_level = 'Yellow' THEN yellow_subtype ELSE risk_level END AS cls, patient_id || '-' || bucket AS id FROM typed WHERE risk_level <> 'Red' AND coalesce(yellow_subtype, '') <> 'Y_OTHER'), n AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY sha256(id || '|42'), id) AS n FROM s) SELECT id, cls FROM n WHERE n <= 20")
def _(spark, sf):
    s = graded(spark, sf).where("risk_level <> 'Red' and coalesce(yellow_subtype, '') <> 'Y_OTHER'").select(F.concat_ws("-", "patient_id", "bucket").alias("id"), ru.stage2_label(F.col("risk_level"), F.col("yellow_subtype")).alias("cls"))
    quotas = spark.createDataFrame([(c, 20) for c in ("Y_DDI_MAJOR", "Y_TRIPLE", "Y_DOUBLE", "Y_DDI_MOD", "Y_DUP", "Y_FRAG", "Green", "Normal")], "cls string, quota int")
    return sp.quota_sample(saved(s, "stage2"), quotas, ["cls"], "id").select("id", "cls")


@query("class_pairs", f"{WITH}, c AS (SELECT class_no, row_number() OVER (ORDER BY class_no) + 1 AS idx FROM (SELECT DISTINCT class_no FROM rx WHERE start_date < DATE '1995-03-01')) SELECT DISTINCT patient_id, CASE WHEN drug_id % 11 = 0 THEN 1 ELSE coalesce(idx, 0) END AS idx FROM rx LEFT JOIN c USING (class_no)")
def _(spark, sf):
    """Classes as indexes: 1 where a line has none, 0 for one that the vocabulary of the first weeks doesn't know."""
    r = rx(spark, sf)
    known = r.where("start_date < date '1995-03-01'").select("class_no").distinct().select("class_no", (F.row_number().over(Window.orderBy("class_no")) + 1).alias("idx"))
    lines = r.join(known, "class_no", "left")
    return lines.select("patient_id", F.when(F.col("drug_id") % 11 == 0, 1).otherwise(F.coalesce("idx", F.lit(0))).cast("long").alias("idx")).distinct()


@query("history_contract", f"{WITH} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (drug_id % 19 = 0) AS BIGINT) AS n_bad_dates FROM rx")
def _(spark, sf):
    text = F.when(F.col("drug_id") % 19 == 0, "2024-13-01").otherwise(F.date_format("start_date", "yyyyMMdd"))
    parsed = rx(spark, sf).select(text.alias("t")).select(F.expr("try_to_timestamp(t, 'yyyyMMdd')").alias("d"))
    return parsed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("d").isNull()).alias("n_bad_dates"))


@query("sample_summary", "WITH t(toxic, target) AS (VALUES (0, 0.85::DOUBLE), (1, 0.15::DOUBLE)), s AS (SELECT toxic, count(*)::DOUBLE / (SELECT count(*) FROM labels) AS share FROM labels GROUP BY 1) SELECT toxic, share, target, abs(share - target) <= 0.08 AS ok FROM s JOIN t USING (toxic)")
def _(spark, sf):
    target = spark.createDataFrame([(0, 0.85), (1, 0.15)], "toxic int, target double")
    n = table(spark, sf, "labels").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    share = n.select("toxic", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
    return share.join(F.broadcast(target), "toxic").withColumn("ok", F.abs(F.col("share") - F.col("target")) <= 0.08)


@query("deploy_gate", _CURVE + ", c AS (SELECT count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 1) AS p FROM scored), a AS (SELECT sum(n_pos * (neg - fp + n_neg / 2.0))::DOUBLE / (max(pos) * max(neg)) AS roc_auc FROM curve) SELECT tp::DOUBLE / p AS recall, roc_auc, tp::DOUBLE / p >= 0.9 AND roc_auc >= 0.85 AS passed FROM c, a")
def _(spark, sf):
    """A model is let through with a recall of 0.9 and an AUC of 0.85."""
    s = scored(spark, sf)
    both = me.confusion(s).select("recall").crossJoin(me.roc_auc(s))
    return both.withColumn("passed", (F.col("recall") >= 0.9) & (F.col("roc_auc") >= 0.85))


@query("table_kinds", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'line' WHEN c_custkey % 3 = 1 THEN 'header' ELSE 'unknown' END AS kind, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x_T30_"), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("t20_"), "c_name")).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select(table_kind(name).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("label_audit", f"{WITH}, l AS (SELECT patient_id, max(CAST(diag_code LIKE 'K9%' AS INT)) AS label, count(DISTINCT diag_code) AS n_codes FROM rx GROUP BY 1) SELECT label, CAST(count(*) AS BIGINT) AS n, avg(n_codes) AS mean_codes FROM l GROUP BY 1")
def _(spark, sf):
    l = rx(spark, sf).groupBy("patient_id").agg(F.max(F.col("diag_code").startswith("K9").cast("int")).alias("label"), F.countDistinct("diag_code").alias("n_codes"))
    return l.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("n_codes").alias("mean_codes"))


@query("request_risk_flags", f"WITH {RX}, {MEDS} SELECT patient_id, count(DISTINCT drug_id) AS n_drugs, CAST(count(*) FILTER ({_is(ft.HIGH_RISK)}) AS BIGINT) AS n_high, CAST(count(*) FILTER ({_is(ft.RENAL_RISK)}) AS BIGINT) AS n_renal, CAST(count(*) FILTER ({_is(ft.HEPATIC_RISK)}) AS BIGINT) AS n_hepatic FROM rxm GROUP BY 1")
def _(spark, sf):
    flags = (F.count_if(f"{k}_risk").alias(f"n_{k}") for k in ("high", "renal", "hepatic"))
    return rx_meds(spark, sf).groupBy("patient_id").agg(F.countDistinct("drug_id").alias("n_drugs"), *flags)


@query("feature_drugs", f"WITH {OCC_ALL} SELECT patient_id, count(DISTINCT c) AS n_codes FROM (SELECT patient_id, atc_a AS c FROM occ UNION ALL SELECT patient_id, atc_b FROM occ) GROUP BY 1")
def _(spark, sf):
    """ATC codes of the drugs that a patient takes together with another one."""
    pairs = iv.overlaps(rx(spark, sf), carry=("atc_code",))
    codes = pairs.select("patient_id", F.explode(F.array("atc_code_a", "atc_code_b")).alias("c")).distinct()
    return codes.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_codes"))
