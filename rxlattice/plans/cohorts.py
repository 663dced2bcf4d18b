"""Queries for cohorts, labels, samples and datasets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.normalize import age_band, sex_value
from ..operators import knowledge as kn
from ..operators import labels as lb
from ..operators import sampling as sp
from .binding import DEMO, MEDS, RX, SCORED, demographics, rx, rx_meds, scored, table
from .claims import _FEATURES, _LEVEL, graded
from .registry import query

WITH = f"WITH {RX}"
_ADR_ROWS = ", ".join(f"('{k}', '{p}', {w})" for k, (ps, w, _) in lb.ADR.items() for p in ps)
_ADR_DRUGS = ", ".join(f"('{k}', '{p}')" for k, (_, _, ps) in lb.ADR.items() for p in ps)


@query("adr_label", f"""WITH {RX}, {MEDS}, g AS (SELECT *, date_diff('day', min(start_date) OVER (PARTITION BY patient_id), start_date) AS days FROM rx), p(adr, pattern, weight) AS (VALUES {_ADR_ROWS}), r(adr, prefix) AS (VALUES {_ADR_DRUGS}),
  f AS (SELECT patient_id, adr, max(weight) AS w, min(days) AS d FROM g JOIN p ON starts_with(diag_code, pattern) WHERE days BETWEEN 0 AND 90 GROUP BY 1, 2), h AS (SELECT DISTINCT patient_id, adr FROM rxm JOIN r ON starts_with(med_atc, prefix))
  SELECT patient_id, CAST(count(*) AS BIGINT) AS n_reactions, CAST(sum(w) AS DOUBLE) AS adr_score, CAST(min(d) AS INT) AS first_days, CASE WHEN bool_and(h.adr IS NOT NULL) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, string_agg(f.adr, ',' ORDER BY f.adr) AS reactions FROM f LEFT JOIN h USING (patient_id, adr) GROUP BY 1""")
def _(spark, sf):
    r = rx_meds(spark, sf)
    firsts = r.groupBy("patient_id").agg(F.min("start_date").alias("t0"))
    diagnoses = r.join(firsts, "patient_id").select("patient_id", F.col("diag_code").alias("code"), F.datediff("start_date", "t0").alias("days"))
    got = lb.adr_labels(diagnoses, r.select("patient_id", F.col("med_atc").alias("atc_code")))
    return got.select("patient_id", "n_reactions", "adr_score", "first_days", "confidence", F.concat_ws(",", "reactions").alias("reactions"))


@query("sick_code_label", f"{WITH} SELECT patient_id, CAST(max(CAST(diag_code LIKE 'K9%' OR diag_code LIKE 'N1%' AS INT)) AS INT) AS label FROM rx GROUP BY 1")
def _(spark, sf):
    return rx(spark, sf).groupBy("patient_id").agg(F.max((F.col("diag_code").startswith("K9") | F.col("diag_code").startswith("N1")).cast("int")).alias("label"))


@query("multi_institution", f"{WITH} SELECT patient_id, count(DISTINCT institution_id) AS n, CAST(count(DISTINCT institution_id) >= 30 AS INT) AS label FROM rx GROUP BY 1")
def _(spark, sf):
    return lb.distinct_count_label(rx(spark, sf), "institution_id", 30)


@query("therapeutic_dup_label", f"{WITH}, n AS (SELECT patient_id, class_no, count(DISTINCT drug_id) AS n FROM rx GROUP BY 1, 2) SELECT patient_id, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS dup_classes, CAST(count(*) FILTER (n >= 2) >= 12 AS INT) AS label FROM n GROUP BY 1")
def _(spark, sf):
    from ..operators.features import distinct_class_duplicates

    return distinct_class_duplicates(rx(spark, sf), ["patient_id"]).select("patient_id", "dup_classes", (F.col("dup_classes") >= 12).cast("int").alias("label"))


_DUP = f"{WITH}, c AS (SELECT patient_id, class_no, count(DISTINCT drug_id) AS n FROM rx GROUP BY 1, 2), p AS (SELECT patient_id, count(*) FILTER (n >= 2) AS n, max(n) AS m FROM c GROUP BY 1)"


@query("dup_audit", _DUP + " SELECT CAST(count(*) AS BIGINT) AS n_patients, CAST(count(*) FILTER (n = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (n = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (n = 2) AS BIGINT) AS n2, CAST(count(*) FILTER (n >= 3) AS BIGINT) AS n3, quantile_cont(m, 0.5)::DOUBLE AS p50, quantile_cont(m, 0.95)::DOUBLE AS p95 FROM p")
def _(spark, sf):
    from ..operators.features import distinct_class_duplicates

    d = distinct_class_duplicates(rx(spark, sf), ["patient_id"])
    n, q = F.col("dup_classes"), F.percentile("max_per_class", F.array(F.lit(0.5), F.lit(0.95)))
    return d.agg(F.count(F.lit(1)).alias("n_patients"), *(F.count_if(n == k).alias(f"n{k}") for k in (0, 1, 2)), F.count_if(n >= 3).alias("n3"), q[0].alias("p50"), q[1].alias("p95"))


@query("threshold_sweep", f"{WITH}, n AS (SELECT patient_id, count(DISTINCT institution_id) AS n FROM rx GROUP BY 1) SELECT t AS threshold, CAST(count(*) FILTER (n >= t) AS BIGINT) AS n_positive, CAST(count(*) AS BIGINT) AS n_all, count(*) FILTER (n >= t)::DOUBLE / count(*) AS rate FROM n, (VALUES (10), (20), (30), (40), (50)) v(t) GROUP BY 1")
def _(spark, sf):
    n = rx(spark, sf).groupBy("patient_id").agg(F.countDistinct("institution_id").alias("n"))
    return lb.threshold_sweep(n, [10, 20, 30, 40, 50])


@query("percentiles", f"{WITH}, n AS (SELECT patient_id, count(DISTINCT institution_id) AS n FROM rx GROUP BY 1) SELECT quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.95)::DOUBLE AS p95, quantile_cont(n, 0.99)::DOUBLE AS p99, max(n)::DOUBLE AS most FROM n")
def _(spark, sf):
    return lb.percentiles(rx(spark, sf).groupBy("patient_id").agg(F.countDistinct("institution_id").alias("n")), "n")


@query("institution_audit", f"{WITH}, n AS (SELECT patient_id, count(DISTINCT institution_id) AS n, count(*) FILTER (institution_id IS NULL) AS z FROM rx GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n_patients, avg(n) AS mean_n, CAST(max(n) AS BIGINT) AS most, CAST(sum(z) AS BIGINT) AS n_blank FROM n")
def _(spark, sf):
    n = rx(spark, sf).groupBy("patient_id").agg(F.countDistinct("institution_id").alias("n"), F.count_if(F.col("institution_id").isNull()).alias("z"))
    return n.agg(F.count(F.lit(1)).alias("n_patients"), F.avg("n").alias("mean_n"), F.max("n").alias("most"), F.sum("z").alias("n_blank"))


_ONSET = f"""{WITH}, w AS (SELECT *, date_diff('day', DATE '1998-06-30', start_date) AS ago FROM rx), n AS (SELECT patient_id, count(DISTINCT institution_id) FILTER (ago <= 0) AS n_feature, count(DISTINCT institution_id) FILTER (ago > 0) AS n_outcome, count(*) FILTER (ago > 0) AS a, count(*) FILTER (ago <= 0) AS b FROM w WHERE ago BETWEEN -179 AND 180 GROUP BY 1),
  o AS (SELECT patient_id, n_feature, n_outcome, CASE WHEN a > 0 THEN CAST(n_outcome >= 3 AS INT) END AS label, CASE WHEN a = 0 THEN 'censored' WHEN n_feature >= 3 AND n_outcome >= 3 THEN 'persistent' WHEN n_outcome >= 3 THEN 'onset' WHEN n_feature >= 3 THEN 'resolved' ELSE 'none' END AS kind, CASE WHEN a > 0 THEN CAST(n_outcome > n_feature AS INT) END AS escalation FROM n WHERE b > 0)"""


@query("future_onset", _ONSET + " SELECT * FROM o")
def _(spark, sf):
    return lb.future_onset(rx(spark, sf), "1998-06-30", 180, 180)


@query("onset_audit", _ONSET + " SELECT kind, CAST(count(*) AS BIGINT) AS n, avg(n_feature) AS mean_feature, avg(n_outcome) AS mean_outcome FROM o GROUP BY 1")
def _(spark, sf):
    o = lb.future_onset(rx(spark, sf), "1998-06-30", 180, 180)
    return o.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("n_feature").alias("mean_feature"), F.avg("n_outcome").alias("mean_outcome"))


@query("elderly_cohort", f"{WITH}, {DEMO}, i AS (SELECT DISTINCT patient_id FROM rx WHERE diag_code LIKE 'K0%' OR diag_code LIKE 'E11%') SELECT d.patient_id, age, i.patient_id IS NOT NULL AS by_diagnosis FROM demo d LEFT JOIN i ON i.patient_id = d.patient_id WHERE age >= 65 OR i.patient_id IS NOT NULL")
def _(spark, sf):
    return lb.elderly_cohort(demographics(spark, sf), rx(spark, sf).select("patient_id", F.col("diag_code").alias("code")), ["K0", "E11"])


_DEATHS = "d AS (SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 3 = 0 THEN DATE '2020-01-01' + CAST(c_custkey % 700 AS INT) END AS a, CASE WHEN c_custkey % 4 = 0 THEN DATE '2020-06-01' + CAST(c_custkey % 300 AS INT) END AS b FROM customer), x AS (SELECT patient_id, least(a, b) AS death_date FROM d)"


def _deaths(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey as patient_id", "case when c_custkey % 3 = 0 then date_format(date_add(date '2020-01-01', cast(c_custkey % 700 as int)), 'yyyyMMdd') else 'none' end as d1", "case when c_custkey % 4 = 0 then date_format(date_add(date '2020-06-01', cast(c_custkey % 300 as int)), 'yyyyMMdd') end as d2",
    )
    return c.select("patient_id", lb.earliest_date("d1", "d2").alias("death_date"))


@query("death_dates", f"WITH {_DEATHS} SELECT patient_id, death_date FROM x", dates=("death_date",))
def _(spark, sf):
    return _deaths(spark, sf)


@query("exclude_deceased", f"WITH {_DEATHS} SELECT patient_id FROM x WHERE death_date IS NULL OR death_date > DATE '2020-12-31'")
def _(spark, sf):
    people = demographics(spark, sf).select("patient_id")
    return lb.death_exclusion(people, _deaths(spark, sf), "2020-12-31")


@query("polypharmacy_cohort", f"{WITH} SELECT patient_id, count(DISTINCT drug_id) AS n_drugs FROM rx WHERE start_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' GROUP BY 1 HAVING count(DISTINCT drug_id) >= 5")
def _(spark, sf):
    return rx(spark, sf).where("start_date between date '1998-01-01' and date '1998-06-30'").groupBy("patient_id").agg(F.countDistinct("drug_id").alias("n_drugs")).where("n_drugs >= 5")


@query("icd_prefix_patients", f"{WITH} SELECT DISTINCT patient_id FROM rx WHERE diag_code LIKE 'K1%' OR diag_code LIKE 'R5%'")
def _(spark, sf):
    return rx(spark, sf).where(F.col("diag_code").startswith("K1") | F.col("diag_code").startswith("R5")).select("patient_id").distinct()


_CHARLSON = ", ".join(f"('{c}', '{p}', {w})" for c, (ps, w) in lb.CHARLSON.items() for p in ps)


@query("comorbidity", f"{WITH}, v(c, p, w) AS (VALUES {_CHARLSON}), f AS (SELECT DISTINCT patient_id, c, w FROM rx JOIN v ON starts_with(diag_code, p)) SELECT patient_id, CAST(sum(w) AS BIGINT) AS index, CAST(count(*) AS BIGINT) AS n_categories FROM f GROUP BY 1")
def _(spark, sf):
    return lb.comorbidity(rx(spark, sf).select("patient_id", F.col("diag_code").alias("code")), lb.CHARLSON)


@query("patient_drug_list", f"{WITH} SELECT patient_id, string_agg(DISTINCT CAST(drug_id AS VARCHAR), ',' ORDER BY CAST(drug_id AS VARCHAR)) AS drugs FROM rx GROUP BY 1")
def _(spark, sf):
    taken = rx(spark, sf).select("patient_id", F.col("drug_id").cast("string").alias("drug")).distinct()
    return taken.groupBy("patient_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("drug"))).alias("drugs"))


@query("history_window", f"{WITH} SELECT patient_id, drug_id, start_date, CAST(count(*) AS BIGINT) AS n FROM rx WHERE start_date BETWEEN DATE '1999-03-31' - 90 AND DATE '1999-03-31' AND patient_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2, 3", dates=("start_date",))
def _(spark, sf):
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"))
    return rx(spark, sf).where("start_date between date_sub(date '1999-03-31', 90) and date '1999-03-31'").join(ids, "patient_id", "left_semi").groupBy("patient_id", "drug_id", "start_date").agg(F.count(F.lit(1)).alias("n"))


@query("history_union", f"{WITH} SELECT patient_id, start_date AS event_date, CASE source WHEN 'T30' THEN 'treatment' ELSE 'prescription' END AS kind, CAST(count(*) AS BIGINT) AS n FROM rx GROUP BY 1, 2, 3", dates=("event_date",))
def _(spark, sf):
    r = rx(spark, sf)
    parts = [r.where(F.col("source") == s).select("patient_id", F.col("start_date").alias("event_date"), F.lit(k).alias("kind")) for s, k in (("T30", "treatment"), ("T60", "prescription"))]
    return parts[0].unionByName(parts[1]).groupBy("patient_id", "event_date", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("event_dedup", f"{WITH} SELECT patient_id, drug_id, start_date, min(source) AS source FROM rx GROUP BY 1, 2, 3", dates=("start_date",))
def _(spark, sf):
    return kn.first_by(rx(spark, sf).select("patient_id", "drug_id", "start_date", "source"), ["patient_id", "drug_id", "start_date"], [F.col("source")])


@query("dedup_latest", "SELECT o_custkey AS patient_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_id FROM orders GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("order_id"), "o_orderdate")
    return kn.first_by(o, ["patient_id"], [F.col("o_orderdate").desc(), F.col("order_id").desc()]).select("patient_id", "order_id")


@query("primary_diag_join", f"{WITH}, d AS (SELECT bill_no, arg_min(diag_code, (start_date, drug_id, diag_code)) AS main FROM rx WHERE source = 'T30' GROUP BY 1) SELECT main, CAST(count(*) AS BIGINT) AS n FROM rx LEFT JOIN d USING (bill_no) GROUP BY 1")
def _(spark, sf):
    r = rx(spark, sf)
    main = r.where("source = 'T30'").groupBy("bill_no").agg(F.min_by("diag_code", F.struct("start_date", "drug_id", "diag_code")).alias("main"))
    return r.select("bill_no").join(main, "bill_no", "left").groupBy("main").agg(F.count(F.lit(1)).alias("n"))


@query("institution_join", f"{WITH} SELECT r_name AS region, n_name AS nation, CAST(count(*) AS BIGINT) AS n_lines, count(DISTINCT institution_id) AS n_institutions FROM rx LEFT JOIN supplier ON s_suppkey = institution_id LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def _(spark, sf):
    places = table(spark, sf, "supplier").join(kn.small(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(kn.small(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    lines = rx(spark, sf).groupBy("institution_id").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(places, F.col("s_suppkey") == F.col("institution_id"), "left").groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("n_lines"), F.countDistinct("institution_id").alias("n_institutions"))


# ---- samples and datasets

_BAND = "CASE WHEN age < 20 THEN '0-19' WHEN age < 40 THEN '20-39' WHEN age < 60 THEN '40-59' WHEN age < 75 THEN '60-74' ELSE '75+' END"
_QUOTA = f"""WITH {DEMO}, s AS (SELECT patient_id, sex_type, {_BAND} AS band FROM demo), z AS (SELECT sex_type, band, count(*) AS n FROM s GROUP BY 1, 2), e AS (SELECT *, 300 * n / sum(n) OVER ()::DOUBLE AS x FROM z), f AS (SELECT *, floor(x) AS low, 300 - sum(floor(x)) OVER () AS rest FROM e),
  q AS (SELECT sex_type, band, n, CAST(low + CASE WHEN row_number() OVER (ORDER BY x - low DESC, sex_type, band) <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


def _people(spark, sf):
    return demographics(spark, sf).select("patient_id", "sex_type", age_band(F.col("age")).alias("band"))


@query("quota_alloc", _QUOTA + " SELECT sex_type, band, CAST(n AS BIGINT) AS n, quota FROM q")
def _(spark, sf):
    sizes = _people(spark, sf).groupBy("sex_type", "band").agg(F.count(F.lit(1)).alias("n"))
    return sp.largest_remainder(sizes, ["sex_type", "band"], 300)


_HASH = "sha256(CAST(patient_id AS VARCHAR) || '|42')"


@query("stratified_patients", _QUOTA + f", r AS (SELECT s.*, quota, row_number() OVER (PARTITION BY s.sex_type, s.band ORDER BY {_HASH}, patient_id) AS n FROM s JOIN q ON q.sex_type = s.sex_type AND q.band = s.band) SELECT patient_id, sex_type, band FROM r WHERE n <= quota")
def _(spark, sf):
    return sp.stratified(_people(spark, sf), ["sex_type", "band"], 300, "patient_id").select("patient_id", "sex_type", "band")


@query("quota_sample", f"WITH {DEMO}, r AS (SELECT patient_id, region, row_number() OVER (PARTITION BY region ORDER BY {_HASH}, patient_id) AS n FROM demo) SELECT patient_id, region FROM r WHERE n <= 5")
def _(spark, sf):
    d = demographics(spark, sf).select("patient_id", "region")
    quotas = d.select("region").distinct().withColumn("quota", F.lit(5))
    return sp.quota_sample(d, quotas, ["region"], "patient_id").select("patient_id", "region")


_IDHASH = "sha256(CAST(doc_id AS VARCHAR) || '|42')"


@query("stratified_class", f"""WITH z AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), e AS (SELECT *, 100 * n / sum(n) OVER ()::DOUBLE AS x FROM z), f AS (SELECT *, floor(x) AS low, 100 - sum(floor(x)) OVER () AS rest FROM e), q AS (SELECT quality, toxic, low + CASE WHEN row_number() OVER (ORDER BY x - low DESC, quality, toxic) <= rest THEN 1 ELSE 0 END AS quota FROM f),
  r AS (SELECT l.*, quota, row_number() OVER (PARTITION BY l.quality, l.toxic ORDER BY {_IDHASH}, doc_id) AS n FROM labels l JOIN q ON q.quality = l.quality AND q.toxic = l.toxic) SELECT doc_id, quality, toxic FROM r WHERE n <= quota""")
def _(spark, sf):
    return sp.stratified(table(spark, sf, "labels"), ["quality", "toxic"], 100, "doc_id").select("doc_id", "quality", "toxic")


@query("split_stratified", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_IDHASH}, doc_id) AS n, count(*) OVER (PARTITION BY quality) AS a FROM labels) SELECT doc_id, quality, CASE WHEN n <= floor(0.7::DOUBLE * a + 1e-9) THEN 'train' WHEN n <= floor((0.7::DOUBLE + 0.15::DOUBLE) * a + 1e-9) THEN 'val' ELSE 'test' END AS split FROM r")
def _(spark, sf):
    return sp.split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


#: Share of each level in a golden sample, its size, and the least share of positives within a level.
_GOLDEN = {"Red": 0.30, "Yellow": 0.30, "Green": 0.25, "Normal": 0.15}
_GOLDEN_SIZE, _LEAST_POSITIVE = 200, 0.20
_ADR_HIT = "bucket % 5 = 0 AND patient_id % 3 = 0"


@query("golden_sample", _FEATURES + _LEVEL + f""", p AS (SELECT patient_id || '-' || bucket AS id, risk_level, CAST({_ADR_HIT} AS INT) AS positive FROM typed), q(risk_level, target) AS (VALUES {", ".join(f"('{k}', {int(_GOLDEN_SIZE * v)})" for k, v in _GOLDEN.items())}),
  n AS (SELECT risk_level, count(*) FILTER (positive = 1) AS np, count(*) FILTER (positive = 0) AS nn FROM p GROUP BY 1), k AS (SELECT risk_level, target, least(np, target, greatest(CAST(floor(target * {_LEAST_POSITIVE}) AS BIGINT), target - nn)) AS want1 FROM n JOIN q USING (risk_level)),
  ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.risk_level, positive ORDER BY sha256(id || '|42'), id) AS place FROM p) SELECT id, risk_level, positive FROM ranked JOIN k USING (risk_level) WHERE place <= CASE positive WHEN 1 THEN want1 ELSE target - want1 END""")
def _(spark, sf):
    """Levels in fixed shares, in each level at least a fifth with a reaction where there are so many."""
    p = graded(spark, sf).select(F.concat_ws("-", "patient_id", "bucket").alias("id"), "risk_level", F.expr(_ADR_HIT).cast("int").alias("positive"))
    return sp.golden(p, "risk_level", "positive", _GOLDEN, _GOLDEN_SIZE, _LEAST_POSITIVE, "id")


@query("patient_disjoint", f"{WITH} SELECT DISTINCT patient_id FROM rx WHERE start_date >= DATE '2001-06-01' AND patient_id NOT IN (SELECT patient_id FROM rx WHERE start_date < DATE '1995-06-01')")
def _(spark, sf):
    r = rx(spark, sf)
    return sp.disjoint(r.where("start_date >= date '2001-06-01'").select("patient_id").distinct(), r.where("start_date < date '1995-06-01'"))


@query("split_temporal", f"{WITH} SELECT CASE WHEN start_date < DATE '2000-01-01' THEN 'train' WHEN start_date < DATE '2001-01-01' THEN 'val' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n, count(DISTINCT patient_id) AS n_patients FROM rx GROUP BY 1")
def _(spark, sf):
    part = F.when(F.col("start_date") < "2000-01-01", "train").when(F.col("start_date") < "2001-01-01", "val").otherwise("test")
    return rx(spark, sf).groupBy(part.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"))


@query("id_overlap", f"{WITH}, a AS (SELECT DISTINCT patient_id FROM rx WHERE start_date < DATE '1995-04-01'), b AS (SELECT DISTINCT patient_id FROM rx WHERE start_date >= DATE '2001-09-01') SELECT CAST(count(*) FILTER (a.patient_id IS NOT NULL AND b.patient_id IS NOT NULL) AS BIGINT) AS n_both, CAST(count(*) FILTER (b.patient_id IS NULL) AS BIGINT) AS n_only_a, CAST(count(*) FILTER (a.patient_id IS NULL) AS BIGINT) AS n_only_b FROM a FULL JOIN b ON a.patient_id = b.patient_id")
def _(spark, sf):
    r = rx(spark, sf)
    return sp.id_overlap(r.where("start_date < date '1995-04-01'"), r.where("start_date >= date '2001-09-01'"))


@query("class_weights", "WITH p AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS a, count(*) AS k FROM p) SELECT toxic, CAST(n AS BIGINT) AS n_class, a::DOUBLE / (k * n) AS balanced, a::DOUBLE / (k * n) * CASE toxic WHEN 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS costed, (a - n)::DOUBLE / n AS others_per_one FROM p, t")
def _(spark, sf):
    return sp.class_weights(table(spark, sf, "labels"), "toxic", {1: 3.0})


_VOCAB = f"{WITH}, c AS (SELECT drug_id, count(*) AS n FROM rx GROUP BY 1), v AS (SELECT drug_id, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, drug_id) AS idx FROM c)"


def _vocab(spark, sf):
    return sp.dense_index(rx(spark, sf).groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")), "drug_id")


@query("drug_vocab", _VOCAB + " SELECT drug_id, n, idx FROM v")
def _(spark, sf):
    return _vocab(spark, sf)


@query("class_vocab", f"{WITH}, c AS (SELECT DISTINCT class_no FROM rx) SELECT class_no, CAST(row_number() OVER (ORDER BY class_no) + 1 AS BIGINT) AS idx FROM c")
def _(spark, sf):
    classes = rx(spark, sf).select("class_no").distinct()
    return classes.select("class_no", (F.row_number().over(Window.orderBy("class_no")) + 1).cast("long").alias("idx"))


@query("multihot", _VOCAB + " SELECT DISTINCT patient_id, coalesce(idx, 0) AS idx FROM rx LEFT JOIN v USING (drug_id)")
def _(spark, sf):
    return sp.multihot(rx(spark, sf), _vocab(spark, sf), "drug_id")


#: A vocabulary of the lines before a day: codes that come up later are unknown to it.
_OLD = _VOCAB.replace("FROM rx GROUP BY 1)", "FROM rx WHERE start_date < DATE '1997-01-01' GROUP BY 1)")


@query("multihot_temporal", _OLD + " SELECT DISTINCT patient_id, coalesce(idx, 0) AS idx FROM rx LEFT JOIN v USING (drug_id) WHERE start_date >= DATE '1997-01-01'")
def _(spark, sf):
    r = rx(spark, sf)
    old = r.where("start_date < date '1997-01-01'").groupBy("drug_id").agg(F.count(F.lit(1)).alias("n"))
    return sp.multihot(r.where("start_date >= date '1997-01-01'"), sp.dense_index(old, "drug_id"), "drug_id")


@query("dataset_stats", _VOCAB + ", m AS (SELECT DISTINCT patient_id, coalesce(idx, 0) AS idx FROM rx LEFT JOIN v USING (drug_id)), p AS (SELECT patient_id, count(*) AS nnz, count(*) FILTER (idx = 0) AS oov FROM m GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(nnz) AS BIGINT) AS nnz, sum(nnz)::DOUBLE / (count(*) * (SELECT 1 + count(*) FROM v)) AS density, avg(CAST(oov > 0 AS DOUBLE)) AS oov_rate FROM p")
def _(spark, sf):
    vocab = _vocab(spark, sf)
    size = vocab.agg((F.count(F.lit(1)) + 1).alias("n_columns"))
    return sp.dataset_stats(sp.multihot(rx(spark, sf), vocab, "drug_id"), size)


@query("future_dataset", _VOCAB + f""", {DEMO}, z AS (SELECT count(*) AS n_drugs FROM v), k AS (SELECT class_no, row_number() OVER (ORDER BY class_no) + 1 AS idx FROM (SELECT DISTINCT class_no FROM rx)), w AS (SELECT * FROM rx WHERE start_date BETWEEN DATE '1998-01-02' AND DATE '1998-06-30'), i AS (SELECT patient_id, count(DISTINCT institution_id) AS n FROM w GROUP BY 1)
  SELECT DISTINCT patient_id, coalesce(idx, 0) AS col, 1.0::DOUBLE AS value FROM w LEFT JOIN v USING (drug_id) UNION ALL SELECT patient_id, n_drugs + 1, n::DOUBLE / max(n) OVER () FROM i, z UNION ALL SELECT patient_id, n_drugs + 2, age / 100.0::DOUBLE FROM i JOIN demo USING (patient_id), z
  UNION ALL SELECT patient_id, n_drugs + 3, CASE sex_type WHEN '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM i JOIN demo USING (patient_id), z UNION ALL SELECT DISTINCT patient_id, n_drugs + 4 + idx, 1.0::DOUBLE FROM w LEFT JOIN k USING (class_no), z""")
def _(spark, sf):
    """Drugs, scaled institution count, age, sex and classes, one block of columns after the other."""
    r = rx(spark, sf)
    w = r.where("start_date between date '1998-01-02' and date '1998-06-30'")
    vocab = _vocab(spark, sf)
    drugs = sp.multihot(w, vocab, "drug_id").select("patient_id", F.col("idx").alias("col"), F.lit(1.0).alias("value"))
    places = w.groupBy("patient_id").agg(F.countDistinct("institution_id").alias("n"))
    most = places.agg(F.max("n").alias("m"))
    people = places.crossJoin(F.broadcast(most)).join(demographics(spark, sf).select("patient_id", "age", sex_value(F.col("sex_type")).alias("sex")), "patient_id")
    facts = F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("place"), v.cast("double").alias("value")) for k, v in ((1, F.col("n") / F.col("m")), (2, F.col("age") / 100), (3, F.col("sex"))))))
    classes = r.select("class_no").distinct().select("class_no", (F.row_number().over(Window.orderBy("class_no")) + 1).alias("idx"))
    cls = sp.multihot(w, classes, "class_no").select("patient_id", (F.col("idx") + 4).alias("place"), F.lit(1.0).alias("value"))
    size = F.broadcast(vocab.agg(F.count(F.lit(1)).alias("n_drugs")))
    later = people.select("patient_id", facts).unionByName(cls).crossJoin(size).select("patient_id", (F.col("n_drugs") + F.col("place")).alias("col"), "value")
    return drugs.unionByName(later)


@query("vocab_audit", f"{WITH} SELECT drug_id, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT patient_id) AS n_patients, CAST(count(*) FILTER (source = 'T30') AS BIGINT) AS n_t30, CAST(count(*) FILTER (source = 'T60') AS BIGINT) AS n_t60 FROM rx GROUP BY 1")
def _(spark, sf):
    return rx(spark, sf).groupBy("drug_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("patient_id").alias("n_patients"), *(F.count_if(F.col("source") == s).alias(f"n_{s.lower()}") for s in ("T30", "T60")))


@query("vocab_cutoffs", _VOCAB + ", m AS (SELECT patient_id, max(v.n) AS best FROM rx JOIN v USING (drug_id) GROUP BY 1), t(cut) AS (VALUES (20), (30), (40)) SELECT cut, (SELECT CAST(count(*) FILTER (n >= cut) AS BIGINT) FROM v) AS vocab_size, (SELECT sum(CASE WHEN n >= cut THEN n ELSE 0 END)::DOUBLE / sum(n) FROM v) AS row_share, (SELECT avg(CAST(best >= cut AS DOUBLE)) FROM m) AS patient_share FROM t")
def _(spark, sf):
    r = rx(spark, sf).select("patient_id", "drug_id")
    counts = r.groupBy("drug_id").agg(F.count(F.lit(1)).alias("n"))
    best = r.join(counts, "drug_id").groupBy("patient_id").agg(F.max("n").alias("best"))
    cuts = F.broadcast(spark.createDataFrame([(20,), (30,), (40,)], "cut int"))
    v = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).crossJoin(cuts).groupBy("cut").agg(F.sum(F.when(F.col("n") >= F.col("cut"), F.col("c")).otherwise(0)).alias("vocab_size"), (F.sum(F.when(F.col("n") >= F.col("cut"), F.col("n") * F.col("c")).otherwise(0)) / F.sum(F.col("n") * F.col("c"))).alias("row_share"))
    p = best.groupBy("best").agg(F.count(F.lit(1)).alias("c")).crossJoin(cuts).groupBy("cut").agg((F.sum(F.when(F.col("best") >= F.col("cut"), F.col("c")).otherwise(0)) / F.sum("c")).alias("patient_share"))
    return v.join(p, "cut")


@query("top_codes", f"{WITH} SELECT drug_id, CAST(count(*) AS BIGINT) AS n FROM rx GROUP BY 1 ORDER BY n DESC, drug_id LIMIT 20")
def _(spark, sf):
    return rx(spark, sf).groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "drug_id").limit(20)


@query("k_anonymity", f"WITH {DEMO} SELECT {_BAND} AS band, sex_type, region, CAST(count(*) AS BIGINT) AS n FROM demo GROUP BY 1, 2, 3 HAVING count(*) < 5")
def _(spark, sf):
    return demographics(spark, sf).groupBy(age_band(F.col("age")).alias("band"), "sex_type", "region").agg(F.count(F.lit(1)).alias("n")).where("n < 5")


@query("demographics_by_year", "SELECT o_custkey AS patient_id, CAST(year(o_orderdate) AS INT) AS year, arg_max(o_orderstatus, (o_orderdate, o_orderkey, o_orderstatus)) AS status FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("patient_id"), F.year("o_orderdate").alias("year")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("status"))


@query("snapshot_history", f"{WITH}, d AS (SELECT DISTINCT patient_id, drug_id, start_date, end_date, source FROM rx), n AS (SELECT *, row_number() OVER (PARTITION BY patient_id, drug_id, start_date ORDER BY end_date DESC, source) AS n FROM d) SELECT patient_id, drug_id, start_date, end_date, source FROM n WHERE n = 1", dates=("start_date", "end_date"))
def _(spark, sf):
    d = rx(spark, sf).select("patient_id", "drug_id", "start_date", "end_date", "source").distinct()
    return kn.first_by(d, ["patient_id", "drug_id", "start_date"], [F.col("end_date").desc(), F.col("source")])


@query("golden_checks", f"WITH {SCORED} SELECT 'completeness' AS name, avg(CAST(y IS NOT NULL AND y2 IS NOT NULL AS DOUBLE)) AS value FROM scored UNION ALL SELECT 'positive_rate', avg(y) FROM scored UNION ALL SELECT 'agreement', avg(CAST(y = y2 AS DOUBLE)) FROM scored UNION ALL SELECT 'coverage', (SELECT count(*) FROM scored)::DOUBLE / (SELECT count(*) FROM documents)")
def _(spark, sf):
    s = scored(spark, sf).agg(F.avg((F.col("y").isNotNull() & F.col("y2").isNotNull()).cast("double")).alias("c"), F.avg("y").alias("p"), F.avg((F.col("y") == F.col("y2")).cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    all_ = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("docs"))
    facts = [F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in (("completeness", F.col("c")), ("positive_rate", F.col("p")), ("agreement", F.col("a")), ("coverage", F.col("n") / F.col("docs")))]
    return s.crossJoin(all_).select(F.inline(F.array(*facts)))
