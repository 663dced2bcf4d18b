"""Queries over drug lines: intervals, features, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import age_band, atc_level, risk_code, sex_value
from ..operators import features as ft
from ..operators import intervals as iv
from ..operators import knowledge as kn
from ..operators import rules as ru
from ..operators import safety as sy
from ..tables import spread
from .binding import BUCKET, DEMO, KB, MEDICINES, MEDS, N_IDS, OCC, RX, demographics, enzymes_sql, interaction_ids, interactions, medicines, rated_sql, rx, rx_meds, table, with_medicine
from .registry import query

WITH = f"WITH {RX}"
WITH_OCC = f"WITH {RX}, {OCC}"
WITH_MEDS = f"WITH {RX}, {MEDS}"
KEYS = ["patient_id", "bucket"]


def bucket(day: str | Column = "start_date") -> Column:
    return F.floor(F.datediff(day, F.lit("1995-01-01").cast("date")) / 90).cast("int")


@query("scan_project", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


@query("claim_join", "SELECT o_custkey AS patient_id, CAST(count(*) AS BIGINT) AS n_lines, count(DISTINCT o_orderkey) AS n_claims FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    lines, heads = table(spark, sf, "lineitem").select("l_orderkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(heads, lines.l_orderkey == heads.o_orderkey).groupBy(F.col("o_custkey").alias("patient_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("o_orderkey").alias("n_claims"))


@query("rx_interval", f"{WITH} SELECT patient_id, bill_no, line_no, drug_id, institution_id, start_date, end_date, total_days FROM rx", dates=('start_date', 'end_date'))
def _(spark, sf):
    return rx(spark, sf).select("patient_id", "bill_no", "line_no", "drug_id", "institution_id", "start_date", "end_date", "total_days")


@query("rx_union", f"{WITH} SELECT source, CAST(count(*) AS BIGINT) AS n_lines, count(DISTINCT patient_id) AS n_patients FROM rx GROUP BY source")
def _(spark, sf):
    r = rx(spark, sf)
    both = r.where("source = 'T30'").select("patient_id", "source").unionByName(r.where("source = 'T60'").select("patient_id", "source"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("patient_id").alias("n_patients"))


@query("rx_repair_end", f"{WITH} SELECT bill_no, line_no, drug_id, CASE WHEN drug_id % 3 = 0 THEN start_date + total_days - 1 ELSE end_date END AS end_date FROM rx", dates=('end_date',))
def _(spark, sf):
    broken = rx(spark, sf).withColumn("end_date", F.when(F.col("drug_id") % 3 == 0, F.when(F.col("drug_id") % 2 == 0, F.date_sub("start_date", 5))).otherwise(F.col("end_date")))
    return iv.repair_end(broken).select("bill_no", "line_no", "drug_id", "end_date")


@query("overlap_days", f"{WITH} SELECT bill_no, line_no, drug_id, CAST(greatest(0, date_diff('day', greatest(start_date, DATE '1998-01-01'), least(end_date, DATE '1998-01-31')) + 1) AS INT) AS days FROM rx WHERE start_date <= DATE '1998-01-31' AND end_date >= DATE '1998-01-01'")
def _(spark, sf):
    low, high = (F.lit(d).cast("date") for d in ("1998-01-01", "1998-01-31"))
    r = rx(spark, sf).where("start_date <= date '1998-01-31' and end_date >= date '1998-01-01'")
    return r.select("bill_no", "line_no", "drug_id", iv.overlap_days(F.col("start_date"), F.col("end_date"), low, high).cast("int").alias("days"))


@query("interval_filter", f"{WITH} SELECT patient_id, CAST(count(*) AS BIGINT) AS n FROM rx WHERE start_date <= DATE '1997-06-30' AND end_date >= DATE '1997-06-01' GROUP BY 1")
def _(spark, sf):
    return rx(spark, sf).where("start_date <= date '1997-06-30' and end_date >= date '1997-06-01'").groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@query("overlap_pairs", f"{WITH_OCC} SELECT patient_id, drug_a, drug_b, CAST(count(*) AS BIGINT) AS n_occurrences, CAST(max(overlap_days) AS INT) AS max_overlap_days, min(overlap_start) AS first_overlap FROM occ GROUP BY 1, 2, 3", dates=('first_overlap',))
def _(spark, sf):
    return iv.overlap_pairs(iv.overlaps(rx(spark, sf)))


@query("overlap_first", f"{WITH_OCC} SELECT patient_id, drug_a, drug_b, arg_min(overlap_start, (overlap_start, overlap_end)) AS overlap_start, arg_min(overlap_end, (overlap_start, overlap_end)) AS overlap_end FROM occ GROUP BY 1, 2, 3", dates=('overlap_start', 'overlap_end'))
def _(spark, sf):
    return iv.first_overlap(iv.overlaps(rx(spark, sf)))


@query("attributed_overlaps", f"{WITH_OCC} SELECT patient_id, drug_a, drug_b, institution_a, institution_b, overlap_start, overlap_end, institution_a = institution_b AS same_institution FROM occ", dates=('overlap_start', 'overlap_end'))
def _(spark, sf):
    o = iv.overlaps(rx(spark, sf), carry=("institution_id",))
    return o.select("patient_id", "drug_a", "drug_b", F.col("institution_id_a").alias("institution_a"), F.col("institution_id_b").alias("institution_b"), "overlap_start", "overlap_end", (F.col("institution_id_a") == F.col("institution_id_b")).alias("same_institution"))


@query("institution_ddi", f"""{WITH_OCC}, {KB}, hits AS (SELECT o.*, severity, CASE WHEN institution_a = institution_b THEN 'same' ELSE 'cross' END AS side
  FROM occ o JOIN kb ON id_lo = least(drug_a % 50, drug_b % 50) AND id_hi = greatest(drug_a % 50, drug_b % 50) WHERE severity IN ('Contraindicated', 'Major')),
  sides AS (SELECT patient_id, side, severity, institution_a AS institution_id FROM hits UNION ALL SELECT patient_id, side, severity, institution_b FROM hits WHERE institution_a <> institution_b)
  SELECT institution_id, severity, CAST(count(*) AS BIGINT) AS n_events, count(DISTINCT patient_id) AS n_patients, CAST(count(*) FILTER (side = 'same') AS BIGINT) AS n_same, CAST(count(*) FILTER (side = 'cross') AS BIGINT) AS n_cross FROM sides GROUP BY 1, 2""")
def _(spark, sf):
    o = iv.overlaps(rx(spark, sf), carry=("institution_id",)).withColumn("uid", F.struct("patient_id", "drug_a", "drug_b", "institution_id_a", "institution_id_b"))
    lookup = kn.severity_lookup(interactions(spark))
    keyed = o.withColumn("id_lo", F.least(F.col("drug_a") % N_IDS, F.col("drug_b") % N_IDS)).withColumn("id_hi", F.greatest(F.col("drug_a") % N_IDS, F.col("drug_b") % N_IDS))
    hits = keyed.join(kn.small(lookup), ["id_lo", "id_hi"]).where(F.col("severity").isin("Contraindicated", "Major"))
    side = F.when(F.col("institution_id_a") == F.col("institution_id_b"), "same").otherwise("cross")
    sides = hits.select("patient_id", "severity", side.alias("side"), F.explode(F.array_distinct(F.array("institution_id_a", "institution_id_b"))).alias("institution_id"))
    return sides.groupBy("institution_id", "severity").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("patient_id").alias("n_patients"), F.count_if(F.col("side") == "same").alias("n_same"), F.count_if(F.col("side") == "cross").alias("n_cross"))


@query("active_on_day", f"{WITH} SELECT patient_id, CAST(count(*) FILTER (start_date <= DATE '1998-03-01' AND DATE '1998-03-01' <= end_date) AS BIGINT) AS active_lines FROM rx GROUP BY 1")
def _(spark, sf):
    return iv.active_on(rx(spark, sf), "1998-03-01")


@query("max_concurrent", f"""{WITH}, e AS (SELECT patient_id, start_date AS d, 1 AS n FROM rx UNION ALL SELECT patient_id, end_date + 1, -1 FROM rx),
  s AS (SELECT patient_id, d, sum(n) AS n FROM e GROUP BY 1, 2), r AS (SELECT patient_id, sum(n) OVER (PARTITION BY patient_id ORDER BY d) AS n FROM s)
  SELECT patient_id, CAST(max(n) AS BIGINT) AS max_concurrent FROM r GROUP BY 1""")
def _(spark, sf):
    return iv.max_concurrent(rx(spark, sf))


@query("rx_window", f"{WITH} SELECT patient_id, min(start_date) AS window_start, least(max(end_date), min(start_date) + 89) AS window_end FROM rx GROUP BY 1", dates=('window_start', 'window_end'))
def _(spark, sf):
    return iv.observation_window(rx(spark, sf))


@query("pdc_mpr", f"""{WITH}, o AS (SELECT *, max(end_date) OVER (PARTITION BY patient_id, drug_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rx),
  n AS (SELECT *, CASE WHEN before IS NULL OR start_date > before THEN date_diff('day', start_date, end_date) + 1 ELSE greatest(0, date_diff('day', before, end_date)) END AS new_days FROM o)
  SELECT patient_id, drug_id, CAST(sum(total_days) AS BIGINT) AS supplied, CAST(sum(new_days) AS BIGINT) AS covered, date_diff('day', min(start_date), max(end_date)) + 1 AS span,
    sum(total_days)::DOUBLE / (date_diff('day', min(start_date), max(end_date)) + 1) AS mpr, sum(new_days)::DOUBLE / (date_diff('day', min(start_date), max(end_date)) + 1) AS pdc FROM n GROUP BY 1, 2""")
def _(spark, sf):
    return iv.covered_days(rx(spark, sf), ("patient_id", "drug_id"))


@query("switch_or_dup", f"""WITH {RX}, o AS (SELECT a.patient_id, a.class_no = b.class_no AS same_class, date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1 AS d
  FROM rx a JOIN rx b ON a.patient_id = b.patient_id AND a.drug_id < b.drug_id AND a.start_date <= b.end_date AND b.start_date <= a.end_date)
  SELECT CASE WHEN d BETWEEN 1 AND 6 THEN 'switch' WHEN d >= 30 AND same_class THEN 'duplicate' ELSE 'overlap' END AS kind, CAST(count(*) AS BIGINT) AS n, count(DISTINCT patient_id) AS n_patients FROM o GROUP BY 1""")
def _(spark, sf):
    o = iv.overlaps(rx(spark, sf), min_days=1, carry=("class_no",))
    kind = ru.switch_or_duplicate(F.col("overlap_days"), F.col("class_no_a") == F.col("class_no_b"))
    return o.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("n_patients"))


@query("dual_window", f"{WITH} SELECT patient_id, w AS window_days, count(DISTINCT drug_id) AS n_drugs FROM rx, (VALUES (30), (90)) v(w) WHERE start_date BETWEEN DATE '1998-06-30' - w + 1 AND DATE '1998-06-30' GROUP BY 1, 2")
def _(spark, sf):
    r = rx(spark, sf).where("start_date between date '1998-04-02' and date '1998-06-30'").select("patient_id", "drug_id", F.datediff(F.lit("1998-06-30").cast("date"), "start_date").alias("ago"), F.explode(F.array(F.lit(30), F.lit(90))).alias("window_days"))
    return r.where("ago < window_days").groupBy("patient_id", "window_days").agg(F.countDistinct("drug_id").alias("n_drugs"))


@query("eligible_drugs", f"{WITH} SELECT patient_id, count(DISTINCT drug_id) AS n_drugs FROM rx WHERE total_days >= 8 AND NOT (atc_code LIKE 'D%' OR atc_code LIKE 'S%' OR atc_code LIKE 'J07%' OR atc_code LIKE 'V%') GROUP BY 1")
def _(spark, sf):
    return ru.eligible(rx(spark, sf)).groupBy("patient_id").agg(F.countDistinct("drug_id").alias("n_drugs"))


@query("rx_frequency", f"""{WITH} SELECT patient_id, 'month' AS level, date_trunc('month', start_date)::DATE AS period, CAST(count(*) AS BIGINT) AS n_lines, count(DISTINCT drug_id) AS n_drugs FROM rx GROUP BY 1, 2, 3
  UNION ALL SELECT patient_id, 'quarter', date_trunc('quarter', start_date)::DATE, count(*), count(DISTINCT drug_id) FROM rx GROUP BY 1, 2, 3""", dates=('period',))
def _(spark, sf):
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.trunc("start_date", k).alias("period")) for k in ("month", "quarter"))))
    return rx(spark, sf).select("patient_id", "drug_id", levels.alias("l")).groupBy("patient_id", "l.level", "l.period").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("drug_id").alias("n_drugs"))


# ---- features


@query("drug_count", f"{WITH}, c AS (SELECT patient_id, unnest(string_split(lower(product_name), ' ')) AS c FROM rx) SELECT patient_id, count(DISTINCT c) AS n_components FROM c WHERE c <> '' GROUP BY 1")
def _(spark, sf):
    c = rx(spark, sf).select("patient_id", F.explode(F.split(F.lower("product_name"), " ")).alias("c")).where("c <> ''")
    return c.groupBy("patient_id").agg(F.countDistinct("c").alias("n_components"))


@query("institution_count", f"{WITH} SELECT patient_id, count(DISTINCT institution_id) AS institution_count FROM rx GROUP BY 1")
def _(spark, sf):
    return rx(spark, sf).groupBy("patient_id").agg(F.countDistinct("institution_id").alias("institution_count"))


@query("dup_ingredient", f"{WITH}, c AS (SELECT DISTINCT patient_id, bill_no, line_no, drug_id, start_date, total_days, institution_id, unnest(string_split(lower(product_name), ' ')) AS c FROM rx), n AS (SELECT patient_id, c, count(*) AS n FROM c GROUP BY 1, 2) SELECT patient_id, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS dup_ingredient FROM n GROUP BY 1")
def _(spark, sf):
    line = ["patient_id", "bill_no", "line_no", "drug_id", "start_date", "total_days", "institution_id"]
    c = spread(rx(spark, sf).select(*line, "product_name"), "patient_id").select(*line, F.explode(F.array_distinct(F.split(F.lower("product_name"), " "))).alias("c")).distinct()
    return ft.duplicate_counts(c, ["patient_id"], "c", "dup_ingredient")


@query("dup_class", f"{WITH}, n AS (SELECT patient_id, class_no, count(*) AS n FROM rx GROUP BY 1, 2) SELECT patient_id, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS dup_class FROM n GROUP BY 1")
def _(spark, sf):
    return ft.duplicate_counts(spread(rx(spark, sf).select("patient_id", "class_no"), "patient_id"), ["patient_id"], "class_no", "dup_class")


@query("dup_atc", f"""{WITH}, p AS (SELECT patient_id, l, substr(atc_code, 1, w) AS p FROM rx, (VALUES (5, 7), (4, 5), (3, 4)) v(l, w)), n AS (SELECT patient_id, l, p, count(*) AS n FROM p GROUP BY 1, 2, 3)
  SELECT patient_id, CAST(count(*) FILTER (l = 5 AND n >= 2) AS BIGINT) AS dup_atc5, CAST(count(*) FILTER (l = 4 AND n >= 2) AS BIGINT) AS dup_atc4, CAST(count(*) FILTER (l = 3 AND n >= 2) AS BIGINT) AS dup_atc3 FROM n GROUP BY 1""")
def _(spark, sf):
    return ft.duplicate_atc(rx(spark, sf), ["patient_id"])


@query("dup_class_distinct", f"{WITH}, n AS (SELECT patient_id, class_no, count(DISTINCT drug_id) AS n FROM rx GROUP BY 1, 2) SELECT patient_id, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS dup_classes, CAST(max(n) AS BIGINT) AS max_per_class FROM n GROUP BY 1")
def _(spark, sf):
    return ft.distinct_class_duplicates(rx(spark, sf), ["patient_id"])


@query("atc_levels", f"{WITH} SELECT substr(atc_code, 1, 4) AS atc3, substr(atc_code, 1, 5) AS atc4, CAST(count(*) AS BIGINT) AS n FROM rx GROUP BY 1, 2")
def _(spark, sf):
    return rx(spark, sf).groupBy(atc_level(F.col("atc_code"), 3).alias("atc3"), atc_level(F.col("atc_code"), 4).alias("atc4")).agg(F.count(F.lit(1)).alias("n"))


_SEVERITY = "CASE rank WHEN 4 THEN 'Contraindicated' WHEN 3 THEN 'Major' WHEN 2 THEN 'Moderate' WHEN 1 THEN 'Minor' END"
_COUNTS = "CAST(count(*) FILTER (rank = 4) AS BIGINT) AS ddi_contraindicated, CAST(count(*) FILTER (rank = 3) AS BIGINT) AS ddi_major, CAST(count(*) FILTER (rank = 2) AS BIGINT) AS ddi_moderate, CAST(count(*) FILTER (rank = 1) AS BIGINT) AS ddi_minor"
_RATED = f"{WITH_OCC}, {KB}, rated AS ({rated_sql('(SELECT DISTINCT patient_id, drug_a, drug_b FROM occ)')})"


def rated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each patient's pairs of drugs taken at once with the best severity over the ids of both sides."""
    pairs = iv.overlap_pairs(iv.overlaps(rx(spark, sf))).select("patient_id", "drug_a", "drug_b")
    return kn.pairs_with_severity(pairs, interaction_ids("drug_a"), interaction_ids("drug_b"), kn.severity_lookup(interactions(spark)))


def severity_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(f"ddi_{s.lower()}") for s in reversed(kn.SEVERITIES)))


@query("ddi_pairs", f"{_RATED} SELECT patient_id, drug_a, drug_b, rank, {_SEVERITY} AS severity FROM rated")
def _(spark, sf):
    return rated_pairs(spark, sf)


@query("ddi_counts", f"{_RATED} SELECT patient_id, {_COUNTS} FROM rated GROUP BY 1")
def _(spark, sf):
    return severity_counts(rated_pairs(spark, sf), ["patient_id"])


@query("ddi_alerts", f"{_RATED} SELECT patient_id, drug_a, drug_b, {_SEVERITY} AS severity FROM rated WHERE rank >= 3")
def _(spark, sf):
    return rated_pairs(spark, sf).where("rank >= 3").select("patient_id", "drug_a", "drug_b", "severity")


#: Days that two drugs must be taken together.
LEAST_OVERLAP = 7
def safety_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per patient and 90-day bucket: counts, duplicates, rated pairs, flags, enzyme scores, age and sex.

    Lines count in the bucket of their start, pairs in that of their later start, so lines on both sides of an edge
    meet. Pairs are formed by a join and rated where they then are, by (patient, bucket), as are all counts.
    """
    lines = rx_meds(spark, sf)
    facts = sy.group_features(lines.withColumn("bucket", bucket()).withColumn("atc", F.col("med_atc")), KEYS)
    pairs = sy.group_pairs(lines, LEAST_OVERLAP, "1995-01-01", 90)
    rated = kn.pairs_with_severity(pairs, interaction_ids("drug_a"), interaction_ids("drug_b"), kn.severity_lookup(interactions(spark)))
    counts = [f"ddi_{s.lower()}" for s in kn.SEVERITIES]
    people = demographics(spark, sf).select("patient_id", "age", sex_value(F.col("sex_type")).alias("sex"))
    return facts.join(severity_counts(rated, KEYS), KEYS, "left").na.fill(0, counts).join(people, "patient_id", "left")


def patient_features(spark: SparkSession, sf: str) -> DataFrame:
    return safety_features(spark, sf)


def _in(col: str, words: list[str], how: str) -> str:
    return " OR ".join(f"{col} LIKE '{'%' if how == 'has' else ''}{w}%'" for w in words)


def _is(group: tuple[list[str], list[str]]) -> str:
    return f"({_in('lower(med_name)', group[0], 'has')} OR {_in('med_atc', group[1], 'starts')})"


def _flag(name: str, group: tuple[list[str], list[str]]) -> str:
    return f"bool_or({_is(group)}) AS {name}"


_WHAMMY = f"""bool_or(regexp_matches(c, 'pril(\\s|$)') OR c LIKE '%sartan%') AS acei_arb, bool_or({_in("c", ft.K_SPARING, "has")}) AS k_sparing, bool_or({_in("c", ft.NSAID, "has")}) AS nsaid"""


_CODES = ", ".join(f"bool_or({_in('med_atc', prefixes, 'starts')}) AS {n}" for n, prefixes in zip(("ca", "ck", "cn"), sy.WHAMMY_CODES))

_FEATURES = f"""WITH {RX}, {MEDS}, {KB}, {DEMO}, r AS (SELECT *, {BUCKET} AS bucket FROM rxm), {enzymes_sql("r")},
codes AS (SELECT patient_id, bucket, ca AND ck AND cn AS triple_whammy_codes FROM (SELECT patient_id, bucket, {_CODES} FROM r GROUP BY 1, 2)),
base AS (SELECT patient_id, bucket, count(DISTINCT institution_id) AS institution_count, CAST(count(*) AS BIGINT) AS n_lines, min(start_date) AS window_start, least(max(end_date), min(start_date) + 89) AS window_end,
  {_flag("high_risk", ft.HIGH_RISK)}, {_flag("renal_risk", ft.RENAL_RISK)}, {_flag("hepatic_risk", ft.HEPATIC_RISK)}, count(DISTINCT CASE WHEN {_is(ru.GROUPS["qt_prolonging"])} THEN drug_id END) AS qt_drugs FROM r GROUP BY 1, 2),
at_end AS (SELECT patient_id, bucket, CAST(count(*) FILTER (start_date <= window_end AND window_end <= end_date) AS BIGINT) AS drug_count_7d FROM r JOIN base USING (patient_id, bucket) GROUP BY 1, 2),
named AS (SELECT patient_id, bucket, unnest(comps) AS c FROM r),
comp AS (SELECT patient_id, bucket, CAST(count(*) AS BIGINT) AS drug_count, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS dup_same_ingredient FROM (SELECT patient_id, bucket, c, count(*) AS n FROM named GROUP BY 1, 2, 3) GROUP BY 1, 2),
whammy AS (SELECT patient_id, bucket, {_WHAMMY} FROM named GROUP BY 1, 2),
dup AS (SELECT patient_id, bucket, CAST(count(*) FILTER (k = 'class' AND n >= 2) AS BIGINT) AS dup_class, CAST(count(*) FILTER (k = 'a5' AND n >= 2) AS BIGINT) AS dup_atc5, CAST(count(*) FILTER (k = 'a4' AND n >= 2) AS BIGINT) AS dup_atc4, CAST(count(*) FILTER (k = 'a3' AND n >= 2) AS BIGINT) AS dup_atc3
  FROM (SELECT patient_id, bucket, k, v, count(*) AS n FROM (SELECT patient_id, bucket, 'class' AS k, class_no AS v FROM r UNION ALL SELECT patient_id, bucket, 'a5', med_atc FROM r UNION ALL SELECT patient_id, bucket, 'a4', substr(med_atc, 1, 5) FROM r UNION ALL SELECT patient_id, bucket, 'a3', substr(med_atc, 1, 4) FROM r) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
pairs AS (SELECT DISTINCT a.patient_id, CAST(floor(date_diff('day', DATE '1995-01-01', greatest(a.start_date, b.start_date)) / 90.0) AS INT) AS bucket, a.drug_id AS drug_a, b.drug_id AS drug_b FROM rx a JOIN rx b ON a.patient_id = b.patient_id AND a.drug_id < b.drug_id
  AND date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1 >= {LEAST_OVERLAP}),
rated AS ({rated_sql("pairs", "patient_id, bucket")}), counts AS (SELECT patient_id, bucket, {_COUNTS} FROM rated GROUP BY 1, 2),
feats AS (SELECT base.*, drug_count_7d, drug_count, dup_same_ingredient, dup_class, dup_atc5, dup_atc4, dup_atc3, coalesce(ddi_contraindicated, 0) AS ddi_contraindicated, coalesce(ddi_major, 0) AS ddi_major, coalesce(ddi_moderate, 0) AS ddi_moderate, coalesce(ddi_minor, 0) AS ddi_minor,
  acei_arb AND k_sparing AND nsaid AS triple_whammy, triple_whammy_codes, coalesce(cyp_risk_score, 0) AS cyp_risk_score, coalesce(cyp_max_enzyme_risk, 0) AS cyp_max_enzyme_risk, coalesce(cyp_high_risk_pairs, 0) AS cyp_high_risk_pairs, age, CASE sex_type WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS sex
  FROM base JOIN at_end USING (patient_id, bucket) JOIN comp USING (patient_id, bucket) JOIN whammy USING (patient_id, bucket) JOIN dup USING (patient_id, bucket) JOIN codes USING (patient_id, bucket) LEFT JOIN cyp USING (patient_id, bucket) LEFT JOIN counts USING (patient_id, bucket) LEFT JOIN demo USING (patient_id))"""

_LEVEL = """, g AS (SELECT *, triple_whammy OR (drug_count >= 10 AND high_risk) OR (coalesce(age, -1) >= 75 AND drug_count >= 5 AND (renal_risk OR hepatic_risk)) AS severe,
  CAST(ddi_moderate >= 2 AS INT) + CAST(dup_same_ingredient >= 1 AS INT) + CAST(institution_count >= 3 AS INT) AS dims FROM feats),
graded AS (SELECT *, CASE WHEN ddi_contraindicated >= 1 THEN 'Red' WHEN severe OR ddi_major >= 1 OR dims > 0 THEN 'Yellow' WHEN ddi_minor >= 1 OR drug_count >= 5 THEN 'Green' ELSE 'Normal' END AS risk_level FROM g),
typed AS (SELECT *, CASE WHEN risk_level <> 'Yellow' THEN NULL WHEN ddi_major >= 1 THEN 'Y_DDI_MAJOR' WHEN severe OR dims >= 3 THEN 'Y_TRIPLE' WHEN dims = 2 THEN 'Y_DOUBLE'
  WHEN ddi_moderate >= 2 THEN 'Y_DDI_MOD' WHEN dup_same_ingredient >= 1 THEN 'Y_DUP' WHEN institution_count >= 3 THEN 'Y_FRAG' ELSE 'Y_OTHER' END AS yellow_subtype FROM graded)"""


query("patient_features", _FEATURES + " SELECT * FROM feats", dates=("window_start", "window_end"))(patient_features)


def graded(spark: SparkSession, sf: str) -> DataFrame:
    return ru.grade(patient_features(spark, sf))


@query("risk_level", _FEATURES + _LEVEL + " SELECT patient_id, bucket, drug_count, institution_count, ddi_contraindicated, ddi_major, ddi_moderate, ddi_minor, dup_same_ingredient, risk_level, yellow_subtype FROM typed")
def _(spark, sf):
    return graded(spark, sf).select("patient_id", "bucket", "drug_count", "institution_count", "ddi_contraindicated", "ddi_major", "ddi_moderate", "ddi_minor", "dup_same_ingredient", "risk_level", "yellow_subtype")


@query("risk_rules", _FEATURES + _LEVEL + """ SELECT patient_id, bucket, concat_ws(',', CASE WHEN risk_level = 'Yellow' AND ddi_major >= 1 THEN 'DDI_MAJOR' END, CASE WHEN risk_level = 'Yellow' AND ddi_moderate >= 2 THEN 'DDI_MOD' END, CASE WHEN risk_level = 'Yellow' AND dup_same_ingredient >= 1 THEN 'DUP' END,
  CASE WHEN risk_level = 'Yellow' AND institution_count >= 3 THEN 'FRAG' END, CASE WHEN risk_level = 'Red' THEN 'RED_CONTRAINDICATED' END, CASE WHEN risk_level = 'Yellow' AND drug_count >= 10 AND high_risk THEN 'SEV_10DRUG_HIGHRISK' END,
  CASE WHEN risk_level = 'Yellow' AND age >= 75 AND drug_count >= 5 AND (renal_risk OR hepatic_risk) THEN 'SEV_ELDERLY_ORGAN' END, CASE WHEN risk_level = 'Yellow' AND triple_whammy THEN 'SEV_TRIPLE_WHAMMY' END) AS triggers FROM typed WHERE risk_level IN ('Red', 'Yellow')""")
def _(spark, sf):
    return graded(spark, sf).where("risk_level in ('Red', 'Yellow')").select("patient_id", "bucket", F.concat_ws(",", "risk_reasons").alias("triggers"))


@query("yellow_subtype", _FEATURES + _LEVEL + " SELECT yellow_subtype, CAST(count(*) AS BIGINT) AS n FROM typed WHERE risk_level = 'Yellow' GROUP BY 1")
def _(spark, sf):
    return graded(spark, sf).where("risk_level = 'Yellow'").groupBy("yellow_subtype").agg(F.count(F.lit(1)).alias("n"))


@query("risk_distribution", _FEATURES + _LEVEL + " SELECT risk_level, CAST(count(*) AS BIGINT) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS rate FROM typed GROUP BY 1")
def _(spark, sf):
    n = graded(spark, sf).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("run_summary", _FEATURES + _LEVEL + " SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT patient_id) AS n_patients, avg(drug_count) AS mean_drugs, avg(ddi_major) AS mean_major, CAST(count(*) FILTER (risk_level = 'Red') AS BIGINT) AS n_red FROM typed")
def _(spark, sf):
    return graded(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("patient_id").alias("n_patients"), F.avg("drug_count").alias("mean_drugs"), F.avg("ddi_major").alias("mean_major"), F.count_if(F.col("risk_level") == "Red").alias("n_red"))


@query("label_encode", _FEATURES + _LEVEL + " SELECT CASE risk_level WHEN 'Normal' THEN 0 WHEN 'Green' THEN 1 WHEN 'Yellow' THEN 2 ELSE 3 END AS risk_code, CAST(risk_level = 'Red' AS INT) AS is_red, CAST(risk_level IN ('Red', 'Yellow') AS INT) AS is_risk, CAST(count(*) AS BIGINT) AS n FROM typed GROUP BY 1, 2, 3")
def _(spark, sf):
    g = graded(spark, sf)
    return g.groupBy(risk_code(F.col("risk_level")).alias("risk_code"), (F.col("risk_level") == "Red").cast("int").alias("is_red"), F.col("risk_level").isin("Red", "Yellow").cast("int").alias("is_risk")).agg(F.count(F.lit(1)).alias("n"))


@query("safety_net_grade", _FEATURES + """ SELECT CASE WHEN ddi_contraindicated >= 1 OR ddi_major >= 3 OR triple_whammy OR qt_drugs >= 3 OR (drug_count >= 10 AND high_risk) OR (coalesce(age, -1) >= 75 AND drug_count >= 5 AND (renal_risk OR hepatic_risk)) THEN 'Red'
  WHEN ddi_major >= 1 OR ddi_moderate >= 2 THEN 'Yellow' WHEN ddi_minor > 0 OR drug_count >= 5 THEN 'Green' ELSE 'Normal' END AS safety_grade, CAST(count(*) AS BIGINT) AS n FROM feats GROUP BY 1""")
def _(spark, sf):
    return ru.safety_net_grade(safety_features(spark, sf)).groupBy("safety_grade").agg(F.count(F.lit(1)).alias("n"))


@query("fuse_levels", _FEATURES + _LEVEL + """, f AS (SELECT patient_id, bucket, risk_level AS rule_level, CASE WHEN (patient_id * 7 + bucket * 13) % 100 >= 70 THEN 'Red' WHEN (patient_id * 7 + bucket * 13) % 100 >= 40 THEN 'Yellow' WHEN (patient_id * 7 + bucket * 13) % 100 >= 20 THEN 'Green' ELSE 'Normal' END AS model_level,
  dup_same_ingredient, ddi_contraindicated FROM typed), c AS (SELECT *, greatest(CASE rule_level WHEN 'Red' THEN 3 WHEN 'Yellow' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END, CASE model_level WHEN 'Red' THEN 3 WHEN 'Yellow' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END,
  CASE WHEN dup_same_ingredient >= 1 THEN 2 ELSE 0 END, CASE WHEN ddi_contraindicated >= 1 THEN 3 ELSE 0 END) AS k FROM f)
  SELECT patient_id, bucket, rule_level, model_level, CASE k WHEN 3 THEN 'Red' WHEN 2 THEN 'Yellow' WHEN 1 THEN 'Green' ELSE 'Normal' END AS fused_level, rule_level <> model_level AS disagree FROM c""")
def _(spark, sf):
    g = graded(spark, sf).select("patient_id", "bucket", F.col("risk_level").alias("rule_level"), ru.probability_level(((F.col("patient_id") * 7 + F.col("bucket") * 13) % 100) / 100).alias("model_level"), (F.col("dup_same_ingredient") >= 1).alias("has_duplicate"), F.col("ddi_contraindicated").alias("contraindicated"))
    return ru.fuse_levels(g).select("patient_id", "bucket", "rule_level", "model_level", "fused_level", "disagree")


@query("two_stage_dispatch", _FEATURES + _LEVEL + """, p AS (SELECT ((patient_id * 7 + bucket * 13) % 100) / 100.0 AS p, coalesce(yellow_subtype, 'NONE') AS s FROM typed), d AS (SELECT CASE WHEN p >= 0.9 THEN 'Red' WHEN p >= 0.8 THEN 'REVIEW' ELSE s END AS decision FROM p)
  SELECT decision, CASE decision WHEN 'Red' THEN 'immediate' WHEN 'REVIEW' THEN 'pharmacist_review' WHEN 'Y_DDI_MAJOR' THEN 'call' WHEN 'Y_TRIPLE' THEN 'message' ELSE 'monitor' END AS action, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1, 2""")
def _(spark, sf):
    decision, action = ru.two_stage(((F.col("patient_id") * 7 + F.col("bucket") * 13) % 100) / 100, F.coalesce("yellow_subtype", F.lit("NONE")), 0.9, 0.8)
    return graded(spark, sf).groupBy(decision.alias("decision"), action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("action_distribution", _FEATURES + _LEVEL + """, a AS (SELECT CASE WHEN risk_level = 'Red' THEN 'immediate' WHEN yellow_subtype = 'Y_DDI_MAJOR' THEN 'call' WHEN yellow_subtype = 'Y_TRIPLE' THEN 'message' WHEN risk_level = 'Yellow' THEN 'monitor' ELSE 'none' END AS action FROM typed)
  SELECT action, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1""")
def _(spark, sf):
    action = F.when(F.col("risk_level") == "Red", "immediate").when(F.col("yellow_subtype") == "Y_DDI_MAJOR", "call").when(F.col("yellow_subtype") == "Y_TRIPLE", "message").when(F.col("risk_level") == "Yellow", "monitor").otherwise("none")
    return graded(spark, sf).groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("intervention_list", _FEATURES + _LEVEL + """, l AS (SELECT *, CASE WHEN risk_level = 'Red' THEN 'Red' ELSE yellow_subtype END AS label FROM typed)
  SELECT patient_id, bucket, risk_level, CAST(CASE label WHEN 'Red' THEN 0 WHEN 'Y_DDI_MAJOR' THEN 1 ELSE 2 END AS INT) AS priority, CASE label WHEN 'Red' THEN '즉각 개입' WHEN 'Y_DDI_MAJOR' THEN '약사 전화' ELSE '문자 안내' END AS intervention, label,
    CASE WHEN label = 'Red' THEN '금기 DDI ' || ddi_contraindicated || '건' ELSE concat_ws(', ', CASE WHEN ddi_major >= 1 THEN '중증 DDI ' || ddi_major || '건' END, CASE WHEN ddi_moderate >= 2 THEN 'Moderate DDI ' || ddi_moderate || '쌍' END,
      CASE WHEN dup_same_ingredient >= 1 THEN '동일성분 중복 ' || dup_same_ingredient || '건' END, CASE WHEN institution_count >= 3 THEN '다기관(3곳↑)' END, CASE WHEN drug_count >= 10 AND high_risk THEN '10종↑+고위험약' END,
      CASE WHEN age >= 75 AND drug_count >= 5 AND (renal_risk OR hepatic_risk) THEN '고령(75+)+장기부전' END, CASE WHEN triple_whammy THEN 'Triple Whammy' END) END AS reasons,
    drug_count, ddi_major, ddi_contraindicated, dup_same_ingredient, institution_count FROM l WHERE label IN ('Red', 'Y_DDI_MAJOR', 'Y_TRIPLE') ORDER BY priority, patient_id, bucket""")
def _(spark, sf):
    return ru.intervention_list(graded(spark, sf), KEYS)


@query("risk_flags", f"{WITH_MEDS} SELECT patient_id, {_flag('high_risk', ft.HIGH_RISK)}, {_flag('renal_risk', ft.RENAL_RISK)}, {_flag('hepatic_risk', ft.HEPATIC_RISK)} FROM rxm GROUP BY 1")
def _(spark, sf):
    return ft.risk_flags(rx_meds(spark, sf).select("patient_id", F.col("med_name").alias("product_name"), F.col("med_atc").alias("atc_code")), ["patient_id"])


@query("component_risk_flags", f"""{WITH_MEDS}, c AS (SELECT patient_id, {BUCKET} AS bucket, unnest(comps) AS c FROM rxm) SELECT patient_id, bucket, bool_or({_in("c", ft.HIGH_RISK[0], "has")}) AS high_risk, bool_or({_in("c", ft.RENAL_RISK[0], "has")}) AS renal_risk, bool_or({_in("c", ft.HEPATIC_RISK[0], "has")}) AS hepatic_risk FROM c GROUP BY 1, 2""")
def _(spark, sf):
    return ft.component_flags(rx_meds(spark, sf).select("patient_id", bucket().alias("bucket"), F.explode("parts").alias("component")), KEYS)


@query("triple_whammy", f"{WITH_MEDS}, c AS (SELECT patient_id, {BUCKET} AS bucket, unnest(comps) AS c FROM rxm), t AS (SELECT patient_id, bucket, {_WHAMMY} FROM c GROUP BY 1, 2) SELECT *, acei_arb AND k_sparing AND nsaid AS triple_whammy FROM t")
def _(spark, sf):
    return ft.triple_whammy(rx_meds(spark, sf).select("patient_id", bucket().alias("bucket"), F.explode("parts").alias("component")), KEYS)


@query("duplicate_levels", f"""{WITH}, c AS (SELECT patient_id, atc_code, count(*) AS n FROM rx GROUP BY 1, 2), p AS (SELECT a.patient_id, a.atc_code AS atc_a, b.atc_code AS atc_b FROM c a JOIN c b ON a.patient_id = b.patient_id AND a.atc_code < b.atc_code AND substr(a.atc_code, 1, 4) = substr(b.atc_code, 1, 4)
  UNION ALL SELECT patient_id, atc_code, atc_code FROM c WHERE n >= 2), l AS (SELECT *, CASE WHEN atc_a = atc_b THEN 1 WHEN substr(atc_a, 1, 5) = substr(atc_b, 1, 5) THEN 2 ELSE 3 END AS level FROM p),
  e AS (SELECT *, CASE WHEN level = 1 THEN NULL {" ".join(f"WHEN {_in('atc_a', ps, 'starts')} THEN '{n}'" for n, ps in ru.EXCEPTIONS)} END AS exception_code FROM l)
  SELECT patient_id, atc_a, atc_b, level, exception_code, exception_code IS NOT NULL AS allowed FROM e""")
def _(spark, sf):
    return ru.duplicate_levels(rx(spark, sf), ["patient_id"])


def _groups_sql(groups: ru.Groups) -> str:
    """CTE: the medicines' groups."""
    rows = " UNION ALL ".join(f"SELECT med, '{g}' AS grp FROM meds WHERE {' OR '.join(x for x in (_in('lower(med_name)', words, 'has'), _in('med_atc', prefixes, 'starts')) if x)}" for g, (words, prefixes) in groups.items())
    return f"grps AS ({rows}), members AS (SELECT DISTINCT patient_id, {BUCKET} AS bucket, drug_id, grp FROM rxm JOIN grps ON drug_id % {len(MEDICINES)} = med)"


def _rules_sql(rules: list) -> str:
    """Rules that hold for each patient and bucket, written out rule by rule."""

    def clause(groups: list[str], least: int) -> str:
        return f"count(DISTINCT CASE WHEN grp IN ({', '.join(repr(g) for g in groups)}) THEN drug_id END) >= {least}"

    return " UNION ALL ".join(
        f"SELECT patient_id, bucket, '{rule}' AS rule, '{name}' AS name, '{severity}' AS severity FROM members GROUP BY 1, 2 HAVING {' AND '.join(clause(g, least if k == 0 else 1) for k, g in enumerate(clauses))}"
        for rule, name, clauses, least, severity in rules
    )


def members(spark: SparkSession, sf: str, groups: ru.Groups) -> DataFrame:
    """Drugs of each patient and bucket with their groups. Groups are found once per medicine."""
    kinds = ru.memberships(medicines(spark), ru.group_table(spark, groups), "med_atc", "med_name").select("med", "grp")
    return drugs_taken(spark, sf).join(F.broadcast(kinds), F.col("drug_id") % len(MEDICINES) == F.col("med")).drop("med")


def drugs_taken(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct drugs of each patient and bucket, dealt by patient and bucket."""
    return spread(rx(spark, sf).select("patient_id", bucket().alias("bucket"), "drug_id"), *KEYS).distinct()


@query("safety_net_rules", f"{WITH_MEDS}, {_groups_sql(ru.GROUPS)} {_rules_sql(ru.RULES)}")
def _(spark, sf):
    return ru.apply_rules(members(spark, sf, ru.GROUPS), ru.RULES, KEYS)


@query("composite_patterns", f"{WITH_MEDS}, {_groups_sql(ru.PATTERN_GROUPS)} {_rules_sql(ru.PATTERNS)}")
def _(spark, sf):
    return ru.apply_rules(members(spark, sf, ru.PATTERN_GROUPS), ru.PATTERNS, KEYS)


_ASSESSED = f"""{WITH_MEDS}, {KB}, {DEMO}, {_groups_sql(ru.GROUPS)}, hits AS ({_rules_sql(ru.RULES)}),
  taken AS (SELECT patient_id, {BUCKET} AS bucket, drug_id, any_value(med_name) AS med_name, any_value(med_atc) AS med_atc, any_value(comps) AS comps FROM rxm GROUP BY 1, 2, 3),
  drugs AS (SELECT patient_id, bucket, CAST(count(DISTINCT c) AS BIGINT) AS drug_count FROM (SELECT patient_id, bucket, unnest(comps) AS c FROM taken) GROUP BY 1, 2),
  kinds AS (SELECT patient_id, bucket, bool_or({_in("lower(med_name)", ft.HIGH_RISK[0], "has")}) AS high_risk, {_flag("renal_risk", ft.RENAL_RISK)}, {_flag("hepatic_risk", ft.HEPATIC_RISK)}, count(DISTINCT CASE WHEN {_is(ru.GROUPS["qt_prolonging"])} THEN drug_id END) AS qt_drugs FROM taken GROUP BY 1, 2),
  rated AS ({rated_sql("(SELECT a.patient_id, a.bucket, a.drug_id AS drug_a, b.drug_id AS drug_b FROM taken a JOIN taken b ON a.patient_id = b.patient_id AND a.bucket = b.bucket AND a.drug_id < b.drug_id)", "patient_id, bucket")}),
  found AS (SELECT patient_id, bucket, NULL AS rule, rank FROM rated WHERE rank > 0 UNION ALL SELECT patient_id, bucket, rule || ': ' || name, CASE severity WHEN 'Contraindicated' THEN 4 WHEN 'Major' THEN 3 ELSE 2 END FROM hits),
  n AS (SELECT patient_id, bucket, {_COUNTS}, coalesce(bool_or(rule LIKE 'TOP03%'), false) AS triple_whammy, coalesce(string_agg(rule, ', ' ORDER BY rule), '') AS rules FROM found GROUP BY 1, 2),
  a AS (SELECT patient_id, bucket, drug_count, high_risk, renal_risk, hepatic_risk, qt_drugs, coalesce(ddi_contraindicated, 0) AS ddi_contraindicated, coalesce(ddi_major, 0) AS ddi_major, coalesce(ddi_moderate, 0) AS ddi_moderate, coalesce(ddi_minor, 0) AS ddi_minor, coalesce(triple_whammy, false) AS triple_whammy, coalesce(rules, '') AS rules, age
    FROM drugs JOIN kinds USING (patient_id, bucket) LEFT JOIN n USING (patient_id, bucket) LEFT JOIN demo USING (patient_id)),
  g AS (SELECT *, CASE WHEN ddi_contraindicated >= 1 OR ddi_major >= 3 OR triple_whammy OR qt_drugs >= 3 OR (drug_count >= 10 AND high_risk) OR (coalesce(age, -1) >= 75 AND drug_count >= 5 AND (renal_risk OR hepatic_risk)) THEN 'Red'
    WHEN ddi_major >= 1 OR ddi_moderate >= 2 THEN 'Yellow' WHEN ddi_minor > 0 OR drug_count >= 5 THEN 'Green' ELSE 'Normal' END AS safety_grade FROM a)
  SELECT patient_id, bucket, safety_grade, ddi_contraindicated, ddi_major, ddi_moderate, ddi_minor, triple_whammy, qt_drugs, rules,
    concat_ws('; ', CASE safety_grade WHEN 'Red' THEN 'high risk: act now' WHEN 'Yellow' THEN 'medium risk: monitor monthly' WHEN 'Green' THEN 'low risk: inform quarterly' ELSE 'normal' END, CASE WHEN ddi_contraindicated > 0 THEN 'contraindicated ' || ddi_contraindicated END,
      CASE WHEN ddi_major > 0 THEN 'major ' || ddi_major END, CASE WHEN triple_whammy THEN 'triple whammy' END, CASE WHEN qt_drugs >= 3 THEN 'QT drugs ' || qt_drugs END, nullif(rules, '')) AS explanation FROM g"""


@query("safety_net_assessment", _ASSESSED)
def _(spark, sf):
    """The drug list of each patient and bucket: rules, rated pairs of all its drugs, grade and explanation."""
    taken = with_medicine(drugs_taken(spark, sf))
    a, b = taken.select(*KEYS, F.col("drug_id").alias("drug_a")), taken.select(*KEYS, F.col("drug_id").alias("drug_b"))
    rated = kn.pairs_with_severity(a.join(b, KEYS).where("drug_a < drug_b"), interaction_ids("drug_a"), interaction_ids("drug_b"), kn.severity_lookup(interactions(spark)))
    found = ru.assess(members(spark, sf, ru.GROUPS), rated, KEYS)
    keyword = ft.contains_any(F.lower("med_name"), ft.HIGH_RISK[0])
    drugs = taken.groupBy(*KEYS).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("parts")))).cast("long").alias("drug_count"),
        F.bool_or(keyword).alias("high_risk"), *(F.bool_or(c).alias(c) for c in ("renal_risk", "hepatic_risk")),
    )
    people = demographics(spark, sf).select("patient_id", "age")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("ddi_contraindicated", "ddi_major", "ddi_moderate", "ddi_minor", "qt_drugs")}
    whole = drugs.join(found, KEYS, "left").withColumns(counts | {"triple_whammy": F.coalesce("triple_whammy", F.lit(False)), "triggered_rules": F.coalesce("triggered_rules", F.array().cast("array<string>"))})
    graded = ru.safety_net_grade(whole.join(people, "patient_id", "left"))
    return graded.select(*KEYS, "safety_grade", *counts, "triple_whammy", F.concat_ws(", ", "triggered_rules").alias("rules"), ru.explanation(graded).alias("explanation"))


@query("drug_groups", f"{WITH_MEDS}, {_groups_sql(ru.GROUPS)} SELECT grp AS g, count(DISTINCT drug_id) AS n_drugs, CAST(count(*) AS BIGINT) AS n_lines FROM rxm JOIN grps ON drug_id % {len(MEDICINES)} = grps.med GROUP BY 1")
def _(spark, sf):
    lines = rx(spark, sf).groupBy("drug_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = ru.memberships(medicines(spark), ru.group_table(spark, ru.GROUPS), "med_atc", "med_name").select("med", "grp")
    return lines.join(F.broadcast(kinds), F.col("drug_id") % len(MEDICINES) == F.col("med")).groupBy(F.col("grp").alias("g")).agg(F.countDistinct("drug_id").alias("n_drugs"), F.sum("n").alias("n_lines"))


_OTC = ru.GROUPS["anticoagulants_all"], ru.GROUPS["lithium"]


@query("otc_flag", f"{WITH_MEDS} SELECT patient_id, {BUCKET} AS bucket, bool_or({_is(_OTC[0])} OR {_is(_OTC[1])}) AS otc_warning FROM rxm GROUP BY 1, 2")
def _(spark, sf):
    """Patients on an anticoagulant or lithium get a warning about over-the-counter painkillers."""
    warned = [ft.in_group(F.col("med_name"), F.col("med_atc"), g) for g in _OTC]
    return rx_meds(spark, sf).groupBy("patient_id", bucket().alias("bucket")).agg(F.bool_or(warned[0] | warned[1]).alias("otc_warning"))


TEMPORAL = f"""{WITH}, t AS (SELECT *, date_diff('day', min(start_date) OVER (PARTITION BY patient_id), start_date) > 44 AS late FROM rx), d AS (SELECT patient_id, drug_id, bool_or(NOT late) AS e, bool_or(late) AS l FROM t GROUP BY 1, 2),
  c AS (SELECT patient_id, CAST(count(*) FILTER (e) AS BIGINT) AS early_drugs, CAST(count(*) FILTER (l) AS BIGINT) AS late_drugs, CAST(count(*) FILTER (l AND NOT e) AS BIGINT) AS new_drugs FROM d GROUP BY 1),
  i AS (SELECT patient_id, institution_id, count(*)::DOUBLE AS n FROM rx GROUP BY 1, 2), s AS (SELECT patient_id, n / sum(n) OVER (PARTITION BY patient_id) AS p FROM i), h AS (SELECT patient_id, sum(-p * log2(p)) AS institution_entropy, max(p) AS max_share FROM s GROUP BY 1),
  m AS (SELECT patient_id, CAST(count(*) AS BIGINT) AS n_lines, avg(total_days) AS mean_days, CAST(count(*) FILTER (total_days >= 30) AS BIGINT) AS long_lines FROM rx GROUP BY 1)
  SELECT patient_id, early_drugs, late_drugs, late_drugs - early_drugs AS drug_trend, new_drugs, institution_entropy, max_share, n_lines, mean_days, long_lines, long_lines::DOUBLE / n_lines AS long_ratio FROM c JOIN h USING (patient_id) JOIN m USING (patient_id)"""


@query("temporal_features", TEMPORAL)
def _(spark, sf):
    return ft.temporal_features(rx(spark, sf))


@query("coprescription_edges", f"{WITH}, d AS (SELECT DISTINCT patient_id, start_date, drug_id FROM rx), e AS (SELECT a.drug_id AS drug_a, b.drug_id AS drug_b, CAST(count(*) AS BIGINT) AS n FROM d a JOIN d b ON a.patient_id = b.patient_id AND a.start_date = b.start_date AND a.drug_id < b.drug_id GROUP BY 1, 2) SELECT *, ln(1 + n) / max(ln(1 + n)) OVER () AS weight FROM e")
def _(spark, sf):
    return ft.coprescription_edges(rx(spark, sf))


_NODES = f"{WITH}, d AS (SELECT DISTINCT patient_id, start_date, drug_id FROM rx), e AS (SELECT DISTINCT a.drug_id AS x, b.drug_id AS y FROM d a JOIN d b ON a.patient_id = b.patient_id AND a.start_date = b.start_date AND a.drug_id <> b.drug_id), g AS (SELECT x, count(*) AS degree FROM e GROUP BY 1), n AS (SELECT drug_id, ln(1 + coalesce(degree, 0)) AS log_degree, ln(1 + n) AS log_frequency, coalesce(degree, 0) AS degree FROM (SELECT drug_id, count(*) AS n FROM rx GROUP BY 1) l LEFT JOIN g ON x = drug_id)"


@query("node_features", _NODES + " SELECT drug_id, log_degree, log_frequency FROM n")
def _(spark, sf):
    r = rx(spark, sf)
    return ft.node_features(r, ft.coprescription_edges(r))


@query("graph_quality", _NODES + " SELECT CAST(count(*) AS BIGINT) AS n_nodes, avg(CAST(degree = 0 AS DOUBLE)) AS isolated_ratio, avg(degree) AS mean_degree FROM n")
def _(spark, sf):
    r = rx(spark, sf)
    return ft.graph_quality(ft.node_features(r, ft.coprescription_edges(r)))


@query("robust_scale", "WITH q AS (SELECT quantile_cont(l_quantity, 0.5) AS m1, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS r1, quantile_cont(l_extendedprice, 0.5) AS m2, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS r2 FROM lineitem) SELECT l_orderkey, l_linenumber, (l_quantity - m1) / r1 AS l_quantity, (l_extendedprice - m2) / r2 AS l_extendedprice FROM lineitem, q")
def _(spark, sf):
    return ft.robust_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])


@query("feature_corr", "SELECT 'l_quantity' AS a, 'l_quantity' AS b, var_samp(l_quantity) AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem")
def _(spark, sf):
    return ft.feature_correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("demographics_join", f"{WITH}, {DEMO}, n AS (SELECT patient_id, count(DISTINCT drug_id) AS n_drugs FROM rx GROUP BY 1) SELECT patient_id, n_drugs, CASE WHEN age < 20 THEN '0-19' WHEN age < 40 THEN '20-39' WHEN age < 60 THEN '40-59' WHEN age < 75 THEN '60-74' ELSE '75+' END AS band, sex_type FROM n JOIN demo USING (patient_id)")
def _(spark, sf):
    n = rx(spark, sf).groupBy("patient_id").agg(F.countDistinct("drug_id").alias("n_drugs"))
    return n.join(demographics(spark, sf), "patient_id", "left").select("patient_id", "n_drugs", age_band(F.col("age")).alias("band"), "sex_type")
