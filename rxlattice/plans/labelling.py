"""Queries for concurrency over time, contraindicated labels, the labelling job and scoring inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import labels as lb
from ..operators import rules as ru
from ..operators import sampling as sp
from ..tables import saved
from .binding import RX, SCORED, rx, scored
from .claims import _FEATURES, _LEVEL, graded
from .knowledge import PAIRS, pairs
from .registry import query

WITH = f"WITH {RX}"


@query("concurrency", f"""{WITH}, d AS (SELECT DATE '1998-01-01' + CAST(i AS INT) AS day FROM range(181) r(i)), n AS (SELECT patient_id, day, count(*) AS n FROM rx JOIN d ON day BETWEEN start_date AND end_date GROUP BY 1, 2)
  SELECT patient_id, max(n) AS max_concurrent, sum(n)::DOUBLE / 181 AS avg_concurrent, 181 AS days FROM n GROUP BY 1""")
def _(spark, sf):
    """Half a year, day by day in the SQL, by a sweep over events here."""
    got = iv.concurrency(rx(spark, sf), "1998-01-01", "1998-06-30")
    return got.withColumn("days", F.col("days").cast("int"))


@query("concurrency_own", f"""{WITH}, w AS (SELECT patient_id, min(start_date) AS a, max(end_date) AS b, sum(date_diff('day', start_date, end_date) + 1) AS line_days FROM rx GROUP BY 1), e AS (SELECT patient_id, start_date AS d, 1 AS n FROM rx UNION ALL SELECT patient_id, end_date + 1, -1 FROM rx),
  s AS (SELECT patient_id, d, sum(n) AS n FROM e GROUP BY 1, 2), r AS (SELECT patient_id, sum(n) OVER (PARTITION BY patient_id ORDER BY d) AS n FROM s), m AS (SELECT patient_id, CAST(max(n) AS BIGINT) AS max_concurrent FROM r GROUP BY 1)
  SELECT patient_id, max_concurrent, line_days::DOUBLE / (date_diff('day', a, b) + 1) AS avg_concurrent, date_diff('day', a, b) + 1 AS days FROM w JOIN m USING (patient_id)""")
def _(spark, sf):
    return iv.concurrency(rx(spark, sf))


_KNOWN = f"{PAIRS}, k AS (SELECT DISTINCT least(CAST(a_id AS VARCHAR), CAST(b_id AS VARCHAR)) AS lo, greatest(CAST(a_id AS VARCHAR), CAST(b_id AS VARCHAR)) AS hi FROM pairs WHERE severity = 'Contraindicated' AND a_id <> b_id)"


@query("contra_overlap", f"""{WITH}, {_KNOWN}, l AS (SELECT DISTINCT patient_id, CAST(drug_id AS VARCHAR) AS id, start_date, end_date FROM rx), d AS (SELECT DISTINCT patient_id, id FROM l), n AS (SELECT patient_id, count(*) AS n_ids FROM d GROUP BY 1),
  h AS (SELECT a.patient_id, count(*) AS hits FROM d a JOIN d b ON a.patient_id = b.patient_id AND a.id < b.id JOIN k ON lo = a.id AND hi = b.id GROUP BY 1),
  o AS (SELECT a.patient_id, count(DISTINCT lo || ' ' || hi) AS overlap_hits, count(*) AS n_occurrences FROM l a JOIN l b ON a.patient_id = b.patient_id AND a.id < b.id AND a.start_date <= b.end_date AND b.start_date <= a.end_date JOIN k ON lo = a.id AND hi = b.id GROUP BY 1)
  SELECT patient_id, n_ids, coalesce(hits, 0) AS hits, coalesce(overlap_hits, 0) AS overlap_hits, coalesce(n_occurrences, 0) AS n_occurrences, CAST(coalesce(hits, 0) > 0 AS INT) AS label, CAST(coalesce(overlap_hits, 0) > 0 AS INT) AS overlap_label FROM n LEFT JOIN h USING (patient_id) LEFT JOIN o USING (patient_id)""")
def _(spark, sf):
    """Contraindicated pairs among all drugs of a patient and among those taken on a common day."""
    codes = pairs(spark, sf).where("severity = 'Contraindicated'").selectExpr("a_id as INGR_CODE", "b_id as MIXTURE_INGR_CODE")
    lines = rx(spark, sf).select("patient_id", F.col("drug_id").cast("string").alias("id"), "start_date", "end_date")
    return lb.contraindicated_label(lines, lb.contraindicated_pairs(codes))


@query("pair_merge", f"""WITH {PAIRS}, m AS (SELECT a_id % 10 AS grp, least(lower(a_name), lower(b_name)) AS name_lo, greatest(lower(a_name), lower(b_name)) AS name_hi, max(CASE severity WHEN 'Contraindicated' THEN 4 WHEN 'Major' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END) AS r FROM pairs WHERE a_id <> b_id GROUP BY 1, 2, 3)
  SELECT grp, name_lo, name_hi, CASE r WHEN 4 THEN 'Contraindicated' WHEN 3 THEN 'Major' WHEN 2 THEN 'Moderate' WHEN 1 THEN 'Minor' END AS severity, count(*) FILTER (r = 4) OVER w AS n_contraindicated, count(*) FILTER (r = 3) OVER w AS n_major, count(*) FILTER (r = 2) OVER w AS n_moderate, count(*) FILTER (r = 1) OVER w AS n_minor FROM m WINDOW w AS (PARTITION BY grp)""")
def _(spark, sf):
    return ru.higher_pairs(pairs(spark, sf).withColumn("grp", F.col("a_id") % 10), ["grp"])


_PRESENT = ["No_Alert", "Y_DUP", "Y_TRIPLE", "Y_DDI_MOD"]
_LOCAL = [f"((id * {k + 3}) % 10 + 1)" for k in range(4)]


@query("class_reorder", f"""WITH {SCORED}, l AS (SELECT id, score, {', '.join(f'{e}::DOUBLE / ({" + ".join(_LOCAL)}) AS l{k}' for k, e in enumerate(_LOCAL))} FROM scored), g AS (SELECT id, score, [l2, 0.0::DOUBLE, 0.0::DOUBLE, l3, l1, 0.0::DOUBLE, l0] AS p FROM l),
  c AS (SELECT *, ['Y_TRIPLE', 'Y_DOUBLE', 'Y_DDI_MAJOR', 'Y_DDI_MOD', 'Y_DUP', 'Y_FRAG', 'No_Alert'][list_position(p, list_max(p))] AS subtype FROM g), d AS (SELECT *, CASE WHEN score >= 0.9 THEN 'Red' WHEN score >= 0.6 THEN 'REVIEW' ELSE subtype END AS decision FROM c)
  SELECT id, {', '.join(f'p[{k + 1}] AS p{k}' for k in range(7))}, subtype, decision, CASE decision WHEN 'Red' THEN 'immediate' WHEN 'REVIEW' THEN 'pharmacist_review' WHEN 'Y_DDI_MAJOR' THEN 'call' WHEN 'Y_TRIPLE' THEN 'message' ELSE 'monitor' END AS action FROM d""")
def _(spark, sf):
    """The output of a model that knows four classes, in an order of its own, as probabilities of all seven."""
    raw = [(F.col("id") * (k + 3)) % 10 + 1 for k in range(4)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    s = scored(spark, sf).select("id", "score", F.array(*(r / total for r in raw)).alias("local"))
    s = s.withColumn("p", ru.global_probabilities(F.col("local"), _PRESENT)).withColumn("subtype", ru.likeliest(F.col("p")))
    decision, action = ru.two_stage(F.col("score"), F.col("subtype"), 0.9, 0.6)
    return s.select("id", *(F.col("p")[k].alias(f"p{k}") for k in range(7)), "subtype", decision.alias("decision"), action.alias("action"))


@query("history_encoding", f"""{WITH}, v AS (SELECT drug_id, row_number() OVER (ORDER BY n DESC, drug_id) AS idx FROM (SELECT drug_id, count(*) AS n FROM rx WHERE start_date < DATE '1997-01-01' GROUP BY 1)), m AS (SELECT max(n)::DOUBLE AS most FROM (SELECT count(DISTINCT institution_id) AS n FROM rx WHERE start_date < DATE '1997-01-01' GROUP BY patient_id)),
  e AS (SELECT patient_id, drug_id, idx, institution_id FROM rx LEFT JOIN v USING (drug_id) WHERE start_date >= DATE '1997-01-01') SELECT patient_id, array_to_string(list_sort(list_distinct(list(coalesce(idx, 0)))), ',') AS columns, count(DISTINCT drug_id) FILTER (idx IS NOT NULL) AS n_known, count(DISTINCT drug_id) FILTER (idx IS NULL) AS n_unknown, count(DISTINCT institution_id) / any_value(most) AS places FROM e, m GROUP BY 1""")
def _(spark, sf):
    """Later lines by the vocabulary and the scale of the earlier ones."""
    r = rx(spark, sf).select("patient_id", "drug_id", "institution_id", "start_date")
    old, new = r.where("start_date < date '1997-01-01'"), r.where("start_date >= date '1997-01-01'")
    most = old.groupBy("patient_id").agg(F.countDistinct("institution_id").alias("n")).agg(F.max("n")).first()[0]
    got = sp.encode_history(new, sp.dense_index(old.groupBy("drug_id").agg(F.count(F.lit(1)).alias("n")), "drug_id"), "drug_id", "institution_id", most or 1)
    return got.withColumn("columns", F.array_join(F.col("columns").cast("array<string>"), ","))


_SHARES = {"Red": 0.3, "Yellow": 0.3, "Green": 0.25, "Normal": 0.15}
_ADR_SQL = " OR ".join(f"diag_code LIKE '{p}%'" for ps, _, _ in lb.ADR.values() for p in ps)


def _levels(spark, sf):
    """The highest level of each patient."""
    level = F.max_by("risk_level", ru.level_code(F.col("risk_level"))).alias("risk_level")
    return graded(spark, sf).groupBy("patient_id").agg(level)


@query("labelling_job", _FEATURES + _LEVEL + f""", p AS (SELECT patient_id, ['Normal', 'Green', 'Yellow', 'Red'][1 + max(CASE risk_level WHEN 'Red' THEN 3 WHEN 'Yellow' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END)] AS rule_label FROM typed GROUP BY 1),
  a AS (SELECT DISTINCT patient_id FROM rx WHERE bill_no % 3 = 0 AND ({_ADR_SQL})), l AS (SELECT p.*, CAST(a.patient_id IS NOT NULL AS INT) AS adr_label FROM p LEFT JOIN a USING (patient_id))
  SELECT rule_label, adr_label, CASE WHEN adr_label = 1 THEN 'Red' ELSE rule_label END AS final_label, CAST(rule_label = 'Red' AS INT) AS is_high_risk_rule, count(*) AS n FROM l GROUP BY ALL""")
def _(spark, sf):
    """The first two stages of the labelling job over all patients; the third is a sample, see `labelling_review`."""
    labelled = _labelled(spark, sf)
    return labelled.groupBy("rule_label", "adr_label", "final_label", "is_high_risk_rule").agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, sf):
    r = rx(spark, sf)
    diagnoses = r.where("bill_no % 3 = 0").select("patient_id", F.col("diag_code").alias("code"), F.lit(10).alias("days"))
    return lb.reaction_labels(lb.rule_labels(_levels(spark, sf)), diagnoses, r.select("patient_id", "atc_code"))


@query("labelling_review")
def _(spark, sf):
    """The review sample of the labelling job with its checks."""
    labelled = saved(_labelled(spark, sf), "labelled")
    return lb.review_report(lb.review_sample(labelled, _SHARES, 40, 0.2), labelled)
