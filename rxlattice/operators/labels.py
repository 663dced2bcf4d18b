"""Cohorts and outcome labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import saved

# Diagnosis prefixes, weight and related drug classes of each adverse reaction.
ADR = {
    "bleeding": (["K92", "D68", "I60", "I61", "I62"], 1.0, ["B01AA", "B01AE", "B01AF", "M01A"]),
    "acute_kidney_injury": (["N17", "E87"], 1.0, ["C09AA", "C09CA", "C03DA", "C03DB", "M01A"]),
    "digoxin_toxicity": (["I49", "R11"], 0.9, ["C01AA", "C01BD", "C08DA"]),
    "serotonin_syndrome": (["G25", "R56"], 1.0, ["N06AB", "N06AF", "N06AG", "N02CC"]),
    "hypoglycemia": (["E16", "R55"], 0.8, ["A10A", "A10BB", "A10BC"]),
}


# Disease categories of the Charlson index by ICD-10 prefix, with their weights.
CHARLSON = {
    "myocardial_infarction": (["I21", "I22"], 1),
    "heart_failure": (["I50"], 1),
    "peripheral_vascular": (["I70", "I71"], 1),
    "cerebrovascular": (["I60", "I61", "I62", "I63", "I64", "I65", "I66", "I67", "I68", "I69", "G45", "G46"], 1),
    "dementia": (["F00", "F01", "F02", "F03", "G30"], 1),
    "pulmonary": (["J40", "J41", "J42", "J43", "J44", "J45", "J46", "J47"], 1),
    "rheumatic": (["M05", "M06", "M32", "M33", "M34"], 1),
    "peptic_ulcer": (["K25", "K26", "K27", "K28"], 1),
    "mild_liver": (["K70", "K73", "K74", "B18"], 1),
    "diabetes": (["E10", "E11", "E12", "E13", "E14"], 1),
    "hemiplegia": (["G81", "G82"], 2),
    "renal": (["N03", "N05", "N18", "N19", "N25"], 2),
    "cancer": (["C0", "C1", "C2", "C3", "C4", "C5", "C6", "C81", "C82", "C83", "C84", "C85", "C88", "C9"], 2),
    "severe_liver": (["K72", "K76"], 3),
    "metastatic": (["C77", "C78", "C79", "C80"], 6),
    "hiv": (["B20", "B21", "B22", "B24"], 6),
}


def adr_patterns(spark: SparkSession, patterns: dict = ADR) -> DataFrame:
    return spark.createDataFrame([(k, p, w) for k, (ps, w, _) in patterns.items() for p in ps], "adr string, pattern string, weight double")


def adr_labels(diagnoses: DataFrame, drugs: DataFrame, patterns: dict = ADR, lookback: int = 90) -> DataFrame:
    """Proxy label of each patient with a matching diagnosis 0 to `lookback` days after the prescription.

    diagnoses: patient_id, code, days; drugs: patient_id, atc_code. One row per patient with evidence:
    reactions, score, days to the first, and confidence (HIGH if every reaction has a related drug).
    """
    spark = diagnoses.sparkSession
    recent = diagnoses.where(F.col("days").between(0, lookback)).groupBy("patient_id", "code").agg(F.min("days").alias("days"))
    found = recent.join(F.broadcast(adr_patterns(spark, patterns)), F.col("code").startswith(F.col("pattern"))).groupBy("patient_id", "adr").agg(F.max("weight").alias("weight"), F.min("days").alias("days"))
    related = spark.createDataFrame([(k, p) for k, (_, _, ps) in patterns.items() for p in ps], "adr string, prefix string")
    codes = drugs.select("patient_id", "atc_code").distinct()
    has = codes.join(F.broadcast(related), F.col("atc_code").startswith(F.col("prefix"))).select("patient_id", "adr").distinct().withColumn("related", F.lit(True))
    joined = found.join(has, ["patient_id", "adr"], "left")
    got = joined.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_reactions"), F.sum("weight").alias("adr_score"), F.min("days").alias("first_days"), F.bool_and(F.coalesce("related", F.lit(False))).alias("all_related"), F.array_sort(F.collect_set("adr")).alias("reactions"))
    return got.withColumn("confidence", F.when(F.col("all_related"), "HIGH").otherwise("MEDIUM"))


def merged_label(has_adr: Column, rule_level: Column) -> Column:
    """Red with evidence, else the rule's level, else Normal."""
    return F.when(has_adr, "Red").when(rule_level.isin("Red", "Yellow", "Green"), rule_level).otherwise("Normal")


def distinct_count_label(events: DataFrame, column: str, threshold: int, id_: str = "patient_id") -> DataFrame:
    """Label 1 of patients with `threshold` or more distinct values; blanks don't count."""
    value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    n = events.groupBy(id_).agg(F.countDistinct(value).alias("n"))
    return n.withColumn("label", (F.col("n") >= threshold).cast("int"))


LABEL_SOURCES = ("institutions", "diagnosis", "duplication")


def training_labels(rx: DataFrame, source: str) -> DataFrame:
    """patient_id, label by a chosen source: many institutions, a diagnosis, or classes with several drugs."""
    if source == "institutions":
        return distinct_count_label(rx, "institution_id", 30).select("patient_id", "label")
    if source == "diagnosis":
        hit = F.col("diag_code").startswith("K9") | F.col("diag_code").startswith("N1")
        return rx.groupBy("patient_id").agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("label"))
    if source == "duplication":
        from .features import distinct_class_duplicates

        return distinct_class_duplicates(rx, ["patient_id"]).select("patient_id", (F.col("dup_classes") >= 12).cast("int").alias("label"))
    raise ValueError(f"{source!r} is not one of {', '.join(LABEL_SOURCES)}")


def future_onset(events: DataFrame, cut: str, feature_days: int, outcome_days: int, threshold: int = 3, column: str = "institution_id") -> DataFrame:
    """Onset of many-institution use: feature window up to `cut`, outcome window after it.

    Patients with a row in the feature window; those without one in the outcome window are censored.
    One aggregate over both windows, so no join of the two.
    """
    at = F.lit(cut).cast("date")
    ago = F.datediff("start_date", at)
    rows = events.where(ago.between(-feature_days + 1, outcome_days))
    before, after = ago <= 0, ago > 0
    n = rows.groupBy("patient_id").agg(F.countDistinct(F.when(before, F.col(column))).alias("n_feature"), F.countDistinct(F.when(after, F.col(column))).alias("n_outcome"), F.count_if(after).alias("rows_after"), F.count_if(before).alias("rows_before"))
    n = n.where("rows_before > 0")
    high0, high1, censored = F.col("n_feature") >= threshold, F.col("n_outcome") >= threshold, F.col("rows_after") == 0
    kind = F.when(censored, "censored").when(high0 & high1, "persistent").when(~high0 & high1, "onset").when(high0, "resolved").otherwise("none")
    escalation = F.when(~censored, (F.col("n_outcome") > F.col("n_feature")).cast("int"))
    return n.select("patient_id", "n_feature", "n_outcome", F.when(~censored, high1.cast("int")).alias("label"), kind.alias("kind"), escalation.alias("escalation"))


def elderly_cohort(people: DataFrame, diagnoses: DataFrame, prefixes: list[str], least_age: int = 65) -> DataFrame:
    """Patients of `least_age` or more, or with a diagnosis of the given prefixes."""
    match = F.lit(False)
    for p in prefixes:
        match = match | F.col("code").startswith(p)
    ill = diagnoses.where(match).select("patient_id").distinct().withColumn("ill", F.lit(True))
    return people.join(ill, "patient_id", "left").where((F.col("age") >= least_age) | F.col("ill")).select("patient_id", "age", F.coalesce("ill", F.lit(False)).alias("by_diagnosis"))


def earliest_date(*texts: str) -> Column:
    """The earliest of several yyyyMMdd texts that parse."""
    return F.least(*(F.expr(f"cast(try_to_timestamp({t}, 'yyyyMMdd') as date)") for t in texts))


def threshold_sweep(counts: DataFrame, thresholds: list[int], column: str = "n") -> DataFrame:
    """Positives and their rate for each threshold; thresholds are rows, counts are grouped first."""
    spark = counts.sparkSession
    t = F.broadcast(spark.createDataFrame([(x,) for x in thresholds], "threshold int"))
    by = counts.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return by.crossJoin(t).groupBy("threshold").agg(F.sum(F.when(F.col("v") >= F.col("threshold"), F.col("c")).otherwise(0)).alias("n_positive"), F.sum("c").alias("n_all")).withColumn("rate", F.col("n_positive") / F.col("n_all"))


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """p50, p90, p95, p99 and the greatest value; exact, with linear interpolation."""
    p = F.percentile(column, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    return df.agg(p[0].alias("p50"), p[1].alias("p90"), p[2].alias("p95"), p[3].alias("p99"), F.max(column).cast("double").alias("most"))


def death_exclusion(people: DataFrame, deaths: DataFrame, until: str) -> DataFrame:
    """People but for those who died on or before a day."""
    return people.join(deaths.where(F.col("death_date") <= F.lit(until).cast("date")).select("patient_id").distinct(), "patient_id", "left_anti")


def comorbidity(diagnoses: DataFrame, weights: dict[str, tuple[list[str], int]]) -> DataFrame:
    """Sum of the weights of a patient's distinct disease categories (columns patient_id, code)."""
    spark = diagnoses.sparkSession
    rows = spark.createDataFrame([(k, p, w) for k, (ps, w) in weights.items() for p in ps], "category string, prefix string, weight int")
    found = diagnoses.select("patient_id", "code").distinct().join(F.broadcast(rows), F.col("code").startswith(F.col("prefix"))).select("patient_id", "category", "weight").distinct()
    return found.groupBy("patient_id").agg(F.sum("weight").alias("index"), F.count(F.lit(1)).alias("n_categories"))


#: Column names that a table of contraindicated pairs may have.
PAIR_COLUMNS = (("drug_a_code", "drug_b_code"), ("INGR_CODE", "MIXTURE_INGR_CODE"))


def contraindicated_pairs(table: DataFrame) -> DataFrame:
    """id_lo, id_hi: distinct pairs of different ids, trimmed, from either schema; any other raises."""
    for a, b in PAIR_COLUMNS:
        if a in table.columns and b in table.columns:
            ids = table.select(F.trim(F.col(a).cast("string")).alias("a"), F.trim(F.col(b).cast("string")).alias("b")).where("a <> '' and b <> '' and a <> b")
            return ids.select(F.least("a", "b").alias("id_lo"), F.greatest("a", "b").alias("id_hi")).distinct()
    raise ValueError(f"no pair columns among {', '.join(table.columns)}")


#: Days of a time bucket in which partners meet.
PAIR_BUCKET = 90


def contraindicated_label(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per patient the known pairs among all its drugs and among those taken at once, with both labels.

    lines: patient_id, id, start_date, end_date; pairs: id_lo, id_hi. The joins go from a drug to its known partners
    and from there to the patient's drugs, so a pair that isn't known is never formed. The lines are written once, as
    are the known pairs of each patient, small beside them; only lines of drugs in such a pair are shuffled with their
    days. Partners meet in the 90-day buckets that both touch and count where the later one starts. Patients without
    a hit have zeros.
    """
    lines = saved(lines.select("patient_id", "id", "start_date", "end_date"), "contra-lines")
    known = lines.where(F.col("id").isNotNull())
    drugs = known.select("patient_id", "id").distinct()
    partners = drugs.join(pairs, drugs.id == pairs.id_lo).select("patient_id", "id_lo", F.col("id_hi").alias("id"))
    ever = saved(partners.join(drugs, ["patient_id", "id"]).select("patient_id", "id_lo", F.col("id").alias("id_hi")), "contra-ever")
    day = F.lit("1970-01-01").cast("date")

    def bucket(c: Column) -> Column:
        return F.floor(F.datediff(c, day) / PAIR_BUCKET).cast("int")

    def taken(side: str, s: str, e: str) -> DataFrame:
        """Distinct spans of the drugs on a side of `ever`, in each bucket that they touch."""
        ids = ever.select("patient_id", F.col(side).alias("id")).distinct()
        spans = known.where("start_date <= end_date").join(ids, ["patient_id", "id"], "left_semi").distinct()
        buckets = F.explode(F.sequence(bucket(F.col("start_date")), bucket(F.col("end_date"))))
        return spans.select("patient_id", F.col("id").alias(side), F.col("start_date").alias(s), F.col("end_date").alias(e), buckets.alias("bucket"))

    first = ever.join(taken("id_lo", "s1", "e1"), ["patient_id", "id_lo"])
    met = first.join(taken("id_hi", "s2", "e2"), ["patient_id", "bucket", "id_hi"]).where("s1 <= e2 and s2 <= e1").where(bucket(F.greatest("s1", "s2")) == F.col("bucket"))
    at_once = met.groupBy("patient_id").agg(F.countDistinct("id_lo", "id_hi").alias("overlap_hits"), F.count(F.lit(1)).alias("n_occurrences"))
    hits = ever.groupBy("patient_id").agg(F.count(F.lit(1)).alias("hits"))
    people = lines.groupBy("patient_id").agg(F.countDistinct("id").alias("n_ids")).join(hits, "patient_id", "left").join(at_once, "patient_id", "left").na.fill(0)
    return people.select("patient_id", "n_ids", "hits", "overlap_hits", "n_occurrences", (F.col("hits") > 0).cast("int").alias("label"), (F.col("overlap_hits") > 0).cast("int").alias("overlap_label"))


def rule_labels(features: DataFrame) -> DataFrame:
    """Stage 1: the rule's level as label, and whether it is high (Red); a frame without levels raises."""
    if "risk_level" not in features.columns:
        raise ValueError("the features have no risk_level")
    return features.withColumn("rule_label", F.col("risk_level")).withColumn("is_high_risk_rule", F.coalesce((F.col("risk_level") == "Red"), F.lit(False)).cast("int"))


def reaction_labels(labelled: DataFrame, diagnoses: DataFrame | None, drugs: DataFrame | None, id_: str = "patient_id") -> DataFrame:
    """Stage 2: proxy labels of adverse reactions beside the rules' and the final label.

    Without diagnoses every reaction is 0, with LOW confidence, and the rule decides.
    """
    if diagnoses is None or drugs is None:
        found = labelled.withColumns({"adr_label": F.lit(0), "adr_score": F.lit(0.0), "adr_confidence": F.lit("LOW")})
    else:
        adr = adr_labels(diagnoses, drugs).select(id_, F.lit(1).alias("adr_label"), "adr_score", F.col("confidence").alias("adr_confidence"))
        found = labelled.join(adr, id_, "left").na.fill({"adr_label": 0, "adr_score": 0.0, "adr_confidence": "LOW"})
    return found.withColumn("final_label", merged_label(F.col("adr_label") == 1, F.col("rule_label")))


def review_sample(labelled: DataFrame, shares: dict[str, float], total: int, least: float, id_: str = "patient_id") -> DataFrame:
    """Stage 3: a golden sample by rule level with columns for the experts, whose label starts as the rule's."""
    from .sampling import golden

    sample = golden(labelled, "rule_label", "adr_label", shares, total, least, id_)
    return sample.withColumns({"expert_label": F.col("rule_label"), "expert_comment": F.lit(""), "review_status": F.lit("pending")})


def review_report(sample: DataFrame, labelled: DataFrame) -> DataFrame:
    """name, value: size, share of each level, share of reactions, filled labels, agreement of experts and rules."""
    n = labelled.agg(F.count(F.lit(1)).cast("double").alias("n_all"))
    s = sample.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("adr_label").cast("double")).alias("reactions"), F.avg(F.col("expert_label").isNotNull().cast("double")).alias("completeness"),
        F.avg((F.col("expert_label") == F.col("rule_label")).cast("double")).alias("agreement"), *(F.avg((F.col("rule_label") == k).cast("double")).alias(f"share_{k}") for k in ("Red", "Yellow", "Green", "Normal")),
    )
    both = s.crossJoin(n)
    return both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in both.columns))))
