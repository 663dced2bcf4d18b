"""Interaction knowledge: pair lookups, source merges, name indexes, enzyme matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("Minor", "Moderate", "Major", "Contraindicated")
ENZYMES = ("cyp3a4", "cyp2d6", "cyp2c9", "cyp2c19", "cyp1a2")
#: Rows up to which a lookup table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000

# Other names of ingredients.
SYNONYMS = {
    "diphenylhydantoin": "phenytoin", "sodium valproate": "valproic acid", "valproate semisodium": "valproic acid", "valproate": "valproic acid",
    "divalproex": "valproic acid", "levothyroxine sodium": "levothyroxine", "thyroxine": "levothyroxine", "acetylsalicylic acid": "aspirin",
    "salicylic acid acetyl": "aspirin", "paracetamol": "acetaminophen", "metamizole": "dipyrone",
    "methylprednisolone sodium succinate": "methylprednisolone", "prednisolone sodium phosphate": "prednisolone", "dexamethasone sodium phosphate": "dexamethasone", "thiamine": "vitamin b1", "pyridoxine": "vitamin b6",
    "cobalamin": "vitamin b12", "cyanocobalamin": "vitamin b12", "ergocalciferol": "vitamin d2", "cholecalciferol": "vitamin d3", "retinol": "vitamin a",
    "tocopherol": "vitamin e", "phytomenadione": "phytonadione", "glyceryl trinitrate": "nitroglycerin", "salbutamol": "albuterol", "frusemide": "furosemide",
    "ciclosporin": "cyclosporine", "nifedipine retard": "nifedipine", "glibenclamide": "glyburide", "bendroflumethiazide": "bendrofluazide", "co-amoxiclav": "amoxicillin", "sultamicillin": "ampicillin",
}


def rank(severity: Column) -> Column:
    """1 to 4 by severity; 0 for unknown labels, which never win."""
    out = F.when(F.lit(False), 0)
    for k, name in enumerate(SEVERITIES, 1):
        out = out.when(severity == name, k)
    return out.otherwise(0)


def severity(r: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, name in enumerate(SEVERITIES, 1):
        out = out.when(r == k, name)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows; the count, a job of its own, stops one row above."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pair_dedup(pairs: DataFrame) -> DataFrame:
    """One row per unordered id pair with its highest severity (columns a_id, b_id, severity)."""
    got = pairs.select(F.least("a_id", "b_id").alias("id_lo"), F.greatest("a_id", "b_id").alias("id_hi"), rank(F.col("severity")).alias("rank"))
    best = got.where("id_lo is not null and id_hi is not null").groupBy("id_lo", "id_hi").agg(F.max("rank").alias("rank"))
    return best.withColumn("severity", severity(F.col("rank")))


def severity_lookup(matrix: DataFrame) -> DataFrame:
    """id_lo, id_hi, rank: the symmetric lookup; rows with a blank id or severity are skipped."""
    rows = matrix.selectExpr("drug_a_id as a_id", "drug_b_id as b_id", "severity").where("severity is not null and trim(severity) <> ''")
    return pair_dedup(rows).where("rank > 0").select("id_lo", "id_hi", "rank", "severity")


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two interaction sources (a_name, b_name, severity): the first one wins a pair of lower-case names."""
    both = first.select(F.lit(1).alias("priority"), F.lower("a_name").alias("a"), F.lower("b_name").alias("b"), F.lit("Contraindicated").alias("severity")).unionByName(
        second.select(F.lit(2).alias("priority"), F.lower("a_name").alias("a"), F.lower("b_name").alias("b"), "severity")
    )
    keyed = both.select("priority", F.least("a", "b").alias("name_lo"), F.greatest("a", "b").alias("name_hi"), "severity", rank(F.col("severity")).alias("rank"))
    best = F.min(F.struct("priority", (-F.col("rank")).alias("r"), "severity")).alias("best")
    return keyed.groupBy("name_lo", "name_hi").agg(best).select("name_lo", "name_hi", F.col("best.severity").alias("severity"), F.col("best.priority").alias("priority"))


def name_index(names: DataFrame) -> DataFrame:
    """Unique lower-case names with the id registered first (columns name, id, place)."""
    return names.groupBy(F.lower("name").alias("name")).agg(F.min_by("id", F.struct("place", "id")).alias("id"))


def code_map(rows: DataFrame) -> DataFrame:
    """Code to id from rows with several codes in one cell, cut at | (columns codes, id, place): the last one wins."""
    each = rows.select(F.explode(F.split("codes", r"\|")).alias("atc"), "id", "place").where("atc <> ''")
    return each.groupBy("atc").agg(F.max_by("id", F.struct("place", "id")).alias("id"))


def names_within(texts: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Each text with each known name (column name) that stands in it as whole words; texts without one once, with null.

    A name is looked up by its first word, so texts and names meet by an equi join and no pair is made that
    shares no word.
    """
    first = names.select("name", F.split_part("name", F.lit(" "), F.lit(1)).alias("_w"))
    words = texts.select(column, F.explode(F.array_distinct(F.split(F.lower(column), " "))).alias("_w"))
    whole = F.concat(F.lit(" "), F.lower(column), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("name"), F.lit(" ")))
    hits = words.join(first, "_w").where(whole).select(column, "name").distinct()
    return texts.join(hits, column, "left")


def cyp_matrix(actions: DataFrame) -> DataFrame:
    """Drug x enzyme counts of actions (columns drug, enzyme, action, strength, known); known 'no' is dropped."""
    rows = actions.where("known is null or lower(known) <> 'no'")
    cols: list[Column] = []
    for e in ENZYMES:
        of = F.col("enzyme") == e
        for action in ("substrate", "inhibitor", "inducer"):
            cols.append(F.count_if(of & (F.col("action") == action)).alias(f"{e}_{action}_count"))
        cols.append(F.count_if(of & (F.col("action") == "inhibitor") & (F.col("strength") == "strong")).alias(f"{e}_inhibitor_strong_count"))
    got = rows.groupBy("drug").agg(*cols)
    return got.select("*", *((F.col(f"{e}_inhibitor_count") + F.col(f"{e}_inducer_count") > 0).cast("int").alias(f"{e}_interaction_risk") for e in ENZYMES))


# Weight of an enzyme in the risk score.
ENZYME_WEIGHTS = {"cyp3a4": 3.0, "cyp2d6": 2.0, "cyp2c9": 2.0, "cyp2c19": 1.5, "cyp1a2": 1.0}


def cyp_features(taken: DataFrame, matrix: DataFrame) -> DataFrame:
    """Enzyme features of each patient's drugs (columns patient_id, drug; matrix: `cyp_matrix`)."""
    aggs: list[Column] = []
    for e in ENZYMES:
        aggs += [F.count_if(F.col(f"{e}_{kind}_count") > 0).alias(f"{e}_{short}") for kind, short in (("substrate", "sub"), ("inhibitor_strong", "strong"), ("inhibitor", "inh"))]
    got = taken.join(small(matrix), "drug", "left").groupBy("patient_id").agg(*aggs)
    from .safety import enzyme_scores

    pairs = {e: F.col(f"{e}_strong") * F.col(f"{e}_sub") for e in ENZYMES}
    return got.select(
        "patient_id", *(F.col(f"{e}_sub").alias(f"{e}_substrates") for e in ENZYMES), *(F.col(f"{e}_strong").alias(f"{e}_strong_inhibitors") for e in ENZYMES),
        *(pairs[e].alias(f"{e}_pairs") for e in ENZYMES), *(v.alias(n) for n, v in enzyme_scores().items()),
    )


def pairs_with_severity(pairs: DataFrame, ids_a: Column, ids_b: Column, lookup: DataFrame) -> DataFrame:
    """Best severity of each drug pair over the cross product of both sides' interaction ids.

    The id arrays are exploded and met with the lookup by an equi join; pairs without a hit get rank 0.
    """
    keys = pairs.columns
    ids = pairs.withColumn("_a", F.explode_outer(ids_a)).withColumn("_b", F.explode_outer(ids_b))
    ids = ids.withColumn("id_lo", F.least("_a", "_b")).withColumn("id_hi", F.greatest("_a", "_b"))
    hit = ids.join(small(lookup.select("id_lo", "id_hi", "rank")), ["id_lo", "id_hi"], "left")
    best = hit.groupBy(*keys).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("rank"))
    return best.withColumn("severity", severity(F.col("rank")))


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct unordered id pairs (columns a_id, b_id)."""
    return pairs.select(F.least("a_id", "b_id").alias("id_lo"), F.greatest("a_id", "b_id").alias("id_hi")).where("id_lo is not null").distinct()


def with_synonyms(names: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of names (column name); a name that isn't known is looked up under its other name."""
    spark = names.sparkSession
    other = spark.createDataFrame(sorted(SYNONYMS.items()), "name string, other string")
    got = names.join(known, "name", "left").join(F.broadcast(other), "name", "left")
    second = known.select(F.col("name").alias("other"), F.col("id").alias("other_id"))
    return got.join(second, "other", "left").select("name", F.coalesce("id", "other_id").alias("id"))


def coverage(mapped: DataFrame, column: str) -> DataFrame:
    """Rows, unmapped rows and the unmapped rate of a mapping."""
    return mapped.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_unmapped"), F.avg(F.when(F.col(column).isNull(), 1.0).otherwise(0.0)).alias("unmapped_rate"))


def violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
