"""The claims model over the driver's tables, for Spark and as SQL text for the oracle.

`rx` is one row per drug line: lineitem is the line, orders the claim header, part the drug.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import components
from ..operators import features as ft
from ..operators import knowledge as kn
from ..operators import rules as ru
from ..operators import safety as sy

#: Drugs share interaction ids: drug_id modulo this; every seventh drug is a combination with a second id.
N_IDS = 50

#: Medicines that drugs stand for, by drug_id modulo their number: product name, ATC code, components.
MEDICINES = [
    ("Warfarin sodium 2mg", "B01AA03", ["warfarin"]),
    ("Ibuprofen 200mg", "M01AE01", ["ibuprofen"]),
    ("Clopidogrel 75mg", "B01AC04", ["clopidogrel"]),
    ("Omeprazole magnesium 20mg", "A02BC01", ["omeprazole"]),
    ("Enalapril maleate 5mg", "C09AA02", ["enalapril"]),
    ("Losartan potassium, hydrochlorothiazide", "C09DA01", ["losartan", "hydrochlorothiazide"]),
    ("Spironolactone 25mg", "C03DA01", ["spironolactone"]),
    ("Digoxin 0.25mg", "C01AA05", ["digoxin"]),
    ("Amiodarone hydrochloride 200mg", "C01BD01", ["amiodarone"]),
    ("Methotrexate 2.5mg", "L01BA01", ["methotrexate"]),
    ("Trimethoprim, sulfamethoxazole", "J01EE01", ["trimethoprim", "sulfamethoxazole"]),
    ("Sertraline hydrochloride 50mg", "N06AB06", ["sertraline"]),
    ("Selegiline hydrochloride 5mg", "N04BD01", ["selegiline"]),
    ("Sumatriptan succinate 50mg", "N02CC01", ["sumatriptan"]),
    ("Lithium carbonate 300mg", "N05AN01", ["lithium"]),
    ("Haloperidol 5mg", "N05AD01", ["haloperidol"]),
    ("Levofloxacin hydrate 500mg", "J01MA12", ["levofloxacin"]),
    ("Simvastatin 20mg", "C10AA01", ["simvastatin"]),
    ("Clarithromycin 250mg", "J01FA09", ["clarithromycin"]),
    ("Amlodipine besylate 5mg", "C08CA01", ["amlodipine"]),
    ("Telmisartan, amlodipine (as amlodipine besylate 6.9mg)", "C09DB04", ["telmisartan", "amlodipine"]),
    ("Naproxen sodium 550mg", "M01AE02", ["naproxen"]),
    ("Insulin glargine", "A10AE04", ["insulin glargine"]),
    ("Atenolol 50mg", "C07AB03", ["atenolol"]),
    ("Verapamil hydrochloride 80mg", "C08DA01", ["verapamil"]),
    ("Tramadol hydrochloride 50mg", "N02AX02", ["tramadol"]),
    ("Lorazepam 1mg", "N05BA06", ["lorazepam"]),
    ("Cetirizine hydrochloride 10mg", "R06AE07", ["cetirizine"]),
]


#: Enzyme roles of some of their components: component, enzyme, action, whether strong.
ENZYME_ROLES = [
    ("warfarin", "cyp2c9", "substrate", False), ("warfarin", "cyp3a4", "substrate", False), ("ibuprofen", "cyp2c9", "substrate", False), ("clopidogrel", "cyp2c19", "substrate", False),
    ("omeprazole", "cyp2c19", "substrate", False), ("omeprazole", "cyp2c19", "inhibitor", True), ("losartan", "cyp2c9", "substrate", False), ("amiodarone", "cyp2d6", "inhibitor", False),
    ("amiodarone", "cyp2c9", "inhibitor", True), ("sertraline", "cyp2d6", "inhibitor", True), ("simvastatin", "cyp3a4", "substrate", False), ("clarithromycin", "cyp3a4", "inhibitor", True),
    ("amlodipine", "cyp3a4", "substrate", False), ("haloperidol", "cyp2d6", "substrate", False), ("verapamil", "cyp3a4", "inhibitor", False), ("tramadol", "cyp2d6", "substrate", False),
    ("sulfamethoxazole", "cyp2c9", "inhibitor", False), ("levofloxacin", "cyp1a2", "inhibitor", False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rx(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate")
    heads = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    drugs = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    joined = lines.join(heads, lines.l_orderkey == heads.o_orderkey).join(drugs, lines.l_partkey == drugs.p_partkey)
    return joined.selectExpr(
        "o_custkey as patient_id", "l_suppkey as institution_id", "l_orderkey as bill_no", "l_linenumber as line_no", "l_partkey as drug_id",
        "cast(l_shipdate as date) as start_date", "greatest(1, cast(l_quantity as int)) as total_days",
        "date_add(cast(l_shipdate as date), greatest(1, cast(l_quantity as int)) - 1) as end_date",
        "p_name as product_name", "p_brand as class_no",
        "upper(substr(p_type,1,1)) || lpad(cast(p_size % 20 as string),2,'0') || substr('ABCDE', cast(1 + p_partkey % 5 as int), 1) || substr('ABC', cast(1 + p_partkey % 3 as int), 1) || lpad(cast(p_partkey % 10 as string),2,'0') as atc_code",
        "case when l_linestatus = 'F' then 'T30' else 'T60' end as source",
        "substr('EKNRG', cast(1 + l_partkey % 5 as int), 1) || lpad(cast(l_suppkey % 100 as string),2,'0') as diag_code",
    )


RX = """rx AS (
  SELECT o_custkey AS patient_id, l_suppkey AS institution_id, l_orderkey AS bill_no, l_linenumber AS line_no, l_partkey AS drug_id,
    CAST(l_shipdate AS DATE) AS start_date, greatest(1, CAST(l_quantity AS INT)) AS total_days,
    CAST(l_shipdate AS DATE) + greatest(1, CAST(l_quantity AS INT)) - 1 AS end_date, p_name AS product_name, p_brand AS class_no,
    upper(substr(p_type,1,1)) || lpad(CAST(p_size % 20 AS string),2,'0') || substr('ABCDE', CAST(1 + p_partkey % 5 AS INT), 1)
      || substr('ABC', CAST(1 + p_partkey % 3 AS INT), 1) || lpad(CAST(p_partkey % 10 AS string),2,'0') AS atc_code,
    CASE WHEN l_linestatus = 'F' THEN 'T30' ELSE 'T60' END AS source,
    substr('EKNRG', CAST(1 + l_partkey % 5 AS INT), 1) || lpad(CAST(l_suppkey % 100 AS string),2,'0') AS diag_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""



def medicines(spark: SparkSession) -> DataFrame:
    """med, med_name, med_atc: the fixed list of MEDICINES."""
    return spark.createDataFrame([(k, name, atc) for k, (name, atc, _) in enumerate(MEDICINES)], "med long, med_name string, med_atc string")


#: Risk groups that a medicine is in by its name or code.
_GROUPS = {"high_risk": ft.HIGH_RISK, "renal_risk": ft.RENAL_RISK, "hepatic_risk": ft.HEPATIC_RISK, "qt": ru.GROUPS["qt_prolonging"]}


def with_kinds(meds: DataFrame) -> DataFrame:
    """Adds what a medicine is by its name and code: parts (components), risk flags, QT group, and all of it as bits."""
    name, atc = F.col("med_name"), F.col("med_atc")
    kinds = meds.withColumns({"parts": F.array_distinct(components(name)), **{n: ft.in_group(name, atc, g) for n, g in _GROUPS.items()}})
    return kinds.withColumn("flags", sy.medicine_flags(name, atc, F.col("parts"), _GROUPS, ENZYME_ROLES))


@lru_cache(maxsize=4)
def _kinds(spark: SparkSession) -> DataFrame:
    """The fixed list with its kinds; its plan is built once a session."""
    return with_kinds(medicines(spark))


def with_medicine(rows: DataFrame) -> DataFrame:
    """Rows with a drug_id, with its medicine and kinds. The list is a literal, so its broadcast is bounded."""
    return rows.join(F.broadcast(_kinds(rows.sparkSession)), F.col("drug_id") % len(MEDICINES) == F.col("med"))


def rx_meds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`rx` with the medicine of each line and its kinds."""
    return with_medicine(rx(spark, sf_dir))


def _text(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def enzymes_sql(lines: str) -> str:
    """CTEs `enz` and `cyp`: distinct medicines per (patient, bucket) in each enzyme role, and the scores from them."""
    rows = [(k, e, r, s) for k, (_, _, parts) in enumerate(MEDICINES) for c, e, r, s in ENZYME_ROLES if c in parts]
    counts = ", ".join(
        f"count(DISTINCT med) FILTER (e = '{e}' AND {w}) AS {e}_{n}" for e in kn.ENZYMES for n, w in (("sub", "r = 'substrate'"), ("strong", "r = 'inhibitor' AND s"), ("inh", "r = 'inhibitor'"))
    )
    risk = [f"({e}_strong * 3.0 + {e}_inh + {e}_strong * {e}_sub * 2.0) * {w}" for e, w in kn.ENZYME_WEIGHTS.items()]
    return (
        f"roles(med, e, r, s) AS (VALUES {', '.join(f"({k}, '{e}', '{r}', {s})" for k, e, r, s in rows)}), enz AS (SELECT patient_id, bucket, {counts} FROM {lines} JOIN roles ON med = drug_id % {len(MEDICINES)} GROUP BY 1, 2), "
        f"cyp AS (SELECT patient_id, bucket, ({' + '.join(risk)})::DOUBLE AS cyp_risk_score, greatest({', '.join(risk)})::DOUBLE AS cyp_max_enzyme_risk, {' + '.join(f'{e}_strong * {e}_sub' for e in kn.ENZYMES)} AS cyp_high_risk_pairs FROM enz)"
    )


#: `rx` with med_name, med_atc and the components that the medicine is known to have.
MEDS = (
    "meds(med, med_name, med_atc, comps) AS (VALUES " + ", ".join(f"({k}, '{n}', '{a}', {_text(c)})" for k, (n, a, c) in enumerate(MEDICINES)) + "), "
    f"rxm AS (SELECT rx.*, med_name, med_atc, comps FROM rx JOIN meds ON drug_id % {len(MEDICINES)} = med)"
)


def interaction_ids(drug: str) -> Column:
    """Ids of a drug in the interaction matrix; a combination has two."""
    own = F.array((F.col(drug) % N_IDS).cast("long"))
    return F.when(F.col(drug) % 7 == 0, F.concat(own, F.array(((F.col(drug) * 3 + 1) % N_IDS).cast("long")))).otherwise(own)


def ids_sql(drug: str) -> str:
    return f"CASE WHEN {drug} % 7 = 0 THEN [{drug} % {N_IDS}, ({drug} * 3 + 1) % {N_IDS}] ELSE [{drug} % {N_IDS}] END"


def rated_sql(pairs: str, keys: str = "patient_id") -> str:
    """CTE body: the distinct (keys, drug_a, drug_b) of `pairs` with the best rank over the ids of both sides."""
    return (
        f"SELECT {keys}, drug_a, drug_b, coalesce(max(kb.rank), 0) AS rank FROM (SELECT *, unnest(ids_b) AS ib FROM (SELECT *, unnest({ids_sql('drug_a')}) AS ia, {ids_sql('drug_b')} AS ids_b FROM {pairs})) p "
        "LEFT JOIN kb ON id_lo = least(ia, ib) AND id_hi = greatest(ia, ib) GROUP BY ALL"
    )


#: 90-day buckets of the start date, the grain of features and risk.
BUCKET = "CAST(floor(date_diff('day', DATE '1995-01-01', start_date) / 90.0) AS INT)"

#: Occurrences of two drugs taken at once for at least 7 days.
OCC = """occ AS (
  SELECT a.patient_id, a.drug_id AS drug_a, b.drug_id AS drug_b, greatest(a.start_date, b.start_date) AS overlap_start,
    least(a.end_date, b.end_date) AS overlap_end, date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1 AS overlap_days,
    a.institution_id AS institution_a, b.institution_id AS institution_b, a.atc_code AS atc_a, b.atc_code AS atc_b, a.class_no AS class_a, b.class_no AS class_b
  FROM rx a JOIN rx b ON a.patient_id = b.patient_id AND a.drug_id < b.drug_id
   AND date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1 >= 7)"""

KB = """kb AS (
  SELECT a AS id_lo, b AS id_hi, CASE WHEN k = 0 THEN 'Contraindicated' WHEN k <= 2 THEN 'Major' WHEN k <= 5 THEN 'Moderate' ELSE 'Minor' END AS severity,
    CASE WHEN k = 0 THEN 4 WHEN k <= 2 THEN 3 WHEN k <= 5 THEN 2 ELSE 1 END AS rank
  FROM (SELECT a, b, (a * 7 + b * 13) % 10 AS k FROM range(50) x(a), range(50) y(b) WHERE a < b) WHERE k <= 6)"""


def interactions(spark: SparkSession) -> DataFrame:
    """The interaction matrix: a_id, b_id, a_name, b_name, severity. Fixed size: N_IDS squared."""
    n = N_IDS
    return (
        spark.range(n * n).selectExpr(f"cast(id div {n} as bigint) as a", f"cast(id % {n} as bigint) as b").where("a < b").withColumn("k", F.expr("(a * 7 + b * 13) % 10")).where("k <= 6")
        .selectExpr("a as drug_a_id", "b as drug_b_id", "concat('drug', a) as drug_a_name", "concat('drug', b) as drug_b_name", "case when k = 0 then 'Contraindicated' when k <= 2 then 'Major' when k <= 5 then 'Moderate' else 'Minor' end as severity")
    )


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as patient_id", "cast(abs(c_acctbal) as int) % 100 as age", "cast(1 + c_custkey % 2 as string) as sex_type", "c_nationkey as region")


DEMO = "demo AS (SELECT c_custkey AS patient_id, CAST(trunc(abs(c_acctbal)) AS INT) % 100 AS age, CAST(1 + c_custkey % 2 AS VARCHAR) AS sex_type, c_nationkey AS region FROM customer)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores: y, score in 0..1, group."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return labels.join(docs, "doc_id").selectExpr("doc_id as id", "quality as y", "toxic as y2", "(n_chars % 1000) / 1000.0D as score", "lang as grp")


SCORED = "scored AS (SELECT l.doc_id AS id, quality AS y, toxic AS y2, (n_chars % 1000) / 1000.0::DOUBLE AS score, lang AS grp FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
