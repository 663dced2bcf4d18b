"""Queries over codes, names and interaction knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import knowledge as kn
from .binding import RX, rx, table
from .registry import query

WITH = f"WITH {RX}"

#: Interaction rows bound to order lines: two ids, two names, a severity, a source.
PAIRS = """pairs AS (SELECT l_partkey AS a_id, l_suppkey AS b_id, 'Drug ' || CAST(l_partkey AS VARCHAR) AS a_name, 'DRUG ' || CAST(l_suppkey AS VARCHAR) AS b_name,
  CASE l_linenumber % 6 WHEN 0 THEN 'Contraindicated' WHEN 1 THEN 'Major' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Minor' WHEN 4 THEN 'odd' END AS severity, l_linestatus AS src FROM lineitem)"""
_RANK = "CASE severity WHEN 'Contraindicated' THEN 4 WHEN 'Major' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END"
_NAME = "CASE r WHEN 4 THEN 'Contraindicated' WHEN 3 THEN 'Major' WHEN 2 THEN 'Moderate' WHEN 1 THEN 'Minor' END"


def pairs(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey as a_id", "l_suppkey as b_id", "concat('Drug ', l_partkey) as a_name", "concat('DRUG ', l_suppkey) as b_name",
        "case l_linenumber % 6 when 0 then 'Contraindicated' when 1 then 'Major' when 2 then 'Moderate' when 3 then 'Minor' when 4 then 'odd' end as severity", "l_linestatus as src",
    )


@query("pair_dedup", f"WITH {PAIRS}, m AS (SELECT least(a_id, b_id) AS id_lo, greatest(a_id, b_id) AS id_hi, max({_RANK}) AS r FROM pairs GROUP BY 1, 2) SELECT id_lo, id_hi, r AS rank, {_NAME} AS severity FROM m")
def _(spark, sf):
    return kn.pair_dedup(pairs(spark, sf))


@query("severity_lookup", f"WITH {PAIRS}, m AS (SELECT least(a_id, b_id) AS id_lo, greatest(a_id, b_id) AS id_hi, max({_RANK}) AS r FROM pairs WHERE severity IS NOT NULL GROUP BY 1, 2) SELECT id_lo, id_hi, r AS rank, {_NAME} AS severity FROM m WHERE r > 0")
def _(spark, sf):
    return kn.severity_lookup(pairs(spark, sf).withColumnsRenamed({"a_id": "drug_a_id", "b_id": "drug_b_id"}))


@query("ddi_merge", f"""WITH {PAIRS}, b AS (SELECT 1 AS priority, lower(a_name) AS a, lower(b_name) AS b, 'Contraindicated' AS severity FROM pairs WHERE src = 'F' AND a_id % 5 = 0 UNION ALL SELECT 2, lower(a_name), lower(b_name), severity FROM pairs WHERE src = 'O'),
  k AS (SELECT priority, least(a, b) AS name_lo, greatest(a, b) AS name_hi, severity, {_RANK} AS r FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY name_lo, name_hi ORDER BY priority, r DESC, severity NULLS FIRST) AS n FROM k) SELECT name_lo, name_hi, severity, priority FROM n WHERE n = 1""")
def _(spark, sf):
    p = pairs(spark, sf)
    return kn.merge_sources(p.where("src = 'F' and a_id % 5 = 0"), p.where("src = 'O'"))


@query("matrix_stats", f"WITH {PAIRS} SELECT 'severity' AS what, coalesce(severity, 'none') AS value, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY 2 UNION ALL SELECT 'source', src, count(*) FROM pairs GROUP BY src")
def _(spark, sf):
    facts = F.explode(F.array(F.struct(F.lit("severity").alias("what"), F.coalesce("severity", F.lit("none")).alias("value")), F.struct(F.lit("source").alias("what"), F.col("src").alias("value"))))
    return pairs(spark, sf).select(facts.alias("f")).groupBy("f.what", "f.value").agg(F.count(F.lit(1)).alias("n"))


@query("name_index", "WITH n AS (SELECT lower(p_type) AS name, p_partkey AS id, p_size AS place FROM part) SELECT name, arg_min(id, (place, id)) AS id FROM n GROUP BY 1")
def _(spark, sf):
    return kn.name_index(table(spark, sf, "part").selectExpr("p_type as name", "p_partkey as id", "p_size as place"))


@query("norm_edi", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS edi FROM part")
def _(spark, sf):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("x"), F.col("p_partkey"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" "), F.col("p_partkey"), F.lit(".0 "))).otherwise(F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", nz.edi_code(raw).alias("edi"))


_NAMES = ("' hydrochloride   37.5mg'", "' magnesium (as ' || split_part(p_name, ' ', 1) || ' 20mg)'", "' sodium hydrate'")


@query("norm_ingredient", "SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN split_part(lower(p_name), ' ', 1) ELSE lower(p_name) END AS ingredient FROM part")
def _(spark, sf):
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" hydrochloride   37.5mg"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_name"), F.lit(" magnesium (as "), first, F.lit(" 20mg)"))).otherwise(F.concat("p_name", F.lit(" sodium hydrate")))
    return table(spark, sf, "part").select("p_partkey", nz.ingredient(raw).alias("ingredient"))


@query("split_components", "WITH c AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS c FROM part) SELECT p_partkey, CAST(count(*) FILTER (length(c) > 2) AS INT) AS n_components FROM c GROUP BY 1")
def _(spark, sf):
    raw = F.concat_ws(" 5mg, ", F.split("p_name", " "))
    return table(spark, sf, "part").select("p_partkey", F.size(nz.components(raw)).alias("n_components"))


@query("infer_severity", r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Unknown' WHEN regexp_matches(text, '(?i)\bthis\b') THEN 'Contraindicated' ELSE 'x' END AS kind FROM documents""".replace("'x'", "'Minor'").replace(r"regexp_matches(text, '(?i)\bthis\b')", r"regexp_matches(text, '(?i)(\bcontraindicated\b|must not be (used|taken|combined)|should not be (used|taken|combined) (together|concomitantly))')"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nz.severity_of(F.col("text")).alias("kind"))


@query("extract_codes", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\b[A-Za-z][0-9]{2}\b'))), ',') AS codes FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat_ws(",", F.array_sort(nz.codes_in_text(F.col("html"), r"\b[A-Za-z][0-9]{2}\b"))).alias("codes"))


@query("pseudonymize", "SELECT c_custkey, sha256('pepper:' || CAST(c_custkey AS VARCHAR)) AS patient_hash, sha256('pepper:' || c_name) AS name_hash FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", nz.pseudonym(F.col("c_custkey"), "pepper").alias("patient_hash"), nz.pseudonym(F.col("c_name"), "pepper").alias("name_hash"))


@query("age_band", "SELECT CASE WHEN a < 20 THEN '0-19' WHEN a < 40 THEN '20-39' WHEN a < 60 THEN '40-59' WHEN a < 75 THEN '60-74' ELSE '75+' END AS band, CASE WHEN a < 65 THEN 'lt65' WHEN a < 75 THEN '65-74' ELSE '75plus' END AS review_group, CASE s WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sex_value, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(trunc(abs(c_acctbal)) AS INT) % 100 AS a, 1 + c_custkey % 2 AS s FROM customer) GROUP BY 1, 2, 3")
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("cast(abs(c_acctbal) as int) % 100 as a", "cast(1 + c_custkey % 2 as string) as s")
    return c.groupBy(nz.age_band(F.col("a")).alias("band"), nz.review_group(F.col("a")).alias("review_group"), nz.sex_value(F.col("s")).alias("sex_value")).agg(F.count(F.lit(1)).alias("n"))


_SYNONYMS = ", ".join(f"('{a}', '{b}')" for a, b in kn.SYNONYMS.items())
#: Names that drugs are registered under, and names that they are looked up by: some are synonyms, some unknown.
_KNOWN = sorted(set(kn.SYNONYMS.values()))
_ASKED = sorted(kn.SYNONYMS) + ["no such drug"]


def _pick(words: list[str], at: str) -> str:
    return f"element_at(array({', '.join(repr(w) for w in words)}), cast(1 + {at} % {len(words)} as int))"


def _pick_sql(words: list[str], at: str) -> str:
    return f"([{', '.join(repr(w) for w in words)}])[CAST(1 + {at} % {len(words)} AS INT)]"


@query("synonym_map", f"WITH n AS (SELECT DISTINCT CASE p_partkey % 2 WHEN 0 THEN lower(p_name) ELSE {_pick_sql(_ASKED, 'p_partkey')} END AS name FROM part), k AS (SELECT name, min(id) AS id FROM (SELECT lower(p_name) AS name, p_partkey AS id FROM part UNION ALL SELECT {_pick_sql(_KNOWN, 'p_partkey')}, 100000000 + p_partkey % {len(_KNOWN)} FROM part) GROUP BY 1), s(name, other) AS (VALUES {_SYNONYMS}) SELECT n.name, coalesce(k.id, o.id) AS id FROM n LEFT JOIN k ON k.name = n.name LEFT JOIN s ON s.name = n.name LEFT JOIN k o ON o.name = s.other")
def _(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.expr(f"case p_partkey % 2 when 0 then lower(p_name) else {_pick(_ASKED, 'p_partkey')} end").alias("name")).distinct()
    known = p.select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("id")).unionByName(p.select(F.expr(_pick(_KNOWN, "p_partkey")).alias("name"), (F.lit(100000000) + F.col("p_partkey") % len(_KNOWN)).alias("id")))
    return kn.with_synonyms(names, known.groupBy("name").agg(F.min("id").alias("id")))


@query("atc_map", "WITH m AS (SELECT unnest(string_split(p_brand || '|' || split_part(p_type, ' ', 1), '|')) AS atc, p_partkey AS id, p_size AS place FROM part) SELECT atc, arg_max(id, (place, id)) AS id FROM m WHERE atc <> '' GROUP BY 1")
def _(spark, sf):
    """ATC code to drug id; of drugs with one code the one registered last wins."""
    rows = table(spark, sf, "part").select(F.concat_ws("|", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1))).alias("codes"), F.col("p_partkey").alias("id"), F.col("p_size").alias("place"))
    return kn.code_map(rows)


@query("code_bridge", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS class_no, p_type AS kind FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) ON l_partkey = p_partkey")
def _(spark, sf):
    lines, bridge = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf, "part").where("p_partkey % 7 <> 0").selectExpr("p_partkey as l_partkey", "p_brand as class_no", "p_type as kind")
    return lines.join(bridge, "l_partkey", "left")


@query("standardize_codes", f"{WITH}, p AS (SELECT p_partkey AS k, p_name FROM part WHERE p_partkey % 3 = 0), b AS (SELECT p_brand AS k, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS codes FROM part GROUP BY 1) SELECT drug_id, coalesce(min(p_name), min(codes)) AS standard, CAST(count(*) AS BIGINT) AS n FROM rx LEFT JOIN p ON p.k = drug_id LEFT JOIN b ON b.k = class_no GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "part")
    direct = p.where("p_partkey % 3 = 0").selectExpr("p_partkey as drug_id", "p_name as direct")
    by_class = p.groupBy(F.col("p_brand").alias("class_no")).agg(F.concat_ws(",", F.array_sort(F.collect_set("p_type"))).alias("codes"))
    lines = rx(spark, sf).groupBy("drug_id", "class_no").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(direct, "drug_id", "left").join(by_class, "class_no", "left").select("drug_id", F.coalesce("direct", "codes").alias("standard"), "n")


@query("master_coverage", f"{WITH}, m AS (SELECT drug_id, CASE WHEN drug_id % 9 <> 0 THEN atc_code END AS code FROM rx) SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (code IS NULL) AS BIGINT) AS n_unmapped, avg(CASE WHEN code IS NULL THEN 1.0 ELSE 0.0 END) AS unmapped_rate FROM m")
def _(spark, sf):
    return kn.coverage(rx(spark, sf).select(F.when(F.col("drug_id") % 9 != 0, F.col("atc_code")).alias("code")), "code")


@query("fd_violations", "SELECT p_brand, count(DISTINCT p_type) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def _(spark, sf):
    return kn.violations(table(spark, sf, "part"), "p_brand", "p_type")


_CYP = """acts AS (SELECT DISTINCT l_partkey AS drug, ['cyp3a4', 'cyp2d6', 'cyp2c9', 'cyp2c19', 'cyp1a2'][1 + l_suppkey % 5] AS enzyme, ['substrate', 'inhibitor', 'inducer'][1 + l_linenumber % 3] AS action, CASE WHEN l_quantity > 25 THEN 'strong' ELSE 'weak' END AS strength, CASE WHEN l_returnflag = 'R' THEN 'no' ELSE 'yes' END AS known FROM lineitem)"""


def actions(spark, sf):
    return actions_of(table(spark, sf, "lineitem"))


def actions_of(lines):
    """drug, enzyme, action, strength, known: distinct enzyme actions bound to order lines."""
    return lines.selectExpr(
        "l_partkey as drug", "element_at(array('cyp3a4', 'cyp2d6', 'cyp2c9', 'cyp2c19', 'cyp1a2'), cast(1 + l_suppkey % 5 as int)) as enzyme", "element_at(array('substrate', 'inhibitor', 'inducer'), cast(1 + l_linenumber % 3 as int)) as action",
        "case when l_quantity > 25 then 'strong' else 'weak' end as strength", "case when l_returnflag = 'R' then 'no' else 'yes' end as known",
    ).distinct()


def _cyp_columns() -> str:
    cols = []
    for e in kn.ENZYMES:
        cols += [f"CAST(count(*) FILTER (enzyme = '{e}' AND action = '{a}') AS BIGINT) AS {e}_{a}_count" for a in ("substrate", "inhibitor", "inducer")]
        cols += [f"CAST(count(*) FILTER (enzyme = '{e}' AND action = 'inhibitor' AND strength = 'strong') AS BIGINT) AS {e}_inhibitor_strong_count", f"CAST(count(*) FILTER (enzyme = '{e}' AND action IN ('inhibitor', 'inducer')) > 0 AS INT) AS {e}_interaction_risk"]
    return ", ".join(cols)


_MATRIX = f"{_CYP}, matrix AS (SELECT drug, {_cyp_columns()} FROM acts WHERE known <> 'no' GROUP BY drug)"


@query("cyp_matrix", f"WITH {_MATRIX} SELECT * FROM matrix")
def _(spark, sf):
    return kn.cyp_matrix(actions(spark, sf))


def _cyp_sql() -> str:
    sums = ", ".join(f"CAST(count(*) FILTER ({e}_{k}_count > 0) AS BIGINT) AS {e}_{s}" for e in kn.ENZYMES for k, s in (("substrate", "sub"), ("inhibitor_strong", "strong"), ("inhibitor", "inh")))
    risk = {e: f"(({e}_strong * 3.0 + {e}_inh + {e}_strong * {e}_sub * 2.0) * {w})::DOUBLE" for e, w in kn.ENZYME_WEIGHTS.items()}
    out = ", ".join([*(f"{e}_sub AS {e}_substrates, {e}_strong AS {e}_strong_inhibitors, {e}_strong * {e}_sub AS {e}_pairs" for e in kn.ENZYMES), f"{' + '.join(risk.values())} AS cyp_risk_score", f"greatest({', '.join(risk.values())}) AS cyp_max_enzyme_risk", f"{' + '.join(f'{e}_strong * {e}_sub' for e in kn.ENZYMES)} AS cyp_high_risk_pairs"])
    return f"WITH {RX}, {_MATRIX}, t AS (SELECT DISTINCT patient_id, drug_id AS drug FROM rx), s AS (SELECT patient_id, {sums} FROM t LEFT JOIN matrix USING (drug) GROUP BY 1) SELECT patient_id, {out} FROM s"


@query("cyp_features", _cyp_sql())
def _(spark, sf):
    taken = rx(spark, sf).select("patient_id", F.col("drug_id").alias("drug")).distinct()
    return kn.cyp_features(taken, kn.cyp_matrix(actions(spark, sf)))


@query("pair_exclude", f"WITH {PAIRS}, x AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 11 = 0) SELECT a_id, b_id, CAST(count(*) AS BIGINT) AS n FROM pairs WHERE a_id NOT IN (SELECT id FROM x) AND b_id NOT IN (SELECT id FROM x) GROUP BY 1, 2")
def _(spark, sf):
    out = table(spark, sf, "supplier").where("s_suppkey % 11 = 0").select(F.col("s_suppkey").alias("id")).distinct()
    kept = pairs(spark, sf).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(out.withColumnRenamed("id", "a_id"), "a_id", "left_anti").join(out.withColumnRenamed("id", "b_id"), "b_id", "left_anti")


@query("ddi_name_match", f"""{WITH}, d AS (SELECT DISTINCT product_name FROM rx), w AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS w FROM part WHERE p_partkey % 3 = 0) SELECT product_name, CAST(count(w) AS BIGINT) AS n_matches FROM d LEFT JOIN w ON contains(' ' || lower(product_name) || ' ', ' ' || w || ' ') GROUP BY 1""")
def _(spark, sf):
    names = rx(spark, sf).select("product_name").distinct()
    known = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("name")).distinct()
    return kn.names_within(names, "product_name", known).groupBy("product_name").agg(F.count("name").alias("n_matches"))


@query("map_coverage", f"""WITH {RX}, {PAIRS}, p AS (SELECT DISTINCT a.patient_id, least(a.drug_id, b.drug_id) AS lo, greatest(a.drug_id, b.drug_id) AS hi, a.drug_id % 9 <> 0 AND b.drug_id % 9 <> 0 AS mapped FROM rx a JOIN rx b ON a.patient_id = b.patient_id AND a.drug_id < b.drug_id AND date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1 >= 7),
  k AS (SELECT least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi FROM pairs GROUP BY 1, 2 HAVING max({_RANK}) >= 3) SELECT CAST(count(*) AS BIGINT) AS n_full, CAST(count(*) FILTER (mapped) AS BIGINT) AS n_mapped, CAST(count(*) FILTER (NOT mapped) AS BIGINT) AS n_missed FROM p JOIN k USING (lo, hi)""")
def _(spark, sf):
    from ..operators.intervals import overlaps

    o = overlaps(rx(spark, sf)).select("patient_id", F.least("drug_a", "drug_b").alias("id_lo"), F.greatest("drug_a", "drug_b").alias("id_hi"), ((F.col("drug_a") % 9 != 0) & (F.col("drug_b") % 9 != 0)).alias("mapped")).distinct()
    hits = o.join(kn.pair_dedup(pairs(spark, sf)).where("rank >= 3"), ["id_lo", "id_hi"])
    return hits.agg(F.count(F.lit(1)).alias("n_full"), F.count_if("mapped").alias("n_mapped"), F.count_if(~F.col("mapped")).alias("n_missed"))


@query("contra_audit", f"""WITH {RX}, {PAIRS}, k AS (SELECT least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi FROM pairs WHERE severity = 'Contraindicated' GROUP BY 1, 2), d AS (SELECT DISTINCT patient_id, drug_id AS id FROM rx), n AS (SELECT patient_id, count(*) AS n FROM d GROUP BY 1),
  h AS (SELECT a.patient_id, count(*) AS hits FROM d a JOIN d b ON a.patient_id = b.patient_id AND a.id < b.id JOIN k ON lo = a.id AND hi = b.id GROUP BY 1) SELECT patient_id, CAST(n * (n - 1) // 2 AS BIGINT) AS candidates, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM n LEFT JOIN h USING (patient_id)""")
def _(spark, sf):
    k = kn.canonical_pairs(pairs(spark, sf).where("severity = 'Contraindicated' and a_id <> b_id"))
    d = rx(spark, sf).select("patient_id", F.col("drug_id").alias("id")).distinct()
    n = d.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    # From the drugs that a patient has to their partners, then back to the patient's drugs: no pair is made that isn't known.
    partner = d.join(k, d.id == k.id_lo).select("patient_id", F.col("id_hi").alias("id"))
    hits = partner.join(d, ["patient_id", "id"]).groupBy("patient_id").agg(F.count(F.lit(1)).alias("hits"))
    return n.join(hits, "patient_id", "left").select("patient_id", F.expr("n * (n - 1) div 2").alias("candidates"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
