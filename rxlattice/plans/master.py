"""Queries for the drug master and for knowledge read from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import master as ma
from ..sources import files
from ..tables import folder, spread
from .binding import table
from .knowledge import _CYP, actions_of
from .registry import query

# ---- the drug master: part is the product list, order lines are the interaction matrix

_TAG = "translate(cast({k} % 500 as string), '0123456789', 'bcdfghjklm')"
_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_NAME_A, _NAME_B = f"concat({_W2}, {_TAG.format(k='p_partkey')})", f"concat({_W1}, {_TAG.format(k='l_suppkey')})"


def products(spark, sf):
    """code, name, place: codes repeat on large tables; names are combinations, bases, synonyms or unknown."""
    name = f"""case p_partkey % 4 when 0 then concat({_NAME_A}, ' sodium 10mg') when 1 then concat({_NAME_A}, ' hydrochloride 5mg, ', {_W1}, ' magnesium (as ', {_NAME_A}, 'x 20mg)')
      when 2 then concat('Paracetamol 500mg, ', {_NAME_A}) else 'unknownium 5mg' end"""
    return table(spark, sf, "part").selectExpr("concat(lpad(cast(p_partkey % 10000 as string), 4, '0'), case when p_partkey % 4 in (1, 2) then '00' else '01' end, 'A') as code", f"{name} as name", "p_partkey as place")


def name_matrix(spark, sf):
    """drug_a_name, drug_b_name, drug_a_id, drug_b_id, place: names in other spellings than the products'."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    rows = lines.join(p, lines.l_partkey == p.p_partkey).selectExpr(
        f"concat(upper({_NAME_A}), ' SODIUM') as drug_a_name", f"case when l_linenumber = 1 then 'Acetaminophen' else {_NAME_B} end as drug_b_name",
        "case when p_partkey % 11 <> 0 then concat('DB', l_suppkey) end as drug_a_id", "concat('D', l_suppkey) as drug_b_id", "struct(l_orderkey as o, l_linenumber as l) as place",
    )
    return rows


_SQL_A = "split_part(p_name, ' ', 2) || translate(CAST(p_partkey % 500 AS VARCHAR), '0123456789', 'bcdfghjklm')"
_SQL_B = "split_part(p_name, ' ', 1) || translate(CAST(l_suppkey % 500 AS VARCHAR), '0123456789', 'bcdfghjklm')"
_MASTER = f"""WITH sides AS (SELECT 0 AS side, {_SQL_A} AS name, 'DB' || l_suppkey AS id, l_orderkey AS o, l_linenumber AS l FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 11 <> 0
    UNION ALL SELECT 1, CASE l_linenumber WHEN 1 THEN 'acetaminophen' ELSE {_SQL_B} END, 'D' || l_suppkey, l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey),
  names AS (SELECT name, arg_min(id, (side, o, l, id)) AS id FROM sides GROUP BY 1),
  prod AS (SELECT lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN p_partkey % 4 IN (1, 2) THEN '00' ELSE '01' END || 'A' AS code, p_partkey AS place,
    CASE p_partkey % 4 WHEN 0 THEN [{_SQL_A}] WHEN 1 THEN [{_SQL_A}, {_SQL_A} || 'x'] WHEN 2 THEN ['paracetamol', {_SQL_A}] ELSE ['unknownium'] END AS comps FROM part),
  firsts AS (SELECT code, arg_min(comps, place) AS comps FROM prod GROUP BY 1),
  cells AS (SELECT code, generate_subscripts(comps, 1) AS i, unnest(comps) AS c FROM firsts),
  met AS (SELECT code, i, c, id FROM cells LEFT JOIN names ON name = CASE c WHEN 'paracetamol' THEN 'acetaminophen' ELSE c END),
  master AS (SELECT code, substr(code, 5, 2) = '00' AS is_combo, string_agg(c, '|' ORDER BY i) AS components, coalesce(string_agg(id, '|' ORDER BY i), '') AS ids FROM met GROUP BY 1)"""


@query("drug_master", _MASTER + " SELECT code, is_combo, components, ids FROM master")
def _(spark, sf):
    m = ma.build(products(spark, sf), name_matrix(spark, sf))
    return m.select("code", "is_combo", F.concat_ws("|", "components").alias("components"), F.concat_ws("|", "ids").alias("ids"))


@query("drug_master_report", _MASTER + """, r AS (SELECT count(*) AS n_codes, count(*) FILTER (ids <> '') AS n_mapped, count(*) FILTER (is_combo) AS n_combos, count(*) FILTER (is_combo AND ids <> '') AS n_combos_mapped FROM master)
  SELECT *, round(n_mapped::DOUBLE / n_codes * 100, 4) AS mapped_pct, round(n_combos_mapped::DOUBLE / n_combos * 100, 4) AS combos_pct FROM r""")
def _(spark, sf):
    return ma.report(ma.build(products(spark, sf), name_matrix(spark, sf)))


@query("drug_master_repair", _MASTER + f""", old AS (SELECT code, comps, CASE WHEN code LIKE '%5__A' THEN ['somethingelse'] ELSE comps[1:1] END AS kept FROM firsts),
  now AS (SELECT code, CAST(count(id) AS BIGINT) AS n_new, CAST(count(id) FILTER (i = 1) AS BIGINT) AS n_old, count(*) AS n, count(DISTINCT id) AS d FROM met GROUP BY 1)
  SELECT code, array_to_string(CASE WHEN repaired THEN comps ELSE kept END, '|') AS components, repaired FROM (SELECT old.*, code NOT LIKE '%5__A' AND d > n_old AS repaired FROM old JOIN now USING (code))""")
def _(spark, sf):
    """A stored master that kept only the first component, or another one, is repaired where the names say more."""
    m = ma.build(products(spark, sf), name_matrix(spark, sf))
    old = m.select("code", "raw_name", "is_combo", F.when(F.col("code").like("%5__A"), F.array(F.lit("somethingelse"))).otherwise(F.slice("components", 1, 1)).alias("components"))
    path = folder(spark, "master")
    old.write.parquet(path)
    fixed = ma.repair(spark.read.parquet(path), name_matrix(spark, sf))
    return fixed.select("code", F.concat_ws("|", "components").alias("components"), "repaired")


# ---- drug XML: the tables written as nested elements, read back into three tables


def _drug_xml(spark, sf):
    """The XML of all parts: suppliers are partners, actions are grouped by enzyme and whether they are known.

    A file is read whole by one task, so lines are dealt by part over as many files as the tables' size asks for. All
    aggregates and joins below work where the lines are.
    """
    lines = spread(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_partkey")
    acts = actions_of(lines).groupBy("drug", "enzyme", "known").agg(F.array_sort(F.collect_set("action")).alias("acts"))
    item = F.struct(F.upper("enzyme").alias("name"), F.col("known").alias("known-action"), F.struct(F.col("acts").alias("action")).alias("actions"))
    enzymes = acts.groupBy("drug").agg(F.struct(F.collect_list(item).alias("enzyme")).alias("enzymes"))
    partner = F.struct(F.concat(F.lit("S"), "l_suppkey").alias("drugbank-id"), F.concat(F.lit("Supplier "), "l_suppkey").alias("name"), F.lit("may be used together").alias("description"))
    pairs = lines.select("l_partkey", "l_suppkey").distinct().groupBy(F.col("l_partkey").alias("drug")).agg(F.struct(F.collect_list(partner).alias("drug-interaction")).alias("drug-interactions"))
    ids = F.array(F.struct(F.concat(F.lit("old"), "p_partkey").alias("_VALUE"), F.lit(False).alias("_primary")), F.struct(F.concat(F.lit("P"), "p_partkey").alias("_VALUE"), F.lit(True).alias("_primary")))
    drugs = table(spark, sf, "part").select(F.col("p_partkey").alias("drug"), ids.alias("drugbank-id"), F.col("p_name").alias("name"), F.struct(F.array(F.struct(F.col("p_brand").alias("_code"))).alias("atc-code")).alias("atc-codes"))
    path = folder(spark, "xml")
    # By merge joins, as a broadcast would leave the parts in the files that they came in.
    nested = drugs.join(pairs.hint("merge"), "drug", "left").join(enzymes.hint("merge"), "drug", "left").drop("drug")
    nested.write.format("xml").options(rootTag="drugbank", rowTag="drug", compression="gzip").save(path)
    return files.read_drug_xml(spark, path, save=folder(spark, "xml-rows"))


@query("drug_xml", f"""WITH {_CYP}, e AS (SELECT 'P' || drug AS drug_id, enzyme, action, known FROM acts JOIN part ON p_partkey = drug GROUP BY ALL), p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT 'enzyme' AS kind, enzyme || ' ' || action || ' ' || known AS what, count(*) AS n, count(DISTINCT drug_id) AS n_drugs FROM e GROUP BY 2 UNION ALL SELECT 'pair', 'S' || l_suppkey, count(*), count(DISTINCT l_partkey) FROM p GROUP BY 2 UNION ALL SELECT 'drug', p_brand, count(*), count(DISTINCT p_partkey) FROM part GROUP BY 2""")
def _(spark, sf):
    """What the three tables of the XML hold: drugs by code, pairs by partner, enzyme rows by enzyme, action and known-action."""
    drugs, pairs, enzymes = _drug_xml(spark, sf)
    what = F.concat_ws(" ", files.enzyme_key(F.col("enzyme")), "action", "known_action")
    rows = enzymes.select(F.lit("enzyme").alias("kind"), what.alias("what"), "drug_id").unionByName(pairs.select(F.lit("pair").alias("kind"), F.col("b_id").alias("what"), F.col("a_id").alias("drug_id")))
    rows = rows.unionByName(drugs.select(F.lit("drug").alias("kind"), F.col("atc_codes").alias("what"), "drug_id"))
    return rows.groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("drug_id").alias("n_drugs"))
