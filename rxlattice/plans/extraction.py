"""Queries for chunked extraction, run logs, catalogues and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import knowledge as kn
from ..sources import extract as ex
from ..sources import stages as sg
from ..tables import folder
from .binding import RX, rx, table
from .claims import TEMPORAL
from .knowledge import _cyp_sql, actions
from .registry import query

WITH = f"WITH {RX}"
_PLAN = ex.chunks("199601", "199812", 6, before=2, after=1)
_CHUNKS = "c(label, since, until) AS (VALUES " + ", ".join(f"('{c.label}', DATE '{c.since}', DATE '{c.until}')" for c in _PLAN) + ")"
_COUNTS = "count(*) AS n_records, count(*) FILTER (source = 'T30') AS n_t30, count(*) FILTER (source = 'T60') AS n_t60, CAST(min(start_date) AS VARCHAR) AS first_day, CAST(max(start_date) AS VARCHAR) AS last_day"


def _extracted(spark, sf):
    """Extracted in two runs: the first is broken off after two chunks, the second goes on where it ended."""
    path, lines = folder(spark, "extract"), rx(spark, sf)

    def records(chunk):
        return lines.where(chunk.holds("start_date")).select("patient_id", "drug_id", "institution_id", "start_date", "total_days", "source")

    first = ex.extract(spark, path, _PLAN[:2], records)
    second = ex.extract(spark, path, _PLAN, records)
    return path, [*((label, 1) for label in first), *((label, 2) for label in second)]


@query("chunked_extract", f"{WITH}, {_CHUNKS} SELECT label, CAST(since AS VARCHAR) AS since, CAST(until AS VARCHAR) AS until, {_COUNTS}, CASE WHEN label IN ('{_PLAN[0].label}', '{_PLAN[1].label}') THEN 1 ELSE 2 END AS run FROM c JOIN rx ON start_date BETWEEN since AND until GROUP BY ALL")
def _(spark, sf):
    path, runs = _extracted(spark, sf)
    return ex.extract_log(spark, path).join(F.broadcast(spark.createDataFrame(runs, "label string, run int")), "label")


@query("extract_summary", f"{WITH}, {_CHUNKS} SELECT count(DISTINCT label) AS n_chunks, {_COUNTS}, count(DISTINCT patient_id) AS n_persons FROM c JOIN rx ON start_date BETWEEN since AND until")
def _(spark, sf):
    path, _ = _extracted(spark, sf)
    return ex.extract_summary(spark, path, _PLAN)


#: The columns that two tables should have: one is missing, two are there that aren't listed, one has another type.
_WANTED = [
    ("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"), ("orders", "o_clerk_id", None), ("orders", "o_orderstatus", "string"), ("orders", "o_orderdate", None), ("orders", "o_orderpriority", None),
    ("nation", "n_nationkey", None), ("nation", "n_name", "string"), ("nation", "n_ruler", "string"),
]
_WANTED_SQL = "wanted(t, c) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c, _ in _WANTED) + "), found AS (SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ('orders', 'nation'))"


@query("catalogue_contract", f"WITH {_WANTED_SQL} SELECT t AS table_name, c AS column_name, 'missing' AS problem FROM wanted WHERE (t, c) NOT IN (SELECT (t, c) FROM found) UNION ALL SELECT t, c, 'extra' FROM found WHERE (t, c) NOT IN (SELECT (t, c) FROM wanted)")
def _(spark, sf):
    """The session's catalogue against a contract: columns that are missing and those that it doesn't know."""
    for name in ("orders", "nation"):
        table(spark, sf, name).createOrReplaceTempView(f"contract_{name}")
    found = ex.catalogue(spark, prefix="contract_").withColumn("table_name", F.regexp_replace("table_name", "^contract_", ""))
    wanted = spark.createDataFrame(_WANTED, "table_name string, column_name string, data_type string")
    return ex.contract_problems(found, wanted).where("problem <> 'type'")


_RUNS = "runs AS (SELECT 'run-' || substr(o_orderpriority, 1, 1) AS run_id, '2024-01-0' || substr(o_orderpriority, 1, 1) AS logged, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)"


def _runs(spark, sf):
    """A record of each run, here one an order priority, with its counts."""
    path = folder(spark, "runs")
    facts = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n_"), "o_orderstatus"), F.col("n").cast("string")))).alias("facts")
    counts = table(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("p"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(facts)
    for r in counts.collect():  # five runs
        ex.append_run(spark, path, f"run-{r['p']}", f"2024-01-0{r['p']}", r["facts"])
    return path


@query("run_catalogue", f"WITH {_RUNS} SELECT run_id, logged, CAST(sum(n) FILTER (status = 'F') AS VARCHAR) AS n_done FROM runs GROUP BY 1, 2 ORDER BY logged DESC LIMIT 3")
def _(spark, sf):
    return ex.run_catalogue(spark, _runs(spark, sf), 3).select("run_id", "logged", F.col("facts")["n_F"].alias("n_done"))


@query("baseline_report", f"WITH {_RUNS} SELECT run_id, CAST(sum(n) FILTER (status = 'F') AS BIGINT) AS status_n_F, CAST(sum(n) FILTER (status = 'O') AS BIGINT) AS status_n_O, CAST(sum(n) FILTER (status = 'P') AS BIGINT) AS status_n_P FROM runs GROUP BY 1")
def _(spark, sf):
    rows = ex.run_catalogue(spark, _runs(spark, sf)).select("run_id", F.explode("facts").alias("name", "value"))
    return ex.baseline_report(rows.select("run_id", F.lit("status").alias("track"), "name", F.col("value").cast("long").alias("value")))


def feature_stages(spark, sf) -> list[sg.Stage]:
    """Counts, enzyme features, temporal features and labels of all patients, one stage after the other."""
    lines = rx(spark, sf)

    def counts(_):
        return lines.groupBy("patient_id").agg(F.countDistinct("drug_id").alias("n_drugs"))

    def enzymes(t):
        taken = lines.select("patient_id", F.col("drug_id").alias("drug")).distinct()
        return t["counts"].join(kn.cyp_features(taken, kn.cyp_matrix(actions(spark, sf))).select("patient_id", "cyp_risk_score"), "patient_id", "left")

    def temporal(t):
        return t["enzymes"].join(ft.temporal_features(lines).select("patient_id", "early_drugs", "new_drugs", "long_ratio"), "patient_id", "left")

    def labelled(t):
        return t["temporal"].withColumn("label", (F.col("cyp_risk_score") >= 500).cast("int"))

    return [sg.Stage("counts", 1, counts), sg.Stage("enzymes", 1, enzymes, ("counts",)), sg.Stage("temporal", 1, temporal, ("enzymes",)), sg.Stage("labelled", 1, labelled, ("temporal",))]


@query("feature_stages", f"{WITH}, c AS (SELECT patient_id, count(DISTINCT drug_id) AS n_drugs FROM rx GROUP BY 1) SELECT patient_id, n_drugs, cyp_risk_score, early_drugs, new_drugs, long_ratio, CAST(cyp_risk_score >= 500 AS INT) AS label FROM c LEFT JOIN ({_cyp_sql()}) e USING (patient_id) LEFT JOIN ({TEMPORAL}) t USING (patient_id)")
def _(spark, sf):
    """All stages, then again with one of them lost, which is redone alone."""
    path, stages = folder(spark, "stages"), feature_stages(spark, sf)
    sg.run_stages(spark, path, stages, sf)
    sg.forget(spark, path, stages, sf, "enzymes")
    tables, made = sg.run_stages(spark, path, stages, sf)
    if made != ["enzymes"]:
        raise RuntimeError(f"made again: {', '.join(made)}")
    return tables["labelled"]
