"""Work that must not grow faster than the tables: partitions by size, inputs that are computed once."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rxlattice import tables
from rxlattice.operators import rules as ru
from rxlattice.operators import sampling as sp
from rxlattice.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["composite_patterns", "safety_net_rules", "safety_net_assessment", "temporal_features", "dup_ingredient", "dup_class", "dup_atc", "pdc_mpr", "risk_rules"])
def test_partitions_grow_with_the_tables(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1000, raising=False)
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    parts = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert parts and min(parts) > 20


def test_spread_of_rows_that_know_no_size(spark):
    assert "REPARTITION_BY_COL" in tables.spread(spark.createDataFrame([(1,)], "k long"), "k")._jdf.queryExecution().executedPlan().toString()


def counted(spark, rows):
    """`rows` and a counter of how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(count, rows.schema), seen


def test_golden_sample_computes_its_input_once(spark):
    rows = spark.range(4000).selectExpr("cast(id as string) as id", "elt(1 + cast(id % 2 as int), 'a', 'b') as level", "cast(id % 7 = 0 as int) as positive")
    df, seen = counted(spark, rows)
    got = sp.golden(df, "level", "positive", {"a": 0.5, "b": 0.5}, 100, 0.2, "id").collect()
    assert seen.value == 4000
    ranked = rows.withColumn("n", F.expr("row_number() over (partition by level, positive order by sha2(concat(id, '|42'), 256), id)"))
    want = ranked.where("n <= if(positive = 1, 10, 40)").select("level", "positive", "id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_quota_sample_ranks_only_slices_that_are_wanted(spark):
    rows = spark.range(20_000).selectExpr("cast(id as string) as id", "id % 2 as k")
    got = sp.quota_sample(rows, spark.createDataFrame([(0, 3), (1, 30_000)], "k long, quota int"), ["k"], "id")
    assert got.where("k = 1").count() == 10_000 and got.where("k = 0").count() == 3
    few = sp.quota_sample(rows, spark.createDataFrame([(0, 3), (1, 3)], "k long, quota int"), ["k"], "id")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


def test_rules_of_many_clauses(spark):
    """More clauses than one number has bits; a clause of several drugs; a null drug counts for none."""
    rules = [(f"R{k}", "n", [[f"a{k}"], [f"b{k}", "c"]], 2 if k == 39 else 1, "Major") for k in range(40)]
    rows = [(1, 7, "a39"), (1, 7, "a39"), (1, 8, "c"), (2, 7, "a39"), (2, 8, "a39"), (2, 7, "b39"), (3, 7, "a0"), (3, None, "c"), (4, 1, "a5"), (4, 1, "b5"), (4, 2, "a35"), (4, 2, "b35"), (4, 2, "b36")]
    members = spark.createDataFrame(rows, "k long, drug_id long, grp string")
    assert sorted((r.k, r.rule) for r in ru.apply_rules(members, rules, ["k"]).collect()) == [(2, "R39"), (4, "R35"), (4, "R5")]


def test_numbers_of_patients_are_read_back(spark):
    """The split reads a row a patient, not the lines again."""
    from rxlattice.plans import storage

    label, _ = storage._patients(spark, SF)
    assert not any("lineitem" in f for f in label.inputFiles())


def test_drug_xml_has_more_files_for_larger_tables(spark, monkeypatch):
    """A file of XML is read whole by one task."""
    from rxlattice.plans import master

    paths = []

    def folder(session, kind):
        paths.append(tables.folder(session, kind))
        return paths[-1]

    monkeypatch.setattr(tables, "SPREAD_BYTES", 10_000)
    monkeypatch.setattr(master, "folder", folder)
    drugs, _, _ = master._drug_xml(spark, SF)
    assert drugs.count() == spark.read.parquet(f"{SF}/part.parquet").count()
    files = list(Path(paths[0].removeprefix("file://")).glob("part-*"))
    assert len(files) > 8 and all(f.name.endswith(".gz") for f in files)
