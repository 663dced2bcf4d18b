"""Ingest guards, golden shares, matrices, sources without a query of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rxlattice import schema
from rxlattice.functions import normalize as nz
from rxlattice.operators import ingest as ing
from rxlattice.operators import knowledge as kn
from rxlattice.operators import labels as lb
from rxlattice.operators import metrics as me
from rxlattice.operators import sampling as sp
from rxlattice.sources import files


def test_guards(spark):
    assert ing.buffered(["202401"], 2, 1) == (dt.date(2023, 11, 1), dt.date(2024, 2, 29))
    with pytest.raises(ValueError):
        ing.buffered([], 1, 1)
    with pytest.raises(KeyError, match="nope"):
        ing.by_config(spark.range(3), {"a": [1]}, {"id": "nope"})
    assert [r.id for r in ing.by_config(spark.range(3), {"a": [1]}, {"id": "a"}).collect()] == [1]
    assert ing.check_lookback(90, 90) == 90
    for days, fitted in ((6, None), (1826, None), (90, 60)):
        with pytest.raises(ValueError):
            ing.check_lookback(days, fitted)


def test_strict_records(spark):
    rows = spark.createDataFrame([("20240101", "20240105", 9), ("20240101", "", 3), ("20240101", "20231201", None)], "start_text string, end_text string, total_days int")
    assert [str(r.end_date) for r in ing.strict_records(rows).collect()] == ["2024-01-05", "2024-01-03", "2024-01-01"]
    with pytest.raises(Exception, match="not a date"):
        ing.strict_records(spark.createDataFrame([("2024-1-1", "", 1)], "start_text string, end_text string, total_days int")).collect()


def test_outpatient_fallbacks(spark):
    heads = spark.createDataFrame([(1, 7, 3, "20240101", " "), (2, 8, 3, "20240102", "A1"), (3, 9, 3, "x", "A1")], "claim long, patient_id long, institution_id long, start_text string, main_diag string")
    diagnoses = spark.createDataFrame([(1, 2, "D2"), (1, 1, "D1"), (1, 0, " ")], "claim long, place int, code string")
    lines = spark.createDataFrame([(1, 1, " ", "R", "5"), (2, 1, "G", "R", "0"), (2, 2, None, "", "5"), (3, 1, "G", "R", "5"), (4, 1, "G", "R", "5")], "claim long, line int, generic_code string, revised_code string, days string")
    got = {(r.claim, r.line): (r.drug_code, r.diag_code, r.total_days) for r in ing.outpatient_records(lines, heads, diagnoses).collect()}
    assert got == {(1, 1): ("R", "D1", 5), (2, 1): ("G", "A1", 1)}


def test_golden_floor_of_positives(spark):
    rows = [(i, "Red", int(i < 5)) for i in range(100)] + [(i, "Green", int(i < 190)) for i in range(100, 200)] + [(300, "Normal", 0)]
    df = spark.createDataFrame(rows, "id long, level string, y int")
    got = sp.golden(df, "level", "y", {"Red": 0.5, "Green": 0.3, "Normal": 0.2}, 100, 0.2, "id")
    n = {(r.level, r.y): r["count"] for r in got.groupBy("level", "y").count().collect()}
    assert n == {("Red", 1): 5, ("Red", 0): 45, ("Green", 1): 20, ("Green", 0): 10, ("Normal", 0): 1}
    with pytest.raises(ValueError):
        sp.golden(df, "level", "y", {"Red": 0.5}, 100, 0.2, "id")


def test_confusion_matrix_has_every_pair(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    rows = me.confusion_matrix(df, "t", "p", ["a", "b", "c"]).collect()
    assert len(rows) == 9 and {(r.truth, r.predicted): r.n for r in rows if r.n} == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 1}
    assert rows[0].macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)


def test_curve_with_scores_of_any_scale(spark):
    scores = [-5.0, -0.25, 0.0, 1e-9, 0.3, 0.30001, 0.5, 7.0, 7.0, 4096.0]
    df = spark.createDataFrame([(s, i % 2) for i, s in enumerate(scores)], "score double, y int")
    got = [(r.score, r.tp, r.fp) for r in me.curve(df).orderBy(F.desc("score")).collect()]
    want = []
    for s in sorted(set(scores), reverse=True):
        above = [i for i, x in enumerate(scores) if x >= s]
        want.append((s, sum(i % 2 for i in above), sum(1 - i % 2 for i in above)))
    assert got == want


def test_names_within_and_code_map(spark):
    texts = spark.createDataFrame([("sodium valproate 5",), ("valproatex",), ("none",)], "t string")
    names = spark.createDataFrame([("valproate",), ("sodium valproate",), ("zz",)], "name string")
    got = {(r.t, r.name) for r in kn.names_within(texts, "t", names).collect()}
    assert got == {("sodium valproate 5", "valproate"), ("sodium valproate 5", "sodium valproate"), ("valproatex", None), ("none", None)}
    rows = spark.createDataFrame([("A|B", 1, 1), ("B", 2, 2), ("", 3, 3)], "codes string, id long, place int")
    assert {r.atc: r.id for r in kn.code_map(rows).collect()} == {"A": 1, "B": 2}


def test_small_columns(spark):
    row = spark.range(1).select(
        nz.is_combination(F.lit("123400ABC")).alias("a"), nz.is_combination(F.lit("123401ABC")).alias("b"), nz.age_at(2024, F.lit(1890), F.lit(5)).alias("c"), nz.age_at(2024, F.lit(None).cast("int"), F.lit(5)).alias("d"),
        nz.decade_age(F.lit("7")).alias("e"), nz.percent(F.lit(1), F.lit(3)).alias("f"), nz.percent(F.lit(1), F.lit(0)).alias("g"),
        lb.merged_label(F.lit(True), F.lit("Green")).alias("h"), lb.merged_label(F.lit(False), F.lit("Green")).alias("i"), lb.merged_label(F.lit(False), F.lit(None)).alias("j"),
    ).first()
    assert tuple(row) == (True, False, 120, 5, 70, 33.3333, 0.0, "Red", "Green", "Normal")


def test_csv_and_dataset(spark, tmp_path):
    (tmp_path / "m.csv").write_text("code,name\nA1,x\nB2,\n")
    got = files.read_csv(spark, f"{tmp_path}/m.csv", schema.struct("code string, name string")).collect()
    assert [tuple(r) for r in got] == [("A1", "x"), ("B2", None)]
    coo = spark.createDataFrame([(1, 5, 1.0), (1, 2, 0.5), (2, 1, 1.0)], "patient_id long, idx long, value double")
    files.write_dataset(coo, spark.createDataFrame([(1, 1)], "patient_id long, label int"), f"{tmp_path}/set")
    assert [tuple(r) for r in files.read_dataset(spark, f"{tmp_path}/set").collect()] == [(1, 1, [2, 5], [0.5, 1.0])]
