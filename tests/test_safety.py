"""Feature rows and grades of patients with drugs that the given tables don't hold."""

import datetime as dt

from rxlattice.operators import rules as ru
from rxlattice.plans import binding, claims


def test_triple_whammy_and_qt_drugs_reach_the_grades(spark, monkeypatch):
    day = dt.date(2000, 1, 3)
    drugs = {
        1: [("enalapril maleate 5mg", "X"), ("spironolactone, Naproxen", "X")],  # a combination counts by its components
        2: [("enalapril maleate 5mg", "X"), ("naproxen", "X"), ("plain", "X")],
        3: [("a one", "C01BA01"), ("b two", "J01MA02"), ("c three", "N05AD01")],
        4: [("a one", "C01BA01"), ("b two", "J01MA02")],
        5: [("losartan", "X"), ("eplerenone", "X"), ("celecoxib", "X")],
    }
    # Ids of one residue have no interaction with each other, so only the drugs' kinds grade.
    rows = [(p, 7, p, k, 350 * (10 * p + k) + 1, day, 3, day + dt.timedelta(2), name, atc) for p, found in drugs.items() for k, (name, atc) in enumerate(found)]
    schema = "patient_id long, institution_id long, bill_no long, line_no int, drug_id long, start_date date, total_days int, end_date date, med_name string, med_atc string, class_no string"
    lines = spark.createDataFrame([(*r, "c") for r in rows], schema)
    monkeypatch.setattr(claims, "rx_meds", lambda s, sf: binding.with_kinds(lines))
    monkeypatch.setattr(claims, "demographics", lambda s, sf: spark.createDataFrame([(p, 40, "1") for p in drugs], "patient_id long, age int, sex_type string"))
    got = {r.patient_id: r for r in claims.safety_features(spark, "").collect()}
    assert {p: (r.triple_whammy, r.qt_drugs) for p, r in got.items()} == {1: (True, 0), 2: (False, 0), 3: (False, 3), 4: (False, 2), 5: (True, 0)}
    graded = {r.patient_id: (r.risk_level, r.yellow_subtype) for r in claims.graded(spark, "").collect()}
    assert graded == {p: ("Yellow", "Y_TRIPLE") if p in (1, 5) else ("Normal", None) for p in drugs}
    safe = {r.patient_id: r.safety_grade for r in ru.safety_net_grade(claims.safety_features(spark, "")).select("patient_id", "safety_grade").collect()}
    assert {p for p, g in safe.items() if g == "Red"} == {1, 3, 5}


def line(p, day, k, inst, name, atc, days=3, cls="c"):
    return (p, inst, day, day + dt.timedelta(days - 1), k, name, atc, cls)


LINES = "patient_id long, institution_id long, start_date date, end_date date, drug_id long, med_name string, med_atc string, class_no string"


def test_enzyme_scores_and_code_whammy(spark, monkeypatch):
    day = dt.date(2000, 1, 3)
    rows = [
        line(1, day, 1, 7, "clarithromycin 250mg", "J01FA09"), line(1, day, 2, 7, "simvastatin 20mg", "C10AA01"), line(1, day, 3, 8, "simvastatin 40mg", "C10AA01"),  # one code, two drugs: one substrate
        line(2, day, 4, 7, "clarithromycin 250mg", "J01FA09"), line(3, day, 5, None, "x", "C09AA02"), line(3, day, 6, 7, "y", "C03DA01"), line(3, day, 7, 7, "z", "M01AE02"), line(4, day, 8, None, None, None),
    ]
    lines = spark.createDataFrame(rows, LINES)
    monkeypatch.setattr(claims, "rx_meds", lambda s, sf: binding.with_kinds(lines))
    monkeypatch.setattr(claims, "demographics", lambda s, sf: spark.createDataFrame([], "patient_id long, age int, sex_type string"))
    got = {r.patient_id: r for r in claims.safety_features(spark, "").collect()}
    assert (got[1].cyp_risk_score, got[1].cyp_max_enzyme_risk, got[1].cyp_high_risk_pairs) == (18.0, 18.0, 1)  # 3 * (3 + 1 + 2)
    assert (got[2].cyp_risk_score, got[2].cyp_high_risk_pairs, got[2].drug_count, got[2].institution_count) == (12.0, 0, 1, 1)
    assert got[3].triple_whammy_codes and not got[3].triple_whammy and got[3].institution_count == 1
    assert (got[4].drug_count, got[4].institution_count, got[4].cyp_risk_score, got[4].n_lines) == (1, 0, 0.0, 1)


def test_a_patient_with_50000_lines(spark, monkeypatch):
    """One shared id with many lines in one bucket: counts and pairs without an array of the group."""
    n = 50_000
    base = spark.range(n).selectExpr("0L as patient_id", "id % 90 as institution_id", "date_add(date '2000-01-01', cast(id % 80 as int)) as start_date", "date_add(date '2000-01-01', cast(id % 80 + 9 as int)) as end_date", "id % 40 as drug_id", "concat('name', id % 40, 'x') as med_name", "concat('A', lpad(id % 20, 6, '0')) as med_atc", "cast(id % 11 as string) as class_no")
    one = spark.createDataFrame([line(5, dt.date(2000, 1, 3), 1, 7, "solo", "X01")], LINES)
    monkeypatch.setattr(claims, "rx_meds", lambda s, sf: binding.with_kinds(base.unionByName(one)))
    monkeypatch.setattr(claims, "demographics", lambda s, sf: spark.createDataFrame([], "patient_id long, age int, sex_type string"))
    rows = {(r.patient_id, r.window_start): r for r in claims.safety_features(spark, "").collect()}
    hot = next(r for (p, _), r in rows.items() if p == 0)
    assert sum(r.n_lines for (p, _), r in rows.items() if p == 0) == n and hot.dup_class == 11 and hot.institution_count == 90 and hot.dup_atc5 == 20
