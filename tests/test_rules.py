import pytest
from pyspark.sql import functions as F

from rxlattice.functions import normalize as nz
from rxlattice.operators import features as ft
from rxlattice.operators import knowledge as kn
from rxlattice.operators import labels as lb
from rxlattice.operators import rules as ru

BASE = {"drug_count": 1, "institution_count": 1, "ddi_contraindicated": 0, "ddi_major": 0, "ddi_moderate": 0, "ddi_minor": 0, "dup_same_ingredient": 0, "high_risk": False, "renal_risk": False, "hepatic_risk": False, "triple_whammy": False, "age": 40}


@pytest.mark.parametrize(
    ("change", "level", "subtype"),
    [
        ({}, "Normal", None), ({"drug_count": 4}, "Normal", None), ({"drug_count": 5}, "Green", None), ({"ddi_minor": 1}, "Green", None), ({"ddi_contraindicated": 1, "ddi_major": 2}, "Red", None),
        ({"ddi_major": 1}, "Yellow", "Y_DDI_MAJOR"), ({"ddi_moderate": 1}, "Normal", None), ({"ddi_moderate": 2}, "Yellow", "Y_DDI_MOD"), ({"dup_same_ingredient": 1}, "Yellow", "Y_DUP"), ({"institution_count": 2}, "Normal", None),
        ({"institution_count": 3}, "Yellow", "Y_FRAG"), ({"institution_count": 3, "ddi_moderate": 2}, "Yellow", "Y_DOUBLE"), ({"institution_count": 3, "ddi_moderate": 2, "dup_same_ingredient": 1}, "Yellow", "Y_TRIPLE"),
        ({"triple_whammy": True}, "Yellow", "Y_TRIPLE"), ({"drug_count": 10, "high_risk": True}, "Yellow", "Y_TRIPLE"), ({"drug_count": 9, "high_risk": True}, "Green", None),
        ({"age": 75, "drug_count": 5, "renal_risk": True}, "Yellow", "Y_TRIPLE"), ({"age": 74, "drug_count": 5, "renal_risk": True}, "Green", None), ({"age": None, "drug_count": 5, "renal_risk": True}, "Green", None),
    ],
)
def test_grade_boundaries(spark, change, level, subtype):
    row = BASE | change
    types = {int: "int", bool: "boolean"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in BASE.items())
    got = ru.grade(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert (got.risk_level, got.yellow_subtype) == (level, subtype)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("tramadol hydrochloride   37.5mg", "tramadol"), ("esomeprazole magnesium (as esomeprazole 20mg)", "esomeprazole"), ("carbidopa hydrate (as carbidopa   25mg)", "carbidopa"), ("Caffeine anhydrous   0.1g", "caffeine"), ("sodium", "sodium")],
)
def test_ingredient(spark, raw, want):
    assert one(spark, raw, nz.ingredient) == want


def test_components(spark):
    assert one(spark, "ergotamine tartrate   1mg, caffeine anhydrous   0.1g, x", nz.components) == ["ergotamine", "caffeine"]


@pytest.mark.parametrize(("raw", "want"), [(" 123.0 ", "000000123"), ("1234567890", "1234567890"), ("12a", None), (None, None)])
def test_edi(spark, raw, want):
    assert one(spark, raw, nz.edi_code) == want


@pytest.mark.parametrize(("raw", "want"), [("", "Unknown"), (None, "Unknown"), ("X is contraindicated with Y", "Contraindicated"), ("may be FATAL", "Major"), ("The risk or severity of adverse effects", "Moderate"), ("nothing known", "Minor")])
def test_severity(spark, raw, want):
    assert one(spark, raw, nz.severity_of) == want


def test_missing_and_bands(spark):
    assert [one(spark, x, nz.missing_to_null) for x in ("nan", " None ", "", " a ")] == [None, None, None, "a"]
    ages = spark.createDataFrame([(0,), (19,), (20,), (74,), (75,), (200,), (None,)], "a int").select(nz.age_band(F.col("a")).alias("b")).collect()
    assert [r.b for r in ages] == ["0-19", "0-19", "20-39", "60-74", "75+", "unknown", "unknown"]


def test_pairs_over_component_ids(spark):
    lookup = kn.severity_lookup(spark.createDataFrame([("D_A", "D_B", "Major"), ("D_B", "D_A", "Minor"), ("D_C", "D_B", "odd"), ("D_A", None, "Major")], "drug_a_id string, drug_b_id string, severity string"))
    pairs = spark.createDataFrame([(1, ["D_A", "D_C"], ["D_B"]), (2, ["D_C"], ["D_B"]), (3, None, ["D_B"])], "k long, a array<string>, b array<string>")
    got = {r.k: (r["rank"], r.severity) for r in kn.pairs_with_severity(pairs, F.col("a"), F.col("b"), lookup).collect()}
    assert got == {1: (3, "Major"), 2: (0, None), 3: (0, None)}


def test_duplicate_levels(spark):
    rx = spark.createDataFrame([(1, "C09AA01"), (1, "C09AA01"), (1, "C09AA02"), (1, "C09AB01"), (1, "N02BE01"), (2, "C09AA01")], "patient_id long, atc_code string")
    got = {(r.atc_a, r.atc_b): (r.level, r.exception_code) for r in ru.duplicate_levels(rx, ["patient_id"]).collect()}
    assert got == {("C09AA01", "C09AA01"): (1, None), ("C09AA01", "C09AA02"): (2, "E1"), ("C09AA01", "C09AB01"): (3, "E1"), ("C09AA02", "C09AB01"): (3, "E1")}


def test_rule_table(spark):
    drugs = spark.createDataFrame([(1, 1, "B01AA03"), (1, 2, "M01AE01"), (2, 1, "C09AA01"), (2, 2, "C03DA01"), (2, 3, "M01AE01"), (3, 1, "C01BA01"), (3, 2, "C01BD01"), (4, 1, "N06AB03")], "patient_id long, drug_id long, atc_code string")
    got = {(r.patient_id, r.rule) for r in ru.apply_rules(ru.memberships(drugs, ru.group_table(spark, ru.GROUPS)), ru.RULES, ["patient_id"]).collect()}
    assert got == {(1, "TOP01"), (2, "TOP03")}


PLANTED = {
    "TOP01": ["Xarelto (rivaroxaban)", "aspirin 100"], "TOP02": ["Plavix", "esomeprazole"], "TOP03": ["valsartan", "Amiloride", "ketorolac"], "TOP04": ["digitoxin", "Isoptin"], "TOP05": ["MTX", "bactrim"],
    "TOP06": ["citalopram", "linezolid"], "TOP07": ["paroxetine", "rizatriptan"], "TOP08": ["lithobid", "indapamide"], "TOP09": ["sotalol", "methadone", "ondansetron"], "TOP10": ["lovastatin", "telithromycin"],
}


def test_each_rule_fires_by_name_and_not_without_one_of_its_drugs(spark):
    rows = [(f"{rule}-{gone}", k, name) for rule, names in PLANTED.items() for gone in ("all", *range(len(names))) for k, name in enumerate(names) if k != gone]
    drugs = spark.createDataFrame([(*r, None) for r in rows], "patient_id string, drug_id long, name string, atc_code string")
    members = ru.memberships(drugs, ru.group_table(spark, ru.GROUPS), name="name")
    got = {(r.patient_id, r.rule) for r in ru.apply_rules(members, ru.RULES, ["patient_id"]).collect()}
    assert got == {(f"{rule}-all", rule) for rule in PLANTED}


def test_second_stage_classes(spark):
    rows = spark.createDataFrame([("Yellow", "Y_DUP"), ("Green", None), ("Normal", None)], "l string, s string")
    assert [r.c for r in rows.select(ru.stage2_label(F.col("l"), F.col("s")).alias("c")).collect()] == ["Y_DUP", "Green", "Normal"]
    assert [r.c for r in spark.createDataFrame([("Y_DUP",), ("Green",), ("odd",)], "c string").select(ru.subtype_level(F.col("c")).alias("c")).collect()] == ["Yellow", "Green", "Normal"]
    for bad in (("Red", None), ("Yellow", None), ("Green", "Y_DUP")):
        with pytest.raises(Exception, match="no second-stage class"):
            spark.createDataFrame([bad], "l string, s string").select(ru.stage2_label(F.col("l"), F.col("s"))).collect()


def test_triple_whammy(spark):
    parts = spark.createDataFrame([(1, "perindopril erbumine"), (1, "spironolactone"), (1, "ibuprofen"), (2, "prilocaine"), (2, "spironolactone"), (2, "ibuprofen")], "patient_id long, component string")
    assert {r.patient_id: r.triple_whammy for r in ft.triple_whammy(parts, ["patient_id"]).collect()} == {1: True, 2: False}


def test_onset_and_censoring(spark):
    rows = [(1, "A", "2024-01-10"), (1, "B", "2024-01-12"), (1, "A", "2024-02-10"), (1, "B", "2024-02-11"), (1, "C", "2024-02-12"), (2, "A", "2024-01-12"), (3, "A", "2024-02-12")]
    events = spark.createDataFrame(rows, "patient_id long, institution_id string, d string").withColumn("start_date", F.to_date("d"))
    got = {r.patient_id: (r.label, r.kind, r.escalation) for r in lb.future_onset(events, "2024-01-31", 60, 60).collect()}
    assert got == {1: (1, "onset", 1), 2: (None, "censored", None)}


def test_adr_label(spark):
    diagnoses = spark.createDataFrame([(1, "K921", 30), (1, "N179", 120), (2, "E160", 0), (3, "X00", 1)], "patient_id long, code string, days int")
    drugs = spark.createDataFrame([(1, "M01AE01"), (2, "C09AA01")], "patient_id long, atc_code string")
    got = {r.patient_id: (r.reactions, r.confidence, r.adr_score) for r in lb.adr_labels(diagnoses, drugs).collect()}
    assert got == {1: (["bleeding"], "HIGH", 1.0), 2: (["hypoglycemia"], "MEDIUM", 0.8)}
