"""The intervention list: what is done, reasons by the triggers themselves, order of priority."""

from rxlattice.operators import rules as ru

BASE = {"k": 0, "drug_count": 1, "institution_count": 1, "ddi_contraindicated": 0, "ddi_major": 0, "ddi_moderate": 0, "ddi_minor": 0, "dup_same_ingredient": 0, "high_risk": False, "renal_risk": False, "hepatic_risk": False, "triple_whammy": False, "age": 40}
TYPES = {int: "int", bool: "boolean"}


def graded(spark, *changes):
    rows = [tuple((BASE | {"k": k} | c).values()) for k, c in enumerate(changes)]
    return ru.grade(spark.createDataFrame(rows, ", ".join(f"{n} {TYPES[type(v)]}" for n, v in BASE.items())))


def test_list(spark):
    got = ru.intervention_list(graded(
        spark, {"institution_count": 3, "ddi_moderate": 2, "dup_same_ingredient": 1}, {"ddi_major": 2, "triple_whammy": True, "institution_count": 4}, {"ddi_major": 1}, {"ddi_contraindicated": 2, "ddi_major": 1, "triple_whammy": True},
        {"drug_count": 10, "high_risk": True, "renal_risk": True, "age": 80}, {"ddi_moderate": 2}, {"ddi_minor": 1}, {"age": None, "drug_count": 6, "renal_risk": True}, {"ddi_contraindicated": 1},
    ), ["k"]).collect()
    assert [(r.k, r.priority, r.intervention, r.label, r.reasons) for r in got] == [
        (3, 0, "즉각 개입", "Red", "금기 DDI 2건"), (8, 0, "즉각 개입", "Red", "금기 DDI 1건"),
        (1, 1, "약사 전화", "Y_DDI_MAJOR", "중증 DDI 2건, 다기관(3곳↑), Triple Whammy"), (2, 1, "약사 전화", "Y_DDI_MAJOR", "중증 DDI 1건"),
        (0, 2, "문자 안내", "Y_TRIPLE", "Moderate DDI 2쌍, 동일성분 중복 1건, 다기관(3곳↑)"), (4, 2, "문자 안내", "Y_TRIPLE", "10종↑+고위험약, 고령(75+)+장기부전"),
    ]
    assert got[0].asDict() | {"risk_level": "Red", "ddi_contraindicated": 2, "ddi_major": 1, "drug_count": 1, "dup_same_ingredient": 0, "institution_count": 1} == got[0].asDict()


def test_reasons_below_yellow(spark):
    rows = graded(spark, {"ddi_minor": 3, "drug_count": 7}, {"drug_count": 7}, {})
    assert [r.t for r in rows.orderBy("k").select(ru.reason_text().alias("t")).collect()] == ["Minor DDI 3건", "5종↑ (7종)", ""]
