import random

import pytest
from pyspark.sql import functions as F

from rxlattice.operators import features as ft
from rxlattice.operators import metrics as me
from rxlattice.operators import monitoring as mo
from rxlattice.operators import quality as qu
from rxlattice.operators import sampling as sp


def scores(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "id long, y int, score double")


def test_exact_small_case(spark):
    df = scores(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    assert me.roc_auc(df).first().roc_auc == 1.0
    best = me.pr_auc(df).first()
    assert (best.pr_auc, best.best_f1, best.best_threshold) == (1.0, 1.0, 0.8)


def test_auc_with_ties_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.3, round(rng.random(), 1)) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    df = scores(spark, [(int(y), s) for y, s in rows])
    assert me.roc_auc(df).first().roc_auc == pytest.approx(want)
    assert me.roc_auc(df.withColumn("score", F.col("score") ** 3)).first().roc_auc == pytest.approx(want)


def test_tau_falls_with_the_floor(spark):
    rng = random.Random(2)
    df = scores(spark, [(1, rng.betavariate(8, 2)) for _ in range(200)] + [(0, rng.betavariate(2, 8)) for _ in range(800)])
    taus = [r.tau for r in me.tau_sweep(df, [0.7, 0.8, 0.9, 0.95]).orderBy("floor").collect()]
    assert taus == sorted(taus, reverse=True)


def test_psi_of_itself_is_zero_and_shift_is_found(spark):
    a = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 3).alias("c"))
    assert mo.psi_continuous(a, a, "x").first().psi == pytest.approx(0)
    assert mo.psi_categorical(a, a, "c").first().psi == pytest.approx(0)
    assert mo.psi_continuous(a, a.withColumn("x", F.col("x") * 2), "x").first().psi > 0.2


def test_quotas_add_up_and_samples_repeat(spark):
    people = spark.range(540).select("id", (F.col("id") % 2).alias("s"), (F.col("id") % 5).alias("b"), (F.col("id") % 3).alias("r"))
    first = {r.id for r in sp.stratified(people, ["s", "b", "r"], 80, "id").collect()}
    assert len(first) == 80
    assert first == {r.id for r in sp.stratified(people.repartition(7), ["s", "b", "r"], 80, "id").collect()}


def test_split_is_disjoint_and_whole(spark):
    df = sp.split(spark.range(100).select("id", (F.col("id") % 10 == 0).cast("int").alias("y")), "y", "id")
    assert {(r.split, r.y): r["count"] for r in df.groupBy("split", "y").count().collect()} == {("train", 0): 63, ("val", 0): 13, ("test", 0): 14, ("train", 1): 7, ("val", 1): 1, ("test", 1): 2}


def test_dense_index_has_no_gaps(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "code string, n long")
    assert {r.code: r.idx for r in sp.dense_index(counts, "code").collect()} == {"b": 1, "a": 2, "c": 3, "d": 4}


def test_scaler(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (None,), (5.0,)], "x double")
    got = [r.x for r in ft.robust_scale(df, ["x"]).collect()]
    assert got == [-1.0, 0.0, 0.0, 0.0, 1.0]
    back = ft.robust_unscale(ft.robust_scale(df, ["x"]), ft.robust_stats(df, ["x"]), ["x"])
    assert [r.x for r in back.collect()] == [1.0, 3.0, 3.0, 3.0, 5.0]


def test_selection(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.lit(1.0).alias("c"), (F.col("id") % 7).cast("double").alias("d"))
    assert ft.select_features(df, ["a", "b", "c", "d"]) == ["a", "d"]
    assert ft.select_features(df, ["a", "b", "c", "d"], protected=("c",)) == ["a", "c", "d"]


def test_validation(spark):
    df = spark.createDataFrame([("1", "p", "20240101", "F"), (None, "p", "20241301", "F"), ("2", None, "20240101", "x")], "k string, p string, d string, s string")
    rules = qu.header_rules("k", "p", "d", "s", ["F"])
    assert {r.rule: r.n_bad for r in qu.long_counts(df, rules).collect()} == {"key_missing": 1, "patient_missing": 1, "bad_date": 1, "bad_status": 1}
    row = qu.validity(df, rules).first()
    assert (row.n_violations, row.n_bad_rows, row.passed) == (4, 2, False)
    with pytest.raises(ValueError):
        qu.require(df, ["k", "zz"])


def test_declines(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([0.9, 0.8, 0.7, 0.7, 0.6, 0.5])], "k string, t int, v double")
    assert [r.t for r in mo.declines(df, "v", "t", ["k"]).orderBy("t").collect()] == [2, 5]


def test_threshold_pairs_by_hand(spark):
    rows = [(i, y, x) for i, (y, x) in enumerate([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.5), (1, 0.3), (0, 0.3), (0, 0.1)])]
    got = {r.floor: r for r in me.threshold_pairs(spark.createDataFrame(rows, "id int, y int, score double"), [0.3, 0.6, 0.98, 0.0]).collect()}
    assert (got[0.3].tau_red, got[0.3].tau_review, got[0.3].n_red, got[0.3].n_review, got[0.3].n_clean, got[0.3].red_missed, got[0.3].red_lost) == (0.9, 0.3, 1, 5, 1, 2, 0)
    assert (got[0.6].tau_red, got[0.6].recall, got[0.6].precision) == (0.8, 2 / 3, 2 / 3)
    assert "above the floor" in got[0.98].error and "outside" in got[0.0].error and got[0.98].tau_red is None
    flat = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "id int, y int, score double")
    row = me.threshold_pairs(flat, [0.9]).first()
    assert row.collapsed and row.tau_red == 0.5 and abs(row.tau_review - (0.5 - 1e-6)) < 1e-12 and row.n_review == 0
    one = me.threshold_pairs(spark.createDataFrame([(0, 1, 0.5)], "id int, y int, score double"), [0.9]).first()
    assert one.error == "both classes are needed"
    assert me.best_pair(flat).collect() == []


def test_best_pair_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    for scale in (1.0, 1e-3, 50.0):
        rows = [(i, int(rng.random() < 0.3), round(rng.random(), 2) * scale) for i in range(300)]
        df = spark.createDataFrame(rows, "id int, y int, score double")
        scores = sorted({x for _, _, x in rows})
        pos = sum(y for _, y, _ in rows)

        def cost(red, review):
            fp = sum(y == 0 and x >= red for _, y, x in rows)
            lost = sum(y == 1 and x < review for _, y, x in rows)
            return round(fp + 0.2 * sum(review <= x < red for _, _, x in rows) + 3 * lost, 6), lost

        want = min((cost(a, b)[0], a, b) for i, a in enumerate(scores) for b in scores[:i] if 1 - cost(a, b)[1] / pos >= 0.4)
        r = me.best_pair(df, leak=3.0, target=0.4).first()
        assert (r.cost, r.tau_red, r.tau_review) == want
