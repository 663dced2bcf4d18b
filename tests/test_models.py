"""Reported metrics of the models against numpy on the very scores, calibration against a fit of its own."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxlattice.operators import metrics as me
from rxlattice.operators import ml
from rxlattice.plans import registry, storage
from rxlattice.tables import saved

SF = "/root/testdata/sf0.001"


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def pr_auc(y, s):
    """Trapezoids from (0, 1) over the distinct scores, descending."""
    area, recall, precision = 0.0, 0.0, 1.0
    for t in np.unique(s)[::-1]:
        tp, called = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        r, p = tp / (y == 1).sum(), tp / called
        area += (r - recall) * (p + precision) / 2
        recall, precision = r, p
    return area


def logistic_fit(x, y, rounds=100):
    """Newton's method for one feature and a constant, without a penalty."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-12 * np.eye(2), a.T @ (y - p))
    return lambda v: 1 / (1 + np.exp(-(w[0] + w[1] * v)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_linear_and_trees_on_the_given_tables(spark):
    label, codes = storage._patients(spark, SF)
    data = saved(label.join(codes, "patient_id"), "training")
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    reported = {r.model: r for r in registry.queries()["model_comparison"](spark, SF).collect()}
    for name, model in (("linear", ml.linear_model()), ("trees", ml.tree_model(["drugs", "days", "lines"]))):
        rows = ml.score(model.fit(train), test).collect()
        y, s = np.array([r.label for r in rows]), np.array([r.score for r in rows])
        assert reported[name].roc_auc == pytest.approx(auc(y, s), abs=1e-9) and reported[name].pr_auc == pytest.approx(pr_auc(y, s), abs=1e-9)
    ranked = registry.queries()["train_trees"](spark, SF).collect()
    assert {r.feature for r in ranked} == {"drugs", "days", "lines"} and sum(r.importance for r in ranked) == pytest.approx(1)


def test_calibration_equals_a_fit_of_its_own(spark):
    rng = np.random.default_rng(2)
    s = rng.random(400)
    y = (rng.random(400) < 0.2 + 0.5 * s).astype(int)
    rows = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "patient_id long, label int, score double")
    got = {r.patient_id: r.calibrated for r in ml.calibrated(rows.where("patient_id < 250"), rows.where("patient_id >= 250")).collect()}
    want = logistic_fit(s[:250], y[:250])
    assert all(got[i] == pytest.approx(want(s[i]), abs=1e-3) for i in range(250, 400))


def test_linear_model_learns_the_codes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        codes = [f"c{k}" for k in range(12) if rng.random() < 0.3]
        odds = -1 + 3 * ("c1" in codes) - 3 * ("c2" in codes)
        rows.append((i, int(rng.random() < 1 / (1 + np.exp(-odds))), codes))
    df = spark.createDataFrame(rows, "patient_id long, label int, codes array<string>")
    model = ml.linear_model().fit(df)
    weights = dict(zip(model.stages[0].vocabulary, model.stages[1].coefficients))
    assert max(weights, key=weights.get) == "c1" and min(weights, key=weights.get) == "c2"
    scored = ml.score(model, df)
    got = me.roc_auc(scored.withColumnRenamed("label", "y")).first().roc_auc
    rows = scored.select("label", F.col("score")).collect()
    assert got == pytest.approx(auc(np.array([r.label for r in rows]), np.array([r.score for r in rows]))) and got > 0.8
