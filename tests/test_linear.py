"""The model whose vectors are spread over the cluster against `pyspark.ml` on the same rows."""

import os

import numpy as np
import pytest

from rxlattice.operators import linear, ml
from rxlattice.plans import registry

SF = "/root/testdata/sf0.001"
SCHEMA = "patient_id long, label int, codes array<string>"


@pytest.fixture(scope="module")
def rows(spark):
    """Rows with up to 30 codes each of 60, one code that all have, and some rows without a code."""
    rng = np.random.default_rng(7)
    got = []
    for i in range(300):
        codes = [f"c{k}" for k in range(60) if rng.random() < 0.02 + 0.4 * (k % 7 == 0)]
        odds = -1 + 2 * ("c0" in codes) - 2 * ("c7" in codes) + ("c5" in codes)
        got.append((i, int(rng.random() < 1 / (1 + np.exp(-odds))), ["all", *codes] if i < 290 or i >= 295 else ["all"]))
    return spark.createDataFrame(got, SCHEMA)


def test_same_weights_and_scores_over_many_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(linear, "WIDTH", 25)
    monkeypatch.setattr(linear, "ROWS", 90)
    train, test = rows.where("patient_id < 240").cache(), rows.where("patient_id >= 240").unionByName(spark.createDataFrame([(900, 0, []), (901, 1, ["unseen"])], SCHEMA))
    want, got = ml.linear_model().fit(train), linear.fit(train)
    weights = {r.code: r.weight for r in got.weights.collect()}
    assert weights == pytest.approx(dict(zip(want.stages[0].vocabulary, want.stages[1].coefficients.toArray())), abs=1e-9) and weights["all"] == 0
    assert got.intercept == pytest.approx(want.stages[1].intercept, abs=1e-9)
    scores = {r.patient_id: r.score for r in got.score(test).collect()}
    assert scores == pytest.approx({r.patient_id: r.score for r in ml.score(want, test).collect()}, abs=1e-9) and len(scores) == 62


def test_rows_of_one_class_or_without_codes(spark):
    ones = linear.fit(spark.createDataFrame([(1, 1, ["a"]), (2, 1, ["b"])], SCHEMA))
    assert [r.score for r in ones.score(spark.createDataFrame([(3, 0, ["a"])], SCHEMA)).collect()] == [1.0]
    bare = linear.fit(spark.createDataFrame([(1, 1, []), (2, 0, []), (3, 0, []), (4, 0, [])], SCHEMA))
    assert [r.score for r in bare.score(spark.createDataFrame([(5, 0, ["a"])], SCHEMA)).collect()] == pytest.approx([0.25])
    with pytest.raises(ValueError):
        linear.fit(spark.createDataFrame([], SCHEMA))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["train_linear", "batch_score", "model_comparison"])
def test_queries_hold_no_vocabulary_in_the_driver(spark, monkeypatch, name):
    def local(*_, **__):
        raise AssertionError("vocabulary and weights in the driver")

    fitted = []

    def fit(train):
        fitted.append(train.columns)
        return linear.Linear(spark.createDataFrame([("1", 0.5), ("2", -0.5)], "code string, weight double"), 0.1)

    monkeypatch.setattr(ml, "CountVectorizer", local)
    monkeypatch.setattr(linear, "fit", fit)
    assert registry.queries()[name](spark, SF).count() > 0 and len(fitted) == 1
