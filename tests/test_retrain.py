"""The training chain: saved products, references of drift, refusal of half-written ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxlattice.operators import retrain
from rxlattice.tables import folder, saved

COLUMNS = ["a", "b", "flat"]


def frame(spark, n=1500, shift=0.0, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.gauss(shift, 1)
        rows.append((i, int(a + rng.gauss(0, 0.3) > 0), a, None if i % 10 == 0 else rng.random(), 3.0))
    return saved(spark.createDataFrame(rows, "patient_id long, label int, a double, b double, flat double"), "frame")


def test_reference_equals_numpy(spark):
    df = frame(spark)
    got = {r.feature: r for r in retrain.reference(df, COLUMNS).collect()}
    for c in COLUMNS:
        v = np.array([r[c] for r in df.collect() if r[c] is not None])
        edges = np.unique(np.quantile(v, np.arange(1, 10) / 10))
        assert np.allclose(got[c].edges, edges)
        n = np.bincount((edges[None, :] <= v[:, None]).sum(1), minlength=len(edges) + 1)
        assert np.allclose(got[c].shares, n / n.sum())
    assert got["flat"].edges == [3.0] and got["flat"].shares == [0.0, 1.0]


def test_drift_of_shifted_and_missing_features(spark):
    path = folder(spark, "ref")
    retrain.reference(frame(spark), COLUMNS).write.parquet(path)
    saved_reference = spark.read.parquet(path)
    same = {r.feature: (r.psi, r.status) for r in retrain.drift(saved_reference, frame(spark)).collect()}
    assert all(abs(p) < 1e-12 and s == "stable" for p, s in same.values())
    moved = {r.feature: r.status for r in retrain.drift(saved_reference, frame(spark, shift=2.0).drop("b")).collect()}
    assert moved == {"a": "drift", "b": "missing", "flat": "stable"}


def test_product_is_saved_and_scores_later_rows(spark):
    path = folder(spark, "product")
    made = retrain.retrain(frame(spark).fillna(0.5), ["a", "b"], path)
    back = retrain.load(spark, path)
    assert (back.columns, back.tau_red, back.tau_review) == (made.columns, made.tau_red, made.tau_review) and back.tau_review < back.tau_red
    later = frame(spark, shift=0.2, seed=9).fillna(0.5)
    assert sorted(map(tuple, back.score(later.drop("label")).collect())) == sorted(map(tuple, made.score(later).collect()))
    said = {(r.kind, r.name): r.value for r in retrain.report(back, later).collect()}
    assert said["quality", "roc_auc"] > 0.95 and sum(v for (k, _), v in said.items() if k == "decision") == 1500
    assert {n for k, n in said if k == "drift"} == {"a", "b"}
    with pytest.raises(ValueError, match="missing features: b"):
        back.score(later.drop("b"))


def test_a_folder_without_manifest_is_refused(spark):
    path = folder(spark, "half")
    frame(spark).write.parquet(f"{path}/reference")
    with pytest.raises(ValueError, match="no whole training product"):
        retrain.load(spark, path)
    with pytest.raises(ValueError, match="no cut-offs"):
        df = retrain.parts(frame(spark).fillna(0.5))
        one = df.withColumn("label", F.when(F.col("part") == "val", 1).otherwise(F.col("label"))).drop("part")
        retrain.retrain(one, ["a", "b"], folder(spark, "bad"))
