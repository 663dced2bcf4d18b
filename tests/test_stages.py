"""Stages persisted step by step: recovery, versions, other inputs."""

import pytest
from pyspark.sql import functions as F

from rxlattice.sources import stages as sg
from rxlattice.tables import folder


def plan(spark, calls, version=1, fail=None):
    def step(name, f):
        def make(t):
            calls.append(name)
            if name == fail:
                raise RuntimeError("lost")
            return f(t)

        return make

    return [
        sg.Stage("a", 1, step("a", lambda t: spark.range(4))), sg.Stage("b", version, step("b", lambda t: t["a"].withColumn("x", F.col("id") * version)), ("a",)),
        sg.Stage("c", 1, step("c", lambda t: t["a"].selectExpr("id as y")), ("a",)), sg.Stage("d", 1, step("d", lambda t: t["b"].join(t["c"], F.col("id") == F.col("y")).agg(F.sum("x").alias("s"))), ("b", "c")),
    ]


def test_recovery_and_versions(spark):
    path, calls = folder(spark, "stages"), []
    with pytest.raises(RuntimeError, match="lost"):
        sg.run_stages(spark, path, plan(spark, calls, fail="c"), "2024-01")
    calls.clear()
    tables, made = sg.run_stages(spark, path, plan(spark, calls), "2024-01")
    assert made == calls == ["c", "d"] and tables["d"].first().s == 6
    calls.clear()
    assert sg.run_stages(spark, path, plan(spark, calls), "2024-01")[1] == [] == calls
    sg.forget(spark, path, plan(spark, calls), "2024-01", "b")
    assert sg.run_stages(spark, path, plan(spark, calls), "2024-01")[1] == ["b"]  # those after it are whole and stay
    tables, made = sg.run_stages(spark, path, plan(spark, calls, version=2), "2024-01")
    assert made == ["b", "d"] and tables["d"].first().s == 12
    assert sg.run_stages(spark, path, plan(spark, calls), "2024-02")[1] == ["a", "b", "c", "d"]
    said = [(r.stage, r.version, r.source) for r in sg.manifests(spark, path).collect()]
    assert sorted(said) == sorted([("a", 1, "2024-01"), ("b", 1, "2024-01"), ("b", 2, "2024-01"), ("c", 1, "2024-01"), ("d", 1, "2024-01"), ("d", 1, "2024-01"), *((n, 1, "2024-02") for n in "abcd")])


def test_order_is_checked(spark):
    stages = plan(spark, [])
    with pytest.raises(ValueError, match="comes before"):
        sg.keys(stages[::-1], "x")
    with pytest.raises(ValueError, match="twice"):
        sg.keys([stages[0], stages[0]], "x")
