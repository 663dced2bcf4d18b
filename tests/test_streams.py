"""Streams of more than one batch: state across batches, one row for each key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rxlattice.operators import ml
from rxlattice.streaming import jobs
from rxlattice.tables import folder

DAY = dt.datetime(2024, 1, 1, 12)


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_one_row_a_user_and_late_rows(spark, tmp_path):
    def row(user, days, lasts):
        ts = DAY + dt.timedelta(days)
        return (user, ts, int((ts - dt.datetime(1970, 1, 1)).total_seconds()) + lasts * 86400)

    batches = [[row(1, 10, 5), row(2, 0, 1)], [row(1, 2, 30), row(1, 3, 1)], [row(1, 12, 1), row(3, 1, 1)]]
    log = stream(spark, tmp_path, batches, "user_id long, ts timestamp, ends_at long")
    got = {r.user_id: (r.n_seen, r.n_active, r.last_ts) for r in jobs.run(jobs.active_state(log), "active", "update", ("user_id",)).collect()}
    last = {1: 12, 2: 0, 3: 1}
    # At day 12 of user 1: the interval of day 10 (to 15), the late one of day 2 (to 32) and that of day 12 are open.
    assert got == {k: (n, a, DAY + dt.timedelta(last[k])) for k, n, a in ((1, 4, 3), (2, 1, 1), (3, 1, 1))}


def test_preferred_and_features_over_batches(spark, tmp_path):
    batches = [[(1, DAY, "T60"), (2, DAY, "T30"), (3, DAY, None)], [(1, DAY, "T30"), (2, DAY, "T60")], [(3, DAY, "T60")]]
    log = stream(spark, tmp_path, batches, "user_id long, ts timestamp, source string")
    assert {(r.user_id, r.source) for r in jobs.run(jobs.preferred(log, ["user_id"], "source"), "p", "update", ("user_id",)).collect()} == {(1, "T30"), (2, "T30"), (3, "T60")}
    assert {(r.user_id, r.n) for r in jobs.upsert_features(log).collect()} == {(1, 2), (2, 2), (3, 2)}


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def replay(weeks=9, users=40):
    """A batch a week; each user has rows in two weeks, three weeks apart, and some in both sources."""
    out = []
    for w in range(weeks):
        rows = []
        for u in range(users):
            if u % weeks in (w, w - 3):
                ts = DAY + dt.timedelta(days=7 * w + u % 5)
                rows += [(u, ts, "T60"), (u, ts + dt.timedelta(hours=1), "T30" if u % 2 else "T60")]
        out.append(rows)
    return out


def test_state_ends_in_a_two_month_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 4)
    batches = replay()
    every = [r for b in batches for r in b]
    static = spark.createDataFrame(every, "user_id long, ts timestamp, source string")
    log = stream(spark, tmp_path, batches, "user_id long, ts timestamp, source string")
    progress: list = []
    got = jobs.upsert_features(log, "replay", idle="5 days", delay="2 days", progress=progress)
    want = static.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = state_rows(progress)
    assert max(rows) <= 4 * 40 and rows[-1] < max(rows)  # value and timer of each user that is there, not of all

    days = static.withColumn("day", F.to_date("ts").cast("string"))
    progress = []
    best = jobs.drain(jobs.preferred(log.withColumn("day", F.to_date("ts").cast("string")), ["user_id", "day"], "source"), "replay-p", "update", ("user_id", "day"), progress)
    want = days.groupBy("user_id", "day").agg(F.min("source").alias("source"))
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect()))
    rows, keys = state_rows(progress), want.count()
    assert max(rows) < keys and rows[-1] < max(rows)


def test_rows_later_than_the_delay_are_dropped(spark, tmp_path):
    late = DAY - dt.timedelta(days=30)
    batches = [[(1, DAY, "T60")], [(2, DAY + dt.timedelta(days=9), "T60")], [(1, late, "T30"), (3, DAY + dt.timedelta(days=9), "T30")], [(4, DAY + dt.timedelta(days=9), "T30")]]
    log = stream(spark, tmp_path, batches, "user_id long, ts timestamp, source string")
    got = jobs.run(jobs.preferred(log, ["user_id"], "source"), "late", "update", ("user_id",))
    assert {(r.user_id, r.source) for r in got.collect()} == {(1, "T60"), (2, "T60"), (3, "T30"), (4, "T30")}


def test_least_of_a_key_that_comes_back(spark, tmp_path, monkeypatch):
    """The state of a key's first days has ended when it comes back; two of its windows may also meet in one batch."""
    monkeypatch.setattr(jobs, "COMPACT", 2)

    def row(user, days, source):
        return (user, DAY + dt.timedelta(days), source)

    batches = [[row(1, 0, "T30"), row(2, 0, "T60"), row(2, 3, "T30"), row(3, 3, None)], [row(4, 20, "T60")], [row(4, 20, "T60")], [row(1, 20, "T60"), row(2, 21, "T60"), row(3, 20, None)], [row(4, 19, "T30")]]
    log = stream(spark, tmp_path, batches, "user_id long, ts timestamp, source string")
    got = jobs.run(jobs.preferred(log, ["user_id"], "source"), "back", "update", ("user_id",)).collect()
    assert sorted(map(tuple, got)) == [(1, "T30"), (2, "T30"), (3, None), (4, "T30")]


def test_state_is_kept_without_python(spark, tmp_path):
    """A key costs no call into Python: several such calls a key took some milliseconds."""
    log = stream(spark, tmp_path, [[(1, DAY, "T60")]], "user_id long, ts timestamp, source string")
    for frame in (jobs.preferred(log, ["user_id"], "source"), jobs.feature_counts(log)):
        assert "Python" not in (plan := frame._jdf.queryExecution().analyzed().toString()) and "TransformWithState" not in plan


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(Session, "x")


def test_models_calibrate_and_validate(spark):
    rows = [(i, int(i % 10 >= 5), [f"c{i % 10}", f"d{i % 3}"], float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "patient_id long, label int, codes array<string>, x double")
    model, best = ml.cross_validated(ml.linear_model(), df, 2)
    scored = ml.score(model, df)
    assert best > 0.95 and ml.auc(scored) > 0.95
    got = ml.calibrated(scored.where("patient_id < 100"), scored.where("patient_id >= 100"))
    assert got.count() == 100 and got.where(F.abs(F.col("calibrated") - F.col("label")) > 0.5).count() == 0
