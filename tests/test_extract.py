"""Chunks, resume after a broken run, database parts, catalogues and logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rxlattice.sources import extract as ex
from rxlattice.sources import files
from rxlattice.tables import folder


def lines(spark):
    rows = [(i % 7, dt.date(2024, 1, 1) + dt.timedelta(days=i), "T30" if i % 3 else "T60") for i in range(120)]
    return spark.createDataFrame(rows, "patient_id int, start_date date, source string").repartition(3)


def test_chunks_cover_without_overlap():
    for unit, size in (("month", 1), ("month", 5), ("day", 9)):
        plan = ex.chunks("202311", "202402", size, unit, before=1, after=1)
        assert plan[0].since == dt.date(2023, 10, 1) and plan[-1].until == dt.date(2024, 3, 31)
        assert all(a.until + dt.timedelta(1) == b.since for a, b in zip(plan, plan[1:])) and len({c.label for c in plan}) == len(plan)
    assert [c.label for c in ex.chunks("202401", "202403", 2)] == ["202401_202402", "202403"]
    with pytest.raises(ValueError, match="no chunks"):
        ex.chunks("202402", "202401")


def test_a_broken_run_goes_on_where_it_ended(spark):
    path, df, calls = folder(spark, "ex"), lines(spark), []
    plan = ex.chunks("202401", "202405")

    def records(chunk, fail=None):
        calls.append(chunk.label)
        rows = df.where(chunk.holds("start_date"))
        return rows.withColumn("source", F.when(F.lit(chunk.label != fail), F.col("source")).otherwise(F.raise_error(F.lit("lost")))) if fail else rows

    with pytest.raises(Exception, match="lost"):
        ex.extract(spark, path, plan, lambda c: records(c, "202403"))
    assert {r.label for r in ex.extract_log(spark, path).collect()} == {"202401", "202402"}
    calls.clear()
    assert ex.extract(spark, path, plan, records) == ["202403", "202404", "202405"] == calls
    got = {r.label: (r.n_records, r.n_t30, r.n_t60, r.first_day) for r in ex.extract_log(spark, path).collect()}
    want = df.groupBy(F.date_format("start_date", "yyyyMM").alias("m")).agg(F.count("*"), F.count_if(F.col("source") == "T30"), F.count_if(F.col("source") == "T60"), F.min("start_date").cast("string"))
    assert {k: v for k, v in got.items() if v[0]} == {r[0]: tuple(r)[1:] for r in want.collect()} and got["202405"] == (0, 0, 0, None)
    assert ex.extract(spark, path, plan, records) == []
    total = ex.extract_summary(spark, path, plan).first()
    assert (total.n_chunks, total.n_records, total.n_persons) == (5, 120, 7)
    assert ex.extracted(spark, path, plan).count() == 120


def test_statistics_count_once_when_tasks_fail(spark):
    """A task that fails and runs again doesn't count twice."""
    path, df = folder(spark, "ex"), lines(spark)
    plan = ex.chunks("202401", "202401")
    ex.extract(spark, path, plan, lambda c: df.where(c.holds("start_date")).repartition(5, "patient_id"))
    assert ex.extract_log(spark, path).first().n_records == 31


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_database_in_parts(spark, tmp_path):
    """Parts by months and pages hold every row once; filters and columns reach the database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i, f"p{i % 40:02d}", f"2024{1 + i % 3:02d}{1 + i % 28:02d}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "N int, PERSON string, DAY8 string, AMOUNT double")
    df.write.option("createTableColumnTypes", "PERSON VARCHAR(20), DAY8 VARCHAR(8)").jdbc(url, "lines", properties=DERBY)
    link = spark._jvm.java.sql.DriverManager.getConnection(url)
    link.createStatement().executeUpdate("UPDATE lines SET person = NULL WHERE MOD(N, 11) = 0")
    link.close()
    df = df.withColumn("PERSON", F.when(F.col("N") % 11 != 0, F.col("PERSON")))
    months = ex.month_conditions("DAY8", ["202401", "202402"])
    got = ex.read_jdbc_parts(spark, url, "lines", months, ("person", ["p10", "p30"]), DERBY)
    assert got.rdd.getNumPartitions() == 6
    want = df.where("DAY8 < '202403'")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    narrow = got.where("AMOUNT > 100").select("N")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull" in plan and "GreaterThan" in plan and "ReadSchema: struct<N:int>" in plan
    assert narrow.count() == want.where("AMOUNT > 100").count()
    ranged = files.read_jdbc(spark, url, "lines", "N", 0, 300, 4, "AMOUNT < 200", DERBY)
    assert ranged.rdd.getNumPartitions() == 4 and ranged.count() == 200


def test_contract_in_both_directions(spark):
    spark.range(1).selectExpr("id as A", "'x' as b", "1.5D as extra").createOrReplaceTempView("zz_one")
    wanted = spark.createDataFrame([("zz_one", "a", "bigint"), ("zz_one", "B", "int"), ("zz_one", "gone", None), ("zz_two", "k", None)], "table_name string, column_name string, data_type string")
    got = {tuple(r) for r in ex.contract_problems(ex.catalogue(spark, prefix="zz_"), wanted).collect()}
    assert got == {("zz_one", "gone", "missing"), ("zz_two", "k", "missing"), ("zz_one", "extra", "extra"), ("zz_one", "b", "type")}
    spark.catalog.dropTempView("zz_one")
    df = spark.createDataFrame([(1, 2, 3)], "patient_id int, b int, z int")
    assert ex.feature_problems(df, ["a", "b"]) == (["a"], ["z"])


def test_recent_partitions_and_runs(spark):
    path = folder(spark, "recent")
    for day in ("2024-01-01", "2024-01-03", "2024-01-02"):
        spark.createDataFrame([(f"n{day}",)], "name string").write.json(f"{path}/day={day}")
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{path}/day=2023-01-01")
    got = ex.read_recent(spark, path, "day", "name string", 2)
    assert {(r.name, r.day) for r in got.collect()} == {("n2024-01-02", "2024-01-02"), ("n2024-01-03", "2024-01-03")}
    assert len(got.inputFiles()) >= 2 and not any("2024-01-01" in f for f in got.inputFiles())
    assert ex.read_recent(spark, path, "day", "name string", 0).collect() == []
    runs = folder(spark, "runs")
    for i, at in ((1, "2024-01-02"), (2, "2024-01-05"), (3, "2024-01-05"), (1, "2024-01-01")):
        ex.append_run(spark, runs, f"r{i}", at, {"auc": i / 10})
    assert [(r.run_id, r.logged) for r in ex.run_catalogue(spark, runs, 2).collect()] == [("r2", "2024-01-05"), ("r3", "2024-01-05")]
    assert ex.run_catalogue(spark, runs).count() == 3
    results = spark.createDataFrame([("a", "linear", "auc", 0.8), ("a", "trees", "auc", 0.7), ("b", "linear", "auc", 0.9)], "run_id string, track string, name string, value double")
    assert {(r.run_id, r.linear_auc, r.trees_auc) for r in ex.baseline_report(results).collect()} == {("a", 0.8, 0.7), ("b", 0.9, None)}
