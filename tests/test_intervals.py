from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rxlattice.operators import intervals as iv

RX = "patient_id long, drug_id long, institution_id long, start_date date, end_date date, total_days int"


def line(patient, drug, start, days, place=1):
    first = date(2024, 1, 1) + timedelta(start)
    return (patient, drug, place, first, first + timedelta(days - 1), days)


def frame(spark, lines):
    return spark.createDataFrame(lines, RX)


@pytest.mark.parametrize(
    ("a", "b", "days"),
    [(("01", "10"), ("20", "30"), 0), (("01", "10"), ("11", "20"), 0), (("01", "10"), ("10", "20"), 1), (("05", "15"), ("01", "20"), 11), (("01", "20"), ("05", "15"), 11)],
)
def test_overlap_days(spark, a, b, days):
    d = [F.lit(f"2024-01-{x}").cast("date") for x in (*a, *b)]
    assert spark.range(1).select(iv.overlap_days(*d).alias("n")).first().n == days


def test_six_days_no_pair_seven_days_pair(spark):
    rx = frame(spark, [line(1, 1, 0, 10), line(1, 2, 4, 6), line(2, 1, 0, 10), line(2, 2, 3, 7), line(3, 5, 0, 10), line(3, 5, 0, 10)])
    assert [(r.patient_id, r.overlap_days) for r in iv.overlaps(rx).collect()] == [(2, 7)]


def test_long_line_meets_a_later_one_once(spark):
    rx = frame(spark, [line(1, 1, 0, 200), line(1, 2, 150, 40)])
    assert [r.overlap_days for r in iv.overlaps(rx).collect()] == [40]


def test_repeated_pair_is_one_pair_and_two_occurrences(spark):
    rx = frame(spark, [line(1, 1, 0, 10), line(1, 2, 0, 10), line(1, 1, 100, 10), line(1, 2, 100, 12)])
    occ = iv.overlaps(rx)
    assert occ.count() == 2
    row = iv.overlap_pairs(occ).first()
    assert (row.n_occurrences, row.max_overlap_days, row.first_overlap) == (2, 10, date(2024, 1, 1))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 4), st.integers(0, 300), st.integers(1, 120)), min_size=2, max_size=14), st.sampled_from([7, 30, 90, 365]))
def test_pairs_do_not_depend_on_the_bucket(spark, lines, width):
    rows = [line(*x) for x in lines]
    want = sorted((a[0], a[1], b[1], max(a[3], b[3]), min(a[4], b[4])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (min(a[4], b[4]) - max(a[3], b[3])).days + 1 >= 7)
    got = iv.overlaps(frame(spark, rows), width=width)
    assert sorted((r.patient_id, r.drug_a, r.drug_b, r.overlap_start, r.overlap_end) for r in got.collect()) == want


def test_concurrency_coverage_and_windows(spark):
    rx = frame(spark, [line(1, 1, 0, 10), line(1, 2, 5, 10), line(1, 3, 9, 1), line(1, 4, 20, 5)])
    assert iv.max_concurrent(rx).first().max_concurrent == 3
    row = iv.covered_days(rx).first()
    assert (row.supplied, row.covered, row.span) == (26, 20, 25)
    window = iv.observation_window(frame(spark, [line(1, 1, 0, 200)])).first()
    assert window.window_end == date(2024, 1, 1) + timedelta(89)


def test_line_to_interval(spark):
    rows = [("20240101", "5", " ", "B"), ("20240101", "0", "A", "B"), ("2024x", "5", "A", "B"), ("20240101", "5", "", " ")]
    got = iv.with_interval(spark.createDataFrame(rows, "start_text string, days string, code string, second string"), codes=("code", "second")).collect()
    assert [(r.drug_code, r.total_days, str(r.end_date)) for r in got] == [("B", 5, "2024-01-05"), ("A", 1, "2024-01-01")]


def test_plan_has_no_cartesian_product(spark):
    rx = frame(spark, [line(1, 1, 0, 10)])
    assert "Cartesian" not in iv.overlaps(rx)._jdf.queryExecution().executedPlan().toString()
