"""Concurrency over time, contraindicated labels, class order, history encoding and the labelling job, by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rxlattice.operators import intervals as iv
from rxlattice.operators import labels as lb
from rxlattice.operators import rules as ru
from rxlattice.operators import sampling as sp

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def test_concurrency_equals_days_counted_one_by_one(spark):
    rng = random.Random(2)
    rows = [(p, day(a), None if rng.random() < 0.1 else day(a + rng.randint(0, 60))) for p in range(12) for a in (rng.randint(0, 200) for _ in range(rng.randint(1, 9)))]
    df = spark.createDataFrame(rows, "patient_id int, start_date date, end_date date")
    for since, until in ((day(50), day(120)), (day(100), day(100)), (None, None)):
        got = {r.patient_id: (r.max_concurrent, r.avg_concurrent, r.days) for r in iv.concurrency(df, since and since.isoformat(), until and until.isoformat()).collect()}
        want = {}
        for p in range(12):
            own = [(s, e if e else (until or s)) for q, s, e in rows if q == p]
            low, high = since or min(s for s, _ in own), until or max(e for _, e in own)
            days = [low + dt.timedelta(days=i) for i in range((high - low).days + 1)]
            n = [sum(s <= d <= e for s, e in own) for d in days]
            if any(n):
                want[p] = (max(n), sum(n) / len(n), len(n))
        assert got.keys() == want.keys()
        assert all(got[p][0] == m and abs(got[p][1] - a) < 1e-12 and got[p][2] == k for p, (m, a, k) in want.items())


def test_contraindicated_overlap(spark):
    rng = random.Random(6)
    pairs = {tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(9)}
    rows = [(p, rng.choice("abcdefgh") if rng.random() < 0.9 else None, day(a), day(a + rng.choice([0, 3, 200]))) for p in range(25) for a in (rng.randint(0, 400) for _ in range(rng.randint(1, 7)))]
    lines = spark.createDataFrame(rows, "patient_id int, id string, start_date date, end_date date")
    table = spark.createDataFrame([(b, f" {a} ") for a, b in pairs] + [("a", "a"), (None, "b"), ("", "c")], "drug_a_code string, drug_b_code string")
    known = lb.contraindicated_pairs(table)
    assert {tuple(r) for r in known.collect()} == pairs
    got = {r.patient_id: r for r in lb.contraindicated_label(lines, known).collect()}
    for p in {r[0] for r in rows}:
        own = {(i, s, e) for q, i, s, e in rows if q == p and i}
        ids = {i for i, _, _ in own}
        hits = {(a, b) for a, b in pairs if {a, b} <= ids}
        met = [(x[0], y[0]) for x in own for y in own if (x[0], y[0]) in pairs and x[1] <= y[2] and y[1] <= x[2]]
        assert (got[p].n_ids, got[p].hits, got[p].overlap_hits, got[p].n_occurrences) == (len(ids), len(hits), len(set(met)), len(met))
        assert (got[p].label, got[p].overlap_label) == (int(bool(hits)), int(bool(met)))
    other = table.withColumnsRenamed({"drug_a_code": "INGR_CODE", "drug_b_code": "MIXTURE_INGR_CODE"})
    assert {tuple(r) for r in lb.contraindicated_pairs(other).collect()} == pairs
    with pytest.raises(ValueError, match="no pair columns"):
        lb.contraindicated_pairs(table.select("drug_a_code"))


def test_probabilities_in_global_order(spark):
    df = spark.createDataFrame([([0.1, 0.9],), (None,)], "p array<double>")
    got = df.select(ru.global_probabilities(F.col("p"), ["Y_DUP", "Y_TRIPLE"]).alias("g")).collect()
    assert got[0].g == [0.9, 0, 0, 0, 0.1, 0, 0] and got[1].g is None
    assert df.select(ru.likeliest(ru.global_probabilities(F.col("p"), ["Y_DUP", "Y_TRIPLE"])).alias("c")).collect()[0].c == "Y_TRIPLE"
    with pytest.raises(ValueError, match="repeat"):
        ru.global_probabilities(F.col("p"), ["Y_DUP", "Y_DUP"])
    with pytest.raises(ValueError, match="among"):
        ru.global_probabilities(F.col("p"), ["Other"])
    with pytest.raises(Exception, match="3 probabilities are wanted, there are 2"):
        df.select(ru.global_probabilities(F.col("p"), ["Y_DUP", "Y_TRIPLE", "Y_FRAG"])).collect()


def test_history_encoding(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "code string, idx long")
    events = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (1, "q", "y"), (1, "r", None), (2, "q", "x"), (3, None, "z")], "patient_id int, code string, place string")
    got = {r.patient_id: (r["columns"], r.n_known, r.n_unknown, r.places) for r in sp.encode_history(events, vocab, "code", "place", 4).collect()}
    assert got == {1: ([0, 1, 2], 2, 2, 0.5), 2: ([0], 0, 1, 0.25), 3: ([], 0, 0, 0.25)}


def test_higher_pairs(spark):
    rows = [(1, "B", "a ", "Minor"), (1, "A", "b", "Major"), (1, "a", "c", "odd"), (1, "A", "a", "Major"), (2, "x", "y", "Contraindicated")]
    got = {(r.k, r.name_lo, r.name_hi): (r.severity, r.n_contraindicated, r.n_major, r.n_minor) for r in ru.higher_pairs(spark.createDataFrame(rows, "k int, a_name string, b_name string, severity string"), ["k"]).collect()}
    assert got == {(1, "a", "b"): ("Major", 0, 1, 0), (1, "a", "c"): (None, 0, 1, 0), (2, "x", "y"): ("Contraindicated", 1, 0, 0)}


def test_labelling_job(spark):
    levels = spark.createDataFrame([(i, ("Red", "Yellow", "Green", "Normal")[i % 4]) for i in range(80)], "patient_id int, risk_level string")
    diagnoses = spark.createDataFrame([(i, "K920", 5) for i in range(0, 80, 6)] + [(1, "K92", 300)], "patient_id int, code string, days int")
    drugs = spark.createDataFrame([(0, "B01AA03")], "patient_id int, atc_code string")
    labelled = lb.reaction_labels(lb.rule_labels(levels), diagnoses, drugs)
    rows = {r.patient_id: r for r in labelled.collect()}
    assert len(rows) == 80 and {p for p, r in rows.items() if r.adr_label} == set(range(0, 80, 6))
    assert rows[6].final_label == "Red" and rows[6].rule_label == "Green" and rows[1].final_label == "Yellow" and rows[0].adr_confidence == "HIGH" and rows[6].adr_confidence == "MEDIUM"
    alone = lb.reaction_labels(lb.rule_labels(levels), None, None)
    assert {(r.adr_confidence, r.final_label == r.rule_label) for r in alone.collect()} == {("LOW", True)}
    sample = lb.review_sample(labelled, {"Red": 0.3, "Yellow": 0.3, "Green": 0.25, "Normal": 0.15}, 20, 0.2)
    said = {r.name: r.value for r in lb.review_report(sample, labelled).collect()}
    assert said["n"] == 20 and said["share_Red"] == 0.3 and said["agreement"] == 1.0 and said["n_all"] == 80
    assert {r.review_status for r in sample.collect()} == {"pending"}
    with pytest.raises(ValueError, match="risk_level"):
        lb.rule_labels(levels.drop("risk_level"))


def test_lines_are_computed_once_for_contraindicated_labels(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(i):
        read.add(1)
        return i

    day = dt.date(2024, 1, 1)
    lines = spark.createDataFrame([(p, i, day, day) for p in range(10) for i in "abc"], "patient_id long, id string, start_date date, end_date date").withColumn("id", seen("id"))
    known = spark.createDataFrame([("a", "b"), ("a", "x")], "id_lo string, id_hi string")
    got = lb.contraindicated_label(lines, known).collect()
    assert {tuple(r)[1:] for r in got} == {(3, 1, 1, 1, 1, 1)} and len(got) == 10 and read.value == 30
