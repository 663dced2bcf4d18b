"""Nulls, empty tables, clashing columns, repeated rows and long texts for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from rxlattice.llm import chunk_store, decontaminate, fertility, language_model, line_dedup, near_dedup, packing, quality_model, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["hash", "key", "n", "uid", "start", "part", "spans", "again", "n_lines", "n_removed", "class_id", "symbols", "_doc", "component", "a", "b", "label", "held_out", "score"]
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s1", 10), (1, "alpha beta gamma delta epsilon zeta", "en", "s1", 10), (2, None, None, None, None), (3, "", "en", "s2", 0), (4, "  \n\t ", "en", "s2", 5),
    (None, "alpha beta gamma delta epsilon zeta", "en", "s3", 10), (5, LONG, "en", "s1", len(LONG)), (6, "one\ntwo\nthree\nfour", "en", "s1", 4), (7, "one\ntwo\nthree\nfive", None, "s1", 4), (8, "ÀÉ ü x 日本語", "fr", "s1", 4),
]
LABELS = [(1, 1, 0), (3, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 1)]
ITEMS = [(1, "gamma delta epsilon zeta alpha beta"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon zeta")]


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d: quality_model.score(d, quality_model.train(d, labels(s))),
    "chunk_store": lambda s, d: chunk_store.read_documents(s, chunk_store.write_store(d)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "secrets": lambda s, d: secrets.scan(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "contained": lambda s, d: decontaminate.contained_items(d, items(s)),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "lm": lambda s, d: language_model.score(d, language_model.train(d, 3)),
    "fertility": lambda s, d: fertility.apply_rules(d),
    "packing": lambda s, d: packing.pack(d),
}
PER_ROW = {"quality", "chunk_store", "toxicity", "secrets", "near", "lines", "lm", "fertility"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, DOCS)
    plain = OPERATORS[name](spark, docs).collect()
    if name in PER_ROW:
        assert len(plain) == len(ROWS)
    wide = docs.select("*", *(F.lit("x").alias(c) for c in CLASH))
    again = OPERATORS[name](spark, wide)
    if name == "lines":  # passes columns through
        assert again.columns[-2:] == ["_n_lines", "_n_removed"] and {r.n_lines for r in again.collect()} == {"x"}
        again = again.selectExpr(*docs.columns, "_n_lines as n_lines", "_n_removed as n_removed")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, plain))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    none = labels(spark, [])
    assert all(r.selected for r in quality_model.score(docs, quality_model.train(docs, none)).collect())
    assert all(r.score < 1e-6 and not r.spans for r in toxicity.score(docs, toxicity.train(docs, none)).collect())


def test_no_items(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    assert decontaminate.contained_items(docs, items(spark, [])).collect() == []
    assert decontaminate.drop_contaminated(docs, items(spark, [])).count() == len(ROWS)


def test_contained_values(spark):
    found = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained_items(spark.createDataFrame(ROWS, DOCS), items(spark)).collect()}
    assert found == {(1, 4, 1), (1, None, 2), (None, 4, 1), (None, None, 2)}


def test_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, DOCS)
        wide = docs.drop("n_chars").select("*", *(F.lit("x").alias(c) for c in CLASH))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, columns = docs, wide.columns
            docs, wide = stage(spark, docs, str(tmp_path)), stage(spark, wide, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and wide.columns == columns, name
            assert docs.schema == before.schema
            plain = ["doc_id", "text", "lang", "source"]
            assert sorted(map(repr, docs.select(plain).collect())) == sorted(map(repr, wide.select(plain).collect())), name
            assert all(r[c] == "x" for r in wide.collect() for c in CLASH)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert bool(pieces) == bool(rows)
