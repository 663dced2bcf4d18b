"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame. All but the
last return the columns of `documents`; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlattice.llm import decontaminate, line_dedup, near_dedup, packing, quality_model
from rxlattice.llm.common import materialize, table

#: Near copies share so many percent of their shingles; the 85 of op5 is the contract of that query alone.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good grade is too small go.

    A null, empty or blank text has the score 0 and is judged by the thresholds alone; repeated rows share one
    fate; without labels, or with one grade only, all stay; a null doc_id trains nothing but is judged; an empty
    table stays empty. All columns pass through as they are.
    """
    return quality_model.select_documents(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go; a document that has nothing but repeated lines goes whole.

    Null, empty and blank texts, texts of fewer than three lines and rows with a null doc_id stay as they are;
    rows that repeat a doc_id and text don't remove each other's lines; of windows with equal lines the one of
    least (doc_id, position) stays. n_chars is counted anew where lines went, if there is such a column. All
    other columns pass through, whatever their names.
    """
    found = line_dedup.dedup_lines(docs)
    n_lines, n_removed = line_dedup.count_names(docs)
    found = found.where((F.col(n_lines) == 0) | (F.col(n_removed) < F.col(n_lines)))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, of a similarity of 0.8 or more, the smallest doc_id stays.

    Null, empty and blank texts have no shingle, are near nothing and stay; so do rows with a null doc_id; of
    rows that repeat one doc_id all stay if that doc_id does. All columns pass through as they are.
    """
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; null and empty items are held by none; repeated rows share one
    fate; an empty benchmark removes nothing; a null doc_id is judged by its text. All columns pass through.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces of sequences of at most 4096 tokens.

    A null text is an empty one and holds the end id only; repeated rows and rows with a null doc_id are packed
    each on its own; an empty table gives no piece; columns other than doc_id and text are ignored.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("pack", pack),
]

#: A fitted classifier and a tokenizer can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
