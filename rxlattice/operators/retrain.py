"""Retraining as a chain with saved products: model, cut-offs and the distribution that drift is held against.

`retrain` splits a feature frame by the hash of its ids, fits the model on the training part, chooses the cut-offs on
the validation part and saves all of it below one folder, with a manifest written last: a folder without one is no
whole product and `load` refuses it. What is scored later uses the saved products alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics, ml
from .monitoring import psi_of, psi_status

#: Bins of a feature's reference distribution.
BINS = 10


def reference(train: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """feature, edges, shares: the quantile bins of each column, exact, and the share of its rows in each.

    Nulls are left out; edges are made unique, so there may be fewer bins; a column without values has no row.
    """
    probs = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    one = train.agg(*(F.array_distinct(F.percentile(F.col(c).cast("double"), probs)).alias(f"c{i}") for i, c in enumerate(columns)))
    edges = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("edges")) for i, c in enumerate(columns))))).where("edges is not null")
    known = {r["feature"]: r["edges"] for r in edges.collect()}  # at most bins - 1 numbers for each column
    counts = _binned(train, known).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    place = F.sequence(F.lit(0), F.size("edges"))
    return edges.join(counts, "feature").select("feature", "edges", F.transform(place, lambda b: F.coalesce(F.col("m")[b], F.lit(0)) / F.col("total")).alias("shares"))


def _binned(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """feature, bin, n: the rows of each bin of all features, by one pass and one aggregate."""

    def place(c: str) -> Column:
        return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[c])), lambda e: e <= F.col(c).cast("double")))

    names = [c for c in edges if c in df.columns]
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, bin int, n long")
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), place(c)).alias("bin")) for c in names)))
    return df.select(cells).where("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def drift(saved_reference: DataFrame, current: DataFrame) -> DataFrame:
    """feature, psi, status of `current` against a saved reference; a feature it doesn't have is `missing`.

    Empty shares count as in the other drift reports.
    """
    known = {r["feature"]: r["edges"] for r in saved_reference.select("feature", "edges").collect()}
    counts = _binned(current, known)
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    each = saved_reference.select("feature", F.posexplode("shares").alias("bin", "r")).join(F.broadcast(counts), ["feature", "bin"], "left").join(F.broadcast(totals), "feature", "left")
    there = each.where("total is not null").select("feature", "r", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("c"))
    found = saved_reference.select("feature").join(F.broadcast(psi_of(there, ["feature"])), "feature", "left")
    return found.withColumn("status", F.when(F.col("psi").isNull(), "missing").otherwise(psi_status(F.col("psi"))))


@dataclass(frozen=True)
class Product:
    """What a training run has saved."""

    path: str
    columns: list[str]
    model: PipelineModel
    tau_red: float
    tau_review: float

    def reference(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/reference")

    def score(self, df: DataFrame, id_: str = "patient_id") -> DataFrame:
        """id, score and decision (Red, REVIEW, clear) by the saved model and cut-offs; no label is needed."""
        if gone := [c for c in self.columns if c not in df.columns]:
            raise ValueError(f"missing features: {', '.join(gone)}")
        scored = self.model.transform(df).select(id_, ml.positive("probability").alias("score"))
        decision = F.when(F.col("score") >= self.tau_red, "Red").when(F.col("score") >= self.tau_review, "REVIEW").otherwise("clear")
        return scored.withColumn("decision", decision)


def parts(df: DataFrame, id_: str = "patient_id") -> DataFrame:
    """`df` with its part by the hash of the id: train (70), val (15), test (15)."""
    place = F.pmod(F.xxhash64(F.col(id_).cast("string")), F.lit(100))
    return df.withColumn("part", F.when(place < 70, "train").when(place < 85, "val").otherwise("test"))


def _text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def retrain(features: DataFrame, columns: list[str], path: str, floor: float = 0.9, target: float = 0.98, id_: str = "patient_id", label: str = "label") -> Product:
    """Train, choose cut-offs, save everything below `path`; the products are read back from there.

    `features` is read several times and should be a table. Rows without a label are left out. Too few classes in the
    validation part raise, as no cut-off can be chosen.
    """
    spark = features.sparkSession
    df = parts(features.where(F.col(label).isNotNull()), id_).withColumnRenamed(label, "label")
    train, val = df.where("part = 'train'"), df.where("part = 'val'")
    model = ml.tree_model(columns).fit(train)
    model.write().overwrite().save(f"{path}/model")
    reference(train, columns).write.mode("overwrite").parquet(f"{path}/reference")
    scored = ml.score(model, val, id_).withColumnRenamed("label", "y")
    cut = metrics.threshold_pairs(scored, [floor], target).first()
    if cut["error"]:
        raise ValueError(f"no cut-offs: {cut['error']}")
    _text(spark, f"{path}/manifest", json.dumps({"columns": columns, "tau_red": cut["tau_red"], "tau_review": cut["tau_review"], "floor": floor, "target": target}))
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Product:
    try:
        said = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    except Exception as e:
        raise ValueError(f"{path} holds no whole training product") from e
    return Product(path, said["columns"], PipelineModel.load(f"{path}/model"), said["tau_red"], said["tau_review"])


def report(product: Product, later: DataFrame, id_: str = "patient_id", label: str = "label") -> DataFrame:
    """kind, name, value: cut-offs, quality on labelled later rows, shares of decisions, drift of each feature."""
    spark = later.sparkSession
    scored = product.score(later, id_)
    with_label = scored.join(later.select(id_, F.col(label).alias("y")), id_).where("y is not null")
    auc = metrics.roc_auc(with_label).select(F.lit("quality").alias("kind"), F.lit("roc_auc").alias("name"), F.col("roc_auc").alias("value"))
    at = metrics.confusion(with_label, product.tau_red)
    rates = at.select(F.inline(F.array(*(F.struct(F.lit("quality").alias("kind"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in ("recall", "precision")))))
    decided = scored.groupBy("decision").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("decision").alias("kind"), F.col("decision").alias("name"), "value")
    cuts = spark.createDataFrame([("cut", "tau_red", product.tau_red), ("cut", "tau_review", product.tau_review)], "kind string, name string, value double")
    drifted = drift(product.reference(spark), later).select(F.lit("drift").alias("kind"), F.col("feature").alias("name"), F.col("psi").alias("value"))
    return cuts.unionByName(auc).unionByName(rates).unionByName(decided).unionByName(drifted)
