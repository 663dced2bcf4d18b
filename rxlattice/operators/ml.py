"""Distributed training and scoring with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_lists(events: DataFrame, code: str, id_: str = "patient_id") -> DataFrame:
    """Distinct codes of each id as an array of texts: what the sparse vectors are made from."""
    return events.select(id_, F.col(code).cast("string").alias("c")).distinct().groupBy(id_).agg(F.collect_list("c").alias("codes"))


def linear_model(max_vocab: int = (1 << 31) - 1, reg: float = 0.01, weight: str | None = None) -> Pipeline:
    """Logistic regression on the multi-hot sparse vector of `codes`; every code has a place unless `max_vocab` is less.

    Vocabulary and weights lie in the driver; `linear.fit` fits the same model with both spread over the cluster.
    """
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=20)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[CountVectorizer(inputCol="codes", outputCol="features", binary=True, vocabSize=max_vocab), lr])


def tree_model(columns: list[str], kind: str = "gbt", seed: int = 42) -> Pipeline:
    """Boosted trees or a forest on numeric columns."""
    if kind == "gbt":
        trees = GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, seed=seed)
    else:
        trees = RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=5, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), trees])


def positive(column: str) -> Column:
    """The probability of the positive class."""
    return vector_to_array(column)[1]


def score(model: PipelineModel, df: DataFrame, id_: str = "patient_id") -> DataFrame:
    return model.transform(df).select(id_, "label", positive("probability").alias("score"))


def auc(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(scored)


def cross_validated(pipeline: Pipeline, df: DataFrame, folds: int = 3, seed: int = 42) -> tuple[PipelineModel, float]:
    lr = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed).fit(df)
    return cv.bestModel, max(cv.avgMetrics)


def importances(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(columns, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def calibrated(held_out: DataFrame, scored: DataFrame) -> DataFrame:
    """`scored` with its scores put through a one-feature logistic regression that is fitted on other, held-out rows."""
    p = Pipeline(stages=[VectorAssembler(inputCols=["score"], outputCol="features"), LogisticRegression(labelCol="label")])
    return p.fit(held_out).transform(scored).select("*", vector_to_array("probability")[1].alias("calibrated")).drop("features", "rawPrediction", "probability", "prediction")
