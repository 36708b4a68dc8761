"""Distributed models over feature columns, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import selection

#: Rows of a bucket within which permuted values are dealt out.
BUCKET_ROWS = 10_000

#: Estimators over columns `features` and `label`; add to them to make one known.
CLASSIFIERS: dict[str, Callable] = {
    "logistic": lambda: LogisticRegression(maxIter=50),
    "logistic_balanced": lambda: LogisticRegression(maxIter=50, weightCol="weight"),
    "linear_svc": lambda: LinearSVC(maxIter=50),
    "forest": lambda: RandomForestClassifier(numTrees=20, seed=1),
    "linear_svc_balanced": lambda: LinearSVC(maxIter=50, weightCol="weight"),
    "forest_balanced": lambda: RandomForestClassifier(numTrees=20, seed=1, weightCol="weight"),
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
    "boosted": lambda: GBTClassifier(maxIter=10, seed=1),
    "boosted_balanced": lambda: GBTClassifier(maxIter=10, seed=1, weightCol="weight"),
}
REGRESSORS: dict[str, Callable] = {
    "linear": lambda: LinearRegression(),
    "ridge": lambda: LinearRegression(regParam=0.1),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "huber": lambda: LinearRegression(loss="huber"),
    "forest": lambda: RandomForestRegressor(numTrees=20, seed=1),
    "boosted": lambda: GBTRegressor(maxIter=10, seed=1),
}


def fit(df: DataFrame, features: list[str], label: str, name: str, kinds: dict[str, Callable] = CLASSIFIERS) -> PipelineModel:
    """Standardized features into the named model; rows with a null go. Balanced models weigh labels alike."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*features, label])).withColumn("label", F.col(label).cast("double"))
    if name.endswith("balanced"):
        n, ones = rows.agg(F.count("*"), F.sum("label")).first()
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, n / (2 * max(ones or 0, 1))).otherwise(n / (2 * max(n - (ones or 0), 1))))
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), kinds[name]()]
    return Pipeline(stages=stages).fit(rows)


def scores(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds `score`: the probability of label 1, the margin where there is none, or the predicted value."""
    out = model.transform(df.where(" and ".join(f"`{c}` is not null" for c in features)))
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.col("prediction")
    return out.withColumn("score", score).select(*df.columns, "score")


def calibrate(scored: DataFrame, label: str, how: str = "sigmoid") -> PipelineModel:
    """A curve from score to probability; apply it with transform(). sigmoid or isotonic."""
    rows = scored.withColumn("label", F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=["score"], outputCol="features_of_score")
    curve = LogisticRegression(featuresCol="features_of_score", predictionCol="_p", probabilityCol="calibrated", rawPredictionCol="_r") if how == "sigmoid" else IsotonicRegression(featuresCol="features_of_score", predictionCol="calibrated")
    return Pipeline(stages=[assembler, curve]).fit(rows)


def cross_calibrate(df: DataFrame, features: list[str], label: str, name: str, how: str = "sigmoid", folds: int = 5, seed: int = 0) -> list[tuple[PipelineModel, PipelineModel]]:
    """Models and their curves, one of each per fold: a model learns from the other folds, its curve from its scores of the fold.

    Rows go to folds by hash. probability() takes the mean over the folds.
    """
    rows = df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(folds)))
    out = []
    for k in range(folds):
        model = fit(rows.where(F.col("_fold") != k), features, label, name)
        out.append((model, calibrate(scores(model, rows.where(F.col("_fold") == k), features), label, how)))
    return out


def probability(ensemble: list[tuple[PipelineModel, PipelineModel]], df: DataFrame, features: list[str]) -> DataFrame:
    """Adds `calibrated`, the mean of what the models' curves give; rows with a null feature go."""
    rows, names = df, []
    for k, (model, curve) in enumerate(ensemble):
        names.append(f"_p{k}")
        found = curve.transform(scores(model, rows, features))
        value = vector_to_array("calibrated")[1] if dict(found.dtypes)["calibrated"] != "double" else F.col("calibrated")
        rows = found.select(*rows.columns, value.alias(names[-1]))
    return rows.select(*df.columns, (reduce(Column.__add__, map(F.col, names)) / len(names)).alias("calibrated"))


def weights(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Shares of the features: absolute coefficients, or importances of trees."""
    fitted = model.stages[-1]
    values = fitted.coefficients if hasattr(fitted, "coefficients") else fitted.featureImportances
    total = sum(map(abs, values.toArray())) or 1.0
    return {f: abs(v) / total for f, v in zip(features, values.toArray(), strict=True)}


def permutation_weights(model: PipelineModel, df: DataFrame, features: list[str], label: str, seed: int = 0, repeats: int = 30) -> dict[str, float]:
    """How much accuracy falls when a feature's values are dealt out anew, as shares; never below zero, the mean of `repeats` deals.

    Values are dealt anew within buckets that rows fall into by hash, so that no task holds
    all rows. Rows that are wholly equal may change places unnoticed.
    """

    def accuracy(rows: DataFrame) -> float:
        return model.transform(rows).agg(F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double"))).first()[0] or 0.0

    base = df.where(" and ".join(f"`{c}` is not null" for c in [*features, label]))
    right, fall = accuracy(base), {}
    buckets = 1 + base.count() // BUCKET_ROWS
    base = base.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), *base.columns), F.lit(buckets)))
    at = lambda salt: F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(salt), *base.columns)))
    for f in features:
        falls = []
        for r in range(repeats):
            a, b = base.withColumn("_i", at(seed + 1)), base.select("_b", F.col(f).alias("_v"), at(seed + 2 + r).alias("_i"))
            falls.append(right - accuracy(a.join(b, ["_b", "_i"]).withColumn(f, F.col("_v")).drop("_b", "_i", "_v")))
        fall[f] = max(0.0, sum(falls) / repeats)
    total = sum(fall.values()) or 1.0
    return {f: v / total for f, v in fall.items()}


def synthetic_oversample(df: DataFrame, features: list[str], label: str, by: str, neighbours: int = 5, seed: int = 0) -> DataFrame:
    """by, features and label, with made-up rows of the rarer label until both are as many."""
    return selection.oversample(df, features, label, by, neighbours, seed)
