"""Bootstrap ensembles of linear models, fit in one pass of aggregates.

Instead of drawing rows, every model counts every row as often as a Poisson number with mean
one says, which is what drawing with replacement tends to. The number comes from a hash of
the row's key and the model's number, so it does not depend on the order or place of rows
and a task that runs again gives the same. A model is then a few weighted sums of products:
its normal equations, summed in each task before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ridge penalty on all weights, the constant's too.
PENALTY = 1e-6


def poisson_steps(most: int = 12) -> list[int]:
    """Where a number below 2^32 reaches 1, 2, ... of a Poisson number with mean one."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])
    return [math.ceil(s * (1 << 32)) for s in share]


def poisson(key: Column, model: Column) -> Column:
    """How often a model counts the row with this key: 0, 1, 2, ..., 12 at most."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), model.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.size(F.filter(F.array(*(F.lit(s) for s in poisson_steps())), lambda s: s <= hashed)).cast("long")


def normal_equations(rows: DataFrame, by: str, key: str, features: list[str], target: str, models: int) -> DataFrame:
    """by, model, n, sums: for each model the weighted sums of products of (1, *features, target), the upper triangle row by row.

    Rows with a null or NaN feature or target take no part.
    """
    names = [*features, target]
    known = rows.select(by, key, *(F.col(c).cast("double").alias(c) for c in names)).where(" and ".join(f"not isnan(`{c}`) and `{c}` is not null" for c in names))
    each = known.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1)))).withColumn("_w", poisson(F.col(key), F.col("model"))).where("_w > 0")
    values = [F.lit(1.0), *(F.col(f"`{c}`") for c in names)]
    products = [F.sum(F.col("_w") * values[i] * values[j]) for i in range(len(values)) for j in range(i, len(values))]
    return each.groupBy(by, "model").agg(F.sum("_w").alias("n"), F.array(*products).alias("sums"))


def fit(rows: DataFrame, by: str, key: str, features: list[str], target: str, models: int = 10, penalty: float = PENALTY) -> DataFrame:
    """by, model, weights: the constant first. A model that counts no row has none."""
    size = len(features) + 2

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(sums: pd.Series) -> pd.Series:
        at = np.triu_indices(size)

        def one(values: np.ndarray) -> list[float]:
            m = np.zeros((size, size))
            m[at] = values
            m.T[at] = values
            return np.linalg.solve(m[:-1, :-1] + penalty * np.eye(size - 1), m[:-1, -1]).tolist()

        return sums.map(one)

    return normal_equations(rows, by, key, features, target, models).select(by, "model", "n", solve("sums").alias("weights"))


def prob_above(rows: DataFrame, weights: DataFrame, by: str, features: list[str], threshold: Column) -> DataFrame:
    """rows with `prob`: the share of the models of their `by` that predict more than the threshold.

    A `by` has a row of weights for each of its models, which are put beside its rows as one
    array; rows with a null feature get null.
    """
    packed = weights.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("model", "weights"))).alias("_models"))  # as many as models
    values = F.array(F.lit(1.0), *(F.col(f"`{c}`").cast("double") for c in features))
    total = lambda m: F.aggregate(F.zip_with(m["weights"], values, lambda w, x: w * x), F.lit(0.0), lambda a, b: a + b)
    above = F.size(F.filter("_models", lambda m: total(m) > threshold)) / F.size("_models")
    known = F.lit(True)
    for c in features:
        known = known & F.col(f"`{c}`").isNotNull()
    return rows.join(packed, by, "left").withColumn("prob", F.when(known & F.col("_models").isNotNull(), above)).drop("_models")
