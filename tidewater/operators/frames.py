"""Small operators on any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def left_join_with(left: DataFrame, right: DataFrame, left_on: str, right_on: str, columns: dict[str, Column], select: list[str]) -> DataFrame:
    """Left join on keys of different names, computed columns, and a choice of columns."""
    other = right if left_on == right_on else right.withColumnRenamed(right_on, left_on)
    return left.join(other, left_on, "left").withColumns(columns).select(*select)


def keep_ids(df: DataFrame, column: str, ids: DataFrame, drop: list[str]) -> DataFrame:
    """Rows whose column is among the ids, without some columns."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi").drop(*drop)


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, in the order of first rows."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(order)


def count_members(df: DataFrame, array: str) -> DataFrame:
    """How many different values the arrays of a column hold."""
    return df.select(F.explode(array).alias("x")).agg(F.count_distinct("x").alias("n"))


def time_axis(df: DataFrame, start: int, step: int, order: str) -> DataFrame:
    """Adds `ut`: start + i * step for the i-th row of each feed."""
    w = Window.partitionBy("feed").orderBy(order)
    return df.withColumn("ut", F.lit(start) + (F.row_number().over(w) - 1) * step)


def mesh(spark: SparkSession, axes: dict[str, tuple[float, float]], points: int) -> DataFrame:
    """An even grid over one or two axes, `points` per axis."""
    rows = spark.range(points ** len(axes))
    for k, (name, (lo, hi)) in enumerate(axes.items()):
        rows = rows.withColumn(name, F.lit(lo) + (F.floor(F.col("id") / points**k) % points) * ((hi - lo) / (points - 1)))
    return rows.drop("id")


def run_means(runs: DataFrame, by: list[str], mean: list[str], total: list[str], skip_first: list[str], order: str) -> DataFrame:
    """Per run means and sums of metrics; those in `skip_first` leave out the run's first row."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = runs.withColumn("_n", F.row_number().over(w))
    late = [F.avg(F.when(F.col("_n") > 1, F.col(c))).alias(c) for c in skip_first]
    return rows.groupBy(*by).agg(*(F.avg(c).alias(c) for c in mean), *(F.sum(c).alias(c) for c in total), *late)


def calibrated(df: DataFrame, prediction: str, actual: str, order: str) -> DataFrame:
    """Shifts a feed's predictions so that the newest one equals its actual value."""
    w = Window.partitionBy("feed")
    off = F.max_by(F.col(actual) - F.col(prediction), order).over(w)
    return df.withColumn("calibrated", F.col(prediction) + off)


def with_values(df: DataFrame, name: str, values: list, order: str) -> DataFrame:
    """Adds a column from a list, one value per row in the order of a unique column; their numbers must agree.

    The list comes from the driver, so the table is as small; only its keys are numbered.
    """
    keys = [r[0] for r in df.select(order).orderBy(order).limit(len(values) + 1).collect()]
    if len(keys) != len(values):
        raise ValueError(f"{len(values)} values for {'more' if len(keys) > len(values) else len(keys)} rows")
    pairs = df.sparkSession.createDataFrame([*zip(keys, values, strict=True)], f"`{order}` {dict(df.dtypes)[order]}, `{name}` {_kind(values)}")
    return df.join(pairs, order).select(*df.columns, name)


def _kind(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    return {frozenset([bool]): "boolean", frozenset([int]): "long", frozenset([float]): "double", frozenset([int, float]): "double"}.get(frozenset(kinds), "string")
