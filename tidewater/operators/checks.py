"""Data-quality checks. Each returns the rows that break a rule; no rows means the rule holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicates(rows: DataFrame, keys: tuple[str, ...] = ("ID", "timestamp")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def gaps(rows: DataFrame) -> DataFrame:
    """How often each step between neighbouring slots of a feed occurs, as a share of the feed's steps."""
    slots = rows.select("pair", "timeframe", "slot").distinct()
    w = Window.partitionBy("pair", "timeframe").orderBy("slot")
    steps = slots.withColumn("timedelta", F.col("slot") - F.lag("slot").over(w)).where("timedelta is not null")
    counts = steps.groupBy("pair", "timeframe", "timedelta").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("pair", "timeframe")))


def gap_alerts(rows: DataFrame, expected: list[int], least: float = 99.5) -> DataFrame:
    return gaps(rows).where(F.col("timedelta").isin(expected) & (F.col("pct") < least))


def unmatched(payouts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Payouts within the predictions' time range that no prediction has."""
    ends = predictions.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return payouts.join(predictions.select("ID"), "ID", "left_anti").join(F.broadcast(ends), F.col("timestamp").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def missing_tables(spark: SparkSession, expected: list[str]) -> list[str]:
    return sorted(set(expected) - {t.name for t in spark.catalog.listTables()})


def leftover_views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.tableType == "TEMPORARY")


def describe(tables: dict[str, DataFrame], time: str = "timestamp") -> DataFrame:
    """Rows and ends of time of each table, in one union of aggregates."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows"), F.min(time).alias("min_ts"), F.max(time).alias("max_ts")) for n, df in tables.items()))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """How many rows break each rule."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(n).alias("rule"), F.count("*").alias("violations")) for n, df in checks.items()))


def latest(tables: dict[str, DataFrame], time: str = "timestamp") -> DataFrame:
    """The newest time of each table and, named `all`, of all of them."""
    each = reduce(DataFrame.unionByName, (df.agg(F.lit(n).alias("table_name"), F.max(time).alias("newest")) for n, df in tables.items()))
    return each.unionByName(each.agg(F.lit("all").alias("table_name"), F.max("newest").alias("newest")))


def covers(rows: DataFrame, start: int, time: str = "timestamp") -> DataFrame:
    """One row: first and last time, and whether the rows begin by `start` and end after they begin."""
    ends = rows.agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    return ends.withColumn("covered", F.coalesce((F.col("first_ts") <= start) & (F.col("last_ts") > F.col("first_ts")), F.lit(False)))


def has_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column, whether some value and whether every value is null or NaN."""
    gone = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
    return df.agg(*(F.coalesce(F.bool_or(g), F.lit(False)).alias(f"{c}_some") for c, g in gone.items()), *(F.coalesce(F.bool_and(g), F.lit(True)).alias(f"{c}_all") for c, g in gone.items()))


def describe_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, kind, n_rows: the columns of each table and how many rows it has."""
    spark = next(iter(tables.values())).sparkSession
    kinds = spark.createDataFrame([(n, c, t) for n, df in tables.items() for c, t in df.dtypes], "table_name string, column_name string, kind string")
    counts = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(n)) for n, df in tables.items()))
    return kinds.join(counts, "table_name").select("table_name", "column_name", "kind", "n_rows")


def preview(df: DataFrame, rows: int = 5) -> list[dict]:
    """A few rows, for people to look at."""
    return [r.asDict() for r in df.limit(rows).collect()]


def wrong_schemas(tables: dict[str, DataFrame], expected: dict[str, T.StructType]) -> list[str]:
    """Names of registered tables that are missing or have other columns or types."""
    plain = lambda s: [(f.name, f.dataType) for f in s]
    return sorted(n for n, s in expected.items() if n not in tables or plain(tables[n].schema) != plain(s))


def make_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Temporary views by name; drop_views() takes them away."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def drop_views(spark: SparkSession, names: list[str]) -> list[str]:
    """Drop the named views; returns those that there were."""
    return [n for n in names if spark.catalog.dropTempView(n)]


def report_duplicates(rows: DataFrame, path: str, keys: tuple[str, ...] = ("ID", "timestamp")) -> None:
    """Write the duplicates as CSV with a header."""
    duplicates(rows, keys).write.mode("overwrite").option("header", True).csv(path)
