"""Time series: merging, filling, lags and changes.

A series is a long table with a `feed` column, so that windows run per feed and different
feeds run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = ("open", "high", "low", "close", "volume")


def by_feed(order: str = "timestamp") -> Window:
    return Window.partitionBy("feed").orderBy(order)


def merge_feeds(candles: DataFrame, feeds: list[str], signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """One wide row per timestamp of any feed: timestamp, then `feed:signal` columns in order.

    One pivoting aggregation instead of a chain of full outer joins; a feed without rows
    gives null columns.
    """
    cells = [F.first(F.when(F.col("feed") == f, F.col(s)), ignorenulls=True).alias(f"{f}:{s}") for f in feeds for s in signals]
    return candles.where(F.col("feed").isin(feeds)).groupBy("timestamp").agg(*cells)


def change(c: str, order: str = "timestamp") -> Column:
    """Relative change from the row before; null for the first row and after a zero."""
    w = by_feed(order)
    return F.try_divide(F.col(c), F.lag(c).over(w)) - 1


def difference(df: DataFrame, c: str, times: int = 1, order: str = "timestamp") -> DataFrame:
    """Adds `diff`, the n-th difference; rows without enough history go."""
    out = df.withColumn("diff", F.col(c))
    for _ in range(times):
        out = out.withColumn("diff", F.col("diff") - F.lag("diff").over(by_feed(order)))
    return out.where("diff is not null")


def step_warnings(df: DataFrame, step: int, least: float = 0.5, most: float = 2.5) -> DataFrame:
    """Feeds with steps below `least` or above `most` times the usual one."""
    d = df.withColumn("d", F.col("timestamp") - F.lag("timestamp").over(by_feed()))
    ends = d.groupBy("feed").agg(F.min("d").alias("min_step"), F.max("d").alias("max_step"))
    return ends.where((F.col("min_step") < least * step) | (F.col("max_step") > most * step))


def interpolate(df: DataFrame, c: str, order: str = "timestamp") -> DataFrame:
    """Fills nulls and NaNs of a column by position: linear inside, the nearest value at the ends."""
    w = by_feed(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.when(~F.isnan(c), F.col(c))
    rows = df.withColumn("_v", v).withColumn("_i", F.row_number().over(w))
    at = F.when(F.col("_v").isNotNull(), F.col("_i"))
    ends = {"_a": F.last("_v", True).over(before), "_b": F.first("_v", True).over(after), "_ia": F.last(at, True).over(before), "_ib": F.first(at, True).over(after)}
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * F.try_divide((F.col("_i") - F.col("_ia")).cast("double"), (F.col("_ib") - F.col("_ia")).cast("double"))
    return rows.withColumns(ends).withColumn(c, F.coalesce("_v", line, "_a", "_b")).drop("_v", "_i", *ends)


def settle_nulls(df: DataFrame, c: str = "close", fields: tuple[str, ...] = ("timestamp", *SIGNALS)) -> DataFrame:
    """A row whose `c` is null takes the fields of the last whole row, or the next; rows of a feed without any go."""
    w = by_feed()
    whole = F.when(F.col(c).isNotNull(), F.struct(*fields))
    before, after = F.last(whole, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(whole, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("_x", F.coalesce(before, after)).where("_x is not null").select("feed", F.col("timestamp").alias("slot_ms"), "_x.*")


def grid(df: DataFrame, step: int) -> DataFrame:
    """Every step from a feed's first to its last timestamp, with the rows that exist."""
    ends = df.groupBy("feed").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    steps = ends.select("feed", F.explode(F.sequence("lo", "hi", F.lit(step))).alias("timestamp"))
    return steps.join(df, ["feed", "timestamp"], "left")


def lag_matrix(df: DataFrame, c: str, lags: int, train: int, testshift: int = 0, relative: bool = False) -> DataFrame:
    """Target y and its values `lags`..1 rows before, for the last `train` + 1 usable rows before `testshift`.

    With `relative` the values are relative changes and the first row of a feed goes.
    """
    rows = df.select("feed", "timestamp", F.col(c).alias("yraw")).withColumn("y", change("yraw") if relative else F.col("yraw"))
    w, last = by_feed(), Window.partitionBy("feed").orderBy(F.desc("timestamp"))
    rows = rows.where("y is not null") if relative else rows
    rows = rows.select("*", *(F.lag("y", k).over(w).alias(f"lag_{k}") for k in range(lags, 0, -1)), F.row_number().over(last).alias("n"))
    return rows.where((F.col("n") > testshift) & (F.col("n") <= testshift + train + 1)).drop("n")


def time_blocks(df: DataFrame, c: str, size: int) -> DataFrame:
    """For each row with `size` rows before it: these values, the newest first."""
    w = by_feed().rowsBetween(-size, -1)
    rows = df.withColumn("block", F.collect_list(c).over(w)).where(F.size("block") == size)
    return rows.select("feed", "timestamp", F.reverse("block").alias("block"))


def high_low(df: DataFrame, testshift: int) -> DataFrame:
    """High and low of the row `testshift` + 1 before the last of each feed."""
    last = Window.partitionBy("feed").orderBy(F.desc("timestamp"))
    return df.withColumn("n", F.row_number().over(last)).where(F.col("n") == testshift + 2).select("feed", "timestamp", "high", "low")


def true_values(df: DataFrame, step: int) -> DataFrame:
    """Did the close rise to the next candle? Only where the next candle is one step later; equal closes cancel."""
    w = by_feed()
    rows = df.select("feed", "timestamp", "close", F.lead("close").over(w).alias("then"), F.lead("timestamp").over(w).alias("t"))
    return rows.where(F.col("t") == F.col("timestamp") + step).select("feed", F.col("t").alias("timestamp"), (F.col("then") > F.col("close")).alias("truevalue"), (F.col("then") == F.col("close")).alias("cancel"))


def clean(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows in the time range, one per feed and timestamp."""
    return df.where(F.col("timestamp").between(start, end)).dropDuplicates(["feed", "timestamp"])


def scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their feed's mean over its population deviation; a constant column becomes zero."""
    stats = df.groupBy("feed").agg(*(F.avg(c).alias(f"_{c}_m") for c in cols), *(F.stddev_pop(c).alias(f"_{c}_s") for c in cols))
    scale = {c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"_{c}_m"), F.col(f"_{c}_s")), F.lit(0.0))) for c in cols}
    return df.join(stats, "feed").withColumns(scale).select(*df.columns)
