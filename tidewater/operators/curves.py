"""Running accuracy and profit, per series and per slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.kpis import exact_sum

#: The 97.5 % quantile of the normal distribution.
Z95 = 1.959963984540054
MONEY = "decimal(18,4)"


def _running(*by: str, order: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_curves(bronze: DataFrame, by: tuple[str, ...] = ("user", "contract"), order: tuple[str, ...] = ("slot", "seq")) -> DataFrame:
    """Running count, hits, accuracy with normal bounds, and profit of each series.

    `order` must be a total order within a series. Unsettled rows count as payout zero.
    """
    w = _running(*by, order=order)
    pay = F.coalesce("payout", F.lit(0.0))
    p = F.col("n_correct") / F.col("n")
    half = F.sqrt(p * (1 - p) / F.col("n")) * Z95
    return (
        bronze.withColumn("n", F.count(F.lit(1)).over(w))
        .withColumn("n_correct", F.count_if(pay > 0).over(w))
        .withColumn("profit", F.sum((F.greatest(pay, F.lit(0.0)) - F.col("stake")).cast(MONEY)).over(w).cast("double"))
        .select(*by, *order, "n", "n_correct", "profit", (p * 100).alias("accuracy"), (F.greatest(p - half, F.lit(0.0)) * 100).alias("low"), (F.least(p + half, F.lit(1.0)) * 100).alias("high"))
    )


def series_totals(curves: DataFrame, fee: float, by: tuple[str, ...] = ("user", "contract")) -> DataFrame:
    """The last point of each series, with what transactions cost."""
    last = curves.groupBy(*by).agg(F.max("n").alias("n"), F.max("n_correct").alias("n_correct"), F.max_by("profit", "n").alias("profit"))
    return last.withColumn("tx_cost", F.col("n") * 2 * F.lit(fee))


def portfolio(curves: DataFrame, bronze: DataFrame, fee: float) -> DataFrame:
    """One row: total profit and cost, mean stake, accuracy over all series."""
    totals = series_totals(curves, fee).agg(exact_sum("profit").alias("total_profit"), exact_sum("tx_cost").alias("total_cost"), (F.sum("n_correct") * 100.0 / F.sum("n")).alias("avg_accuracy"))
    return totals.crossJoin(bronze.agg((exact_sum("stake") / F.count("stake")).alias("avg_stake")))  # two single rows


def slot_figures(bronze: DataFrame, by: str, order: tuple[str, ...] = ("slot", "seq")) -> DataFrame:
    """Per slot of a feed or participant: stake, profit, count and accuracy.

    Accuracy is the ratio of the slot's sums of running hits and running counts, as the
    chart of the figures defines it; profit also comes as a running sum.
    """
    w = _running(by, order=order)
    slot = Window.partitionBy(by, "slot").orderBy(*([c for c in order if c != "slot"] or ["slot"]))  # one sort serves all windows, and no aggregate holds a task's slots
    whole = slot.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda c: F.sum(c.cast(MONEY)).over(whole).cast("double")
    pay = F.coalesce("payout", F.lit(0.0))
    rows = bronze.withColumn("cnt", F.count(F.lit(1)).over(w)).withColumn("hit", F.count_if(pay > 0).over(w))
    slots = rows.select(
        by, "slot", total(F.col("stake")).alias("stake"), total(F.greatest(pay, F.lit(0.0)) - F.col("stake")).alias("profit"), total(pay).alias("income"),
        F.count(F.lit(1)).over(whole).alias("count"), (F.sum("hit").over(whole) * 100.0 / F.sum("cnt").over(whole)).alias("accuracy"), F.row_number().over(slot).alias("_row"),
    ).where(F.col("_row") == F.col("count")).drop("_row")
    return slots.withColumn("cum_profit", F.sum(F.col("profit").cast(MONEY)).over(_running(by, order=("slot",))).cast("double"))
