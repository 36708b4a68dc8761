"""Verdict accuracy of slots: do stakes point to what came true?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.kpis import exact_sum

DAY = 86_400


def verdicts(slots: DataFrame) -> DataFrame:
    """Adds the verdict: null without stakes, false without stakes up, else whether most stakes are up."""
    up, total = F.col("roundSumStakesUp"), F.col("roundSumStakes")
    return slots.withColumn("verdict", F.when(total == 0, None).when(up == 0, False).otherwise(up / F.nullif(total, F.lit(0.0)) > 0.5))


def slot_contributions(slots: DataFrame, end: int) -> DataFrame:
    """What each slot adds to its contract's statistics, seen at time `end` in seconds."""
    split = end - DAY
    live = F.col("status") != "Canceled"
    known = F.col("truevalue").isNotNull() & live
    stake = F.col("roundSumStakes")
    return verdicts(slots.where(stake != 0)).select(
        "contract", "slot",
        F.when((F.col("slot") > split - DAY) & (F.col("slot") < split), stake).otherwise(0.0).alias("stake_yesterday"),
        F.when(F.col("slot") > split, stake).otherwise(0.0).alias("stake_today"),
        F.coalesce(known & (F.col("verdict") == F.col("truevalue")), F.lit(False)).cast("int").alias("correct"),
        known.cast("int").alias("evaluated"),
    )


def accuracy(contributions: DataFrame) -> DataFrame:
    n, right = F.sum("evaluated"), F.sum("correct")
    return contributions.groupBy("contract").agg(
        exact_sum("stake_yesterday").alias("stake_yesterday"), exact_sum("stake_today").alias("stake_today"), right.alias("correct"), n.alias("evaluated"),
        F.when(right == 0, 0.0).otherwise(right * 100.0 / F.nullif(n, F.lit(0))).alias("accuracy"),
    )
