"""Key figures per feed, participant, subscription, day and slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def exact_sum(c: Column | str) -> Column:
    """A sum of money amounts that does not depend on the order of rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double, null for an empty whole."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def _paid() -> Column:
    return F.count_if(F.col("payout") > 0)


def feed_payout_stats(bronze: DataFrame, start_ms: int | None = None) -> DataFrame:
    """Volume, accuracy and mean stake of each feed; unsettled rows count in the denominator."""
    rows = bronze if start_ms is None else bronze.where(F.col("timestamp") > start_ms)
    return rows.groupBy("contract").agg(exact_sum("stake").alias("volume"), share(_paid(), F.count("*")).alias("avg_accuracy"), (exact_sum("stake") / F.count("stake")).alias("avg_stake"))


def user_payout_stats(bronze: DataFrame) -> DataFrame:
    gain = F.col("payout") - F.col("stake")
    profit = exact_sum(gain)
    return bronze.groupBy("user").agg(
        exact_sum("stake").alias("total_stake"),
        F.coalesce(exact_sum(F.when(F.col("payout") > 0, gain)), F.lit(0.0)).alias("gross_income"),
        F.coalesce(exact_sum(F.when(F.col("payout") == 0, F.col("stake"))), F.lit(0.0)).alias("stake_loss"),
        exact_sum("payout").alias("total_payout"), profit.alias("total_profit"), F.count("ID").alias("stake_count"),
        F.count_distinct("contract").alias("feed_count"), _paid().alias("correct_predictions"),
        (exact_sum("stake") / F.count("ID")).alias("avg_stake"), F.min("slot").alias("first_payout_time"), F.max("slot").alias("last_payout_time"),
        (profit * 100 / F.nullif(exact_sum("stake"), F.lit(0.0))).alias("apr"), share(_paid(), F.count("*")).alias("avg_accuracy"),
    )


def users_table(stats: DataFrame, fee: float) -> DataFrame:
    """Figures per participant with what transactions cost: two per stake."""
    filled = stats.fillna(0)
    cost = F.col("stake_count") * 2 * F.lit(fee)
    return filled.withColumn("tx_costs", cost).withColumn("profit", F.col("total_profit") - cost)


def subscription_stats(subscriptions: DataFrame, buyer: str, web: str) -> DataFrame:
    """Sales of each feed in one pass, the two special buyers counted apart."""
    return subscriptions.groupBy(F.split_part("ID", F.lit("-"), F.lit(1)).alias("contract")).agg(
        exact_sum("last_price_value").alias("sales_revenue"), (exact_sum("last_price_value") / F.count("last_price_value")).alias("price"), F.count("*").alias("sales"),
        F.count_if(F.col("user") == buyer).alias("df_buy_count"), F.count_if(F.col("user") == web).alias("ws_buy_count"),
    )


def daily_subscriptions(subscriptions: DataFrame, contract: str) -> DataFrame:
    day = F.to_date(F.timestamp_millis("timestamp"))
    return subscriptions.where(F.col("ID").startswith(f"{contract}-")).groupBy(day.alias("day")).agg(F.count("*").alias("count"), exact_sum("last_price_value").alias("revenue"))


def feeds_table(feeds: DataFrame, payout_stats: DataFrame, sales: DataFrame) -> DataFrame:
    """Feeds with predictions and subscriptions; a feed that lacks either does not appear."""
    rows = feeds.join(payout_stats, "contract").join(sales, "contract").fillna(0)
    base, quote = (F.split_part("pair", F.lit("/"), F.lit(i)) for i in (1, 2))
    return rows.withColumns({"base_token": base, "quote_token": quote, "source": F.initcap("source")})


def feeds_metrics(feeds: DataFrame, bronze: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row: number of feeds, accuracy, volume, sales and revenue."""
    one = feeds.agg(F.count_distinct(F.struct("contract", "pair", "timeframe", "source")).alias("feeds"))
    two = bronze.agg(share(_paid(), F.count("*")).alias("accuracy"), exact_sum("stake").alias("volume"))
    three = subscriptions.agg(F.count("*").alias("sales"), exact_sum("last_price_value").alias("revenue"))
    return one.crossJoin(two).crossJoin(three)  # three single rows


def users_metrics(bronze: DataFrame, fee: float) -> DataFrame:
    """One row over all participants; income here counts only payouts above the stake."""
    gain, n = F.col("payout") - F.col("stake"), F.count("*")
    clipped, stake = F.coalesce(exact_sum(F.when(F.col("payout") > 0, F.col("payout"))), F.lit(0.0)), exact_sum("stake")
    return bronze.agg(
        F.count_distinct("user").alias("users"), share(_paid(), n).alias("accuracy"), stake.alias("stake"),
        F.coalesce(exact_sum(F.when(F.col("payout") > F.col("stake"), gain)), F.lit(0.0)).alias("gross_income"),
        clipped.alias("clipped_payout"), (clipped - stake - n * F.lit(fee) * 2).alias("profit"),
    )


def slot_range(bronze: DataFrame) -> DataFrame:
    return bronze.agg(F.floor(F.min("timestamp") / 1000).alias("first_s"), F.floor(F.max("timestamp") / 1000).alias("last_s"))


def payouts_of(bronze: DataFrame, contracts: list[str], users: list[str], start_slot: int) -> DataFrame:
    """Rows of the chosen feeds and participants from a slot on, numeric nulls as zero."""
    rows = bronze.where(F.col("contract").isin(contracts) & F.col("user").isin(users) & (F.col("slot") >= start_slot))
    return rows.select("ID", "contract", "user", "slot", "stake", "payout").fillna(0)


def feeds_of_users(bronze: DataFrame, users: list[str]) -> DataFrame:
    """Contracts of predictions in whose ID one of the users appears, anywhere."""
    any_of = F.lit(False)
    for u in users:
        any_of = any_of | F.contains(F.col("ID"), F.lit(u))
    return bronze.where(any_of).select("contract").distinct()


def summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Settled predictions by feed or participant: both the share predicted up and the share right."""
    rows = predictions.where(F.col("payout").isNotNull() & F.col("truevalue").isNotNull())
    return rows.groupBy(*by).agg(
        F.min("source").alias("source"), exact_sum("payout").alias("sum_payout"), exact_sum("stake").alias("sum_stake"), F.count("predvalue").alias("n_predictions"),
        share(F.count_if("predvalue"), F.count("pair")).alias("share_up"), share(F.count_if(F.col("predvalue") == F.col("truevalue")), F.count("pair")).alias("accuracy"),
    )


def traction(rows: DataFrame, user: str, day: Column) -> DataFrame:
    """Per day: active users, users seen for the first time, and all users so far.

    The running distinct count is a running sum of first sightings, so its window runs
    over one row per day, whatever the number of users.
    """
    seen = rows.select(F.col(user).alias("user"), day.alias("day")).distinct()
    first = seen.groupBy("user").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("new_users"))
    active = seen.groupBy("day").agg(F.count("*").alias("active_users"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = active.join(first, "day", "left").fillna(0, ["new_users"])
    return both.withColumn("cum_users", F.sum("new_users").over(w))


def slot_statistics(predictions: DataFrame) -> DataFrame:
    rows = predictions.where(F.col("payout").isNotNull() & F.col("truevalue").isNotNull())
    return rows.groupBy("pair", "timeframe", "slot").agg(
        F.concat_ws("-", "pair", "timeframe", "slot").alias("slot_key"), F.date_format(F.timestamp_seconds("slot"), "yyyy-MM-dd").alias("day"),
        F.count_distinct("user").alias("n_users"), exact_sum("payout").alias("sum_payout"), exact_sum("stake").alias("sum_stake"),
    )


def slot_daily_statistics(slots: DataFrame, sample: int = 5) -> DataFrame:
    """Means over at most `sample` slots of a pair, timeframe and day, then summed up per day.

    The sample is the first slots by a hash of the key, the same in every run.
    """
    w = Window.partitionBy("pair", "timeframe", "day").orderBy(F.md5("slot_key"), "slot_key")
    kept = slots.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample)
    mean = lambda c: (F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count("*"))
    feed = kept.groupBy("pair", "timeframe", "day").agg(mean("sum_stake").alias("stake"), (F.sum("n_users") / F.count("*")).alias("users"))
    return feed.groupBy("day").agg(F.round(exact_sum("stake"), 2).alias("daily_stake"), F.round(F.avg("users"), 6).alias("mean_users"), F.count("*").alias("n_feeds"))


def coverage(bronze: DataFrame, least: float = 0.9) -> DataFrame:
    """Share of a contract's predictions that are settled, and whether it is enough."""
    rows = bronze.groupBy("contract").agg((F.count("payout") / F.count("*")).alias("ratio"))
    return rows.withColumn("status", F.when(F.col("ratio") >= least, "PASS").otherwise("FAIL"))


def missing_consumption(sales: DataFrame, days: int, price: float) -> DataFrame:
    """What each feed still has to sell to reach a weekly amount spread evenly over days."""
    expected = F.lit(float(days)) * price
    missing = F.greatest(expected - F.col("sales") * price, F.lit(0.0))
    return sales.select("contract", expected.alias("expected"), missing.alias("missing"), F.ceil(missing / price).alias("times"))


def of_prefix(rows: DataFrame, prefix: str, start: int, end: int) -> DataFrame:
    """Rows whose contract begins with `prefix` and whose slot lies between start and end, both left out."""
    return rows.where(F.col("contract").startswith(prefix) & (F.col("slot") > start) & (F.col("slot") < end))
