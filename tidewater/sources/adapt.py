"""Canonical relations of the prediction market, made from the star-schema test tables.

A supplier stands for a feed contract, a customer for a participant, a line item for a
prediction with its stake and (where settled) payout, an order for a subscription, and the
event stream for price ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
TICKERS = ("BTC", "ETH", "ADA", "BNB", "SOL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day_seconds(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract, pair, timeframe, source."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(*_feed_columns())


def _feed_columns() -> list[Column]:
    """contract, pair, timeframe and source of rows of suppliers with their nations."""
    ticker = F.element_at(F.array(*map(F.lit, TICKERS)), (F.col("s_suppkey") % len(TICKERS) + 1).cast("int"))
    return [
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("contract"),
        F.concat(ticker, F.lit("/USDT")).alias("pair"),
        F.when(F.col("s_suppkey") % 2 == 0, "5m").otherwise("1h").alias("timeframe"),
        F.lower("n_name").alias("source"),
    ]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prediction; `ID` is contract-slot-user and `seq` orders rows of one slot.

    Line items meet suppliers and nations one after another: Spark knows the size of each of
    these tables, but not that of their join, and broadcasts them while they are small.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    s, n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    contract, pair, timeframe, source = _feed_columns()
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(
        contract,
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"),
        (_day_seconds("o_orderdate") + DAY).alias("slot"),
        (_day_seconds("o_orderdate") * 1000).alias("timestamp"),
        F.when(flag != "N", F.col("l_tax") >= 0.03).alias("predvalue"),
        (F.col("l_linestatus") == "F").alias("truevalue"),
        price.alias("stake"),
        F.when(flag == "A", price * (2 - F.col("l_discount"))).when(flag == "R", 0.0).alias("payout"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        pair,
        timeframe,
        source,
    )
    return rows.withColumn("ID", F.concat_ws("-", "contract", "slot", "user"))


PREDICTIONS_SQL = """
feeds AS (
  SELECT 'c' || s_suppkey AS contract, ['BTC','ETH','ADA','BNB','SOL'][s_suppkey % 5 + 1] || '/USDT' AS pair,
         CASE WHEN s_suppkey % 2 = 0 THEN '5m' ELSE '1h' END AS timeframe, lower(n_name) AS source
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
predictions AS (
  SELECT 'c' || l_suppkey AS contract, 'u' || o_custkey AS user, f.pair, f.timeframe, f.source,
         CAST(epoch(o_orderdate) AS BIGINT) + 86400 AS slot, CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS timestamp,
         CASE WHEN l_returnflag <> 'N' THEN l_tax >= 0.03 END AS predvalue, l_linestatus = 'F' AS truevalue, l_extendedprice AS stake,
         CASE l_returnflag WHEN 'A' THEN l_extendedprice * (2 - l_discount) WHEN 'R' THEN 0.0 END AS payout,
         l_orderkey * 100 + l_linenumber AS seq,
         'c' || l_suppkey || '-' || (CAST(epoch(o_orderdate) AS BIGINT) + 86400) || '-' || 'u' || o_custkey AS ID
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN feeds f ON f.contract = 'c' || l_suppkey)"""


def payouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement events: they come one to three days after the prediction."""
    late = (F.col("seq") % 3 + 1) * DAY * 1000
    return predictions(spark, sf_dir).where("payout is not null").select("ID", "contract", "user", "slot", (F.col("timestamp") + late).alias("timestamp"), "payout", "predvalue", "truevalue", "stake", "seq")


PAYOUTS_SQL = """
payouts AS (
  SELECT ID, contract, user, slot, timestamp + (seq % 3 + 1) * 86400000 AS timestamp, payout, predvalue, truevalue, stake, seq
  FROM predictions WHERE payout IS NOT NULL)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID is contract-orderkey; two users are special: the one that buys data and the web feed."""
    user = F.when(F.col("o_orderpriority") == "1-URGENT", "dfbuyer").when(F.col("o_orderpriority") == "2-HIGH", "websocket").otherwise(F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("ID"),
        user.alias("user"), F.col("o_totalprice").alias("last_price_value"), (_day_seconds("o_orderdate") * 1000).alias("timestamp"),
    )


SUBSCRIPTIONS_SQL = """
subscriptions AS (
  SELECT 'c' || (o_custkey % 20) || '-' || o_orderkey AS ID,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'dfbuyer' WHEN '2-HIGH' THEN 'websocket' ELSE 'u' || o_custkey END AS user,
         o_totalprice AS last_price_value, CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS timestamp
  FROM orders)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes of a contract's slot, its truth, and a status."""
    amount = F.col("stake").cast("decimal(18,4)")
    return predictions(spark, sf_dir).groupBy("contract", "slot").agg(
        F.sum(amount).cast("double").alias("roundSumStakes"),
        F.coalesce(F.sum(F.when(F.col("predvalue"), amount)).cast("double"), F.lit(0.0)).alias("roundSumStakesUp"),
        F.max(F.when(F.col("slot") % (3 * DAY) != 0, F.col("truevalue"))).alias("truevalue"),
        F.when(F.max("seq") % 50 == 0, "Canceled").otherwise("Paying").alias("status"),
    )


SLOTS_SQL = """
slots AS (
  SELECT contract, slot, CAST(sum(CAST(stake AS DECIMAL(18,4))) AS DOUBLE) AS roundSumStakes,
         coalesce(CAST(sum(CAST(CASE WHEN predvalue THEN stake END AS DECIMAL(18,4))) AS DOUBLE), 0.0) AS roundSumStakesUp,
         max(CASE WHEN slot % 259200 <> 0 THEN truevalue END) AS truevalue,
         CASE WHEN max(seq) % 50 = 0 THEN 'Canceled' ELSE 'Paying' END AS status
  FROM predictions GROUP BY contract, slot)"""

HOUR_MS = 3_600_000


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, t (ms), price, size, event_id."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("feed"), F.floor(micros / 1000).cast("long").alias("t"), F.col("value").alias("price"), (F.col("user_id") + 1).cast("double").alias("size"), "event_id")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly feed, timestamp, open, high, low, close, volume; hours without ticks are missing."""
    order = F.struct("t", "event_id")
    return ticks(spark, sf_dir).groupBy("feed", (F.col("t") - F.col("t") % HOUR_MS).alias("timestamp")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
    )


CANDLES_SQL = """
ticks AS (SELECT event_type AS feed, epoch_us(ts) // 1000 AS t, value AS price, CAST(user_id + 1 AS DOUBLE) AS size, event_id FROM events),
candles AS (
  SELECT feed, t - t % 3600000 AS timestamp, arg_min(price, (t, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, event_id)) AS close, sum(size) AS volume
  FROM ticks GROUP BY feed, t - t % 3600000)"""
