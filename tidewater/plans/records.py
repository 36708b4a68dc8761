"""Queries on nested records of the graph service, table views and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import conditions, display, text
from tidewater.operators import checks, frames, kpis
from tidewater.plans.registry import query
from tidewater.sources import adapt, graph
from tidewater.sources.adapt import PAYOUTS_SQL, PREDICTIONS_SQL, SLOTS_SQL, SUBSCRIPTIONS_SQL

_START, _END = 780_000_000, 860_000_000


@query(f"""WITH {PREDICTIONS_SQL}, {SLOTS_SQL} SELECT contract || '-' || slot || '-t' AS ID, (slot + 60) * 1000 AS timestamp, contract || '/USDT' AS token, truevalue, slot, 0.0::DOUBLE AS revenue, roundSumStakesUp, roundSumStakes
  FROM slots WHERE truevalue IS NOT NULL AND slot + 60 BETWEEN {_START} AND {_END}""")
def true_value_records(spark, d):
    token = F.struct(F.concat("contract", F.lit("/USDT")).alias("name"))
    at = F.concat_ws("-", "contract", "slot")
    nested = adapt.slots(spark, d).where("truevalue is not null").select(
        F.concat(at, F.lit("-t")).alias("id"), (F.col("slot") + 60).alias("timestamp"), F.col("truevalue").alias("trueValue"),
        F.struct(at.alias("id"), F.struct(token.alias("token")).alias("predictContract"), F.lit(None).cast("double").alias("revenue"), "roundSumStakesUp", "roundSumStakes").alias("slot"),
    )
    return graph.flat_true_values(nested, _START, _END)


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL} SELECT ID, contract || '/USDT' AS token, "user", slot, timestamp, payout, predvalue, truevalue, stake FROM payouts
  WHERE timestamp // 1000 BETWEEN {_START} AND {_END} AND (contains(ID, 'c3-') OR contains(ID, '1-8'))""")
def payout_records(spark, d):
    slot = F.struct(F.concat_ws("-", "contract", "slot").alias("id"), F.struct(F.col("contract").alias("id"), F.struct(F.concat("contract", F.lit("/USDT")).alias("name")).alias("token")).alias("predictContract"))
    nested = adapt.payouts(spark, d).select(
        F.col("ID").alias("id"), F.floor(F.col("timestamp") / 1000).cast("long").alias("timestamp"), "payout", F.col("predvalue").alias("predictedValue"), F.col("truevalue").alias("trueValue"),
        F.struct("stake", F.struct(F.col("user").alias("id")).alias("user"), slot.alias("slot")).alias("prediction"),
    )
    return graph.flat_payouts(nested, _START, _END, ["c3-", "1-8"])


@query(f"""WITH {SUBSCRIPTIONS_SQL}, s AS (SELECT *, split_part(ID, '-', 1) AS contract FROM subscriptions) SELECT ID, upper(contract) || '/USDT' AS pair, CASE WHEN substr(contract, 2)::INTEGER % 2 = 0 THEN '5m' ELSE '1h' END AS timeframe, 'binance' AS source,
  timestamp, 'tx' || ID AS tx_id, 3.0::DOUBLE AS last_price_value, "user" FROM s WHERE timestamp // 1000 > {_START} AND timestamp // 1000 < {_END} AND contract IN ('c1', 'c2', 'c7', 'c12')""")
def subscription_records(spark, d):
    contract = F.split_part("ID", F.lit("-"), F.lit(1))
    seconds = F.when(F.substring(contract, 2, 9).cast("int") % 2 == 0, 300).otherwise(3600).cast("long")
    none = F.array().cast("array<struct<key: string, value: string>>")
    nested = adapt.subscriptions(spark, d).select(
        F.col("ID").alias("id"), F.concat(F.lit("tx"), "ID").alias("txId"), F.floor(F.col("timestamp") / 1000).cast("long").alias("timestamp"), F.struct(F.col("user").alias("id")).alias("user"),
        F.struct(contract.alias("id"), F.struct(F.concat(F.upper(contract), F.lit("/USDT")).alias("name")).alias("token"), seconds.alias("secondsPerEpoch"), none.alias("nftData")).alias("predictContract"),
    )
    return graph.flat_subscriptions(nested, _START, _END, ["C1", "c2", "c7", "c12"])


@query(f"""WITH {PREDICTIONS_SQL}, {SLOTS_SQL} SELECT contract, slot // {30 * 86_400} AS month, count(*) AS n, min(slot) AS first_slot, count(truevalue) AS settled FROM slots GROUP BY 1, 2""")
def slots_of_contracts(spark, d):
    truth = F.when(F.col("truevalue").isNotNull(), F.array(F.struct(F.lit("t").alias("id"), F.col("truevalue").alias("trueValue"))))
    nested = adapt.slots(spark, d).select(F.concat_ws("-", "contract", "slot").alias("id"), "slot", truth.alias("trueValues"))
    found = graph.slots_by_contract(nested)
    settled = F.size(F.filter("slots", lambda s: s["truevalue"].isNotNull())).cast("long")
    return found.select("contract", "month", F.size("slots").cast("long").alias("n"), F.col("slots")[0]["slot"].alias("first_slot"), settled.alias("settled"))


@query(f"""WITH {PREDICTIONS_SQL} SELECT contract, pair, timeframe, source FROM feeds WHERE (source = 'nation_11' AND pair = 'ETH/USDT') OR (source = 'nation_14' AND pair = 'BNB/USDT' AND timeframe = '1h') OR (source = 'nation_6' AND pair = 'BTC/USDT' AND timeframe = '5m')""")
def feeds_of_combinations(spark, d):
    wanted = spark.createDataFrame([("nation_11", "ETH/USDT", None), ("nation_14", "BNB/USDT", "1h"), ("nation_14", "BNB/USDT", "1h"), ("nation_6", "BTC/USDT", "5m")], "source string, pair string, timeframe string")
    return conditions.in_combinations(adapt.feeds(spark, d), wanted)


@query("SELECT n_nationkey, n_name, [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 170, 180, 190, 200, 210, 220, 230, 240, 250][row_number() OVER (ORDER BY n_nationkey)]::BIGINT AS rank FROM nation")
def column_from_list(spark, d):
    return frames.with_values(adapt.table(spark, d, "nation").select("n_nationkey", "n_name"), "rank", list(range(10, 260, 10)), "n_nationkey")


_NUMBER = """CASE WHEN abs({0}) >= 1e6 THEN regexp_replace(CAST(round(CAST({0} / 1e6 AS DECIMAL(30,10)), 2) AS VARCHAR), '\\.?0+$', '') || 'M' WHEN abs({0}) >= 1e3 THEN regexp_replace(CAST(round(CAST({0} / 1e3 AS DECIMAL(30,10)), 2) AS VARCHAR), '\\.?0+$', '') || 'K'
  ELSE regexp_replace(CAST(round(CAST({0} AS DECIMAL(30,10)), 2) AS VARCHAR), '\\.?0+$', '') END""".format


@query(f"""WITH c AS (SELECT c_name AS addr, c_mktsegment AS segment, CAST(round(c_acctbal / 1000, 3) AS DOUBLE) AS volume, CAST(c_custkey AS BIGINT) AS sales, CAST(c_custkey % 7 AS BIGINT) AS df_buy_count, CAST(c_custkey % 3 AS BIGINT) AS ws_buy_count FROM customer)
  SELECT substr(addr, 1, 5) || '...' || right(addr, 5) AS addr, segment, {_NUMBER('volume')} AS volume, CAST(sales AS VARCHAR) AS sales, CAST(df_buy_count AS VARCHAR) AS df_buy_count, CAST(ws_buy_count AS VARCHAR) AS ws_buy_count,
  {_NUMBER('sales')} || ' (' || CASE WHEN df_buy_count > 0 THEN df_buy_count || ' DF' ELSE '' END || CASE WHEN df_buy_count > 0 AND ws_buy_count > 0 THEN ', ' ELSE '' END || CASE WHEN ws_buy_count > 0 THEN ws_buy_count || ' WS' ELSE '' END || ')' AS sales_str FROM c""")
def display_table(spark, d):
    c = adapt.table(spark, d, "customer")
    rows = c.select(
        F.col("c_name").alias("addr"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal").cast("double") / 1000, 3).alias("volume"), F.col("c_custkey").cast("long").alias("sales"),
        (F.col("c_custkey") % 7).cast("long").alias("df_buy_count"), (F.col("c_custkey") % 3).cast("long").alias("ws_buy_count"),
    )
    return display.formatted(rows)


@query(f"""WITH {PREDICTIONS_SQL} SELECT contract, slot, "user", stake FROM predictions WHERE contract LIKE 'c1%' AND slot > {_START} AND slot < {_END}""")
def predictions_of_prefix(spark, d):
    return kpis.of_prefix(adapt.predictions(spark, d), "c1", _START, _END).select("contract", "slot", "user", "stake")


@query("SELECT o_orderkey, CAST(o_orderkey // 30 * 30 AS BIGINT) AS period_start, CAST(o_totalprice AS DOUBLE) * 1e-9::DOUBLE * 3.0::DOUBLE AS fee FROM orders")
def fees_and_periods(spark, d):
    o = adapt.table(spark, d, "orders")
    return o.select("o_orderkey", text.period_start(F.col("o_orderkey"), 30).alias("period_start"), text.fee_in_tokens(F.col("o_totalprice").cast("double"), F.lit(1e-9), F.lit(3.0)).alias("fee"))


@query("""SELECT 'nation' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, CAST((SELECT count(*) FROM nation) AS BIGINT) AS n_rows
  UNION ALL SELECT 'region', unnest(['r_regionkey', 'r_name']), CAST((SELECT count(*) FROM region) AS BIGINT)""")
def described_columns(spark, d):
    found = checks.describe_columns({n: adapt.table(spark, d, n).select(*c) for n, c in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]))})
    return found.select("table_name", "column_name", "n_rows")
