"""Queries on feeds, participants and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import kpis
from tidewater.plans.registry import query
from tidewater.sources import adapt
from tidewater.sources.adapt import PREDICTIONS_SQL, SUBSCRIPTIONS_SQL

FEE = 0.0125
_SUM = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
S = _SUM.format
PAID = "CAST(count(*) FILTER (payout > 0) AS DOUBLE)"


@query(f"WITH {PREDICTIONS_SQL} SELECT DISTINCT contract, pair, timeframe, source FROM predictions")
def distinct_feeds(spark, d):
    return adapt.predictions(spark, d).select("contract", "pair", "timeframe", "source").distinct()


@query(f"WITH {PREDICTIONS_SQL} SELECT contract, {S('stake')} AS volume, {PAID} * 100 / count(*) AS avg_accuracy, {S('stake')} / count(stake) AS avg_stake FROM predictions GROUP BY contract")
def feed_payout_stats(spark, d):
    return kpis.feed_payout_stats(adapt.predictions(spark, d))


@query(f"WITH {PREDICTIONS_SQL} SELECT contract, {S('stake')} AS volume, {PAID} * 100 / count(*) AS avg_accuracy, {S('stake')} / count(stake) AS avg_stake FROM predictions WHERE timestamp > 852076800000 GROUP BY contract")
def feed_payout_stats_since(spark, d):
    return kpis.feed_payout_stats(adapt.predictions(spark, d), 852076800000)


_USER = f"""SELECT "user", {S('stake')} AS total_stake, coalesce({S('CASE WHEN payout > 0 THEN payout - stake END')}, 0.0) AS gross_income,
  coalesce({S('CASE WHEN payout = 0 THEN stake END')}, 0.0) AS stake_loss, {S('payout')} AS total_payout, {S('payout - stake')} AS total_profit,
  count(ID) AS stake_count, count(DISTINCT contract) AS feed_count, count(*) FILTER (payout > 0) AS correct_predictions, {S('stake')} / count(ID) AS avg_stake,
  min(slot) AS first_payout_time, max(slot) AS last_payout_time, {S('payout - stake')} * 100 / nullif({S('stake')}, 0.0) AS apr, {PAID} * 100 / count(*) AS avg_accuracy
  FROM predictions GROUP BY "user" """


@query(f"WITH {PREDICTIONS_SQL} {_USER}")
def user_payout_stats(spark, d):
    return kpis.user_payout_stats(adapt.predictions(spark, d))


@query(f"WITH {PREDICTIONS_SQL}, u AS ({_USER}) SELECT * REPLACE (coalesce(total_payout, 0) AS total_payout, coalesce(total_profit, 0) AS total_profit, coalesce(apr, 0) AS apr), stake_count * 2 * 0.0125::DOUBLE AS tx_costs, coalesce(total_profit, 0) - stake_count * 2 * 0.0125::DOUBLE AS profit FROM u")
def users_table(spark, d):
    return kpis.users_table(kpis.user_payout_stats(adapt.predictions(spark, d)), FEE)


_SALES = f"""SELECT split_part(ID, '-', 1) AS contract, {S('last_price_value')} AS sales_revenue, {S('last_price_value')} / count(last_price_value) AS price, count(*) AS sales,
  count(*) FILTER ("user" = 'dfbuyer') AS df_buy_count, count(*) FILTER ("user" = 'websocket') AS ws_buy_count FROM subscriptions GROUP BY 1"""


@query(f"WITH {SUBSCRIPTIONS_SQL} {_SALES}")
def subscription_stats(spark, d):
    return kpis.subscription_stats(adapt.subscriptions(spark, d), "dfbuyer", "websocket")


@query(f"WITH {SUBSCRIPTIONS_SQL} SELECT CAST(make_timestamp(timestamp * 1000) AS DATE) AS day, count(*) AS count, {S('last_price_value')} AS revenue FROM subscriptions WHERE ID LIKE 'c7-%' GROUP BY 1")
def daily_subscriptions(spark, d):
    return kpis.daily_subscriptions(adapt.subscriptions(spark, d), "c7")


@query(f"""WITH {PREDICTIONS_SQL}, {SUBSCRIPTIONS_SQL}, s AS ({_SALES}),
  p AS (SELECT contract, {S('stake')} AS volume, {PAID} * 100 / count(*) AS avg_accuracy, {S('stake')} / count(stake) AS avg_stake FROM predictions GROUP BY contract)
  SELECT f.contract, f.pair, f.timeframe, upper(f.source[1]) || f.source[2:] AS source, volume, avg_accuracy, avg_stake, sales_revenue, price, sales, df_buy_count, ws_buy_count,
  split_part(f.pair, '/', 1) AS base_token, split_part(f.pair, '/', 2) AS quote_token FROM feeds f JOIN p USING (contract) JOIN s USING (contract)""")
def feeds_table(spark, d):
    sales = kpis.subscription_stats(adapt.subscriptions(spark, d), "dfbuyer", "websocket")
    return kpis.feeds_table(adapt.feeds(spark, d), kpis.feed_payout_stats(adapt.predictions(spark, d)), sales)


@query(f"""WITH {PREDICTIONS_SQL}, {SUBSCRIPTIONS_SQL} SELECT (SELECT count(DISTINCT (contract, pair, timeframe, source)) FROM feeds) AS feeds,
  (SELECT {PAID} * 100 / count(*) FROM predictions) AS accuracy, (SELECT {S('stake')} FROM predictions) AS volume,
  (SELECT count(*) FROM subscriptions) AS sales, (SELECT {S('last_price_value')} FROM subscriptions) AS revenue""")
def feeds_metrics(spark, d):
    return kpis.feeds_metrics(adapt.feeds(spark, d), adapt.predictions(spark, d), adapt.subscriptions(spark, d))


@query(f"""WITH {PREDICTIONS_SQL} SELECT count(DISTINCT "user") AS users, {PAID} * 100 / count(*) AS accuracy, {S('stake')} AS stake,
  coalesce({S('CASE WHEN payout > stake THEN payout - stake END')}, 0.0) AS gross_income, coalesce({S('CASE WHEN payout > 0 THEN payout END')}, 0.0) AS clipped_payout,
  coalesce({S('CASE WHEN payout > 0 THEN payout END')}, 0.0) - {S('stake')} - count(*) * 0.0125::DOUBLE * 2 AS profit FROM predictions""")
def users_metrics(spark, d):
    return kpis.users_metrics(adapt.predictions(spark, d), FEE)


@query(f"WITH {PREDICTIONS_SQL} SELECT min(timestamp) // 1000 AS first_s, max(timestamp) // 1000 AS last_s FROM predictions")
def slot_range(spark, d):
    return kpis.slot_range(adapt.predictions(spark, d))


@query(f"""WITH {PREDICTIONS_SQL} SELECT ID, contract, "user", slot, stake, coalesce(payout, 0) AS payout FROM predictions
  WHERE contract IN ('c1', 'c2', 'c3', 'c4') AND "user" IN ('u1', 'u2', 'u5', 'u11', 'u20', 'u30') AND slot >= 800000000""")
def payouts_of_feeds_and_users(spark, d):
    return kpis.payouts_of(adapt.predictions(spark, d), ["c1", "c2", "c3", "c4"], ["u1", "u2", "u5", "u11", "u20", "u30"], 800000000)


@query(f"WITH {PREDICTIONS_SQL} SELECT DISTINCT contract FROM predictions WHERE ID LIKE '%-u77%' OR ID LIKE '%-u70%'")
def feeds_of_users(spark, d):
    return kpis.feeds_of_users(adapt.predictions(spark, d), ["-u77", "-u70"])


def _summary(by: str) -> str:
    return f"""WITH {PREDICTIONS_SQL} SELECT {by}, min(source) AS source, {S('payout')} AS sum_payout, {S('stake')} AS sum_stake, count(predvalue) AS n_predictions,
      CAST(count(*) FILTER (predvalue) AS DOUBLE) * 100 / count(pair) AS share_up, CAST(count(*) FILTER (predvalue = truevalue) AS DOUBLE) * 100 / count(pair) AS accuracy
      FROM predictions WHERE payout IS NOT NULL AND truevalue IS NOT NULL GROUP BY {by}"""


@query(_summary("pair, timeframe"))
def feed_summary(spark, d):
    return kpis.summary(adapt.predictions(spark, d), ["pair", "timeframe"])


@query(_summary('"user", pair, timeframe'))
def user_summary(spark, d):
    return kpis.summary(adapt.predictions(spark, d), ["user", "pair", "timeframe"])


@query("""WITH seen AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS day FROM events), f AS (SELECT u, min(day) AS day FROM seen GROUP BY u)
  SELECT day, count(*) AS active_users, coalesce((SELECT count(*) FROM f WHERE f.day = seen.day), 0) AS new_users, (SELECT count(*) FROM f WHERE f.day <= seen.day) AS cum_users FROM seen GROUP BY day""")
def traction(spark, d):
    return kpis.traction(adapt.table(spark, d, "events"), "user_id", F.col("ts").cast("date"))


_SLOTS = f"""SELECT pair, timeframe, slot, pair || '-' || timeframe || '-' || slot AS slot_key, strftime(make_timestamp(slot * 1000000), '%Y-%m-%d') AS day,
  count(DISTINCT "user") AS n_users, {S('payout')} AS sum_payout, {S('stake')} AS sum_stake FROM predictions WHERE payout IS NOT NULL AND truevalue IS NOT NULL GROUP BY pair, timeframe, slot"""


@query(f"WITH {PREDICTIONS_SQL} {_SLOTS}")
def slot_statistics(spark, d):
    return kpis.slot_statistics(adapt.predictions(spark, d))


@query(f"""WITH {PREDICTIONS_SQL}, s AS ({_SLOTS}), k AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe, day ORDER BY md5(slot_key), slot_key) AS n FROM s),
  f AS (SELECT pair, timeframe, day, {S('sum_stake')} / count(*) AS stake, CAST(sum(n_users) AS DOUBLE) / count(*) AS users FROM k WHERE n <= 5 GROUP BY ALL)
  SELECT day, round({S('stake')}, 2) AS daily_stake, round(avg(users), 6) AS mean_users, count(*) AS n_feeds FROM f GROUP BY day""")
def slot_daily_statistics(spark, d):
    return kpis.slot_daily_statistics(kpis.slot_statistics(adapt.predictions(spark, d)))


@query(f"WITH {PREDICTIONS_SQL}, c AS (SELECT contract, CAST(count(payout) AS DOUBLE) / count(*) AS ratio FROM predictions GROUP BY contract) SELECT *, CASE WHEN ratio >= 0.68 THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def settlement_coverage(spark, d):
    return kpis.coverage(adapt.predictions(spark, d), 0.68)


@query(f"WITH {SUBSCRIPTIONS_SQL}, s AS ({_SALES}) SELECT contract, 2250.0::DOUBLE AS expected, greatest(2250.0::DOUBLE - sales * 3.0, 0.0)::DOUBLE AS missing, CAST(ceil(greatest(2250.0::DOUBLE - sales * 3.0, 0.0) / 3.0) AS BIGINT) AS times FROM s")
def missing_consumption(spark, d):
    return kpis.missing_consumption(kpis.subscription_stats(adapt.subscriptions(spark, d), "dfbuyer", "websocket"), 750, 3.0)
