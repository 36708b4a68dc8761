"""Queries on curves, slots, checks and candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import accuracy as acc
from tidewater.operators import checks, curves, series
from tidewater.plans.registry import query
from tidewater.sources import adapt
from tidewater.sources.adapt import CANDLES_SQL, HOUR_MS, PAYOUTS_SQL, PREDICTIONS_SQL, SLOTS_SQL, SUBSCRIPTIONS_SQL

FEE = 0.0125
S = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)".format
_RUN = 'OVER (PARTITION BY "user", contract ORDER BY slot, seq, stake, payout NULLS FIRST ROWS UNBOUNDED PRECEDING)'
_CURVES_SQL = f"""r AS (SELECT "user", contract, slot, seq, stake, payout, count(*) {_RUN} AS n, count(*) FILTER (payout > 0) {_RUN} AS n_correct,
    CAST(sum(CAST(greatest(coalesce(payout, 0), 0) - stake AS DECIMAL(18,4))) {_RUN} AS DOUBLE) AS profit FROM predictions),
  c AS (SELECT *, CAST(n_correct AS DOUBLE) / n AS p, sqrt(p * (1 - p) / n) * 1.959963984540054::DOUBLE AS h FROM r),
  curves AS (SELECT "user", contract, slot, seq, stake, payout, n, n_correct, profit, p * 100 AS accuracy, greatest(p - h, 0.0) * 100 AS low, least(p + h, 1.0) * 100 AS high FROM c)"""


#: seq is not unique, so stake and payout follow; rows that are still equal may change places unnoticed.
_ORDER = ("slot", "seq", "stake", "payout")


def _curves(spark, d):
    return curves.running_curves(adapt.predictions(spark, d), order=_ORDER)


@query(f"WITH {PREDICTIONS_SQL}, {_CURVES_SQL} SELECT * FROM curves")
def running_curves(spark, d):
    return _curves(spark, d)


@query(f"""WITH {PREDICTIONS_SQL}, {_CURVES_SQL} SELECT "user", contract, max(n) AS n, max(n_correct) AS n_correct, arg_max(profit, n) AS profit, max(n) * 2 * 0.0125::DOUBLE AS tx_cost FROM curves GROUP BY "user", contract""")
def series_totals(spark, d):
    return curves.series_totals(_curves(spark, d), FEE)


@query(f"""WITH {PREDICTIONS_SQL}, {_CURVES_SQL}, t AS (SELECT "user", contract, max(n) AS n, max(n_correct) AS k, arg_max(profit, n) AS profit FROM curves GROUP BY "user", contract)
  SELECT {S('profit')} AS total_profit, {S('n * 2 * 0.0125::DOUBLE')} AS total_cost, CAST(sum(k) AS DOUBLE) * 100 / sum(n) AS avg_accuracy, (SELECT {S('stake')} / count(stake) FROM predictions) AS avg_stake FROM t""")
def portfolio(spark, d):
    return curves.portfolio(_curves(spark, d), adapt.predictions(spark, d), FEE)


def _figures(by: str) -> str:
    run = f"OVER (PARTITION BY {by} ORDER BY slot, seq, other, stake, payout NULLS FIRST ROWS UNBOUNDED PRECEDING)"
    other = "contract" if "user" in by else '"user"'
    return f"""WITH {PREDICTIONS_SQL}, o AS (SELECT *, {other} AS other FROM predictions), r AS (SELECT *, count(*) {run} AS cnt, count(*) FILTER (payout > 0) {run} AS hit FROM o),
      s AS (SELECT {by}, slot, {S('stake')} AS stake, {S('greatest(coalesce(payout, 0), 0) - stake')} AS profit, {S('coalesce(payout, 0)')} AS income, count(*) AS count, CAST(sum(hit) AS DOUBLE) * 100 / sum(cnt) AS accuracy FROM r GROUP BY {by}, slot)
      SELECT *, CAST(sum(CAST(profit AS DECIMAL(18,4))) OVER (PARTITION BY {by} ORDER BY slot ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum_profit FROM s"""


@query(_figures("contract"))
def feed_figures(spark, d):
    return curves.slot_figures(adapt.predictions(spark, d), "contract", ("slot", "seq", "user", "stake", "payout"))


@query(_figures('"user"'))
def user_figures(spark, d):
    return curves.slot_figures(adapt.predictions(spark, d), "user", ("slot", "seq", "contract", "stake", "payout"))


END = 896_400_000 // 86_400 * 86_400 + 86_400
_CONTRIB = f"""contrib AS (SELECT contract, slot,
    CASE WHEN slot > {END - 172_800} AND slot < {END - 86_400} THEN roundSumStakes ELSE 0.0 END AS stake_yesterday, CASE WHEN slot > {END - 86_400} THEN roundSumStakes ELSE 0.0 END AS stake_today,
    CAST(coalesce(truevalue IS NOT NULL AND status <> 'Canceled' AND (CASE WHEN roundSumStakesUp = 0 THEN false ELSE roundSumStakesUp / roundSumStakes > 0.5 END) = truevalue, false) AS INTEGER) AS correct,
    CAST(truevalue IS NOT NULL AND status <> 'Canceled' AS INTEGER) AS evaluated FROM slots WHERE roundSumStakes <> 0)"""


@query(f"WITH {PREDICTIONS_SQL}, {SLOTS_SQL}, {_CONTRIB} SELECT * FROM contrib")
def slot_contributions(spark, d):
    return acc.slot_contributions(adapt.slots(spark, d), END)


@query(f"""WITH {PREDICTIONS_SQL}, {SLOTS_SQL}, {_CONTRIB} SELECT contract, {S('stake_yesterday')} AS stake_yesterday, {S('stake_today')} AS stake_today, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(evaluated) AS BIGINT) AS evaluated,
  CASE WHEN sum(correct) = 0 THEN 0.0 ELSE CAST(sum(correct) AS DOUBLE) * 100 / sum(evaluated) END AS accuracy FROM contrib GROUP BY contract""")
def slot_accuracy(spark, d):
    return acc.accuracy(acc.slot_contributions(adapt.slots(spark, d), END))


@query(f"""WITH {PREDICTIONS_SQL} SELECT slot, contract, CASE WHEN sum(stake) = 0 THEN NULL WHEN coalesce(sum(CASE WHEN predvalue THEN stake END), 0) = 0 THEN false
  ELSE {S('CASE WHEN predvalue THEN stake END')} / {S('stake')} > 0.5 END AS verdict FROM predictions GROUP BY slot, contract""")
def slot_verdicts(spark, d):
    return acc.verdicts(adapt.slots(spark, d)).select("slot", "contract", "verdict")


@query(f"WITH {PREDICTIONS_SQL} SELECT ID, timestamp, count(*) AS n FROM predictions GROUP BY ID, timestamp HAVING count(*) > 1")
def duplicate_predictions(spark, d):
    return checks.duplicates(adapt.predictions(spark, d))


_GAPS = """g AS (SELECT pair, timeframe, slot - lag(slot) OVER (PARTITION BY pair, timeframe ORDER BY slot) AS timedelta FROM (SELECT DISTINCT pair, timeframe, slot FROM predictions)),
  gaps AS (SELECT pair, timeframe, timedelta, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (PARTITION BY pair, timeframe) AS pct FROM g WHERE timedelta IS NOT NULL GROUP BY pair, timeframe, timedelta)"""


@query(f"WITH {PREDICTIONS_SQL}, {_GAPS} SELECT * FROM gaps")
def slot_gaps(spark, d):
    return checks.gaps(adapt.predictions(spark, d))


@query(f"WITH {PREDICTIONS_SQL}, {_GAPS} SELECT * FROM gaps WHERE timedelta IN (86400, 172800) AND pct < 99.5")
def gap_alerts(spark, d):
    return checks.gap_alerts(adapt.predictions(spark, d), [86_400, 172_800])


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL}, e AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM predictions)
  SELECT payouts.* FROM payouts, e WHERE ID NOT IN (SELECT ID FROM predictions) AND timestamp BETWEEN lo AND hi""")
def unmatched_payouts(spark, d):
    """Payouts that no prediction has, among all predictions; none where every payout comes from a prediction, as in the test tables."""
    return checks.unmatched(adapt.payouts(spark, d), adapt.predictions(spark, d))


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL}, {SUBSCRIPTIONS_SQL} SELECT 'predictions' AS table_name, count(*) AS n_rows, min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM predictions
  UNION ALL SELECT 'payouts', count(*), min(timestamp), max(timestamp) FROM payouts UNION ALL SELECT 'subscriptions', count(*), min(timestamp), max(timestamp) FROM subscriptions""")
def describe_tables(spark, d):
    return checks.describe({"predictions": adapt.predictions(spark, d), "payouts": adapt.payouts(spark, d), "subscriptions": adapt.subscriptions(spark, d)})


@query(f"""WITH {PREDICTIONS_SQL}, {_GAPS} SELECT 'duplicates' AS rule, count(*) AS violations FROM (SELECT ID FROM predictions GROUP BY ID, timestamp HAVING count(*) > 1)
  UNION ALL SELECT 'gaps', count(*) FROM gaps WHERE timedelta IN (86400, 172800) AND pct < 99.5""")
def violations(spark, d):
    p = adapt.predictions(spark, d)
    return checks.violations({"duplicates": checks.duplicates(p), "gaps": checks.gap_alerts(p, [86_400, 172_800])})


# Candles


@query(f"WITH {CANDLES_SQL} SELECT * FROM candles")
def candles(spark, d):
    return adapt.candles(spark, d)


FEEDS = ["click", "purchase", "none"]


@query(f"""WITH {CANDLES_SQL} SELECT timestamp, {', '.join(f'''max(CASE WHEN feed = '{f}' THEN {s} END) AS "{f}:{s}"''' for f in FEEDS for s in ('close', 'volume'))} FROM candles WHERE feed IN ('click', 'purchase', 'none') GROUP BY timestamp""")
def merged_candles(spark, d):
    return series.merge_feeds(adapt.candles(spark, d), FEEDS, ("close", "volume"))


_W = "OVER (PARTITION BY feed ORDER BY timestamp)"


@query(f"WITH {CANDLES_SQL} SELECT feed, timestamp, close / nullif(lag(close) {_W}, 0) - 1 AS change FROM candles")
def relative_change(spark, d):
    return adapt.candles(spark, d).select("feed", "timestamp", series.change("close").alias("change"))


@query(f"WITH {CANDLES_SQL}, a AS (SELECT *, close - lag(close) {_W} AS d1 FROM candles), b AS (SELECT *, d1 - lag(d1) {_W} AS diff FROM a) SELECT feed, timestamp, diff FROM b WHERE diff IS NOT NULL")
def second_difference(spark, d):
    return series.difference(adapt.candles(spark, d), "close", 2).select("feed", "timestamp", "diff")


@query(f"WITH {CANDLES_SQL}, a AS (SELECT feed, timestamp - lag(timestamp) {_W} AS d FROM candles) SELECT feed, min(d) AS min_step, max(d) AS max_step FROM a GROUP BY feed HAVING min(d) < 1800000 OR max(d) > 9000000")
def step_warnings(spark, d):
    return series.step_warnings(adapt.candles(spark, d), HOUR_MS)


_GRID = f"""e AS (SELECT feed, min(timestamp) AS lo, max(timestamp) AS hi FROM candles GROUP BY feed),
  g AS (SELECT feed, unnest(range(lo, hi + 1, 3600000)) AS timestamp FROM e), filled AS (SELECT g.feed, g.timestamp, open, high, low, close, volume FROM g LEFT JOIN candles USING (feed, timestamp))"""


@query(f"WITH {CANDLES_SQL}, {_GRID} SELECT * FROM filled")
def candle_grid(spark, d):
    return series.grid(adapt.candles(spark, d), HOUR_MS)


@query(f"""WITH {CANDLES_SQL}, {_GRID}, i AS (SELECT *, row_number() {_W} AS i FROM filled),
  f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY feed ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS a, first_value(close IGNORE NULLS) OVER (PARTITION BY feed ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
    last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY feed ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS ia, first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY feed ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM i)
  SELECT feed, timestamp, coalesce(close, a + (b - a) * (CAST(i - ia AS DOUBLE) / nullif(CAST(ib - ia AS DOUBLE), 0)), a, b) AS close FROM f""")
def interpolated_candles(spark, d):
    return series.interpolate(series.grid(adapt.candles(spark, d), HOUR_MS), "close").select("feed", "timestamp", "close")


@query(f"""WITH {CANDLES_SQL}, {_GRID}, x AS (SELECT feed, timestamp AS slot_ms, CASE WHEN close IS NOT NULL THEN timestamp END AS t FROM filled),
  y AS (SELECT feed, slot_ms, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY feed ORDER BY slot_ms ROWS UNBOUNDED PRECEDING), first_value(t IGNORE NULLS) OVER (PARTITION BY feed ORDER BY slot_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM x)
  SELECT y.feed, slot_ms, c.timestamp, open, high, low, close, volume FROM y JOIN candles c ON c.feed = y.feed AND c.timestamp = y.t""")
def settled_candles(spark, d):
    return series.settle_nulls(series.grid(adapt.candles(spark, d), HOUR_MS))


@query(f"""WITH {CANDLES_SQL}, l AS (SELECT feed, timestamp, close AS yraw, close AS y, {', '.join(f'lag(close, {k}) {_W} AS lag_{k}' for k in (3, 2, 1))}, row_number() OVER (PARTITION BY feed ORDER BY timestamp DESC) AS n FROM candles)
  SELECT * EXCLUDE (n) FROM l WHERE n > 2 AND n <= 103""")
def lag_matrix(spark, d):
    return series.lag_matrix(adapt.candles(spark, d), "close", 3, 100, 2)


@query(f"""WITH {CANDLES_SQL}, z AS (SELECT feed, timestamp, close AS yraw, close / nullif(lag(close) {_W}, 0) - 1 AS y FROM candles), k AS (SELECT * FROM z WHERE y IS NOT NULL),
  l AS (SELECT *, {', '.join(f'lag(y, {k}) {_W} AS lag_{k}' for k in (2, 1))}, row_number() OVER (PARTITION BY feed ORDER BY timestamp DESC) AS n FROM k) SELECT * EXCLUDE (n) FROM l WHERE n <= 51""")
def lag_matrix_of_changes(spark, d):
    return series.lag_matrix(adapt.candles(spark, d), "close", 2, 50, 0, relative=True)


@query(f"WITH {CANDLES_SQL}, b AS (SELECT feed, timestamp, list(close) OVER (PARTITION BY feed ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM candles) SELECT feed, timestamp, CAST(list_reverse(l) AS VARCHAR) AS block FROM b WHERE len(l) = 4")
def time_blocks(spark, d):
    return series.time_blocks(adapt.candles(spark, d), "close", 4).withColumn("block", F.concat(F.lit("["), F.concat_ws(", ", F.col("block").cast("array<string>")), F.lit("]")))


@query(f"WITH {CANDLES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY timestamp DESC) AS n FROM candles) SELECT feed, timestamp, high, low FROM n WHERE n = 5")
def high_low(spark, d):
    return series.high_low(adapt.candles(spark, d), 3)


@query(f"WITH {CANDLES_SQL} SELECT b.feed, b.timestamp, b.close > a.close AS truevalue, b.close = a.close AS cancel FROM candles a JOIN candles b ON a.feed = b.feed AND b.timestamp = a.timestamp + 3600000")
def true_values(spark, d):
    return series.true_values(adapt.candles(spark, d), HOUR_MS)
