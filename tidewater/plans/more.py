"""Queries on bars, indicators, statistics, labels, incremental enrichment and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import conditions, normal, text
from tidewater.operators import backtest, checks, ensembles, frames, models, selection, sequential, series, stats
from tidewater.plans.registry import query
from tidewater.sources import adapt, graph
from tidewater.sources.adapt import CANDLES_SQL, PAYOUTS_SQL, PREDICTIONS_SQL, SLOTS_SQL, SUBSCRIPTIONS_SQL
from tidewater.streaming import bronze, settle

_W = "OVER (PARTITION BY feed ORDER BY timestamp)"
_I = f"i AS (SELECT *, row_number() {_W} AS i FROM candles)"


def _bars(metric: str, threshold: int) -> str:
    return f"""WITH RECURSIVE {CANDLES_SQL}, {_I}, m AS (SELECT *, {metric} AS v FROM i),
      r AS (SELECT feed, i, v AS total, 0 AS bar FROM m WHERE i = 1 UNION ALL
            SELECT m.feed, m.i, CASE WHEN r.total >= {threshold} THEN m.v ELSE r.total + m.v END, r.bar + CAST(r.total >= {threshold} AS INTEGER) FROM r JOIN m ON m.feed = r.feed AND m.i = r.i + 1),
      b AS (SELECT m.*, r.bar, max(r.total) OVER (PARTITION BY m.feed, r.bar) AS top FROM m JOIN r ON m.feed = r.feed AND m.i = r.i)
      SELECT feed, CAST(bar AS BIGINT) AS bar, min(timestamp) AS timestamp, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume,
      round(sum(close * volume), 6) AS dollar, count(*) AS n, max(timestamp) AS closed_at FROM b WHERE top >= {threshold} GROUP BY feed, bar"""


@query(_bars("volume", 3000))
def volume_bars(spark, d):
    return sequential.threshold_bars(adapt.candles(spark, d), "volume", 3000).withColumn("dollar", F.round("dollar", 6))


@query(_bars("close * volume", 100000))
def dollar_bars(spark, d):
    return sequential.threshold_bars(adapt.candles(spark, d), "dollar", 100000).withColumn("dollar", F.round("dollar", 6))


@query(_bars("1", 7))
def tick_bars(spark, d):
    return sequential.threshold_bars(adapt.candles(spark, d), "tick", 7.9).withColumn("dollar", F.round("dollar", 6))


def _ema(name: str, x: str, alpha: str) -> str:
    return f"""{name} AS (SELECT feed, i, {x} AS e FROM x WHERE i = 1 UNION ALL SELECT x.feed, x.i, {alpha} * {x} + (1 - {alpha}) * r.e FROM {name} r JOIN x ON x.feed = r.feed AND x.i = r.i + 1)"""


@query(f"""WITH RECURSIVE {CANDLES_SQL}, {_I}, x AS (SELECT feed, i, timestamp, close, CASE WHEN i = 1 THEN 0.0 ELSE close - lag(close) OVER (PARTITION BY feed ORDER BY i) END AS s FROM i),
  {_ema('a', 'x.close', '(2::DOUBLE / 13)')}, {_ema('b', 'x.close', '(2::DOUBLE / 27)')}, {_ema('u', 'greatest(x.s, 0.0::DOUBLE)', '(1::DOUBLE / 14)')}, {_ema('v', 'greatest(-x.s, 0.0::DOUBLE)', '(1::DOUBLE / 14)')}
  SELECT x.feed, x.timestamp, x.close, round(CASE WHEN x.i >= 26 THEN a.e - b.e END, 8) AS macd, round(CASE WHEN x.i >= 14 THEN CASE WHEN v.e = 0 THEN 100.0 ELSE 100 - 100 / (1 + u.e / v.e) END END, 8) AS rsi
  FROM x JOIN a ON a.feed = x.feed AND a.i = x.i JOIN b ON b.feed = x.feed AND b.i = x.i JOIN u ON u.feed = x.feed AND u.i = x.i JOIN v ON v.feed = x.feed AND v.i = x.i""")
def indicators(spark, d):
    return sequential.indicators(adapt.candles(spark, d)).withColumn("macd", F.round("macd", 8)).withColumn("rsi", F.round("rsi", 8))


def _signals(spark, d):
    return adapt.candles(spark, d).withColumn("prob_up", ((F.col("timestamp") / 3_600_000).cast("long") * 7919 % 101) / 100.0)


#: One row per step: the position that the step leaves, and what it has realized. Fee 0.001, 1,500 a trade.
_TRADES = f"""WITH RECURSIVE {CANDLES_SQL}, {_I}, m AS (SELECT *, ((timestamp // 3600000) * 7919 % 101) / 100.0::DOUBLE AS p FROM i),
  g AS (SELECT *, 2 * (p - 0.5::DOUBLE) AS conf, p > 0.5 AND 2 * (p - 0.5::DOUBLE) > 0 AS up, p < 0.5 AND -2 * (p - 0.5::DOUBLE) > 0 AS down, 1500.0::DOUBLE * (1 + abs(2 * (p - 0.5::DOUBLE))) AS usd FROM m),
  r AS (SELECT feed, 0::BIGINT AS i, 0 AS side, 0.0::DOUBLE AS size, 0.0::DOUBLE AS worth, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS profit FROM (SELECT DISTINCT feed FROM g)
    UNION ALL SELECT s.feed, s.i,
      CASE WHEN s.side = 0 THEN CASE WHEN s.up THEN 1 WHEN s.down THEN -1 ELSE 0 END WHEN s.price IS NULL THEN s.side ELSE 0 END,
      CASE WHEN s.side = 0 AND s.up THEN s.usd * (1 - 0.001::DOUBLE) / s.close WHEN s.side = 0 AND s.down THEN s.usd / s.close ELSE s.size END,
      CASE WHEN s.side = 0 AND s.up THEN s.usd WHEN s.side = 0 AND s.down THEN s.usd / s.close * (1 - 0.001::DOUBLE) * s.close ELSE s.worth END,
      CASE WHEN s.side = 0 AND s.up THEN s.close * 1.3::DOUBLE WHEN s.side = 0 AND s.down THEN s.close * 1.2::DOUBLE ELSE s.hi END,
      CASE WHEN s.side = 0 AND s.up THEN s.close * 0.8::DOUBLE WHEN s.side = 0 AND s.down THEN s.close * 0.7::DOUBLE ELSE s.lo END,
      CASE WHEN s.side = 0 OR s.price IS NULL THEN 0.0 WHEN s.side > 0 THEN s.size * (1 - 0.001::DOUBLE) * s.price - s.worth ELSE s.worth - s.size * s.price END
    FROM (SELECT r.side, r.size, r.worth, r.hi, r.lo, g.*,
      CASE WHEN r.side > 0 THEN CASE WHEN high >= r.hi THEN r.hi WHEN low <= r.lo THEN r.lo WHEN up THEN NULL ELSE close END
           WHEN r.side < 0 THEN CASE WHEN low <= r.lo THEN r.lo WHEN high >= r.hi THEN r.hi WHEN down THEN NULL ELSE close END END AS price
      FROM r JOIN g ON g.feed = r.feed AND g.i = r.i + 1) s)
  SELECT g.feed, g.timestamp, CAST(side AS BIGINT) AS position, round(profit, 6) AS profit, round(sum(profit) OVER (PARTITION BY g.feed ORDER BY g.i ROWS UNBOUNDED PRECEDING), 4) AS cum_profit FROM g JOIN r ON g.feed = r.feed AND g.i = r.i"""


@query(_TRADES)
def trades(spark, d):
    out = sequential.trades(_signals(spark, d), take=0.3, stop=0.2)
    return out.withColumn("profit", F.round("profit", 6)).withColumn("cum_profit", F.round("cum_profit", 4))


_SO_FAR = "OVER (PARTITION BY feed ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {CANDLES_SQL}, s AS (SELECT feed, timestamp, ((timestamp // 3600000) * 7919 % 101) / 100.0::DOUBLE AS p, close > lag(close) {_W} AS up FROM candles),
  r AS (SELECT *, p > 0.5 AS said, -ln(CASE WHEN up THEN least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) ELSE 1 - least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) END) AS loss FROM s WHERE up IS NOT NULL),
  c AS (SELECT feed, timestamp, count(*) {_SO_FAR} AS n, count(*) FILTER (said = up) {_SO_FAR} AS ok, count(*) FILTER (said AND up) {_SO_FAR} AS tp, count(*) FILTER (said) {_SO_FAR} AS said, count(*) FILTER (up) {_SO_FAR} AS was, avg(loss) {_SO_FAR} AS loss FROM r),
  a AS (SELECT *, CAST(ok AS DOUBLE) / n AS acc, coalesce(CAST(tp AS DOUBLE) / nullif(said, 0), 0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(was, 0), 0) AS re FROM c)
  SELECT feed, timestamp, n, acc AS accuracy, greatest(acc - sqrt(acc * (1 - acc) / n) * 1.959963984540054::DOUBLE, 0.0) AS low, least(acc + sqrt(acc * (1 - acc) / n) * 1.959963984540054::DOUBLE, 1.0) AS high, pr AS precision, re AS recall,
  round(CASE WHEN was = 0 OR was = n THEN 3.0 ELSE loss END, 7) AS log_loss, coalesce(2 * pr * re / nullif(pr + re, 0), 0.0) AS f1 FROM a""")
def signal_metrics(spark, d):
    """Running figures of signals that follow a rule, against the rises that came."""
    rows = _signals(spark, d).withColumn("up", F.col("close") > F.lag("close").over(series.by_feed())).where("up is not null")
    return backtest.metrics(rows).withColumn("log_loss", F.round("log_loss", 7))


@query()
def walk_forward(spark, d):
    return backtest.walk_forward(adapt.candles(spark, d), 3, 100)


@query()
def back_test_metrics(spark, d):
    steps = backtest.walk_forward(adapt.candles(spark, d), 3, 100)
    return backtest.metrics(steps.withColumn("up", F.col("close") > F.col("before")))


@query()
def multi_run(spark, d):
    return backtest.multi_run(adapt.candles(spark, d), {"take": [0.05, 0.2], "stop": [0.02, 0.1, 0.3], "fee": [0.001]}, 2, 100)


@query(f"""WITH {CANDLES_SQL}, p AS (SELECT feed, timestamp, close, lead(close) {_W} > close AS rose, ((timestamp // 3600000) * 7919 % 101) / 100.0::DOUBLE AS p FROM candles)
  SELECT feed, timestamp, round((15.0 + 80.0 + 20.0) * (CASE WHEN rose THEN 20.0 * p ELSE 20.0 * (1 - p) END) / (80.0 * 0.52 + CASE WHEN rose THEN 20.0 * p ELSE 20.0 * (1 - p) END) - 20.0 * p - 20.0 * (1 - p), 8) AS profit FROM p WHERE rose IS NOT NULL""")
def predictor_profit(spark, d):
    rows = _signals(spark, d).withColumn("rose", F.lead("close").over(series.by_feed()) > F.col("close")).where("rose is not null")
    gain = backtest.predictor_profit(F.lit(20.0), F.col("prob_up"), F.col("rose"), F.lit(80.0), F.lit(0.52), F.lit(15.0))
    return rows.select("feed", "timestamp", F.round(gain, 8).alias("profit"))


@query(f"""WITH {CANDLES_SQL} SELECT feed, timestamp, 50.0::DOUBLE AS up_1, 50.0::DOUBLE AS down_1, (100.0 * p)::DOUBLE AS up_2, (100.0 * (1 - p))::DOUBLE AS down_2,
  greatest(100.0 * p - 100.0 * (1 - p), 0.0)::DOUBLE AS up_3, greatest(100.0 * (1 - p) - 100.0 * p, 0.0)::DOUBLE AS down_3
  FROM (SELECT feed, timestamp, ((timestamp // 3600000) * 7919 % 101) / 100.0::DOUBLE AS p FROM candles)""")
def stake_allocation(spark, d):
    each = [c.alias(f"{side}_{k}") for k in (1, 2, 3) for side, c in zip(("up", "down"), backtest.stakes(k, F.lit(100.0), F.col("prob_up")), strict=True)]
    return _signals(spark, d).select("feed", "timestamp", *each)


@query("""SELECT i AS run_i, [0.1, 0.2][CAST(i % 2 AS INTEGER) + 1]::DOUBLE AS take, [1, 2, 3][CAST(i // 2 % 3 AS INTEGER) + 1]::INTEGER AS lags FROM (SELECT unnest(range(6)) AS i)""")
def parameter_sweep(spark, d):
    return backtest.sweep(spark, {"take": [0.1, 0.2], "lags": [1, 2, 3]})


_LAGS = 5


@query(f"""WITH {CANDLES_SQL}, m AS (SELECT feed, timestamp, close - avg(close) OVER (PARTITION BY feed) AS x FROM candles),
  p AS (SELECT feed, {', '.join(f'x * lag(x, {k}) {_W} AS c{k}' for k in range(_LAGS + 1))} FROM m), s AS (SELECT feed, count(*) AS n, {', '.join(f'sum(c{k}) AS c{k}' for k in range(_LAGS + 1))} FROM p GROUP BY feed),
  l AS (SELECT feed, n, unnest(range(0, {_LAGS + 1})) AS lag, unnest([{', '.join(f'c{k} / c0' for k in range(_LAGS + 1))}]) AS acf FROM s),
  h AS (SELECT *, CASE WHEN lag = 0 THEN 0.0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY feed ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) * 1.959963984540054 END AS half FROM l)
  SELECT feed, CAST(lag AS INTEGER) AS lag, n, round(acf, 9) AS acf, round(acf - half, 9) AS low, round(acf + half, 9) AS high FROM h""")
def autocorrelation(spark, d):
    return stats.autocorrelation(adapt.candles(spark, d), "close", _LAGS).select("feed", "lag", "n", *(F.round(c, 9).alias(c) for c in ("acf", "low", "high")))


@query(f"""WITH {CANDLES_SQL}, r AS (SELECT feed, close - lag(close) {_W} AS d, lag(close) {_W} AS x FROM candles),
  f AS (SELECT feed, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, count(*) AS n FROM r WHERE x IS NOT NULL GROUP BY feed), t AS (SELECT feed, n, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS t FROM f)
  SELECT feed, n, round(t, 6) AS t, t < -2.86 AS stationary FROM t""")
def unit_root(spark, d):
    return stats.dickey_fuller(adapt.candles(spark, d), "close").withColumn("t", F.round("t", 6))


def _poly(cs, x: str) -> str:
    return f"({cs[0]}::DOUBLE)" if len(cs) == 1 else f"({cs[0]}::DOUBLE + {x} * {_poly(cs[1:], x)})"


def _normal_sql(z: str) -> str:
    a = f"abs({z})"
    tail = f"exp(-0.5 * {a} * {a}) * CASE WHEN {a} < 7.07106781186547 THEN {_poly(normal._ABOVE[::-1], a)} / {_poly(normal._BELOW[::-1], a)} ELSE 1 / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / sqrt(2 * pi()) END"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


@query(f"""WITH {CANDLES_SQL}, l AS (SELECT feed, timestamp, close - lag(close) {_W} AS d, lag(close) {_W} AS x FROM candles), r AS (SELECT feed, d, x, lag(d) {_W} AS e FROM l),
  f AS (SELECT feed, count(*) AS n, regr_sxx(d, x) AS xx, regr_syy(d, x) AS dd, regr_sxy(d, x) AS dx, regr_sxx(d, e) AS ee, regr_sxy(d, e) AS de, regr_sxy(x, e) AS xe FROM r WHERE e IS NOT NULL GROUP BY feed),
  g AS (SELECT *, dx / xx AS b0, (dx * ee - de * xe) / (xx * ee - xe * xe) AS bx, (de * xx - dx * xe) / (xx * ee - xe * xe) AS be FROM f),
  h AS (SELECT *, dd - b0 * dx AS r0, dd - bx * dx - be * de AS r1 FROM g),
  k AS (SELECT feed, n, CASE WHEN n * ln(r1 / n) + 6 < n * ln(r0 / n) + 4 THEN 1 ELSE 0 END AS lags, b0 / sqrt(r0 / (n - 2) / xx) AS t0, bx / sqrt(r1 / (n - 3) * ee / (xx * ee - xe * xe)) AS t1 FROM h),
  t AS (SELECT feed, n, lags, CASE WHEN lags = 1 THEN t1 ELSE t0 END AS t FROM k),
  z AS (SELECT *, CASE WHEN t <= {stats.SURFACE_MIDDLE} THEN {_poly(stats.SURFACE_LOW, 't')} ELSE {_poly(stats.SURFACE_HIGH, 't')} END AS z FROM t)
  SELECT feed, n, lags, round(t, 6) AS t, t < -2.86 AS stationary, round(CASE WHEN t > {stats.SURFACE_ENDS[1]} THEN 1.0 WHEN t < {stats.SURFACE_ENDS[0]} THEN 0.0 ELSE {_normal_sql('z')} END, 9) AS p FROM z""")
def unit_root_lags(spark, d):
    """With one lagged difference or none, as Akaike's criterion says."""
    return stats.augmented_dickey_fuller(adapt.candles(spark, d), "close", 1).withColumn("t", F.round("t", 6)).withColumn("p", F.round("p", 9))


@query(f"""WITH {CANDLES_SQL}, r AS (SELECT feed, timestamp, close AS observed, (row_number() {_W} - 1) % 24 AS phase,
    CASE WHEN count(close) OVER (PARTITION BY feed ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN (sum(close) OVER (PARTITION BY feed ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - (lag(close, 12) {_W} + lead(close, 12) {_W}) / 2) / 24 END AS trend FROM candles),
  p AS (SELECT feed, phase, avg(observed - trend) AS raw FROM r GROUP BY feed, phase), s AS (SELECT feed, phase, raw - avg(raw) OVER (PARTITION BY feed) AS season FROM p)
  SELECT feed, timestamp, observed, CAST(phase AS INTEGER) AS phase, round(trend, 8) AS trend, round(season, 8) AS season, round(observed - trend - season, 8) AS rest FROM r JOIN s USING (feed, phase)""")
def seasonal(spark, d):
    return stats.seasonal(adapt.candles(spark, d), "close", 24).select("feed", "timestamp", "observed", F.col("phase").cast("int").alias("phase"), *(F.round(c, 8).alias(c) for c in ("trend", "season", "rest")))


_SEASONAL = f"""WITH {CANDLES_SQL}, q AS (SELECT feed, timestamp, close AS observed, row_number() {_W} AS i, (row_number() {_W} - 1) % 24 AS phase,
    CASE WHEN count(close) OVER (PARTITION BY feed ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN (sum(close) OVER (PARTITION BY feed ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) - (lag(close, 12) {_W} + lead(close, 12) {_W}) / 2) / 24 END AS t FROM candles),
  e AS (SELECT feed, min(i) FILTER (t IS NOT NULL) AS a, max(i) FILTER (t IS NOT NULL) AS z FROM q GROUP BY feed),
  k AS (SELECT e.feed, a, z, max(t) FILTER (i = a) AS t1, max(t) FILTER (i = a + 1) AS t2, max(t) FILTER (i = z) AS t4, max(t) FILTER (i = z - 1) AS t3 FROM e JOIN q USING (feed) GROUP BY ALL),
  r AS (SELECT feed, timestamp, observed, phase, CASE WHEN i < a THEN t1 + (i - a) * (t2 - t1) WHEN i > z THEN t4 + (i - z) * (t4 - t3) ELSE t END AS trend FROM q JOIN k USING (feed)),
  p AS (SELECT feed, phase, avg(observed - trend) AS raw FROM r GROUP BY feed, phase), s AS (SELECT feed, phase, raw - avg(raw) OVER (PARTITION BY feed) AS season FROM p)
  SELECT feed, timestamp, observed, CAST(phase AS INTEGER) AS phase, round(trend, 7) AS trend, round(season, 7) AS season, round(observed - trend - season, 7) AS rest FROM r JOIN s USING (feed, phase)"""


@query(_SEASONAL)
def seasonal_extended(spark, d):
    out = stats.seasonal(adapt.candles(spark, d), "close", 24, extend=True)
    return out.select("feed", "timestamp", "observed", F.col("phase").cast("int").alias("phase"), *(F.round(c, 7).alias(c) for c in ("trend", "season", "rest")))


@query(_SEASONAL.replace("SELECT feed, timestamp, observed, CAST(phase AS INTEGER) AS phase, round(trend, 7) AS trend, round(season, 7) AS season, round(observed - trend - season, 7) AS rest", "SELECT feed, " + ", ".join(f"round(stddev_pop({x}) / stddev_pop(observed), 9) AS {n}" for x, n in (("trend", "trend"), ("season", "season"), ("observed - trend - season", "rest")))) + " GROUP BY feed")
def relative_energy(spark, d):
    out = stats.relative_energy(stats.seasonal(adapt.candles(spark, d), "close", 24, extend=True))
    return out.select("feed", *(F.round(c, 9).alias(c) for c in ("trend", "season", "rest")))


def _box_cox_sql(points: int = 21, rounds: int = 3) -> str:
    """The same grids as the operator's: each round has `points` exponents around the best of the round before."""
    z = "z AS (SELECT c.feed, timestamp, m, s, 0.1 - (lo - m) / s AS shift, (close - m) / s + (0.1 - (lo - m) / s) AS z FROM candles c JOIN (SELECT feed, avg(close) AS m, stddev_pop(close) AS s, min(close) AS lo FROM candles GROUP BY feed) f ON c.feed = f.feed)"
    parts, half = [z, "g0 AS (SELECT DISTINCT feed, 0.0::DOUBLE AS l FROM z)"], 2.0
    for r in range(rounds):
        parts.append(f"m{r} AS (SELECT g0.feed, g0.l + {half!r}::DOUBLE * (2 * i / {points - 1}::DOUBLE - 1) AS g FROM g{r} g0, (SELECT unnest(range({points})) AS i))")
        parts.append(f"l{r} AS (SELECT m.feed, g, (g - 1) * sum(ln(z)) - count(*) / 2.0::DOUBLE * ln(var_pop(CASE WHEN abs(g) < 1e-12 THEN ln(z) ELSE (pow(z, g) - 1) / g END)) AS w FROM m{r} m JOIN z ON m.feed = z.feed GROUP BY m.feed, g)")
        parts.append(f"g{r + 1} AS (SELECT feed, arg_max(g, w) AS l FROM l{r} GROUP BY feed)")
        half = half * 2 / (points - 1)
    return f"WITH {CANDLES_SQL}, {', '.join(parts)} SELECT z.feed, timestamp, round((CASE WHEN abs(l) < 1e-12 THEN ln(z) ELSE (pow(z, l) - 1) / l END - shift) * s + m, 5) AS boxcox FROM z JOIN g{rounds} g ON g.feed = z.feed"


@query(_box_cox_sql())
def box_cox(spark, d):
    return stats.box_cox(adapt.candles(spark, d), "close").select("feed", "timestamp", F.round("boxcox", 5).alias("boxcox"))


@query(f"""WITH {CANDLES_SQL}, r AS (SELECT feed, close AS x, min(close) OVER (PARTITION BY feed) AS lo, max(close) OVER (PARTITION BY feed) AS hi, greatest(3, least(100, count(*) OVER (PARTITION BY feed) // 5)) AS k FROM candles),
  b AS (SELECT feed, lo, hi, k, coalesce(least(CAST(floor((x - lo) * k / nullif(hi - lo, 0)) AS BIGINT), k - 1), 0) AS bin FROM r), c AS (SELECT feed, bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(k) AS k FROM b GROUP BY feed, bin)
  SELECT feed, bin, n, lo + bin * ((hi - lo) / k) AS start, round((CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY feed)) / ((hi - lo) / k), 9) AS density FROM c""")
def histogram(spark, d):
    return stats.histogram(adapt.candles(spark, d), "close").withColumn("density", F.round("density", 9))


@query(f"WITH {CANDLES_SQL} SELECT feed, unnest([0.05, 0.5, 0.95])::DOUBLE AS p, round(unnest(quantile_cont(close, [0.05, 0.5, 0.95])), 8) AS value FROM candles GROUP BY feed")
def quantiles(spark, d):
    return stats.quantiles(adapt.candles(spark, d), "close", [0.05, 0.5, 0.95]).withColumn("value", F.round("value", 8))


@query(f"""WITH {CANDLES_SQL}, s AS (SELECT feed, count(close) AS n, stddev_samp(close) * pow(count(close), -0.2) AS h, min(close) AS lo, max(close) AS hi FROM candles GROUP BY feed),
  m AS (SELECT *, lo + (hi - lo) * i / 199 AS x FROM (SELECT *, unnest(range(200)) AS i FROM s))
  SELECT m.feed, CAST(i AS INTEGER) AS i, round(any_value(x), 9) AS x, round(sum(exp(-0.5 * pow((x - close) / h, 2)) / (h * sqrt(2 * pi())) / n), 9) AS density FROM m JOIN candles c USING (feed) GROUP BY m.feed, i""")
def kernel_density(spark, d):
    return stats.kernel_density(adapt.candles(spark, d), "close", 200).select("feed", "i", F.round("x", 9).alias("x"), F.round("density", 9).alias("density"))


# Labels, filters and pages


@query("""SELECT c_custkey, substr(c_name, 1, 5) || '...' || right(c_name, 5) AS short, upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] AS segment, split_part(c_name, '#', 2) AS number,
  CASE WHEN c_acctbal IS NULL THEN NULL ELSE greatest(c_acctbal, 0.0) END AS clipped, strftime(make_timestamp(c_custkey * 86400000000), '%d-%m-%Y %H:%M') AS minute, strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%d') AS day FROM customer""")
def customer_labels(spark, d):
    c = adapt.table(spark, d, "customer")
    return c.select(
        "c_custkey", text.short_address(F.col("c_name")).alias("short"), text.title(F.col("c_mktsegment")).alias("segment"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("number"),
        text.clip_low(F.col("c_acctbal")).alias("clipped"), text.minute_text(F.col("c_custkey") * 86_400_000).alias("minute"), text.day_text(F.col("c_custkey") * 86_400).alias("day"),
    )


_SHORT = """CASE WHEN abs(p) >= 1000000 THEN regexp_replace(CAST(round(CAST(p / 1000000 AS DECIMAL(24,8)), 2) AS VARCHAR), '\\.?0+$', '') || 'M'
  WHEN abs(p) >= 1000 THEN regexp_replace(CAST(round(CAST(p / 1000 AS DECIMAL(24,8)), 2) AS VARCHAR), '\\.?0+$', '') || 'K' ELSE regexp_replace(CAST(round(CAST(p AS DECIMAL(24,8)), 2) AS VARCHAR), '\\.?0+$', '') END"""


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders), s AS (SELECT *, {_SHORT} AS amount FROM o)
  SELECT o_orderkey, amount, CAST(regexp_extract(amount, '^[0-9.]+') AS DOUBLE) * CASE right(amount, 1) WHEN 'M' THEN 1e6::DOUBLE WHEN 'K' THEN 1e3::DOUBLE ELSE 1e0::DOUBLE END AS parsed,
  CAST(CAST(round(CAST(p / 1000 AS DECIMAL(24,8)), 2) AS DOUBLE) AS VARCHAR) || '%' AS percent,
  CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE round_even(p * pow(10::DOUBLE, 2 - floor(log10(abs(p)))), 0) / pow(10::DOUBLE, 2 - floor(log10(abs(p)))) END AS rounded FROM s""")
def amount_labels(spark, d):
    o = adapt.table(spark, d, "orders")
    price = F.col("o_totalprice")
    return o.select("o_orderkey", text.short_number(price).alias("amount"), text.parse_number(text.short_number(price)).alias("parsed"), text.percent(price / 1000).alias("percent"), text.significant(price, 3).alias("rounded"))


@query("SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 100 AND c_acctbal <= 5000 AND regexp_matches(c_name, '(?i)r#0000001')")
def filtered_customers(spark, d):
    conds = [("filter", "p_c_mktsegment", ["BUILDING", "MACHINERY"]), ("range", "c_acctbal", (100, 5000)), ("search", "c_name", "R#0000001")]
    return conditions.check(adapt.table(spark, d, "customer"), conds)


@query("SELECT * FROM part WHERE regexp_matches(p_name, '(?i)RED') OR regexp_matches(p_type, '(?i)RED')")
def searched_parts(spark, d):
    return conditions.search(adapt.table(spark, d, "part"), "RED", ["p_name", "p_type"])


@query("SELECT *, true AS pinned FROM supplier WHERE s_suppkey IN (3, 5) UNION ALL SELECT *, false FROM supplier WHERE s_suppkey NOT IN (3, 5) AND s_acctbal >= 5000")
def pinned_suppliers(spark, d):
    return conditions.pinned(adapt.table(spark, d, "supplier"), "s_suppkey", [3, 5], [("range", "s_acctbal", (5000, None))])


@query("SELECT * FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_custkey DESC NULLS LAST LIMIT 25 OFFSET 50")
def customer_page(spark, d):
    return conditions.page(adapt.table(spark, d, "customer"), "c_mktsegment", "c_custkey", True, 25, 50)


@query("""WITH s AS (SELECT CAST(s_nationkey AS VARCHAR) AS nation, count(*) AS w FROM supplier GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY w DESC, nation) AS n FROM s)
  SELECT CASE WHEN n <= 5 THEN nation ELSE 'rest' END AS nation, CAST(sum(w) AS BIGINT) AS w FROM r GROUP BY 1""")
def top_nations(spark, d):
    s = adapt.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("nation")).agg(F.count("*").alias("w"))
    return conditions.top_with_rest(s, "nation", "w", 5)


@query("(SELECT * FROM events ORDER BY ts LIMIT 1) UNION ALL (SELECT * FROM events ORDER BY ts DESC LIMIT 1)")
def first_and_last_event(spark, d):
    return conditions.ends(adapt.table(spark, d, "events"), "ts")


@query(f"""WITH {PREDICTIONS_SQL} SELECT contract, source AS exchange, unnest([pair, 'DOT/EUR']) AS pair, signal, timeframe FROM feeds, (SELECT unnest(['o', 'c']) AS signal)""")
def expanded_feeds(spark, d):
    """Every contract's feed as text, its pair written with a hyphen beside another one."""
    rows = adapt.feeds(spark, d).select("contract", F.concat_ws(" ", "source", F.concat(F.lower(F.replace("pair", F.lit("/"), F.lit("-"))), F.lit(",DOT/EUR")), F.lit("oc"), "timeframe").alias("feeds"))
    return text.expand_feeds(rows, "feeds").select("contract", "exchange", "pair", "signal", "timeframe")


# Incremental enrichment, nested records

_CUTS = [0, 820_000_000_000, 880_000_000_000, 4_000_000_000_000]


def _events(spark, d):
    every = adapt.predictions(spark, d)
    paid = adapt.payouts(spark, d).groupBy("ID").agg(*(F.max(c).alias(c) for c in ("timestamp", "predvalue", "truevalue", "stake", "payout")))
    return every, paid


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL}, u AS (SELECT ID, max(timestamp) AS t, max(predvalue) AS predvalue, max(truevalue) AS truevalue, max(stake) AS stake, max(payout) AS payout FROM payouts GROUP BY ID),
  p AS (SELECT DISTINCT ID, contract, slot, "user", pair, timeframe, source, timestamp FROM predictions)
  SELECT p.ID, split_part(p.ID, '-', 1) || '-' || split_part(p.ID, '-', 2) AS slot_id, contract, slot, "user", pair, timeframe, source, u.predvalue, u.truevalue, u.stake, CAST(NULL AS DOUBLE) AS revenue, u.payout, p.timestamp,
  CASE WHEN u.t IS NULL OR (p.timestamp > 820000000000) = (u.t > 820000000000) AND (p.timestamp > 880000000000) = (u.t > 880000000000) THEN p.timestamp ELSE greatest(p.timestamp, u.t) END AS last_event_timestamp
  FROM p LEFT JOIN u ON p.ID = u.ID""")
def bronze_incremental(spark, d):
    return bronze.run_windows(*_events(spark, d), _CUTS)


_MAX = "max(predvalue) AS predvalue, max(truevalue) AS truevalue, max(stake) AS stake, max(payout) AS payout, max(t) AS t"


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL}, p AS (SELECT DISTINCT ID, contract, slot, "user", pair, timeframe, source, timestamp FROM predictions),
  u AS (SELECT q.ID, q.predvalue, q.truevalue, q.stake, q.payout, q.timestamp AS t, coalesce(q.timestamp BETWEEN p.timestamp AND p.timestamp + 172800000, false) AS met FROM payouts q LEFT JOIN p ON p.ID = q.ID),
  k AS (SELECT ID, met, {_MAX} FROM u GROUP BY ID, met)
  SELECT p.ID, split_part(p.ID, '-', 1) || '-' || split_part(p.ID, '-', 2) AS slot_id, contract, slot, "user", pair, timeframe, source, predvalue, truevalue, stake, CAST(NULL AS DOUBLE) AS revenue, payout, timestamp,
    greatest(timestamp, coalesce(t, timestamp)) AS last_event_timestamp, false AS orphan FROM p LEFT JOIN k ON k.ID = p.ID AND k.met
  UNION ALL SELECT ID, split_part(ID, '-', 1) || '-' || split_part(ID, '-', 2), NULL, NULL, NULL, NULL, NULL, NULL, predvalue, truevalue, stake, NULL, payout, NULL, t, true FROM k WHERE NOT met""")
def settled_events(spark, d):
    """Settlements of the third day come too late and are orphans."""
    return settle.settled(adapt.predictions(spark, d), adapt.payouts(spark, d), 2 * bronze.DAY_MS)


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL} SELECT ID, max(predvalue) AS u_predvalue, max(truevalue) AS u_truevalue, max(stake) AS u_stake, CAST(NULL AS DOUBLE) AS u_revenue, max(payout) AS u_payout, max(timestamp) AS u_time
  FROM payouts WHERE timestamp > 820000000000 AND timestamp <= 880000000000 GROUP BY ID""")
def update_events(spark, d):
    return bronze.update_events(adapt.payouts(spark, d), 820_000_000_000, 880_000_000_000, False)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def hourly_totals(spark, d):
    return bronze.hourly_totals(adapt.table(spark, d, "events"), "ts", "value")


@query(f"""WITH {PREDICTIONS_SQL} SELECT contract, slot, ID, "user", stake, payout FROM predictions""")
def network_predictions(spark, d):
    """An answer of the service holds a contract's slots of 30 days, so no row holds all of a contract."""
    rows = adapt.predictions(spark, d)
    slots = rows.groupBy("contract", "slot").agg(F.collect_list(F.struct(F.col("ID").alias("id"), "user", "stake", "payout")).alias("predictions"))
    nested = slots.groupBy(F.col("contract").alias("id"), F.floor(F.col("slot") / (30 * adapt.DAY)).alias("page")).agg(F.collect_list(F.struct("slot", "predictions")).alias("slots"))
    return graph.network_predictions(nested)


@query(f"""WITH {PREDICTIONS_SQL} SELECT contract, CAST(list_sort(list(DISTINCT slot)) AS VARCHAR) AS slots FROM predictions WHERE payout IS NULL GROUP BY contract""")
def pending_payouts(spark, d):
    found = graph.pending_payouts(adapt.predictions(spark, d))
    return found.select("contract", F.concat(F.lit("["), F.array_join(F.col("slots").cast("array<string>"), ", "), F.lit("]")).alias("slots"))


@query(f"""WITH {PREDICTIONS_SQL}, {SLOTS_SQL} SELECT contract, slot, roundSumStakesUp / roundSumStakes AS prob_up FROM slots WHERE roundSumStakes > 0""")
def slot_probabilities(spark, d):
    rows = adapt.slots(spark, d).where("roundSumStakes > 0")
    return rows.select("contract", "slot", text.confidence(F.col("roundSumStakesUp"), F.col("roundSumStakes")).alias("prob_up"))


@query(f"""WITH {PREDICTIONS_SQL} SELECT contract, count(DISTINCT "user") * 3.0::DOUBLE AS consumed FROM predictions GROUP BY contract""")
def consumed(spark, d):
    return graph.consumed(adapt.predictions(spark, d).select("contract", "user").distinct())


# Small operators on any table


@query("SELECT o_orderkey, c_name, o_totalprice * 2 AS double_price FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_with(spark, d):
    o, c = adapt.table(spark, d, "orders"), adapt.table(spark, d, "customer")
    return frames.left_join_with(o, c, "o_custkey", "c_custkey", {"double_price": F.col("o_totalprice") * 2}, ["o_orderkey", "c_name", "double_price"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def orders_of_segment(spark, d):
    ids = adapt.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return frames.keep_ids(adapt.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", ids, ["o_custkey"])


@query("SELECT arg_min(event_id, ts) AS event_id, event_type FROM events GROUP BY event_type")
def first_event_of_type(spark, d):
    return frames.distinct_in_order(adapt.table(spark, d, "events"), "event_type", "ts").select("event_id", "event_type")


@query(f"WITH {CANDLES_SQL} SELECT feed, timestamp, 1000 + (row_number() {_W} - 1) * 60 AS ut FROM candles")
def time_axis(spark, d):
    return frames.time_axis(adapt.candles(spark, d), 1000, 60, "timestamp").select("feed", "timestamp", F.col("ut").cast("long").alias("ut"))


@query("SELECT 0.0::DOUBLE + (i % 200) * (1.0::DOUBLE / 199) AS a, -1.0::DOUBLE + (i // 200 % 200) * (2.0::DOUBLE / 199) AS b FROM (SELECT unnest(range(40000)) AS i)")
def response_mesh(spark, d):
    return frames.mesh(spark, {"a": (0.0, 1.0), "b": (-1.0, 1.0)}, 200)


@query(f"WITH {CANDLES_SQL}, p AS (SELECT *, lag(close) {_W} AS guess FROM candles) SELECT feed, timestamp, guess + first_value(close - guess) OVER (PARTITION BY feed ORDER BY timestamp DESC) AS calibrated FROM p")
def calibrated(spark, d):
    rows = adapt.candles(spark, d).withColumn("guess", F.lag("close").over(series.by_feed()))
    return frames.calibrated(rows, "guess", "close", "timestamp").select("feed", "timestamp", "calibrated")


@query(f"""WITH {CANDLES_SQL}, n AS (SELECT *, row_number() {_W} AS n FROM candles) SELECT feed, round(avg(close), 6) AS close, sum(volume) AS volume, round(avg(CASE WHEN n > 1 THEN open END), 6) AS open FROM n GROUP BY feed""")
def run_means(spark, d):
    out = frames.run_means(adapt.candles(spark, d), ["feed"], ["close"], ["volume"], ["open"], "timestamp")
    return out.select("feed", F.round("close", 6).alias("close"), "volume", F.round("open", 6).alias("open"))


@query(f"WITH {PREDICTIONS_SQL} SELECT count(DISTINCT slot) AS n FROM predictions WHERE payout IS NULL")
def count_pending_slots(spark, d):
    return frames.count_members(graph.pending_payouts(adapt.predictions(spark, d)), "slots")


@query("SELECT c_custkey, 'acct(t-2)' AS label, list_extract(regexp_extract_all(c_name, '\\d+'), 1) AS digits, (c_custkey % 9 + 2) || ' days until ' || strftime(make_timestamp((c_custkey % 9 + 2) * 86400000000), '%Y-%m-%d') AS span FROM customer")
def more_labels(spark, d):
    n = F.col("c_custkey") % 9 + 2
    return adapt.table(spark, d, "customer").select("c_custkey", text.shift_label(F.lit("acct"), 2).alias("label"), F.get(text.digit_runs(F.col("c_name")), F.lit(0)).alias("digits"), text.range_label(F.lit(0), n * 86_400).alias("span"))


def _chunks(spark, d):
    return sequential.batches(adapt.table(spark, d, "orders"), "o_custkey", "o_orderkey", 4)


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders")
def batched_orders(spark, d):
    return _chunks(spark, d).select("o_orderkey", "o_custkey", "batch")


@query(f"WITH {CANDLES_SQL}, s AS (SELECT feed, avg(close) AS m, stddev_pop(close) AS s FROM candles GROUP BY feed) SELECT feed, timestamp, round((close - m) / s, 8) AS close FROM candles JOIN s USING (feed)")
def scaled_candles(spark, d):
    return series.scaled(adapt.candles(spark, d), ["close"]).select("feed", "timestamp", F.round("close", 8).alias("close"))


@query(f"WITH {CANDLES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY timestamp DESC) AS n FROM candles) SELECT feed, timestamp, close, CAST(unnest(range(1, CASE n WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 2 END)) AS INTEGER) AS copy FROM n")
def recent_weights(spark, d):
    return backtest.recent_weights(adapt.candles(spark, d), 2, 1).select("feed", "timestamp", "close", "copy")


# Coverage of the lake, distributions, pages, settlement batches and balanced training rows


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL}, {SUBSCRIPTIONS_SQL}, m AS (SELECT 'predictions' AS table_name, max(timestamp) AS newest FROM predictions
  UNION ALL SELECT 'payouts', max(timestamp) FROM payouts UNION ALL SELECT 'subscriptions', max(timestamp) FROM subscriptions)
  SELECT * FROM m UNION ALL SELECT 'all', max(newest) FROM m""")
def latest_timestamps(spark, d):
    return checks.latest({"predictions": adapt.predictions(spark, d), "payouts": adapt.payouts(spark, d), "subscriptions": adapt.subscriptions(spark, d)})


@query(f"""WITH {PREDICTIONS_SQL}, {PAYOUTS_SQL} SELECT min(timestamp) AS first_ts, max(timestamp) AS last_ts, min(timestamp) <= 750000000000 AND max(timestamp) > min(timestamp) AS covered FROM payouts""")
def lake_coverage(spark, d):
    return checks.covers(adapt.payouts(spark, d), 750_000_000_000)


@query(f"""WITH {PREDICTIONS_SQL} SELECT bool_or(stake IS NULL OR isnan(stake)) AS stake_some, bool_and(stake IS NULL OR isnan(stake)) AS stake_all,
  bool_or(payout IS NULL OR isnan(payout)) AS payout_some, bool_and(payout IS NULL OR isnan(payout)) AS payout_all FROM predictions""")
def nan_flags(spark, d):
    return checks.has_nan(adapt.predictions(spark, d), ["stake", "payout"])


@query(f"""WITH {CANDLES_SQL}, s AS (SELECT feed, count(close) AS n, avg(close) AS m, stddev_pop(close) AS s, stddev_samp(close) * pow(count(close), -0.2) AS h, min(close) AS lo, max(close) AS hi FROM candles GROUP BY feed),
  g AS (SELECT *, unnest(range(200)) AS i FROM s), x AS (SELECT *, lo - s / 2 + (hi - lo + s) * i / 199 AS x FROM g),
  k AS (SELECT feed, i, x, m, s, sum(exp(-0.5 * pow((x - close) / h, 2)) / (h * sqrt(2 * pi())) / n) AS pk, any_value(exp(-0.5 * pow((x - m) / s, 2)) / (s * sqrt(2 * pi()))) AS pn FROM x JOIN candles USING (feed) GROUP BY feed, i, x, m, s),
  t AS (SELECT *, max(greatest(pk, pn)) OVER (PARTITION BY feed) AS top FROM k)
  SELECT feed, CAST(i AS INTEGER) AS i, round(x, 8) AS x, round(pn / top, 8) AS pdf_normal, round(pk / top, 8) AS pdf_kernel FROM t""")
def distribution_densities(spark, d):
    out = stats.distribution(adapt.candles(spark, d), "close", 200)
    return out.select("feed", "i", *(F.round(c, 8).alias(c) for c in ("x", "pdf_normal", "pdf_kernel")))


@query()
def distribution_shares(spark, d):
    return stats.distribution(adapt.candles(spark, d), "close", 200).select("feed", "i", "x", "cdf_normal", "cdf_kernel", "nq_normal", "nq_kernel")


_P = 10


@query(f"""WITH RECURSIVE {CANDLES_SQL}, m AS (SELECT feed, timestamp, close - avg(close) OVER (PARTITION BY feed) AS x FROM candles),
  p AS (SELECT feed, {', '.join(f'x * lag(x, {k}) {_W} AS c{k}' for k in range(_P + 1))} FROM m), a AS (SELECT feed, [{', '.join(f'sum(c{k}) / sum(c0)' for k in range(_P + 1))}] AS r FROM p GROUP BY feed),
  d AS (SELECT feed, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, 1.0::DOUBLE AS pacf FROM a
    UNION ALL SELECT feed, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - n * phi[k + 1 - j]), n), n
    FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0)) AS n FROM d WHERE k < {_P}))
  SELECT feed, CAST(k AS INTEGER) AS lag, round(pacf, 8) AS pacf FROM d""")
def partial_autocorrelations(spark, d):
    return stats.partial_autocorrelations(adapt.candles(spark, d), "close", _P).withColumn("pacf", F.round("pacf", 8))


@query()
def unit_root_variants(spark, d):
    return stats.unit_root_variants(adapt.candles(spark, d), "close")


@query("""WITH p AS (SELECT event_id, event_id // 1000 AS page, CASE WHEN event_id // 1000 % 2 = 0 THEN -(epoch_us(ts) // 1000) ELSE epoch_us(ts) // 1000 - event_id * 7919 % 1009 * 1000000 END AS timestamp FROM events),
  e AS (SELECT page, arg_min(timestamp, event_id) AS a, arg_max(timestamp, event_id) AS b FROM p GROUP BY page)
  SELECT event_id, timestamp FROM p JOIN e USING (page) WHERE a <= b OR timestamp >= a""")
def newest_first_page(spark, d):
    """All events in answers of 1,000: every other one comes with the newest first, the rest in no order."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    number = F.floor(F.col("event_id") / 1000)
    mixed = F.when(number % 2 == 0, -t).otherwise(t - F.col("event_id") * 7919 % 1009 * 1_000_000)
    pages = adapt.table(spark, d, "events").select("event_id", number.alias("page"), mixed.alias("timestamp"))
    return graph.newest_first_cut(pages, "event_id", "page").select("event_id", "timestamp")


@query(f"""WITH {PREDICTIONS_SQL}, s AS (SELECT DISTINCT contract, slot FROM predictions WHERE payout IS NULL), n AS (SELECT *, (row_number() OVER (PARTITION BY contract ORDER BY slot) - 1) // 3 AS batch FROM s)
  SELECT contract, batch, CAST(list(slot ORDER BY slot) AS VARCHAR) AS slots FROM n GROUP BY contract, batch""")
def true_value_batches(spark, d):
    found = graph.true_value_batches(adapt.predictions(spark, d).where("payout is null"), 3)
    return found.select("contract", "batch", F.concat(F.lit("["), F.array_join(F.col("slots").cast("array<string>"), ", "), F.lit("]")).alias("slots"))


def _rare(spark, d):
    return adapt.candles(spark, d).withColumn("rare", (F.col("timestamp") / 3_600_000 % 7 == 0).cast("int"))


@query()
def synthetic_oversample(spark, d):
    return models.synthetic_oversample(_rare(spark, d), ["open", "close"], "rare", "feed")


_STEPS = ", ".join(map(str, ensembles.poisson_steps()))
#: Every candle beside the ten models that count it, by MD5 of its time and the model's number.
_COUNTED = f"""c AS (SELECT feed, open, volume, close, model, len(list_filter([{_STEPS}], lambda s: s <= ('0x' || substr(md5(timestamp || '-' || model), 1, 8))::BIGINT)) AS w FROM candles, (SELECT unnest(range(10)) AS model))"""


@query(f"""WITH {CANDLES_SQL}, {_COUNTED} SELECT feed, CAST(model AS INTEGER) AS model, CAST(sum(w) AS BIGINT) AS n, round(sum(w * open), 4) AS x, round(sum(w * volume), 4) AS v, round(sum(w * close), 4) AS y,
  round(sum(w * open * open), 4) AS xx, round(sum(w * open * volume), 4) AS xv, round(sum(w * volume * volume), 4) AS vv, round(sum(w * open * close), 4) AS xy, round(sum(w * volume * close), 4) AS vy FROM c WHERE w > 0 GROUP BY feed, model""")
def bootstrap_sums(spark, d):
    """Normal equations of ten models of the close from open and volume."""
    found = ensembles.normal_equations(adapt.candles(spark, d), "feed", "timestamp", ["open", "volume"], "close", 10)
    at = {"x": 1, "v": 2, "y": 3, "xx": 4, "xv": 5, "xy": 6, "vv": 7, "vy": 8}
    return found.select("feed", "model", "n", *(F.round(F.get("sums", i), 4).alias(n) for n, i in at.items()))


@query(f"""WITH {CANDLES_SQL}, {_COUNTED}, s AS (SELECT feed, model, sum(w) + 1e-6 AS n, sum(w * open) AS x, sum(w * close) AS y, sum(w * open * open) + 1e-6 AS xx, sum(w * open * close) AS xy FROM c GROUP BY feed, model),
  m AS (SELECT feed, (y * xx - x * xy) / (n * xx - x * x) AS a, (n * xy - x * y) / (n * xx - x * x) AS b FROM s)
  SELECT k.feed, k.timestamp, k.open, CAST(count(*) FILTER (a + b * open > open) AS DOUBLE) / count(*) AS prob FROM candles k JOIN m USING (feed) GROUP BY k.feed, k.timestamp, k.open""")
def bootstrap_probabilities(spark, d):
    """The share of ten models of the close from the open that see a rise."""
    candles = adapt.candles(spark, d)
    weights = ensembles.fit(candles, "feed", "timestamp", ["open"], "close", 10)
    return ensembles.prob_above(candles.select("feed", "timestamp", "open"), weights, "feed", ["open"], F.col("open"))


@query(f"""WITH {CANDLES_SQL}, s AS (SELECT feed, count(close) AS n, stddev_samp(close) * pow(count(close), -0.2) AS h, min(close) AS lo, max(close) AS hi, (max(close) - min(close)) / 2048 AS w FROM candles GROUP BY feed),
  p AS (SELECT feed, (close - lo) / w AS place, least(CAST(floor((close - lo) / w) AS BIGINT), 2047) AS k FROM candles JOIN s USING (feed)),
  g AS (SELECT feed, k, sum(m) AS m FROM (SELECT feed, k, 1 - (place - k) AS m FROM p UNION ALL SELECT feed, k + 1, place - k FROM p) GROUP BY feed, k),
  x AS (SELECT *, lo + (hi - lo) * i / 199 AS x FROM (SELECT *, unnest(range(200)) AS i FROM s))
  SELECT x.feed, CAST(i AS INTEGER) AS i, round(any_value(x), 9) AS x, round(any_value(w * w / (8 * pow(h, 3) * sqrt(2 * pi()))), 12) AS bound, round(sum(m / n * exp(-0.5 * pow((x - (lo + k * w)) / h, 2)) / (h * sqrt(2 * pi()))), 9) AS density
  FROM x JOIN g USING (feed) GROUP BY x.feed, i""")
def binned_density(spark, d):
    found = stats.binned_density(adapt.candles(spark, d), "close")
    return found.select("feed", "i", F.round("x", 9).alias("x"), F.round("bound", 12).alias("bound"), F.round("density", 9).alias("density"))


@query(f"""WITH {CANDLES_SQL}, r AS (SELECT feed, open, close, row_number() OVER () AS i FROM candles WHERE timestamp // 3600000 % 7 = 0),
  n AS (SELECT a.feed, a.open, a.close, pow(a.open - b.open, 2) + pow(a.close - b.close, 2) AS far, row_number() OVER (PARTITION BY a.i ORDER BY pow(a.open - b.open, 2) + pow(a.close - b.close, 2)) AS rank FROM r a JOIN r b ON a.feed = b.feed AND a.i <> b.i)
  SELECT feed, open, close, CAST(rank AS INTEGER) AS rank, round(far, 9) AS far FROM n WHERE rank <= 5""")
def rare_neighbours(spark, d):
    """The five nearest rows of each row of the rarer label, from which made-up rows are made."""
    _, rare = selection.rare_rows(_rare(spark, d).select("feed", "open", "close", "rare"), ["open", "close"], "rare", "feed")
    found = selection.nearest_rows(rare, "feed", 5)
    return found.select("feed", F.get("x", 0).alias("open"), F.get("x", 1).alias("close"), "rank", F.round("far", 9).alias("far"))


def _rises(spark, d):
    return adapt.candles(spark, d).select("feed", "timestamp", "open", "volume", (F.col("close") > F.col("open")).cast("int").alias("rise"))


@query()
def calibrated_rises(spark, d):
    """The probability of a rise by logistic models and their curves, each fit on folds that the other does not see."""
    rows, features = _rises(spark, d), ["open", "volume"]
    return models.probability(models.cross_calibrate(rows, features, "rise", "logistic_balanced", folds=3), rows, features).select("feed", "timestamp", "rise", "calibrated")


@query()
def rise_importances(spark, d):
    """What each feature is worth to a model of rises: shares of its coefficients, and of what accuracy loses when its values are dealt anew."""
    rows, features = _rises(spark, d), ["open", "volume"]
    model = models.fit(rows, features, "rise", "logistic")
    by, dealt = models.weights(model, features), models.permutation_weights(model, rows, features, "rise", repeats=3)
    return spark.createDataFrame([(f, float(by[f]), float(dealt[f])) for f in features], "feature string, weight double, permuted double")
