"""Literal tables for operators that SQL does not cover, and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import conditions, text
from tidewater.operators import accuracy, backtest, checks, curves, kpis, sequential, series, stats


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


def candle_frame(spark, closes, volumes=None, feed="a"):
    data = [(feed, 300_000 * i, float(c), c + 1.0, c - 1.0, float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volumes or [1] * len(closes)))]
    return spark.createDataFrame(data, "feed string, timestamp long, open double, high double, low double, close double, volume double")


def test_volume_bars_reset_and_drop_the_open_rest(spark):
    df = candle_frame(spark, [1, 2, 3, 4, 5], [1000, 1500, 2000, 2500, 3000])
    got = rows(sequential.threshold_bars(df, "volume", 4000), "bar", "volume", "n", "timestamp", "closed_at")
    assert got == [(0, 4500.0, 3, 0, 600_000), (1, 5500.0, 2, 900_000, 1_200_000)]
    assert rows(sequential.threshold_bars(df, "tick", 3), "bar", "n", "close") == [(0, 3, 3.0)]
    assert sequential.threshold_bars(df, "dollar", 1e9).count() == 0
    with pytest.raises(ValueError):
        sequential.threshold_bars(df, "other", 1)


def test_bar_numbers_against_a_loop():
    rng = random.Random(1)
    for _ in range(20):
        values = [rng.random() for _ in range(50)]
        assert sequential.BarNumbers(100.0)(values)[0] == [0] * 50
        number = sequential.BarNumbers(2.0)
        got = number(values[:20])[0] + number(values[20:])[0]  # in batches
        for b in set(got) - {got[-1]}:
            part = [v for v, x in zip(values, got) if x == b]
            assert sum(part) >= 2.0 > sum(part[:-1])


def each(f, values):
    return [f(v) for v in values]


def test_indicators_are_null_before_their_windows():
    assert each(sequential.Macd(), [1.0] * 5) == [None] * 5
    assert each(sequential.Rsi(14), [1.0, 2.0]) == [None, None]
    assert each(sequential.Rsi(14), [float(i) for i in range(20)])[-1] == 100.0
    closes = [1.0, 3.0, 2.0, 4.0]
    assert each(sequential.Ema(0.5, 2), closes) == [None, 2.0, 2.0, 3.0]


def test_trader_exits_before_it_enters_again():
    t = sequential.Trader(usd=100, fee=0.0, take=0.1, stop=0.1)
    assert t.step(0.75, 10, 10, 10) == 0 and t.side == 1 and t.size == pytest.approx(15)
    assert t.step(0.25, 10.5, 11.5, 10) == pytest.approx(15) and t.side == 0  # taken at 11
    assert t.step(0.25, 10, 10, 10) == 0 and t.side == -1
    assert t.step(0.25, 10.5, 11.2, 9.5) == pytest.approx(-15) and t.side == 0  # stopped at 11
    t.step(0.6, 10, 10, 10)
    assert t.step(0.4, 10.2, 10.3, 9.9) == pytest.approx(12 * 0.2)  # no longer up: out at the close
    t = sequential.Trader(usd=100, fee=0.1)
    t.step(1.0, 10, 10, 10)
    assert t.size == pytest.approx(18) and t.step(0.0, 10, 10, 10) == pytest.approx(18 * 0.9 * 10 - 200)


def test_greedy_batches(spark):
    df = spark.createDataFrame([("g", "a", 5), ("g", "b", 9), ("g", "c", 1), ("g", "d", 1), ("g", "e", 1)], "g string, address string, times int")
    got = rows(sequential.greedy_batches(df, "g", 10, 3), "address", "batch", "times")
    assert got == [("a", 0, 5), ("b", 0, 5), ("b", 1, 4), ("c", 1, 1), ("d", 1, 1), ("e", 2, 1)]


def test_interpolation_inside_and_at_the_ends(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, math.nan, 4.0, None])] + [("b", 0, None)], "feed string, timestamp long, x double")
    got = rows(series.interpolate(df, "x"), "feed", "timestamp", "x")
    assert got == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 4.0), ("a", 5, 4.0), ("b", 0, None)]


def test_settled_rows_carry_their_own_time(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 5.0), ("a", 2, None), ("b", 0, None)], "feed string, timestamp long, close double")
    assert rows(series.settle_nulls(df, "close", ("timestamp", "close"))) == [("a", 0, 1, 5.0), ("a", 1, 1, 5.0), ("a", 2, 1, 5.0)]


def test_lag_matrix_and_blocks(spark):
    df = candle_frame(spark, [1, 2, 4, 8, 16, 32])
    got = series.lag_matrix(df, "close", 2, 1, 1).orderBy("timestamp").collect()
    assert [(r.y, r.lag_2, r.lag_1) for r in got] == [(8.0, 2.0, 4.0), (16.0, 4.0, 8.0)]
    assert [r.y for r in series.lag_matrix(df, "close", 1, 9, 0, relative=True).collect()] == [1.0] * 5
    assert [r.block for r in series.time_blocks(df, "close", 3).orderBy("timestamp").collect()] == [[4.0, 2.0, 1.0], [8.0, 4.0, 2.0], [16.0, 8.0, 4.0]]


def test_merge_gives_null_columns_for_missing_feeds(spark):
    df = candle_frame(spark, [1, 2]).union(candle_frame(spark, [7], feed="b"))
    out = series.merge_feeds(df, ["a", "b", "c"], ("close",))
    assert out.columns == ["timestamp", "a:close", "b:close", "c:close"]
    assert rows(out) == [(0, 1.0, 7.0, None), (300_000, 2.0, None, None)]


def test_true_values_need_the_next_candle(spark):
    df = candle_frame(spark, [1, 2, 2, 1]).where("timestamp <> 900000").union(spark.createDataFrame([("a", 1_500_000, 0.0, 0.0, 0.0, 9.0, 0.0)], candle_frame(spark, [1]).schema))
    assert rows(series.true_values(df, 300_000), "timestamp", "truevalue", "cancel") == [(300_000, True, False), (600_000, False, True)]


def test_running_curves(spark):
    df = spark.createDataFrame([("u", "c", i, 0, 1.0, p) for i, p in enumerate([2.0, 0.0, None, 3.0])], "user string, contract string, slot long, seq long, stake double, payout double")
    got = curves.running_curves(df).orderBy("slot").collect()
    assert [(r.n, r.n_correct, r.profit) for r in got] == [(1, 1, 1.0), (2, 1, 0.0), (3, 1, -1.0), (4, 2, 1.0)]
    assert got[0].low == got[0].high == 100.0 and got[3].low == pytest.approx(100 * (0.5 - 1.959963984540054 * 0.25))


def test_slot_figures_use_sums_of_running_counts(spark):
    df = spark.createDataFrame([("c", s, q, 1.0, p) for s, q, p in [(1, 0, 2.0), (1, 1, 0.0), (2, 0, 2.0)]], "contract string, slot long, seq long, stake double, payout double")
    got = curves.slot_figures(df, "contract").orderBy("slot").collect()
    assert [r.accuracy for r in got] == [pytest.approx(100 * 2 / 3), pytest.approx(100 * 2 / 3)]
    assert [r.cum_profit for r in got] == [0.0, 1.0]


def test_slot_accuracy_edges(spark):
    end = 10 * accuracy.DAY
    cut = end - accuracy.DAY
    data = [("c", cut, True, 5.0, 3.0, "Paying"), ("c", cut + 1, False, 4.0, 0.0, "Paying"), ("c", cut - 1, True, 2.0, 1.0, "Paying"), ("c", cut - 2, True, 8.0, 8.0, "Canceled"), ("c", cut - 3, None, 1.0, 1.0, "Paying"), ("z", cut, True, 0.0, 0.0, "Paying")]
    df = spark.createDataFrame(data, "contract string, slot long, truevalue boolean, roundSumStakes double, roundSumStakesUp double, status string")
    assert rows(accuracy.accuracy(accuracy.slot_contributions(df, end))) == [("c", 11.0, 4.0, 2, 3, pytest.approx(200 / 3))]


def test_traction_counts_users_once(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 2), ("d", 3), ("a", 3)], "u string, d int")
    assert rows(kpis.traction(df, "u", F.col("d")), "day", "active_users", "new_users", "cum_users") == [(1, 2, 2, 2), (2, 2, 1, 3), (3, 2, 1, 4)]


def test_kpis_of_nothing(spark):
    empty = spark.createDataFrame([], "ID string, contract string, user string, slot long, timestamp long, stake double, payout double")
    assert kpis.user_payout_stats(empty).count() == 0
    one = kpis.users_metrics(empty, 0.1).first()
    assert one.users == 0 and one.accuracy is None


def test_checks(spark):
    df = spark.createDataFrame([("x", 5, "p", "5m", 300), ("x", 5, "p", "5m", 300), ("y", 6, "p", "5m", 600), ("z", 9, "p", "5m", 1500)], "ID string, timestamp long, pair string, timeframe string, slot long")
    assert rows(checks.duplicates(df)) == [("x", 5, 2)]
    assert rows(checks.gaps(df), "timedelta", "pct") == [(300, 50.0), (900, 50.0)]
    assert checks.gap_alerts(df, [300]).count() == 1 and checks.gap_alerts(df, [300], 50.0).count() == 0
    pay = spark.createDataFrame([("x", 5), ("q", 7), ("q", 99)], "ID string, timestamp long")
    assert rows(checks.unmatched(pay, df)) == [("q", 7)]
    df.createOrReplaceTempView("left_over")
    assert "left_over" in checks.leftover_views(spark) and checks.missing_tables(spark, ["nope", "left_over"]) == ["nope"]
    spark.catalog.dropTempView("left_over")


def test_autocorrelation_and_partial():
    acf = [1.0, 0.5, 0.25, 0.125]
    assert stats.partial_autocorrelation(acf) == pytest.approx([1.0, 0.5, 0.0, 0.0])


def test_box_cox_finds_the_log(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", float(x)) for x in np.exp(rng.normal(size=2000))] + [("b", float(x)) for x in rng.normal(size=500)], "feed string, x double")
    log = df.where("feed = 'a'")
    assert abs(stats.box_cox_lambdas(log, "x").first()["lambda"]) < 0.06
    both = {r.feed: r.s for r in stats.box_cox(df, "x").groupBy("feed").agg(F.skewness("boxcox").alias("s")).collect()}
    assert abs(both["a"]) < log.select(F.skewness("x")).first()[0] / 3 and abs(both["b"]) < 0.3  # each feed has its own curve


def test_unit_root_with_lagged_differences(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(2, 600))
    walk, ar = np.cumsum(noise[0]), np.zeros(600)
    for i in range(2, 600):
        ar[i] = 1.2 * ar[i - 1] - 0.5 * ar[i - 2] + noise[1][i]
    df = spark.createDataFrame([(f, i, float(v)) for f, s in (("walk", walk), ("ar", ar)) for i, v in enumerate(s)], "feed string, timestamp long, y double")
    got = {r.feed: r for r in stats.augmented_dickey_fuller(df, "y", 4).collect()}
    assert got["ar"].stationary and not got["walk"].stationary and got["ar"].lags >= 1
    y = ar - ar.mean()
    d = np.diff(y)
    k = got["ar"].lags
    x = np.column_stack([np.ones(len(d) - 4), y[4:-1], *(d[4 - i : len(d) - i] for i in range(1, k + 1))])
    w, rss, *_ = np.linalg.lstsq(x, d[4:], rcond=None)
    t = w[1] / np.sqrt(rss[0] / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert got["ar"].t == pytest.approx(t, rel=1e-6) and got["ar"].n == len(x)


def test_seasonal_splits_exactly(spark):
    df = candle_frame(spark, [10 + i + (3 if i % 4 == 0 else -1) for i in range(40)])
    got = stats.seasonal(df, "close", 4).where("trend is not null").collect()
    assert len(got) == 36 and all(abs(r.rest) < 1e-9 for r in got)
    assert {round(r.season, 9) for r in got} == {3.0, -1.0}


def test_text_functions(spark):
    df = spark.createDataFrame([("0x12345abcdef", 1234567.0, "1.5K", "2024-01-31_10:05", 0.00123456), ("", 12.0, "abc", "nope", -98765.0), (None, None, None, None, 0.0)], "a string, n double, p string, t string, s double")
    got = df.select(text.short_address(F.col("a")), text.short_number(F.col("n")), text.parse_number(F.col("p")), text.parse_time(F.col("t")), text.significant(F.col("s"), 3), text.percent(F.col("n"))).collect()
    assert tuple(got[0]) == ("0x123...bcdef", "1.23M", 1500.0, 1706695500000, pytest.approx(0.00123), "1234567.0%")
    assert tuple(got[1])[:5] == ("No address", "12", None, None, pytest.approx(-98800.0))
    assert tuple(got[2])[:4] == ("No address", None, None, None)
    wei = spark.range(1).select(text.to_wei(F.lit("1.5")).cast("string"), text.from_wei(F.lit(1500000000000000000)), text.decode_hex(F.lit("0x6869")), text.timeframe_seconds(F.lit("5m"))).first()
    assert tuple(wei) == ("1500000000000000000", 1.5, "hi", 300)
    sales = spark.createDataFrame([(107, 105, 2), (3, 0, 0)], "a int, b int, c int").select(text.sales_text(*map(F.col, "abc"))).collect()
    assert [r[0] for r in sales] == ["107 (105 DF, 2 WS)", "3"]


def test_feed_grammar_round_trip(spark):
    df = spark.createDataFrame([("kraken ADA/USDT c 5m",), ("binance btc-usdt,ETH/USDT oc 5m,1h",)], "feeds string")
    one = text.expand_feeds(df, "feeds")
    assert one.count() == 9
    assert rows(text.pack_feeds(one)) == [("binance BTC/USDT,ETH/USDT co 1h",), ("binance BTC/USDT,ETH/USDT co 5m",), ("kraken ADA/USDT c 5m",)]


def test_conditions(spark):
    df = spark.createDataFrame([(1, "Ab.c"), (2, "abXc"), (3, None)], "k int, s string")
    assert rows(conditions.search(df, "b.C", ["s"])) == [(1, "Ab.c")]
    assert rows(conditions.check(df, [("range", "p_k", (2, None))])) == [(2, "abXc"), (3, None)]
    assert conditions.search(df, "", ["s"]).count() == 3
    with pytest.raises(ValueError):
        conditions.condition("other", "k", 1)


def test_backtest_pieces(spark):
    assert rows(backtest.sweep(spark, {"a": [1, 2], "b": ["x", "y"]})) == [(0, 1, "x"), (1, 2, "x"), (2, 1, "y"), (3, 2, "y")]
    steps = spark.createDataFrame([("f", i, p, u) for i, (p, u) in enumerate([(0.9, True), (0.8, False), (0.2, False)])], "feed string, timestamp long, prob_up double, up boolean")
    last = backtest.metrics(steps).orderBy("timestamp").collect()
    assert last[0].log_loss == 3.0 and last[2].accuracy == pytest.approx(2 / 3) and last[2].precision == 0.5 and last[2].recall == 1.0 and last[2].f1 == pytest.approx(2 / 3)
    df = candle_frame(spark, [float(i % 5) for i in range(60)])
    out = backtest.walk_forward(df, 5, 40, 10).collect()
    assert len(out) == 10 and all((r.prob_up > 0.5) == (r.close > r.before) for r in out)
    assert rows(backtest.recent_weights(candle_frame(spark, [1, 2, 3]), 2, 1), "close") == [(1.0,), (2.0,), (2.0,), (3.0,), (3.0,), (3.0,)]
    over = backtest.oversample(spark.createDataFrame([(i, int(i < 3)) for i in range(11)], "i int, y int"), "y")
    assert {r[0]: r[1] for r in over.groupBy("y").count().collect()} == {0: 8, 1: 8}
    assert backtest.importances({"a": -3.0, "b": 1.0}) == {"a": 0.75, "b": 0.25}


def test_slot_sample_is_stable_and_bounded(spark):
    df = spark.createDataFrame([("p", "5m", f"k{i}", "d", 2, 10.0) for i in range(9)], "pair string, timeframe string, slot_key string, day string, n_users long, sum_stake double")
    assert rows(kpis.slot_daily_statistics(df)) == [("d", 10.0, 2.0, 1)]
