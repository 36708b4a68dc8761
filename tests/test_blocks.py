"""Averages and bars over blocks of time against the same row by row."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import blocks, sequential


def frame(spark, feeds):
    rows = [(f, i * 1000 + (i * i) % 700, float(v[0]), float(v[1])) for f, values in feeds.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "feed string, timestamp long, close double, volume double")
    return df.select("feed", "timestamp", F.col("close").alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), "close", "volume")


def some_feeds():
    rng = np.random.default_rng(7)
    walk = lambda n: np.c_[100 + rng.normal(size=n).cumsum(), rng.integers(0, 9, n)]
    return {"long": walk(700), "short": walk(3), "one": walk(1), "even": np.c_[np.full(200, 5.0), np.full(200, 3)], "none": np.c_[np.full(60, 2.0), np.zeros(60)]}


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_averages_of_many_blocks_equal_one_series(spark, size):
    feeds = some_feeds()
    got = blocks.averages(frame(spark, feeds), sequential.INDICATORS, block_rows=size).orderBy("feed", "timestamp").collect()
    for feed, values in feeds.items():
        macd, rsi = sequential.Macd(), sequential.Rsi()
        own = [r for r in got if r.feed == feed]
        assert [r.macd for r in own] == pytest.approx([macd(c) for c in values[:, 0]], abs=1e-9)
        assert [r.rsi for r in own] == pytest.approx([rsi(c) for c in values[:, 0]], abs=1e-7)


def test_rows_without_a_close_are_left_out_of_averages(spark):
    df = frame(spark, {"f": [(float(i), 1) for i in range(40)]})
    gap = df.withColumn("close", F.when(F.col("timestamp") % 5000 > 900, F.col("close")))
    got = {r.timestamp: r.rsi for r in sequential.indicators(gap).collect()}
    rsi = sequential.Rsi()
    want = {r.timestamp: None if r.close is None else rsi(r.close) for r in gap.orderBy("timestamp").collect()}
    assert got == want and len(got) == 40


def test_an_indicator_of_ones_own(spark, monkeypatch):
    monkeypatch.setitem(sequential.INDICATORS, "half", blocks.Indicator((blocks.Average("close", 0.5, 2),), lambda x: 2 * x))
    got = sequential.indicators(frame(spark, {"f": [(c, 1) for c in (1.0, 3.0, 2.0)]}), ("half",)).orderBy("timestamp").collect()
    assert [r.half for r in got] == [None, 4.0, 4.0]


def by_rows(values, threshold):
    bars, sums = sequential.BarNumbers(threshold)(values)
    return bars, sums


@pytest.mark.parametrize("size", [5, 50, 10_000])
def test_bars_of_many_blocks_equal_one_series(spark, size):
    feeds = some_feeds()
    rows = frame(spark, feeds)
    for threshold in (1, 10, 47, 5000):
        got = blocks.bar_numbers(rows, "volume", threshold, block_rows=size).orderBy("feed", "timestamp").collect()
        for feed, values in feeds.items():
            own = [r for r in got if r.feed == feed]
            bars, sums = by_rows(values[:, 1].tolist(), threshold)
            assert [r.bar for r in own] == bars
            assert [r.so_far for r in own] == sums


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 15), st.lists(st.integers(1, 59), max_size=5))
@settings(max_examples=200, deadline=None)
def test_blocks_compose(values, threshold, cuts):
    ends = sorted({c for c in cuts if c < len(values)} | {len(values)})
    bar, so_far, bars, sums = 0, 0.0, [], []
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        own = np.array(values[a:b], float)
        numbered = blocks.number_rows(own, threshold, bar, so_far)
        bars += numbered[0].tolist()
        sums += numbered[1].tolist()
        pieces, opens, ended = blocks.block_map(own, threshold)
        at = int(np.searchsorted(pieces, threshold - so_far, "left"))
        bar, so_far = (bar + int(ended[at]), float(opens[at])) if at < len(pieces) else (bar, so_far + own.sum())
    assert (bars, sums) == by_rows([float(v) for v in values], threshold)


def test_the_map_of_a_long_block_has_few_pieces():
    rng = np.random.default_rng(1)
    pieces, _, _ = blocks.block_map(rng.random(20_000), 50.0)
    assert len(pieces) < 20
    pieces, _, _ = blocks.block_map(np.ones(20_000), 50.0)
    assert len(pieces) == 50  # bars that never meet


def test_tasks_do_not_depend_on_the_number_of_feeds(spark):
    df = frame(spark, {"only": [(float(i % 50), i % 4) for i in range(2000)]})
    placed = blocks.with_blocks(df, block_rows=100)
    assert 18 <= placed.select("block").distinct().count() <= 22
    assert placed.groupBy("block").count().agg(F.max("count")).first()[0] < 130
