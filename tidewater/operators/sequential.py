"""Operators whose next step depends on state: bars, indicators, trades, greedy batches.

Bars and averages run over blocks of time in parallel. Trades run over one run after the
other, in order of time, and hold a batch of rows and a small state, however long the
series. Nothing here can be a window expression, because the state is reset by what it
holds (bars, trades) or decays without end (averages).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import blocks
from tidewater.operators.blocks import in_order

BAR = "feed string, bar long, timestamp long, open double, high double, low double, close double, volume double, dollar double, n long, closed_at long"


class BarNumbers:
    """The bar of each row: a bar ends with the row that lifts its sum to the threshold.

    The sum of a bar starts anew from zero, so what went over the threshold is lost.
    """

    def __init__(self, threshold: float):
        self.threshold, self.total, self.bar = threshold, 0.0, 0

    def __call__(self, values: Iterable[float]) -> tuple[list[int], list[float]]:
        """Bars, and their sums up to and with each row."""
        bars, sums = [], []
        for v in values:
            self.total += v
            bars.append(self.bar)
            sums.append(self.total)
            if self.total >= self.threshold:
                self.bar, self.total = self.bar + 1, 0.0
        return bars, sums


def threshold_bars(candles: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Bars of at least `threshold` volume, dollars or ticks. Sums must not fall: sizes are not negative."""
    if metric not in ("volume", "dollar", "tick"):
        raise ValueError(f"no such metric: {metric}")
    value = {"volume": F.col("volume"), "dollar": F.col("volume") * F.col("close"), "tick": F.lit(1)}[metric]
    full = int(threshold) if metric == "tick" else threshold
    rows = candles.select("feed", "timestamp", "open", "high", "low", "close", "volume").withColumn("value", value)
    return _bars(blocks.bar_numbers(rows, "value", full).drop("value"), full)


def _bars(rows: DataFrame, full: float) -> DataFrame:
    """Bars of numbered rows; the open rest of a feed, whose sum is not full, is no bar."""
    out = rows.groupBy("feed", "bar").agg(
        F.min("timestamp").alias("timestamp"), F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("close") * F.col("volume")).alias("dollar"), F.count("*").alias("n"), F.max("timestamp").alias("closed_at"), F.max("so_far").alias("so_far"),
    )
    return out.where(F.col("so_far") >= full).drop("so_far")


class Ema:
    """Exponential average with factor alpha; null until `least` values are in."""

    def __init__(self, alpha: float, least: int):
        self.alpha, self.least, self.n, self.now = alpha, least, 0, 0.0

    def __call__(self, v: float) -> float | None:
        self.n += 1
        self.now = v if self.n == 1 else self.alpha * v + (1 - self.alpha) * self.now
        return self.now if self.n >= self.least else None


class Macd:
    """A fast less a slow average of closes."""

    def __init__(self, fast: int = 12, slow: int = 26):
        self.fast, self.slow = Ema(2 / (fast + 1), fast), Ema(2 / (slow + 1), slow)

    def __call__(self, close: float) -> float | None:
        a, b = self.fast(close), self.slow(close)
        return None if a is None or b is None else a - b


class Rsi:
    """Averages of rises and falls against each other, from 0 to 100; 100 where nothing fell."""

    def __init__(self, window: int = 14):
        self.up, self.down, self.last = Ema(1 / window, window), Ema(1 / window, window), None

    def __call__(self, close: float) -> float | None:
        change, self.last = 0.0 if self.last is None else close - self.last, close
        u, d = self.up(max(change, 0.0)), self.down(max(-change, 0.0))
        return None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d)


def _strength(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))


#: Named indicators. Add to it to make one known to indicators().
INDICATORS: dict[str, blocks.Indicator] = {
    "macd": blocks.Indicator((blocks.Average("close", 2 / 13, 12), blocks.Average("close", 2 / 27, 26)), np.subtract),
    "rsi": blocks.Indicator((blocks.Average("rise", 1 / 14, 14), blocks.Average("fall", 1 / 14, 14)), _strength),
}


def indicators(candles: DataFrame, names: tuple[str, ...] = ("macd", "rsi")) -> DataFrame:
    """Averages that decay without end are carried over blocks of time."""
    return blocks.averages(candles, {n: INDICATORS[n] for n in names})


class Trader:
    """One position at a time; an exit and the next entry never share a step."""

    def __init__(self, usd: float = 1500.0, fee: float = 0.001, take: float = 0.05, stop: float = 0.02, threshold: float = 0.0):
        self.usd, self.fee, self.take, self.stop, self.threshold = usd, fee, take, stop, threshold
        self.side, self.size, self.worth, self.up, self.down = 0, 0.0, 0.0, 0.0, 0.0

    def step(self, prob_up: float, close: float, high: float, low: float) -> float:
        """The profit that this step realizes."""
        conf = 2 * (prob_up - 0.5)
        go_up, go_down = prob_up > 0.5 and conf > self.threshold, prob_up < 0.5 and -conf > self.threshold
        keep = 1 - self.fee
        if self.side == 0:
            if go_up or go_down:
                self._enter(close, abs(conf), 1 if go_up else -1)
            return 0.0
        if self.side > 0:
            price = self.up if high >= self.up else self.down if low <= self.down else None if go_up else close
            gain = None if price is None else self.size * keep * price - self.worth
        else:
            price = self.down if low <= self.down else self.up if high >= self.up else None if go_down else close
            gain = None if price is None else self.worth - self.size * price
        if gain is None:
            return 0.0
        self.side = 0
        return gain

    def _enter(self, close: float, conf: float, side: int) -> None:
        keep = 1 - self.fee
        usd = self.usd * (1 + conf)
        self.side = side
        if side > 0:
            self.size, self.worth = usd * keep / close, usd
            self.up, self.down = close * (1 + self.take), close * (1 - self.stop)
        else:
            self.size = usd / close
            self.worth = self.size * keep * close
            self.up, self.down = close * (1 + self.stop), close * (1 - self.take)


def trades(signals: DataFrame, by: tuple[str, ...] = ("feed",), **settings: float) -> DataFrame:
    """Profit of each step and so far, from timestamp, prob_up, close, high and low of each run."""

    def start(_: pd.Series) -> Callable[[pd.DataFrame], pd.DataFrame]:
        trader, total = Trader(**settings), 0.0

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal total
            profit, side, so_far = [], [], []
            for r in rows[["prob_up", "close", "high", "low"]].itertuples(index=False):
                profit.append(trader.step(*r))
                side.append(trader.side)
                total += profit[-1]
                so_far.append(total)
            return rows[[*by, "timestamp"]].assign(position=side, profit=profit, cum_profit=so_far)

        return step

    kinds = dict(signals.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", timestamp long, position long, profit double, cum_profit double"
    return in_order(signals.select(*by, "timestamp", "prob_up", "close", "high", "low"), by, start, schema)


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Adds `batch`: chunks of `size` rows in order within each `by`."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def greedy_batches(rows: DataFrame, by: str, most: int, most_rows: int = 3) -> DataFrame:
    """Splits (address, times) into batches whose times add up to at most `most`, of at most `most_rows` addresses.

    Times of one address may be split over batches; addresses are taken in their order.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, batch, room, used = [], 0, most, 0
        for r in group.sort_values("address").itertuples():
            left = int(r.times)
            while left > 0:
                if room == 0 or used == most_rows:
                    batch, room, used = batch + 1, most, 0
                n = min(left, room)
                out.append((getattr(r, by), r.address, batch, n))
                left, room, used = left - n, room - n, used + 1
        return pd.DataFrame(out, columns=[by, "address", "batch", "times"])

    return rows.select(by, "address", "times").groupBy(by).applyInPandas(run, f"{by} string, address string, batch long, times long")
