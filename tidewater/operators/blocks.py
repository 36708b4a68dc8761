"""Operators with a state over a feed's time, in parallel over blocks of time.

Each block is first summed up without what came before it. The summaries of a feed, a row or
a few for each block, are gone through in order; this gives every block the state that it
begins with, and then all blocks are worked out side by side. So the number of tasks does
not depend on the number of feeds, and only summaries pass through one task of a feed.

* Exponential averages: a block takes the average y before it to factor * y + offset.
* Threshold bars: a block takes the sum of the bar that is open before it to that of the bar
  open behind it and a number of bars. This map has a piece for each row of one bar at most,
  and mostly few, because bars that begin at different rows soon end at the same row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block on average.
BLOCK_ROWS = 50_000


def with_blocks(rows: DataFrame, by: str = "feed", time: str = "timestamp", block_rows: int | None = None) -> DataFrame:
    """Adds `block`: equal stretches of a feed's time, so many that they hold `block_rows` rows on average; and `_several`: has the feed more than one?"""
    ends = rows.groupBy(by).agg(F.min(time).alias("_first"), (F.max(time) - F.min(time) + 1).alias("_long"), F.ceil(F.count("*") / (block_rows or BLOCK_ROWS)).alias("_blocks"))
    block = F.floor((F.col(time) - F.col("_first")) * F.col("_blocks").cast("double") / F.col("_long"))
    return rows.join(ends, by).withColumn("block", block.cast("long")).withColumn("_several", F.col("_blocks") > 1).drop(*ends.columns[1:])


def in_order(df: DataFrame, by: tuple[str, ...], start: Callable[[pd.Series], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, order: str = "timestamp") -> DataFrame:
    """A function with a state over each group's rows, in order and in batches.

    `start` makes a group's function from its first row; it gets the group's rows batch by
    batch. Rows are sorted by Spark, which spills, so no group has to fit into memory.
    """
    keys = [*by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for batch in batches:
            for _, rows in batch.groupby(batch[keys].ne(batch[keys].shift()).any(axis=1).cumsum(), sort=False):
                key = tuple(rows[keys].iloc[0])
                if step is None or key != now:
                    now, step = key, start(rows.iloc[0])
                yield step(rows)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


# Exponential averages


@dataclass(frozen=True)
class Average:
    """An exponential average of a series ("close", "rise" or "fall") with factor alpha; null until `least` values are in."""

    of: str
    alpha: float
    least: int


@dataclass(frozen=True)
class Indicator:
    """What `combine` makes of the arrays of some averages; null where one of them is."""

    averages: tuple[Average, ...]
    combine: Callable[..., np.ndarray]


def _series(close: np.ndarray, before: float, of: str) -> np.ndarray:
    """A block's values; `before` is the close before it, its own first one at a feed's begin."""
    if of == "close":
        return close
    change = np.diff(close, prepend=before)
    return np.maximum(change if of == "rise" else -change, 0.0)


def _averaged(values: np.ndarray, alpha: float, before: float) -> np.ndarray:
    return pd.Series(np.r_[before, values]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def averages(rows: DataFrame, indicators: dict[str, Indicator], block_rows: int | None = None) -> DataFrame:
    """feed, timestamp, close and the indicators; rows without a close have none and are left out of the averages."""
    known = with_blocks(rows.where("close is not null").select("feed", "timestamp", "close"), block_rows=block_rows)
    used = sorted({a for i in indicators.values() for a in i.averages}, key=repr)
    ends = known.where("_several").groupBy("feed", "block").agg(F.count("*").alias("n"), F.min_by("close", "timestamp").alias("first"), F.max_by("close", "timestamp").alias("last"))

    def lasts(_: pd.Series) -> Callable[[pd.DataFrame], pd.DataFrame]:
        last, n = None, 0

        def step(blocks: pd.DataFrame) -> pd.DataFrame:
            nonlocal last, n
            first = blocks["first"].iloc[0] if last is None else last
            before = np.r_[first, blocks["last"].to_numpy()[:-1]]
            rows_before = n + np.r_[0, np.cumsum(blocks["n"].to_numpy())[:-1]]
            last, n = blocks["last"].iloc[-1], n + int(blocks["n"].sum())
            return pd.DataFrame({"feed": blocks["feed"], "block": blocks["block"], "before": before, "rows_before": rows_before})

        return step

    begins = in_order(ends, ("feed",), lasts, "feed string, block long, before double, rows_before long", "block")
    placed = known.join(begins, ["feed", "block"], "left").withColumn("rows_before", F.coalesce("rows_before", F.lit(0).cast("long")))  # one block of a feed needs nothing from others

    def offsets(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("timestamp")
        close, before = group["close"].to_numpy(), group["before"].iloc[0]
        out = []
        for a in used:
            values = _series(close, before, a.of)
            start = values[0] if group["rows_before"].iloc[0] == 0 else 0.0  # an average begins with its first value
            out.append(_averaged(values, a.alpha, start)[-1])
        return pd.DataFrame({"feed": [group["feed"].iloc[0]], "block": [group["block"].iloc[0]], "n": [len(group)], "offsets": [out]})

    summed = placed.where("_several").groupBy("feed", "block").applyInPandas(offsets, "feed string, block long, n long, offsets array<double>")

    def carry(_: pd.Series) -> Callable[[pd.DataFrame], pd.DataFrame]:
        now = np.zeros(len(used))
        kept = np.array([1 - a.alpha for a in used])

        def step(blocks: pd.DataFrame) -> pd.DataFrame:
            nonlocal now
            out = []
            for n, offset in zip(blocks["n"], blocks["offsets"], strict=True):
                out.append(now.tolist())
                now = kept**n * now + np.asarray(offset)
            return pd.DataFrame({"feed": blocks["feed"], "block": blocks["block"], "carry": out})

        return step

    carried = in_order(summed, ("feed",), carry, "feed string, block long, carry array<double>", "block")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("timestamp")
        close, rows_before, carry = group["close"].to_numpy(), int(group["rows_before"].iloc[0]), group["carry"].iloc[0]
        before = group["before"].iloc[0] if rows_before else close[0]
        count = rows_before + np.arange(1, len(group) + 1)
        found = {}
        for a, now in zip(used, [0.0] * len(used) if carry is None else carry, strict=True):
            values = _series(close, before, a.of)
            found[a] = np.where(count >= a.least, _averaged(values, a.alpha, values[0] if rows_before == 0 else now), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            return group[["feed", "timestamp", "close"]].assign(**{n: i.combine(*(found[a] for a in i.averages)) for n, i in indicators.items()})

    names = ", ".join(f"{n} double" for n in indicators)
    done = placed.join(carried, ["feed", "block"], "left").groupBy("feed", "block").applyInPandas(work, f"feed string, timestamp long, close double, {names}")
    done = done.select("feed", "timestamp", "close", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in indicators))
    return done.unionByName(rows.where("close is null").select("feed", "timestamp", "close"), allowMissingColumns=True)


# Threshold bars


def _next_starts(sums: np.ndarray, threshold: float) -> np.ndarray:
    """Behind the row with which a bar that begins at each row ends; more than len(sums) where it does not end. `sums` are running sums."""
    before = np.r_[0.0, sums[:-1]]
    at = np.searchsorted(sums, before + threshold, "left")
    return np.where(at < len(sums), at + 1, len(sums) + 1)


def block_map(values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block makes of the sum of an open bar: least running sums of pieces, open sums behind the block, bars that end.

    A bar that lacks x ends in the first piece whose running sum reaches x.
    """
    sums = np.cumsum(values)
    n, total = len(values), sums[-1]
    after = _next_starts(sums, threshold)
    bars, rest = np.zeros(n + 1, np.int64), np.zeros(n + 1)
    for i in range(n - 1, -1, -1):
        if after[i] <= n:
            bars[i], rest[i] = bars[after[i]] + 1, rest[after[i]]
        else:
            rest[i] = total - (sums[i - 1] if i else 0.0)
    reached = min(int(np.searchsorted(sums, threshold, "left")) + 1, n)  # an open bar ends here at the latest
    ended, open_sum = bars[1 : reached + 1] + 1, rest[1 : reached + 1]  # a bar that ends with row j, then those that begin behind it
    last = np.flatnonzero(np.r_[(ended[1:] != ended[:-1]) | (open_sum[1:] != open_sum[:-1]), True])  # the last row of each piece
    return sums[last], open_sum[last], ended[last]


def number_rows(values: np.ndarray, threshold: float, bar: int, so_far: float) -> tuple[np.ndarray, np.ndarray]:
    """The bar of each row of a block, and the bar's sum up to and with the row, from the bar that is open before it."""
    sums = np.cumsum(values)
    after = _next_starts(sums, threshold)
    n = len(values)
    bars, found = np.empty(n, np.int64), np.empty(n)
    i, lacks = 0, threshold - so_far
    end = int(np.searchsorted(sums, lacks, "left"))
    to = min(end + 1, n)
    bars[:to], found[:to] = bar, so_far + sums[:to]
    if end < n:
        found[end] = max(found[end], threshold)  # it ends here, whatever rounding says
    i = end + 1
    while i < n:
        bar += 1
        to = min(int(after[i]), n)
        bars[i:to], found[i:to] = bar, sums[i:to] - sums[i - 1]
        if after[i] <= n:
            found[to - 1] = max(found[to - 1], threshold)
        i = to
    return bars, found


def bar_numbers(rows: DataFrame, value: str, threshold: float, block_rows: int | None = None) -> DataFrame:
    """Adds `bar` and `so_far` to rows with feed and timestamp; values are not negative.

    Sums run from the begin of each block, so they are exact where values are whole numbers,
    and else differ from sums from a bar's begin by rounding.
    """
    placed = with_blocks(rows.withColumn("_value", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), block_rows=block_rows)
    schema = "feed string, block long, total double, pieces array<double>, opens array<double>, bars array<long>"

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("timestamp")["_value"].to_numpy()
        pieces, opens, bars = block_map(values, threshold)
        return pd.DataFrame({"feed": [group["feed"].iloc[0]], "block": [group["block"].iloc[0]], "total": [np.cumsum(values)[-1]], "pieces": [pieces], "opens": [opens], "bars": [bars]})

    def chain(_: pd.Series) -> Callable[[pd.DataFrame], pd.DataFrame]:
        bar, so_far = 0, 0.0

        def step(blocks: pd.DataFrame) -> pd.DataFrame:
            nonlocal bar, so_far
            out = []
            for total, pieces, opens, bars in zip(blocks["total"], blocks["pieces"], blocks["opens"], blocks["bars"], strict=True):
                out.append((bar, so_far))
                at = int(np.searchsorted(pieces, threshold - so_far, "left"))
                if at < len(pieces):
                    bar, so_far = bar + int(bars[at]), float(opens[at])
                else:
                    so_far += float(total)
            return pd.DataFrame({"feed": blocks["feed"], "block": blocks["block"], "_bar": [b for b, _ in out], "_open": [s for _, s in out]})

        return step

    names = [*rows.columns]
    begins = in_order(placed.where("_several").select("feed", "block", "timestamp", "_value").groupBy("feed", "block").applyInPandas(sum_up, schema), ("feed",), chain, "feed string, block long, _bar long, _open double", "block")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("timestamp")
        bars, sums = number_rows(group["_value"].to_numpy(), threshold, int(group["_bar"].iloc[0]), float(group["_open"].iloc[0]))
        return group[names].assign(bar=bars, so_far=sums)

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    begun = placed.join(begins, ["feed", "block"], "left").withColumns({"_bar": F.coalesce("_bar", F.lit(0).cast("long")), "_open": F.coalesce("_open", F.lit(0.0))})
    return begun.groupBy("feed", "block").applyInPandas(work, f"{kinds}, bar long, so_far double")
