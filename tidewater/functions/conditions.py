"""Filters, orders and pages that a table view asks for."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(kind: str, column: str, value) -> Column:
    """filter: value in a list; range: between two ends, either may be None; search: text in any case."""
    c = F.col(column.removeprefix("p_"))
    if kind == "filter":
        return c.isin(list(value))
    if kind == "range":
        low, high = value
        return (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
    if kind == "search":
        return contains(c, value)
    raise ValueError(f"no such condition: {kind}")


def contains(c: Column, text: str) -> Column:
    return c.rlike(f"(?i){re.escape(text)}")


def check(df: DataFrame, conditions: list[tuple]) -> DataFrame:
    """Rows that meet all conditions (kind, column, value)."""
    return df.where(reduce(Column.__and__, (condition(*c) for c in conditions), F.lit(True)))


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns."""
    return df.where(reduce(Column.__or__, (contains(F.col(c), text) for c in columns))) if text else df


def pinned(df: DataFrame, key: str, chosen: list, conditions: list[tuple]) -> DataFrame:
    """Chosen rows first whatever they hold, then those that meet the conditions; `pinned` tells them apart."""
    first = df.where(F.col(key).isin(chosen)).withColumn("pinned", F.lit(True))
    rest = check(df.where(~F.col(key).isin(chosen)), conditions).withColumn("pinned", F.lit(False))
    return first.unionByName(rest)


def page(df: DataFrame, by: str, tie: str, descending: bool, first: int, skip: int = 0) -> DataFrame:
    """A page of rows in one direction for both keys, nulls last."""
    way = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    return df.orderBy(way(by), way(tie)).offset(skip).limit(first)


def top_with_rest(df: DataFrame, name: str, weight: str, n: int) -> DataFrame:
    """The n largest names, each of one row, and one row `rest` for all others."""
    top = df.select(name, weight).orderBy(F.desc(weight), name).limit(n)  # n rows of each task, then n of these
    others = df.join(F.broadcast(top.select(F.col(name).alias("_top"))), F.col(name).eqNullSafe(F.col("_top")), "left_anti")
    rest = others.agg(F.count("*").alias("_n"), F.sum(weight).alias(weight)).where("_n > 0")
    return top.unionByName(rest.select(F.lit("rest").alias(name), weight))


def ends(df: DataFrame, order: str) -> DataFrame:
    """The first and the last row by a column."""
    return df.orderBy(order).limit(1).unionAll(df.orderBy(F.desc(order)).limit(1))


def in_combinations(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose source, pair and timeframe are wanted; a combination without timeframe takes any."""
    keys = wanted.select("source", "pair", F.col("timeframe").alias("_timeframe"))
    same = (df["source"] == keys["source"]) & (df["pair"] == keys["pair"]) & (keys["_timeframe"].isNull() | (df["timeframe"] == keys["_timeframe"]))
    return df.join(keys, same, "left_semi")
