"""Column functions for labels, amounts and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of amounts, and lengths of candle intervals in seconds.
SUFFIXES = (("", 1e0), ("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12))
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}


def title(c: Column) -> Column:
    return F.initcap(c)


def pair_side(pair: Column, side: int) -> Column:
    """1: base, 2: quote of `base/quote`."""
    return F.split_part(pair, F.lit("/"), F.lit(side))


def short_address(c: Column) -> Column:
    """First and last five characters; short ones whole; a note where there is none."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "No address").when(F.length(c) > 10, F.concat(F.substring(c, 1, 5), F.lit("..."), F.right(c, F.lit(5)))).otherwise(c)


def percent(c: Column) -> Column:
    return F.concat(F.round(c, 2).cast("string"), F.lit("%"))


def short_number(c: Column, digits: int = 2, largest: str = "T") -> Column:
    """1234567 -> 1.23M, by the largest suffix up to `largest` that leaves at least one; trailing zeros go."""
    trim = lambda x: F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    size = F.abs(c)
    out = trim(c.cast("double"))
    for suffix, unit in SUFFIXES[1 : [x for x, _ in SUFFIXES].index(largest) + 1]:
        out = F.when(size >= unit, F.concat(trim(c / unit), F.lit(suffix))).otherwise(out)
    return F.when(c.isNotNull(), F.when(out == "-0", "0").otherwise(out))


def parse_number(c: Column) -> Column:
    """`1.5K` -> 1500; null where the text is no number with a known suffix."""
    found = F.regexp_extract(F.trim(c), r"^(-?\d+(?:\.\d+)?)([A-Za-z]?)$", 1)
    suffix = F.upper(F.regexp_extract(F.trim(c), r"^(-?\d+(?:\.\d+)?)([A-Za-z]?)$", 2))
    unit = reduce(lambda w, s: w.when(suffix == s[0], s[1]), SUFFIXES[1:], F.when(suffix == "", 1.0))
    return F.when(found != "", found.try_cast("double") * unit)


def sales_text(total: Column, bought: Column, web: Column) -> Column:
    """`107 (105 DF, 2 WS)`, parts of zero left out."""
    parts = F.concat_ws(", ", F.when(bought > 0, F.concat(bought.cast("string"), F.lit(" DF"))), F.when(web > 0, F.concat(web.cast("string"), F.lit(" WS"))))
    return F.when(parts == "", total.cast("string")).otherwise(F.concat(total.cast("string"), F.lit(" ("), parts, F.lit(")")))


def significant(c: Column, digits: int) -> Column:
    """Rounded to so many significant digits; zero stays zero."""
    power = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(F.nullif(c, F.lit(0.0))))))
    return F.when(c == 0, 0.0).otherwise(F.rint(c * power) / power)


def clip_low(c: Column, low: float = 0.0) -> Column:
    """Like greatest(), but null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def timeframe_seconds(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in TIMEFRAMES.items() for x in kv)), c)


def minute_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "dd-MM-yyyy HH:mm")


def day_text(s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd")


def parse_time(c: Column) -> Column:
    """Milliseconds of `2024-01-31`, with `_HH:mm`, `_HH:mm:ss`, `_HH:mm:ss.SSS`, or ISO with Z; else null."""
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'_'HH:mm", "yyyy-MM-dd'_'HH:mm:ss", "yyyy-MM-dd'_'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return F.unix_millis(F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in forms)))


def to_wei(c: Column) -> Column:
    return (c.cast("decimal(38,18)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")


def from_wei(c: Column) -> Column:
    return c.cast("double") / 1e18


def pad_bytes32(c: Column) -> Column:
    return F.rpad(c, 32, "\0")


def decode_hex(c: Column) -> Column:
    """Text of `0x...`."""
    return F.decode(F.unhex(F.regexp_replace(c, "^0x", "")), "UTF-8")


def confidence(nominator: Column, denominator: Column) -> Column:
    """nominator / denominator, zero for an empty denominator."""
    return F.coalesce(F.try_divide(nominator.cast("double"), denominator.cast("double")), F.lit(0.0))


def expand_feeds(df: DataFrame, c: str) -> DataFrame:
    """`exchange pair,pair signals timeframe,timeframe` -> one row per exchange, pair, signal letter and timeframe.

    Signal letters are o, h, l, c, v; pairs may be written with / or -.
    """
    words = F.split(F.trim(F.col(c)), r"\s+")
    one = df.select("*", F.element_at(words, 1).alias("exchange"), F.explode(F.split(F.element_at(words, 2), ",")).alias("pair"), words.alias("_w"))
    two = one.select("*", F.explode(F.filter(F.split(F.element_at("_w", 3), ""), lambda s: s != "")).alias("signal"))
    return two.select("*", F.explode(F.split(F.element_at("_w", 4), ",")).alias("timeframe")).drop("_w").withColumn("pair", F.upper(F.replace("pair", F.lit("-"), F.lit("/"))))


def pack_feeds(df: DataFrame) -> DataFrame:
    """The reverse of expand_feeds(): exchange, timeframe, signals and pairs in one text."""
    signals = df.groupBy("exchange", "pair", "timeframe").agg(F.array_join(F.array_sort(F.collect_set("signal")), "").alias("signals"))
    packed = signals.groupBy("exchange", "signals", "timeframe").agg(F.array_join(F.array_sort(F.collect_set("pair")), ",").alias("pairs"))
    return packed.select(F.concat_ws(" ", "exchange", "pairs", "signals", "timeframe").alias("feeds"))


def compact_small(c: Column, digits: int = 2) -> Column:
    """Amounts below a hundredth in powers of ten, others with fixed digits."""
    return F.when((c != 0) & (F.abs(c) < 0.01), F.format_string(f"%.{digits}e", c.cast("double"))).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def shift_label(name: Column, lag: int) -> Column:
    """`close` -> `close(t-2)`."""
    return F.concat(name, F.lit(f"(t-{lag})"))


def digit_runs(c: Column) -> Column:
    """All runs of digits in a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))


def range_label(start_s: Column, end_s: Column) -> Column:
    """How long a time range is and when it ends, in words."""
    days = F.floor((end_s - start_s) / 86_400)
    return F.concat(F.when(days == 1, "1 day").otherwise(F.concat(days.cast("string"), F.lit(" days"))), F.lit(" until "), day_text(end_s))


def period_start(c: Column, length: int) -> Column:
    """The start of the period of `length` that a time lies in."""
    return (F.floor(c / length) * length).cast("long")


def fee_in_tokens(gas: Column, price_of_gas: Column, tokens: Column) -> Column:
    """What a transaction costs, in a token of which so many are worth one coin of the chain."""
    return gas * price_of_gas * tokens
