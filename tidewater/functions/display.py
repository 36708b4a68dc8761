"""Text for tables, chosen by the name of a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text



def amount(c: Column) -> Column:
    """Tables show amounts in thousands and millions; there is no larger unit."""
    return text.short_number(c, largest="M")


#: Kinds of display; add to it to make one known.
KINDS: dict[str, Callable[[Column], Column]] = {
    "address": text.short_address,
    "percent": text.percent,
    "amount": amount,
    "small_amount": text.compact_small,
}

# Which column of a table is shown how.
COLUMN_KINDS = {
    "addr": "address", "user": "address", "avg_accuracy": "percent", "accuracy": "percent", "apr": "percent", "total_profit": "amount", "volume": "amount",
    "avg_stake": "amount", "total_stake": "amount", "gross_income": "amount", "stake_loss": "amount", "tx_costs": "amount", "profit": "amount", "sales_revenue": "amount", "price": "amount",
}


def formatted(df: DataFrame, kinds: dict[str, str] = COLUMN_KINDS) -> DataFrame:
    """All columns as text: by their kind, others as they are. With sales and both counts of buyers it adds `sales_str`."""
    out = [(KINDS[kinds[c]](F.col(c)) if c in kinds else F.col(c).cast("string")).alias(c) for c in df.columns]
    if {"sales", "df_buy_count", "ws_buy_count"} <= {*df.columns}:
        part = lambda c, name: F.when(F.col(c) > 0, F.concat(amount(F.col(c)), F.lit(f" {name}")))
        both = F.concat_ws(", ", part("df_buy_count", "DF"), part("ws_buy_count", "WS"))
        out.append(F.concat(amount(F.col("sales")), F.lit(" ("), both, F.lit(")")).alias("sales_str"))
    return df.select(*out)


def value(c: Column, kind: str | None) -> Column:
    """One figure as text, by its kind."""
    return c.cast("string") if kind is None else KINDS[kind](c)
