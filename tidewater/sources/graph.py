"""Nested records of the market's graph service, as a data source and as flat relations.

The `graphpages` source posts one query per page and time range; each range is a partition
of its own. As a stream it keeps times as offsets. Without a network, the same records come from JSON files. Flattening is the
same for both: DataFrame functions over nested columns.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewater.functions.normal import keccak256

PREDICTION = (
    "id string, timestamp long, user struct<id: string>, stake double, predictedValue boolean, payout struct<payout: double, trueValue: boolean, predictedValue: boolean>, "
    "slot struct<slot: long, predictContract: struct<id: string, token: struct<name: string>, secondsPerEpoch: long, nftData: array<struct<key: string, value: string>>>>"
)
SLOT = ("id string, slot long, status string, trueValues array<struct<id: string, trueValue: boolean>>, roundSumStakesUp double, roundSumStakes double")
TRUE_VALUE = "id string, timestamp long, trueValue boolean, slot struct<id: string, predictContract: struct<token: struct<name: string>>, revenue: double, roundSumStakesUp: double, roundSumStakes: double>"
PAYOUT = (
    "id string, timestamp long, payout double, predictedValue boolean, trueValue boolean, "
    "prediction struct<stake: double, user: struct<id: string>, slot: struct<id: string, predictContract: struct<id: string, token: struct<name: string>>>>"
)
SUBSCRIPTION = (
    "id string, txId string, timestamp long, user struct<id: string>, "
    "predictContract struct<id: string, token: struct<name: string>, secondsPerEpoch: long, nftData: array<struct<key: string, value: string>>>"
)
#: What a subscription costs; the service does not tell.
SUBSCRIPTION_PRICE = 3.0
NETWORK = ("id string, secondsPerEpoch long, slots array<struct<slot: long, predictions: array<struct<id: string, user: string, stake: double, payout: double>>>>")


def post(url: str, body: dict, tries: int = 3, timeout: float = 30.0, wait=time.sleep) -> dict:
    """POST JSON; after the i-th failure wait i squared seconds, and raise the last failure."""
    for i in range(1, tries + 1):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as f:
                return json.load(f)
        except (OSError, ValueError):
            if i == tries:
                raise
            wait(i * i)
    raise ValueError("no tries")


class Range(InputPartition):
    """From start up to, but not with, end."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class GraphPaging:
    """Reads the pages of ranges of time. A record at the border of two ranges comes with the later one only."""

    def __init__(self, options: dict):
        self.url, self.query, self.field = options["url"], options["query"], options["field"]
        self.first, self.step, self.time = int(options.get("first", 1000)), int(options.get("step", 86_400)), options.get("time", "timestamp")

    def ask(self, query: str, **variables: int) -> list[dict]:
        return post(self.url, {"query": query, "variables": variables})["data"][self.field]

    def ranges(self, start: int, end: int) -> list[Range]:
        return [Range(a, min(a + self.step, end)) for a in range(start, end, self.step)] or [Range(start, start)]

    def read(self, partition: Range) -> Iterator[tuple]:
        skip = 0
        while partition.start < partition.end:
            rows = self.ask(self.query, start=partition.start, end=partition.end, skip=skip, first=self.first)
            for r in rows:
                at = r.get(self.time)
                if at is None or partition.start <= int(at) < partition.end:
                    yield (json.dumps(r),)
            if len(rows) < self.first:
                return
            skip += self.first


class GraphReader(GraphPaging, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.end = int(options["start"]), int(options["end"])

    def partitions(self) -> list[Range]:
        return self.ranges(self.start, self.end)


class GraphStreamReader(GraphPaging, DataSourceStreamReader):
    """Offsets are times: all records before the offset are read.

    The newest record's time comes from the `newest` query. Spark keeps the offsets of each
    micro-batch before it runs, so a stream that is stopped goes on where it was, and a
    batch that is run again reads the same ranges. Records that the service shows up to
    `hold` seconds late are waited for.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.newest, self.start = options["newest"], int(options.get("start", 0))
        self.end = int(options["end"]) if "end" in options else None
        self.hold = int(options.get("hold", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"before": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        times = [int(r[self.time]) for r in self.ask(self.newest, first=1)]
        before = max([self.start, *(t + 1 - self.hold for t in times)])
        return {"before": before if self.end is None else max(self.start, min(before, self.end))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start["before"], end["before"])

    def commit(self, end: dict) -> None:
        """The service keeps its records, so there is nothing to let go."""


class GraphPages(DataSource):
    """Options: url, query, field of the answer, start, end, step of a partition, first (rows of a page), time (field of the time).

    The query gets start, end, skip and first; records from start on and before end count. On
    a stream also: newest (a query whose first record is the newest), hold; end is optional.
    """

    @classmethod
    def name(cls) -> str:
        return "graphpages"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> GraphReader:
        return GraphReader(self.options)

    def streamReader(self, schema) -> GraphStreamReader:  # noqa: N802
        return GraphStreamReader(self.options)


def records(spark: SparkSession, schema: str, path: str | None = None, **options) -> DataFrame:
    """Nested records from JSON files, or from the service if no path is given."""
    if path is not None:
        return spark.read.schema(schema).json(path)
    spark.dataSource.register(GraphPages)
    return spark.read.format("graphpages").options(**options).load().select(F.from_json("value", schema).alias("r")).select("r.*")


def record_stream(spark: SparkSession, schema: str, **options) -> DataFrame:
    """A stream of nested records of the service, each record once."""
    spark.dataSource.register(GraphPages)
    return spark.readStream.format("graphpages").options(**options).load().select(F.from_json("value", schema).alias("r")).select("r.*")


def value_of(pairs: Column, key: str) -> Column:
    """The decoded value of a key in an array of (key: Keccak-256 of the name, value: text in hex)."""
    hashed = keccak256(key.encode()).hex()
    found = F.get(F.filter(pairs, lambda p: F.regexp_replace(p["key"], "^0x", "") == hashed), 0)["value"]
    return F.decode(F.unhex(F.regexp_replace(found, "^0x", "")), "UTF-8")


def contract_info(contract: Column, source: str = "binance") -> Column:
    """struct<pair, timeframe, source> of a contract: from its data, or from name and epoch where it has none."""
    data = contract["nftData"]
    said = F.struct(*(value_of(data, k).alias(k) for k in ("pair", "timeframe", "source")))
    frame = F.when(contract["secondsPerEpoch"] == 300, "5m").otherwise("1h")
    return F.when(F.size(data) > 0, said).otherwise(F.struct(contract["token"]["name"].alias("pair"), frame.alias("timeframe"), F.lit(source).alias("source")))


def newest_first_cut(pages: DataFrame, order: str = "_page_row", page: str | None = None) -> DataFrame:
    """A page that ends earlier than it begins loses the rows earlier than its first; without `page` all rows are one page.

    First and last of each page are found by partial aggregates and joined back.
    """
    if page is None:
        return newest_first_cut(pages.withColumn("_page", F.lit(0)), order, "_page").drop("_page")
    ends = pages.groupBy(page).agg(F.min_by("timestamp", order).alias("_first"), F.max_by("timestamp", order).alias("_last"))
    kept = (F.col("_first") <= F.col("_last")) | (F.col("timestamp") >= F.col("_first"))
    return pages.join(ends, page).where(kept).drop("_first", "_last")


def true_value_batches(pending: DataFrame, size: int) -> DataFrame:
    """contract, batch, slots: what is to be settled, in batches of `size` slots of one contract."""
    w = Window.partitionBy("contract").orderBy("slot")
    rows = pending.select("contract", "slot").distinct().withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy("contract", "batch").agg(F.array_sort(F.collect_list("slot")).alias("slots"))


def flat_predictions(nested: DataFrame, start: int, end: int, contracts: list[str] | None = None) -> DataFrame:
    """One row per prediction with start < timestamp < end; without a payout nothing of the outcome is known."""
    contract = F.col("slot.predictContract.id")
    rows = nested.where((F.col("timestamp") > start) & (F.col("timestamp") < end))
    rows = rows if contracts is None else rows.where(contract.isin([c.lower() for c in contracts]))
    known = F.col("payout").isNotNull()
    when = lambda c: F.when(known, c)
    rows = rows.withColumn("_info", contract_info(F.col("slot.predictContract")))
    return rows.select(
        F.col("id").alias("ID"), contract.alias("contract"), F.col("_info.pair").alias("pair"), F.col("_info.timeframe").alias("timeframe"), F.col("_info.source").alias("source"),
        when(F.col("payout.predictedValue")).alias("predvalue"), when(F.col("stake")).alias("stake"), when(F.col("payout.trueValue")).alias("truevalue"),
        (F.col("timestamp") * 1000).alias("timestamp"), when(F.col("payout.payout")).alias("payout"), F.col("slot.slot").alias("slot"), F.col("user.id").alias("user"),
    )


def _slot_of(c: str) -> Column:
    """The slot in an id `contract-slot-...`."""
    return F.split_part(F.col(c), F.lit("-"), F.lit(2)).cast("long")


def flat_true_values(nested: DataFrame, start: int, end: int, contracts: list[str] | None = None) -> DataFrame:
    """One row per settled slot with start <= timestamp <= end; amounts that the service leaves out are zero."""
    rows = nested.where(F.col("timestamp").between(start, end))
    rows = rows if contracts is None else rows.where(F.split_part("slot.id", F.lit("-"), F.lit(1)).isin(contracts))
    amount = lambda c: F.coalesce(F.col(f"slot.{c}"), F.lit(0.0)).alias(c)
    return rows.select(
        F.col("id").alias("ID"), (F.col("timestamp") * 1000).alias("timestamp"), F.col("slot.predictContract.token.name").alias("token"), F.col("trueValue").alias("truevalue"), _slot_of("id").alias("slot"),
        amount("revenue"), amount("roundSumStakesUp"), amount("roundSumStakes"),
    )


def flat_payouts(nested: DataFrame, start: int, end: int, contracts: list[str]) -> DataFrame:
    """One row per payout with start <= timestamp <= end whose id holds one of the contracts anywhere."""
    of = reduce(Column.__or__, (F.contains(F.col("id"), F.lit(c)) for c in contracts), F.lit(False))
    return nested.where(F.col("timestamp").between(start, end) & of).select(
        F.col("id").alias("ID"), F.col("prediction.slot.predictContract.token.name").alias("token"), F.col("prediction.user.id").alias("user"), _slot_of("id").alias("slot"),
        (F.col("timestamp") * 1000).alias("timestamp"), "payout", F.col("predictedValue").alias("predvalue"), F.col("trueValue").alias("truevalue"), F.col("prediction.stake").alias("stake"),
    )


def flat_subscriptions(nested: DataFrame, start: int, end: int, contracts: list[str] | None = None) -> DataFrame:
    """One row per subscription with start < timestamp < end, at the one price that there is."""
    contract = F.col("predictContract.id")
    rows = nested.where((F.col("timestamp") > start) & (F.col("timestamp") < end))
    rows = rows.where(contract.isin([c.lower() for c in contracts])) if contracts else rows
    return rows.withColumn("_info", contract_info(F.col("predictContract"))).select(
        F.col("id").alias("ID"), F.col("_info.pair").alias("pair"), F.col("_info.timeframe").alias("timeframe"), F.col("_info.source").alias("source"),
        (F.col("timestamp") * 1000).alias("timestamp"), F.col("txId").alias("tx_id"), F.lit(SUBSCRIPTION_PRICE).alias("last_price_value"), F.col("user.id").alias("user"),
    )


def slots_by_contract(nested: DataFrame) -> DataFrame:
    """contract, slots: what slot records there are of each contract, in order of time; one row per contract and 30 days."""
    rows = nested.select(F.split_part("id", F.lit("-"), F.lit(1)).alias("contract"), F.floor(F.col("slot") / (30 * 86_400)).alias("month"), "slot", F.col("id").alias("ID"), F.get("trueValues", 0)["trueValue"].alias("truevalue"))
    return rows.groupBy("contract", "month").agg(F.array_sort(F.collect_list(F.struct("slot", "ID", "truevalue"))).alias("slots"))


def epoch_seconds(nested: DataFrame, owners: list[str], allowed: list[str] | None = None) -> DataFrame:
    """contract and its seconds per epoch, of the contracts that feed_contracts() keeps."""
    return feed_contracts(nested, owners, allowed).select(F.col("id").alias("contract"), "secondsPerEpoch")


def flat_slots(nested: DataFrame) -> DataFrame:
    """The first true value of each slot, null where there is none."""
    return nested.select(F.col("id").alias("ID"), F.col("slot"), F.get("trueValues", 0)["trueValue"].alias("truevalue"), "status", "roundSumStakesUp", "roundSumStakes")


def pending_slots(nested: DataFrame, now: int, days: int = 3) -> DataFrame:
    """Slots of the last days that are pending and have no true value yet."""
    return nested.where(F.col("slot").between(now - days * 86_400, now) & (F.col("status") == "Pending") & (F.coalesce(F.size("trueValues"), F.lit(0)) <= 0))


def pending_payouts(predictions: DataFrame) -> DataFrame:
    """contract -> its unsettled slots, in order."""
    return predictions.where("payout is null").groupBy("contract").agg(F.array_sort(F.collect_set("slot")).alias("slots"))


def network_predictions(nested: DataFrame) -> DataFrame:
    """contract -> slot -> prediction, one row each; contracts without any keep one row of nulls."""
    slots = nested.select(F.col("id").alias("contract"), F.explode_outer("slots").alias("s"))
    return slots.select("contract", F.col("s.slot").alias("slot"), F.explode_outer("s.predictions").alias("p")).select("contract", "slot", F.col("p.id").alias("ID"), F.col("p.user").alias("user"), F.col("p.stake").alias("stake"), F.col("p.payout").alias("payout"))


def feed_contracts(nested: DataFrame, owners: list[str], allowed: list[str] | None = None) -> DataFrame:
    """Contracts of the owners, or those that are allowed by id."""
    return nested.where(F.lower("owner").isin([o.lower() for o in owners]) | F.col("id").isin(allowed or []))


def consumed(orders: DataFrame, price: float = 3.0) -> DataFrame:
    """What each contract has sold, at a price per order."""
    return orders.groupBy("contract").agg((F.count("*") * F.lit(price)).alias("consumed"))


def shared_slots(pending: DataFrame, size: int) -> DataFrame:
    """Slots that the same set of contracts wait for, in batches of `size`."""
    sets = pending.select("contract", F.explode("slots").alias("slot")).groupBy("slot").agg(F.array_sort(F.collect_set("contract")).alias("contracts"))
    w = Window.partitionBy("contracts").orderBy("slot")
    rows = sets.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy("contracts", "batch").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
