"""Incremental enrichment of predictions with settlements that come late.

merge() is one step as a pure function of DataFrames. BronzeStore keeps the result in parts
and writes those that a step touches; a manifest is published last, so readers see a whole
relation and a failed step changes nothing. stream() feeds a settlement stream through the same step per micro-batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewater.streaming import filters

DAY_MS = 86_400_000
VALUES = ("predvalue", "truevalue", "stake", "revenue", "payout")
_KINDS = {"boolean": T.BooleanType(), "double": T.DoubleType(), "long": T.LongType(), "string": T.StringType()}
_COLUMNS = {
    "string": ("ID", "slot_id", "contract", "user", "pair", "timeframe", "source"),
    "boolean": ("predvalue", "truevalue"),
    "double": ("stake", "revenue", "payout"),
    "long": ("slot", "timestamp", "last_event_timestamp"),
}
_ORDER = ("ID", "slot_id", "contract", "slot", "user", "pair", "timeframe", "source", *VALUES, "timestamp", "last_event_timestamp")
BRONZE = T.StructType([T.StructField(n, _KINDS[next(k for k, v in _COLUMNS.items() if n in v)]) for n in _ORDER])


def in_window(start: int, end: int, first: bool) -> Column:
    """(start, end], on the first run with its start."""
    t = F.col("timestamp")
    return (t >= start if first else t > start) & (t <= end)


def new_events(predictions: DataFrame, start: int, end: int, first: bool) -> DataFrame:
    """Predictions of the window, one per ID, the earliest; their values are not known yet."""
    kinds = {f.name: f.dataType for f in BRONZE}
    kept = ("timestamp", "contract", "slot", "user", "pair", "timeframe", "source")
    rows = predictions.where(in_window(start, end, first)).groupBy("ID").agg(F.min(F.struct(*kept)).alias("_x")).select("ID", "_x.*")
    return rows.select(
        "ID", F.concat_ws("-", F.split_part("ID", F.lit("-"), F.lit(1)), F.split_part("ID", F.lit("-"), F.lit(2))).alias("slot_id"), "contract", "slot", "user", "pair", "timeframe", "source",
        *(F.lit(None).cast(kinds[v]).alias(v) for v in VALUES), "timestamp", F.col("timestamp").alias("last_event_timestamp"),
    )


def update_events(payouts: DataFrame, start: int, end: int, first: bool) -> DataFrame:
    """Settlements of the window, one row per ID with the largest of each value."""
    revenue = F.col("revenue") if "revenue" in payouts.columns else F.lit(None).cast("double")
    rows = payouts.where(in_window(start, end, first)).withColumn("revenue", revenue)
    return rows.groupBy("ID").agg(*(F.max(v).alias(f"u_{v}") for v in VALUES), F.max("timestamp").alias("u_time"))


def merge(prod: DataFrame | None, new: DataFrame, updates: DataFrame) -> DataFrame:
    """The next snapshot.

    A new row takes what its own values lack from the update and keeps its event time. A
    row of the snapshot takes the update's values first and the later event time. IDs that
    the snapshot has are not new, so a replay adds nothing. Updates for no row are dropped.
    """
    rows = new.select(*BRONZE.names, F.lit(False).alias("_old"))
    if prod is not None:  # one pass over both: rows of an ID that the snapshot has stand together
        rows = prod.select(*BRONZE.names, F.lit(True).alias("_old")).unionByName(rows)
        rows = rows.withColumn("_had", F.max("_old").over(Window.partitionBy("ID"))).where("_old or not _had or ID is null")
    value = lambda c: F.when(F.col("_old"), F.coalesce(f"u_{c}", c)).otherwise(F.coalesce(c, f"u_{c}"))
    cols = {c: value(c) for c in VALUES} | {"last_event_timestamp": F.when(F.col("_old"), F.greatest("u_time", "last_event_timestamp")).otherwise(F.col("last_event_timestamp"))}
    return rows.join(updates, "ID", "left").select(*(cols.get(c, F.col(c)).alias(c) for c in BRONZE.names))


def run_windows(predictions: DataFrame, payouts: DataFrame, cuts: list[int]) -> DataFrame:
    """All steps between neighbouring cuts, without a store."""
    prod = None
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        prod = merge(prod, new_events(predictions, a, b, i == 0), update_events(payouts, a, b, i == 0))
    return prod


class BronzeStore:
    """The relation in parts by day of the prediction, and numbered manifests that say which files of parts count.

    An update writes the parts that its events touch and leaves the others where they are;
    a filter beside each part tells whether it may hold an ID, so the others are not read.
    A manifest holds also how far the events are done. It appears by a rename, so readers
    see the relation before or after an update and a failed one changes nothing.
    """

    #: Manifests that stay, for readers that have begun.
    KEPT = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = self._hadoop("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list[str]:
        return sorted(p.getPath().getName() for p in self._fs.globStatus(self._hadoop("MANIFEST-*")) or [])

    def _state(self) -> dict:
        found = self._manifests()
        return json.loads(self.spark.read.text(f"{self.path}/{found[-1]}").first()[0]) if found else {"version": 0, "parts": {}, "done": None}

    def current(self) -> int | None:
        return self._state()["version"] or None

    def read(self) -> DataFrame | None:
        state = self._state()
        return self._read(state, list(state["parts"])) if state["version"] else None

    def _read(self, state: dict, days: list[str]) -> DataFrame:
        folders = [f"{self.path}/{state['parts'][d]}" for d in days]
        return self.spark.read.schema(BRONZE).parquet(*folders) if folders else self.spark.createDataFrame([], BRONZE)

    def _publish(self, state: dict, changes: dict) -> None:
        state = state | changes | {"version": state["version"] + 1}
        name = f"MANIFEST-{state['version']:08d}"
        out = self._fs.create(self._hadoop(f".{name}"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(self._hadoop(f".{name}"), self._hadoop(name)):
            raise RuntimeError(f"another writer published {name} of {self.path}")
        held, used = self._manifests(), set()
        for m in held[-self.KEPT :]:
            used |= {f.split("/")[0] for f in json.loads(self.spark.read.text(f"{self.path}/{m}").first()[0])["parts"].values()}
        for m in held[: -self.KEPT]:
            self._fs.delete(self._hadoop(m), True)
        for f in self._fs.listStatus(self._hadoop("")):
            n = f.getPath().getName()
            if n.startswith("data-") and n not in used:
                self._fs.delete(self._hadoop(n), True)

    def apply(self, predictions: DataFrame, updates: DataFrame, done: int | None = None) -> None:
        """Merge new predictions and collapsed updates (one row per ID) into the parts that they touch."""
        ids = updates.select("ID").union(predictions.select("ID"))
        self._rewrite(predictions, ids, lambda prod: merge(prod, predictions, updates), done)

    def upsert(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Put rows beside those that are there, and make one row of each ID's by `combine`."""
        rows = rows.select(*BRONZE.names)
        self._rewrite(rows, rows.select("ID"), lambda prod: combine(rows if prod is None else prod.unionByName(rows)), None)

    def parts_of(self, ids: DataFrame) -> set[str]:
        """The days whose parts may hold one of the IDs, by their filters; no part is read."""
        return self._parts_of(self._state(), ids)

    def _parts_of(self, state: dict, ids: DataFrame) -> set[str]:
        folders = sorted({f"{self.path}/{f.split('/')[0]}/ids" for f in state["parts"].values()})
        if not folders:
            return set()
        current = self.spark.createDataFrame([(d, f.split("/")[0]) for d, f in state["parts"].items()], "_day string, _in string")
        held = self.spark.read.schema("_day string, _in string, pages long, page long, bits binary").parquet(*folders).join(F.broadcast(current), ["_day", "_in"], "left_semi")  # a row for each part
        return {r[0] for r in filters.parts_with(held, ids, "_day").collect()}

    def _rewrite(self, rows: DataFrame, ids: DataFrame, change: Callable[[DataFrame | None], DataFrame], done: int | None) -> None:
        """Write the parts of the rows' days, and those that may hold one of the IDs, as `change` makes them from what they hold."""
        state = self._state()
        day = F.coalesce(F.floor(F.col("timestamp") / DAY_MS).cast("string"), F.lit("none"))
        name = f"data-{state['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        days = {r[0] for r in rows.select(day.alias("d")).distinct().collect()} | self._parts_of(state, ids)
        touched = sorted(days & set(state["parts"]))
        prod = self._read(state, touched) if state["version"] else None
        out = change(prod).withColumn("_day", day)
        out.hint("rebalance", "_day").write.partitionBy("_day").parquet(f"{self.path}/{name}")  # a large day is several tasks
        new = {p.getPath().getName().removeprefix("_day="): f"{name}/{p.getPath().getName()}" for p in self._fs.globStatus(self._hadoop(f"{name}/_day=*"))}
        if not set(new) <= days:
            raise RuntimeError(f"events of days that were not read: {sorted(set(new) - days)}")
        written = self._read({"parts": new}, list(new)).select("ID", day.alias("_day"))
        filters.id_filters(written, "_day").withColumn("_in", F.lit(name)).write.parquet(f"{self.path}/{name}/ids")
        kept = {d: f for d, f in state["parts"].items() if d not in touched}
        self._publish(state, {"parts": kept | new, "done": state["done"] if done is None else done})

    def high_water(self) -> int | None:
        prod = self.read()
        return None if prod is None else prod.agg(F.max("timestamp")).first()[0]

    def update(self, predictions: DataFrame, payouts: DataFrame, end: int, start: int = 0) -> None:
        """One incremental run from the last event time up to `end`; it raises what goes wrong."""
        done = self._state()["done"]
        first = done is None
        begin = start if first else done
        if begin > end:
            raise ValueError(f"the window ends at {end}, before it begins at {begin}")
        self.apply(new_events(predictions, begin, end, first), update_events(payouts, begin, end, first), end)


def stream(payouts: DataFrame, predictions: Callable[[int | None], DataFrame], store: BronzeStore, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merge a stream of settlements into the store; a replayed batch gives the same relation.

    `predictions` gives those after a time in ms, or all for None: it is asked in each batch
    from the newest prediction of the store on, so predictions that come later are added too.
    Without `every` the stream ends with what there is; with it, it goes on at that interval.
    """
    far = 1 << 62

    def step(batch: DataFrame, _: int) -> None:
        store.apply(new_events(predictions(store.high_water()), 0, far, True), update_events(batch, 0, far, True))

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return payouts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def hourly_totals(events: DataFrame, time: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Sums per hour of a stream or table; rows later than the watermark are dropped from a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("hour"), "n", "total")
