"""Predictions and settlements that meet in any order of arrival.

events() is the same for tables and streams: every prediction as it comes, every pair of a
prediction and a settlement, and the settlements that no prediction came for. On streams
both sides have a watermark, and Spark's join keeps a row in its state until the other
side's watermark has passed all rows that it could meet. collapse() makes one row of an
ID's events and does not depend on their order, so a store that is collapsed after every
micro-batch ends where one batch over all events does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.streaming.bronze import BRONZE, VALUES, BronzeStore

#: A settlement comes this long after its prediction at most.
WAIT_MS = 3 * 86_400_000
_PREDICTION = ("timestamp", "contract", "slot", "user", "pair", "timeframe", "source")
_KINDS = {f.name: f.dataType for f in BRONZE}


def _slot_id():
    return F.concat_ws("-", F.split_part("ID", F.lit("-"), F.lit(1)), F.split_part("ID", F.lit("-"), F.lit(2)))


def _with_time(rows: DataFrame, name: str, late: str) -> DataFrame:
    out = rows.withColumn(name, F.timestamp_millis("timestamp"))
    return out.withWatermark(name, late) if rows.isStreaming else out


def events(predictions: DataFrame, payouts: DataFrame, wait_ms: int = WAIT_MS, late: str = "1 day") -> DataFrame:
    """Rows of BRONZE with `orphan`, which marks settlements without a prediction.

    A settlement belongs to a prediction of its ID that is not later and at most `wait_ms`
    earlier. On streams, rows that are more than `late` behind the newest one of their side
    may be dropped, and an orphan comes when the predictions' watermark passes it.
    """
    revenue = F.col("revenue") if "revenue" in payouts.columns else F.lit(None)
    p = _with_time(predictions.select("ID", *_PREDICTION), "_made", late)
    u = payouts.withColumn("revenue", revenue).select(F.col("ID").alias("_id"), *(F.col(v).cast(_KINDS[v]).alias(f"_{v}") for v in VALUES), "timestamp")
    u = _with_time(u, "_paid", late).withColumnRenamed("timestamp", "_at")
    wait = F.make_dt_interval(secs=F.lit(wait_ms / 1000))
    met = p.join(u, (F.col("ID") == F.col("_id")) & (F.col("_paid") >= F.col("_made")) & (F.col("_paid") <= F.col("_made") + wait), "right_outer")
    pairs = met.select(
        F.coalesce("ID", "_id").alias("ID"), *_PREDICTION, *(F.col(f"_{v}").alias(v) for v in VALUES), F.greatest("timestamp", "_at").alias("last_event_timestamp"), F.col("ID").isNull().alias("orphan"),
    )
    alone = predictions.select("ID", *_PREDICTION, *(F.lit(None).cast(_KINDS[v]).alias(v) for v in VALUES), F.col("timestamp").alias("last_event_timestamp"), F.lit(False).alias("orphan"))
    return alone.unionByName(pairs).withColumn("slot_id", _slot_id()).select(*BRONZE.names, "orphan")


def collapse(rows: DataFrame) -> DataFrame:
    """One row of BRONZE per ID: its earliest prediction, the largest of each value, the latest event."""
    found = rows.groupBy("ID").agg(F.min(F.when(F.col("timestamp").isNotNull(), F.struct(*_PREDICTION))).alias("_p"), *(F.max(c).alias(c) for c in (*VALUES, "last_event_timestamp")))
    return found.select("ID", _slot_id().alias("slot_id"), "_p.*", *VALUES, "last_event_timestamp").select(*BRONZE.names)


def settled(predictions: DataFrame, payouts: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """What a stream of the same events ends with: one row per ID, orphans marked.

    Tables need no join: an ID's events stand together in order of time, and a settlement
    belongs to a prediction if the last one until then is not more than `wait_ms` back. So
    each event moves once, and one sort serves the window and the aggregate.
    """
    revenue = F.col("revenue") if "revenue" in payouts.columns else F.lit(None)
    no = lambda names, kind: [F.lit(None).cast(kind[n]).alias(n) for n in names]
    made = predictions.select("ID", *(F.col(c).cast(_KINDS[c]).alias(c) for c in _PREDICTION), *no(VALUES, _KINDS), F.lit(True).alias("_new"))
    paid = payouts.withColumn("revenue", revenue).select("ID", F.col("timestamp").cast("long").alias("timestamp"), *no(_PREDICTION[1:], _KINDS), *(F.col(v).cast(_KINDS[v]).alias(v) for v in VALUES), F.lit(False).alias("_new"))
    last = F.max(F.when(F.col("_new"), F.col("timestamp"))).over(Window.partitionBy("ID").orderBy("timestamp"))
    met = F.col("ID").isNotNull() & (F.col("timestamp") - last <= wait_ms)
    rows = made.unionByName(paid).withColumn("_known", F.col("_new") | F.coalesce(met, F.lit(False)))
    latest = (*VALUES, "timestamp")
    found = rows.groupBy("ID").agg(
        F.min(F.when(F.col("_new") & F.col("timestamp").isNotNull(), F.struct(*_PREDICTION))).alias("_p"), F.bool_or("_known").alias("_some"), F.bool_and("_known").alias("_all"),
        *(F.max(F.when(F.col("_known") == known, F.col(c))).alias(f"_{c}_{known}") for known in (True, False) for c in latest),
    )
    none = F.lit(None).cast(found.schema["_p"].dataType)
    one = lambda known, p: F.struct(p.alias("_p"), *(F.col(f"_{c}_{known}").alias(c if c in VALUES else "last_event_timestamp") for c in latest), F.lit(not known).alias("orphan"))
    both = F.filter(F.array(F.when(F.col("_some"), one(True, F.col("_p"))), F.when(~F.col("_all"), one(False, none))), lambda x: x.isNotNull())
    out = found.select("ID", F.explode(both).alias("_e")).select("ID", _slot_id().alias("slot_id"), "_e._p.*", *(f"_e.{c}" for c in (*VALUES, "last_event_timestamp", "orphan")))
    return out.select(*BRONZE.names, "orphan")


def stream(predictions: DataFrame, payouts: DataFrame, store: BronzeStore, checkpoint: str, orphans: str | None = None, wait_ms: int = WAIT_MS, late: str = "1 day", every: str | None = None) -> StreamingQuery:
    """Keep a store up to date from two streams; a replayed micro-batch changes nothing.

    Orphans go to parquet files below `orphans`, a folder for each micro-batch. Without
    `every` the stream ends with what there is; with it, it goes on at that interval.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if orphans is not None:
                batch.where("orphan").write.mode("overwrite").parquet(f"{orphans}/batch={number}")
            store.upsert(batch.where("not orphan"), collapse)
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return events(predictions, payouts, wait_ms, late).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
