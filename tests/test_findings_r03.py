"""Findings of the third round: large amounts, whole tables, and steps that move less."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewater.functions import display
from tidewater.llm import lm, substring
from tidewater.operators import curves
from tidewater.plans import catalog, registry  # noqa: F401
from tidewater.sources import adapt
from tidewater.streaming import settle

TABLES = "/root/testdata/sf0.001"
P = "ID string, contract string, slot long, user string, pair string, timeframe string, source string, timestamp long"
U = "ID string, timestamp long, payout double, predvalue boolean, truevalue boolean, stake double"


def test_tables_show_no_unit_above_millions(spark):
    df = spark.createDataFrame([(2.1e9, 3_000_000_123, 5, 1), (999.0, 1_500, 0, 0)], "volume double, sales long, df_buy_count long, ws_buy_count long")
    assert [(r.volume, r.sales_str) for r in display.formatted(df).collect()] == [("2100M", "3000M (5 DF, 1 WS)"), ("999", "1.5K ()")]


def test_payouts_are_matched_with_predictions_of_all_slots(spark):
    assert registry.QUERIES["unmatched_payouts"](spark, TABLES).count() == 0


def exchanges(df):
    """The hash exchanges of a plan as it is before it runs."""
    return [x.strip(" +-:") for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_settled_moves_each_event_once(spark):
    p = spark.createDataFrame([("a-1-u", "a", 1, "u", "p", "5m", "s", 10), ("a-1-u", "a", 1, "u", "p", "5m", "s", 50), (None, "a", 1, "u", "p", "5m", "s", 10), ("b-1-u", "b", 1, "u", "p", "5m", "s", None)], P)
    u = spark.createDataFrame([("a-1-u", 12, 1.0, True, None, 2.0), ("a-1-u", 31, 9.0, True, True, 9.0), ("a-1-u", 50, 3.0, False, True, 1.0), ("a-1-u", 9, 4.0, True, True, 1.0), (None, 10, 5.0, True, True, 1.0), ("b-1-u", 7, 6.0, True, True, 1.0), ("c-1-u", None, 7.0, True, True, 1.0)], U)
    got = settle.settled(p, u, 20)
    assert len(exchanges(got)) == 1
    # the same by the join of streams
    rows = settle.events(p, u, 20)
    want = settle.collapse(rows.where("not orphan")).withColumn("orphan", F.lit(False)).unionByName(settle.collapse(rows.where("orphan")).withColumn("orphan", F.lit(True)))
    assert got.dtypes == want.dtypes
    as_set = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert as_set(got) == as_set(want)
    found = {(r.ID, r.orphan): (r.timestamp, r.payout, r.stake, r.last_event_timestamp) for r in got.collect()}
    assert found["a-1-u", False] == (10, 3.0, 2.0, 50) and found["a-1-u", True] == (None, 9.0, 9.0, 31)


def test_slot_figures_hold_no_task_of_slots_in_an_aggregate(spark):
    df = spark.createDataFrame([("c", 1, 1, 1.0, 2.0), ("c", 1, 0, 1.0, 0.0), ("c", 2, 0, 1.5, 2.0), ("d", 1, 0, 1.0, None)], "contract string, slot long, seq long, stake double, payout double")
    got = curves.slot_figures(df, "contract")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1 and len(exchanges(got)) == 1
    found = sorted(tuple(r) for r in got.collect())
    assert found == [("c", 1, 2.0, 0.0, 2.0, 2, 100 / 3, 0.0), ("c", 2, 1.5, 0.5, 2.0, 1, 200 / 3, 0.5), ("d", 1, 1.0, -1.0, 0.0, 1, 0.0, -1.0)]


def test_line_items_are_not_moved_for_small_tables_of_feeds(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # ten times the table of suppliers
    try:
        assert not [x for x in exchanges(adapt.predictions(spark, "/root/testdata/sf0.1")) if "suppkey" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_of_a_repeated_segment_are_one_row(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, " ".join([line] * 40)), (2, "x " + " ".join([line] * 40))], "doc_id long, text string")
    found = substring.anchors(docs).collect()
    assert len(found) == len({(r.h, r.seg, r.doc_id) for r in found}) < 20
    assert sum(p & 63 for r in found for p in r.pos if r.doc_id == 1) == 40 * 30 - 49  # no window is lost
    assert sorted((r.doc_id, r.n_removed) for r in substring.digests(docs).collect()) == [(1, 0), (2, 1200)]


def test_filters_of_many_shards_are_asked_in_groups(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(i % 60))) for i in range(150)], "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD_GRAMS", 100)  # some ninety shards
    held = F.col("doc_id") % 10 == 0
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    as_set = lambda df: sorted(tuple(round(r[c], 9) for c in names) for r in df.collect())
    want = as_set(lm.score(docs, held))
    asked = []
    sharded = lm._sharded_scores
    for pack, group in ((lm.PACK_BYTES, lm.GROUP_BYTES), (2000, 300)):
        monkeypatch.setattr(lm, "_sharded_scores", lambda *a, pack=pack, group=group: asked.append(a[3]) or sharded(*a, pack, group))
        assert as_set(lm.score(docs, held, broadcast_bytes=-1)) == want
    assert min(asked) > 50
