"""Events in any order of arrival, filters of parts, and pages read by offsets."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidewater.sources import exchange, graph
from tidewater.streaming import bronze, filters, settle

HOUR = 3_600_000
P = "ID string, contract string, slot long, user string, pair string, timeframe string, source string, timestamp long"
U = "ID string, timestamp long, payout double, predvalue boolean, truevalue boolean, stake double"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def market(n=60):
    made = [(f"c{i % 3}-{100 * i}-u", f"c{i % 3}", 100 * i, "u", "ETH/USDT", "5m", "x", (i + 1) * 2 * HOUR) for i in range(n)]
    made += [made[5][:-1] + (made[5][-1] + HOUR,)]  # an ID again, later
    paid = [(m[0], m[-1] + (i % 7) * 10 * HOUR, float(i), i % 2 == 0, i % 3 == 0, 1.5 * i) for i, m in enumerate(made[:n]) if i % 4]
    paid += [(made[1][0], made[1][-1] + 40 * HOUR, 99.0, None, True, None)]  # a second settlement
    paid += [("c9-1-nobody", 20 * HOUR, 1.0, True, True, 1.0), (made[2][0], made[2][-1] - HOUR, 7.0, True, True, 1.0), (made[3][0], made[3][-1] + 200 * HOUR, 8.0, True, True, 1.0)]
    return made, paid


def arrive(folder, batches, schema):
    """A file for each micro-batch, in their order."""
    names = [c.split()[0] for c in schema.split(", ")]
    Path(folder).mkdir(parents=True, exist_ok=True)
    for i, batch in enumerate(batches):
        path = Path(folder) / f"{len(list(Path(folder).glob('*.json'))):04d}-{i}.json"
        path.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in batch))


def run(spark, tmp_path, store, late="60 days"):
    source = lambda kind, name: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    settle.stream(source(P, "p"), source(U, "u"), store, str(tmp_path / "c"), str(tmp_path / "orphans"), late=late).awaitTermination(300)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_result_of_one_batch(spark, tmp_path, seed):
    made, paid = market()
    want = settle.settled(spark.createDataFrame(made, P), spark.createDataFrame(paid, U))
    rng = random.Random(seed)
    rng.shuffle(made)
    rng.shuffle(paid)
    cut = lambda xs, n: [xs[i::n] for i in range(n)]
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    arrive(tmp_path / "p", cut(made[:40], 2), P)
    arrive(tmp_path / "u", cut(paid, 3), U)  # all settlements before a third of the predictions
    run(spark, tmp_path, s)
    arrive(tmp_path / "p", cut(made[40:], 2), P)
    run(spark, tmp_path, s)  # begun anew from its checkpoint
    known = want.where("not orphan")
    assert rows(s.read(), *bronze.BRONZE.names) == rows(known, *bronze.BRONZE.names)
    assert known.count() == 60 and known.where("payout is not null").count() > 40
    # an orphan comes out when the watermark has passed it
    assert spark.read.parquet(str(tmp_path / "orphans/batch=*")).count() == 0
    arrive(tmp_path / "p", [[("far-1-u", "far", 1, "u", "p", "5m", "x", 5000 * HOUR)]], P)
    arrive(tmp_path / "u", [[("far-1-u", 5000 * HOUR, 1.0, True, True, 1.0)]], U)
    run(spark, tmp_path, s)
    got = spark.read.parquet(str(tmp_path / "orphans/batch=*"))
    orphans = [("c0-300-u", 8.0), ("c2-200-u", 7.0), ("c9-1-nobody", 1.0)]  # too late, too early, of no prediction
    assert rows(settle.collapse(got), "ID", "payout") == rows(want.where("orphan"), "ID", "payout") == orphans


def test_rows_behind_the_watermark_are_not_waited_for(spark, tmp_path):
    made, paid = market(12)
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    far = ("far-1-u", "far", 1, "u", "p", "5m", "x", 500 * HOUR)
    arrive(tmp_path / "p", [made[:6], [far], [made[7]]], P)
    arrive(tmp_path / "u", [[paid[0]], [("far-1-u", 500 * HOUR, 1.0, True, True, 1.0)], [paid[4]]], U)
    run(spark, tmp_path, s, late="1 hour")
    got = {r.ID: r.payout for r in s.read().collect()}
    assert got[paid[0][0]] == paid[0][2] and got["far-1-u"] == 1.0
    assert got[made[7][0]] is None  # it is kept, but its settlement came too late


def test_replayed_micro_batches_change_nothing(spark, tmp_path):
    made, paid = market(20)
    p, u = spark.createDataFrame(made, P), spark.createDataFrame(paid, U)
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    batch = settle.events(p, u).where("not orphan")
    s.upsert(batch, settle.collapse)
    once = rows(s.read(), *bronze.BRONZE.names)
    s.upsert(batch.where("payout is not null"), settle.collapse)
    s.upsert(batch, settle.collapse)
    assert rows(s.read(), *bronze.BRONZE.names) == once == rows(settle.settled(p, u).where("not orphan"), *bronze.BRONZE.names)


def test_an_earlier_prediction_moves_its_row_to_another_part(spark, tmp_path):
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    one = ("c-1-u", "c", 1, "u", "p", "5m", "x")
    for hour in (80, 30):
        s.upsert(settle.events(spark.createDataFrame([(*one, hour * HOUR)], P), spark.createDataFrame([], U)).where("not orphan"), settle.collapse)
    assert rows(s.read(), "ID", "timestamp") == [("c-1-u", 30 * HOUR)] and list(s._state()["parts"]) == ["1"]


def test_an_update_reads_only_parts_whose_filter_answers(spark, tmp_path, monkeypatch):
    made = [(f"c{i}-{i}-u", "c", i, "u", "p", "5m", "x", i * 6 * HOUR) for i in range(80)]  # twenty days
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    p = spark.createDataFrame(made, P)
    s.apply(bronze.new_events(p, 0, 1 << 60, True), bronze.update_events(spark.createDataFrame([], U), 0, 1 << 60, True))
    assert len(s._state()["parts"]) == 20
    read = []
    monkeypatch.setattr(bronze.BronzeStore, "_read", lambda self, state, days, f=bronze.BronzeStore._read: (read.append(f(self, state, days)), read[-1])[1])
    u = spark.createDataFrame([("c9-9-u", 100 * HOUR, 5.0, True, True, 1.0), ("c42-42-u", 300 * HOUR, 6.0, True, True, 1.0), ("none-1-u", 300 * HOUR, 6.0, True, True, 1.0)], U)
    assert s.parts_of(u) == {"2", "10"}
    s.apply(bronze.new_events(p.limit(0), 0, 1 << 60, True), bronze.update_events(u, 0, 1 << 60, True))
    files = {f.split("_day=")[1].split("/")[0] for df in read for f in df.inputFiles()}
    assert files == {"2", "10"}
    assert rows(s.read().where("payout is not null"), "ID", "payout") == [("c42-42-u", 6.0), ("c9-9-u", 5.0)]


def test_filters_find_all_that_is_there_and_little_else(spark):
    held = spark.range(20_000).select((F.col("id") % 7).cast("string").alias("_day"), F.concat(F.lit("id"), "id").alias("ID"))
    held = held.union(spark.createDataFrame([("3", None)], "_day string, ID string"))
    found = filters.id_filters(held, "_day").persist()
    assert {r._day: r.pages for r in found.collect()}["0"] in (2, 4)
    for day in ("0", "6"):
        ids = held.where(F.col("_day") == day).select("ID")
        assert day in {r[0] for r in filters.parts_with(found, ids, "_day").collect()}
    one = spark.createDataFrame([("id8",), (None,)], "ID string")
    assert rows(filters.parts_with(found, one, "_day"), "_day") == [("1",)]
    others = spark.range(2_000).select(F.concat(F.lit("no"), "id").alias("ID"))
    assert filters.parts_with(found, others, "_day").count() <= 1
    assert filters.parts_with(filters.id_filters(held.limit(0), "_day"), one, "_day").count() == 0
    found.unpersist()


class Pages:
    """A service of records by time that counts what it is asked for."""

    def __init__(self, times):
        self.times, self.asked = times, []
        pages = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                v = body["variables"]
                records = [{"id": f"r{i}", "timestamp": t} for i, t in enumerate(pages.times)]
                if body["query"] == "newest":
                    found = sorted(records, key=lambda r: -r["timestamp"])[: v["first"]]
                else:
                    pages.asked.append((v["start"], v["end"], v["skip"]))
                    found = [r for r in records if v["start"] <= r["timestamp"] <= v["end"]][v["skip"] : v["skip"] + v["first"]]  # ends belong to it
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"data": {"events": found}}).encode())

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.options = {"url": f"http://127.0.0.1:{self.server.server_port}/", "query": "between", "newest": "newest", "field": "events", "step": "10", "first": "3"}


def test_stopped_streams_read_each_page_once(spark, tmp_path):
    pages = Pages([0, 3, 9, 10, 10, 10, 11, 19, 20, 25])

    def go(**more):
        found = graph.record_stream(spark, "id string, timestamp long", **pages.options, **more)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    try:
        assert go() == sorted(f"r{i}" for i in range(10))  # 10 and 20 lie on borders of partitions
        asked = len(pages.asked)
        assert go() == sorted(f"r{i}" for i in range(10)) and len(pages.asked) == asked
        pages.times += [26, 26, 31, 44]
        assert go() == sorted(f"r{i}" for i in range(14))
        assert min(start for start, _, _ in pages.asked[asked:]) == 26
        pages.times += [50, 60]
        assert go(hold="8") == sorted(f"r{i}" for i in range(15))
        assert go() == sorted(f"r{i}" for i in range(16))
    finally:
        pages.server.shutdown()


def test_tables_of_pages_have_each_record_once(spark):
    pages = Pages(list(range(0, 40, 5)))
    try:
        found = graph.records(spark, "id string, timestamp long", **pages.options, start="0", end="35")
        assert rows(found, "timestamp") == sorted(((t,) for t in range(0, 35, 5)), key=repr)
    finally:
        pages.server.shutdown()


def test_candles_since_a_time(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((q["symbol"], q["timeframe"]))
            found = [[t, 1.0, 2.0, 0.5, float(t), 3.0] for t in range(0, 1000, 50) if t >= int(q["since"])][: int(q["limit"])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = {"url": f"http://127.0.0.1:{server.server_port}/", "api": "since", "symbol": "BTC/USDT", "timeframe": "5m", "start": "0", "end": "800", "step": "300", "page": "4"}
    try:
        assert rows(exchange.fetch(spark, "f", **options), "timestamp", "close") == sorted(((t, float(t)) for t in range(0, 800, 50)), key=repr)
        assert set(asked) == {("BTC/USDT", "5m")}
    finally:
        server.shutdown()
    with pytest.raises(Exception, match="no such service"):
        exchange.fetch(spark, "f", **options | {"api": "other"}).count()
