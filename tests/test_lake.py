"""Stores, sources and incremental enrichment."""

import json
import threading
import uuid
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.normal import keccak256
from tidewater.operators import checks
from tidewater.sources import graph, store
from tidewater.streaming import bronze

LOG = T.StructType([T.StructField("ID", T.StringType()), T.StructField("timestamp", T.LongType())])


def name():
    return f"t_{uuid.uuid4().hex[:8]}"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


@pytest.fixture
def catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lake_test")
    spark.catalog.setCurrentDatabase("lake_test")
    yield store.Catalog(spark)
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE lake_test CASCADE")


def test_tables(spark, catalog):
    a, b = name(), f"bronze_{name()}"
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], LOG)
    catalog.create_empty(a, LOG)
    assert catalog.exists(a) and catalog.row_count(a) == 0
    catalog.insert(df, a)
    catalog.insert(df, b)
    catalog.delete_common(a, spark.createDataFrame([("x",), ("x",)], "ID string"))
    assert rows(spark.table(a)) == [("y", 2), ("z", 3)]
    catalog.update(a, spark.createDataFrame([("y", 9), ("q", 1)], LOG), "ID")
    assert rows(spark.table(a)) == [("y", 9), ("z", 3)]
    assert catalog.truncate_from(2, etl=True) == {b: (3, 1)}
    assert catalog.scalar(f"select max(timestamp), count(*) from {a}") == (9, 2)
    assert catalog.query("select * from nowhere_at_all") is None
    assert rows(catalog.query("select ID from {f} where timestamp > 1", f=df)) == [("y",), ("z",)]
    catalog.move(a, b)
    assert not catalog.exists(a) and catalog.row_count(b) == 3


def test_layers():
    assert store.is_etl_table("_temp_bronze_x") and store.is_etl_table("gold_y") and not store.is_etl_table("_new_events_raw")


def test_export_takes_only_what_is_newer(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.createDataFrame([(str(i), i) for i in range(10)], LOG)
    assert store.export(df.where("timestamp < 5"), path) == 5
    assert store.export(df, path) == 5 and store.export(df, path) == 0
    assert store.high_water(spark, path) == 9 and spark.read.parquet(path).count() == 10
    store.export(df, path, most_files=1)
    assert spark.read.parquet(path).count() == 10 and len(spark.read.parquet(path).inputFiles()) == 1


def test_csv_log_prunes_by_name(spark, tmp_path):
    log = store.CsvLog(spark, str(tmp_path / "log"), LOG, rows=10)
    assert log.last() is None and log.read().count() == 0
    for k in range(3):
        log.append(spark.createDataFrame([(str(i), i) for i in range(100 * k, 100 * k + 25)], LOG))
    log.append(spark.createDataFrame([], LOG))
    assert log.last() == 224 and log.read().count() == 75
    assert len(log.folders(110, 150)) == 1
    assert rows(log.read(123, 201), "timestamp") == [(123,), (124,), (200,), (201,)]


def test_cache_is_used_until_it_is_old(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    cache = store.QueryCache(spark, str(tmp_path), 1000)
    assert cache.get("q", make).count() == cache.get("q", make).count() == 3 and len(calls) == 1
    store.QueryCache(spark, str(tmp_path), 0).get("q", make)
    assert len(calls) == 2


def test_rows_of_a_class_and_piped_text(spark, tmp_path):
    @dataclass
    class Row:
        ID: str
        timestamp: int

    assert rows(store.to_frame(spark, [Row("a", 1)], LOG)) == [("a", 1)]
    with pytest.raises(TypeError):
        store.to_frame(spark, [Row("a", 1), 5], LOG)
    assert rows(store.read_piped(spark, "timestamp | open\n1 | 2.5\n3 | 4.0")) == [(1, 2.5), (3, 4.0)]
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "ID string, timestamp long, x double")
    df.write.parquet(str(tmp_path / "p"))
    read = store.read_range(spark, str(tmp_path / "p"), ["x"], 3, 5, df.schema)
    assert read.columns == ["timestamp", "x"] and read.count() == 3
    store.write_feed_files(df, str(tmp_path / "f"), ["ID"], "timestamp")
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).count() == 10


# Nested records


def test_flat_predictions(spark, tmp_path):
    data = [{"key": "0x" + keccak256(k.encode()).hex(), "value": "0x" + v.encode().hex()} for k, v in (("pair", "ETH/USDT"), ("timeframe", "5m"), ("source", "kraken"))]
    contract = {"id": "0xab", "token": {"name": "ETH/USDT"}, "secondsPerEpoch": 300, "nftData": data}
    base = {"user": {"id": "u"}, "stake": 2.0, "slot": {"slot": 900, "predictContract": contract}}
    nested = [base | {"id": "a", "timestamp": 10, "payout": {"payout": 3.0, "trueValue": True, "predictedValue": False}}, base | {"id": "b", "timestamp": 20, "payout": None}, base | {"id": "c", "timestamp": 99, "payout": None}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, nested)))
    flat = graph.flat_predictions(graph.records(spark, graph.PREDICTION, str(tmp_path)), 5, 50, ["0xAB"])
    assert rows(flat, "ID", "contract", "timeframe", "source", "predvalue", "stake", "truevalue", "timestamp", "payout") == [
        ("a", "0xab", "5m", "kraken", False, 2.0, True, 10_000, 3.0),
        ("b", "0xab", "5m", "kraken", None, None, None, 20_000, None),
    ]
    assert rows(graph.pending_payouts(flat)) == [("0xab", [900])]


def test_slots_and_shared_slots(spark):
    df = spark.createDataFrame([("a", 100, "Pending", [], 1.0, 2.0), ("b", 100, "Pending", [("t", True)], 1.0, 2.0), ("c", 5, "Paying", None, None, None)], graph.SLOT)
    assert rows(graph.flat_slots(df), "ID", "truevalue") == [("a", None), ("b", True), ("c", None)]
    assert rows(graph.pending_slots(df, 200), "id") == [("a",)]
    pending = spark.createDataFrame([("x", [1, 2, 3]), ("y", [2, 3])], "contract string, slots array<long>")
    assert rows(graph.shared_slots(pending, 1)) == [(["x", "y"], 0, [2]), (["x", "y"], 1, [3]), (["x"], 0, [1])]


class Service(BaseHTTPRequestHandler):
    failures = 2

    def do_POST(self):  # noqa: N802
        v = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["variables"]
        if Service.failures:
            Service.failures -= 1
            self.send_response(500)
            self.end_headers()
            return
        found = [{"id": str(i), "slot": i, "status": "Paying", "trueValues": []} for i in range(v["start"], v["end"])]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"data": {"slots": found[v["skip"] : v["skip"] + v["first"]]}}).encode())

    def log_message(self, *_):
        pass


def test_pages_of_the_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    waits = []
    one = graph.post(url, {"variables": {"start": 0, "end": 1, "skip": 0, "first": 5}}, wait=waits.append)
    assert waits == [1, 4] and len(one["data"]["slots"]) == 1
    df = graph.records(spark, graph.SLOT, url=url, query="q", field="slots", start="0", end="25", step="10", first="4")
    assert rows(df, "slot") == sorted(((i,) for i in range(25)), key=repr) and df.rdd.getNumPartitions() == 3
    server.shutdown()
    with pytest.raises(OSError):
        graph.post("http://127.0.0.1:9/", {}, tries=2, wait=waits.append)


# Incremental enrichment


def events(spark):
    pred = [(f"c{i % 3}-{100 * i}-u", f"c{i % 3}", 100 * i, "u", "ETH/USDT", "5m", "x", i) for i in range(1, 31)]
    pay = [(f"c{i % 3}-{100 * i}-u", i + i % 5 * 3, 2.0 * i, True, i % 2 == 0, 1.0 * i) for i in range(1, 31) if i % 4] + [("c9-1-u", 4, 1.0, True, True, 1.0)]
    p = spark.createDataFrame(pred, "ID string, contract string, slot long, user string, pair string, timeframe string, source string, timestamp long")
    u = spark.createDataFrame(pay, "ID string, timestamp long, payout double, predvalue boolean, truevalue boolean, stake double")
    return p, u


VALUES = [c for c in bronze.BRONZE.names if c != "last_event_timestamp"]


def test_windows_give_what_one_batch_gives(spark):
    p, u = events(spark)
    one, many = bronze.run_windows(p, u, [0, 100]), bronze.run_windows(p, u, [0, 7, 15, 22, 100])
    assert rows(one, *VALUES) == rows(many, *VALUES)
    assert many.count() == 30 and many.where("payout is null").count() == 7


def test_store_replays_without_duplicates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bronze, "DAY_MS", 5)  # several parts
    p, u = events(spark)
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    assert s.read() is None and s.high_water() is None
    for end in (7, 15, 22, 100):
        s.update(p, u, end)
    done = rows(s.read(), *VALUES)
    assert rows(s.read(), *VALUES) == rows(bronze.run_windows(p, u, [0, 100]), *VALUES)
    before = s._state()["parts"]
    s.apply(bronze.new_events(p, 0, 4, True), bronze.update_events(u, 0, 1, True))
    changed = {d for d, f in s._state()["parts"].items() if before[d] != f}
    assert changed == {"0"}  # parts that no event touches stay where they are
    s.apply(bronze.new_events(p, 0, 100, True), bronze.update_events(u, 0, 100, True))
    assert rows(s.read(), *VALUES) == done and s.high_water() == 30
    with pytest.raises(ValueError):
        s.update(p, u, 5)


def test_merge_precedence(spark):
    p, u = events(spark)
    prod = bronze.merge(None, bronze.new_events(p, 0, 1, True), bronze.update_events(u, 0, 1, True))
    again = spark.createDataFrame([("c1-100-u", 50, 9.0, None, False, None)], u.schema)
    row = bronze.merge(prod, bronze.new_events(p, 99, 99, False), bronze.update_events(again, 0, 99, True)).first()
    assert (row.payout, row.truevalue, row.last_event_timestamp) == (9.0, False, 50)
    fresh = bronze.merge(None, bronze.new_events(p, 0, 99, True), bronze.update_events(u, 0, 99, True)).where("ID = 'c1-100-u'").first()
    assert fresh.last_event_timestamp == 1


def test_failure_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    p, u = events(spark)
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    s.update(p, u, 15)
    done = rows(s.read(), *VALUES)
    with monkeypatch.context() as m:
        m.setattr(bronze.BronzeStore, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.update(p, u, 100)
    assert rows(bronze.BronzeStore(spark, s.path).read(), *VALUES) == done and s.current() == 1
    s.update(p, u, 100)
    assert rows(s.read(), *VALUES) == rows(bronze.run_windows(p, u, [0, 100]), *VALUES)


def test_stream_adds_predictions_that_come_later(spark, tmp_path):
    p, u = events(spark)
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    for k, (most, test) in enumerate(((10, "timestamp <= 12"), (100, "timestamp > 12"))):
        u.where(test).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema(u.schema).json(str(tmp_path / "in"))
        known = p.where(f"timestamp <= {most}")
        bronze.stream(source, lambda t, known=known: known if t is None else known.where(f"timestamp > {t}"), s, str(tmp_path / "c")).awaitTermination(120)
        assert s.read().count() == min(most, 30) and s.current() == k + 1


def test_stream_equals_batch(spark, tmp_path):
    p, u = events(spark)
    u.repartition(3).write.json(str(tmp_path / "in"))
    s = bronze.BronzeStore(spark, str(tmp_path / "b"))
    source = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    bronze.stream(source, lambda t: p if t is None else p.where(f"timestamp > {t}"), s, str(tmp_path / "c")).awaitTermination(120)
    assert rows(s.read(), *VALUES) == rows(bronze.run_windows(p, u, [0, 100]), *VALUES)


def test_hours_of_a_stream_lose_rows_behind_the_watermark(spark, tmp_path):
    kind = "ts timestamp, value double"
    for k, stamps in enumerate((["10:05:00", "10:30:00", "13:00:00"], ["10:45:00", "12:55:00"], ["15:00:00"])):
        df = spark.createDataFrame([(f"2024-01-01 {t}", 1.0) for t in stamps], "ts string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "value")
        df.coalesce(1).write.json(str(tmp_path / f"in/b{k}"))
        source = spark.readStream.schema(kind).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        q = bronze.hourly_totals(source, "ts", "value").writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start().awaitTermination(120)
    got = {r.hour.hour: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[10] == 2 and got[12] == 1 and got[13] == 1  # 10:45 came more than ten minutes behind 13:00


def test_entry_and_queries_agree_in_names(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 70
    assert e.entry(spark).limit(1).count() == 1


# Steps of several tables, registry, runs


def test_steps_of_several_tables_take_effect_together(spark, catalog):
    a, b = (spark.createDataFrame([(n,)], "x int") for n in (1, 2))
    catalog.create(a, "both_a")
    catalog.create(a, "both_b")
    with pytest.raises(Exception):
        catalog.replace_all({"both_a": b, "both_b": b.select((F.col("x") / 0).alias("x"))})
    assert rows(spark.table("both_a")) == rows(spark.table("both_b")) == [(1,)]
    catalog.replace_all({"both_a": b, "both_b": spark.table("both_a")})
    assert rows(spark.table("both_a")) == [(2,)] and rows(spark.table("both_b")) == [(1,)]
    assert not [n for n in catalog.names() if "_old_" in n or "_new_" in n]
    catalog.update("both_a", spark.createDataFrame([(2, 5), (2, 7)], "x int, y int"), "x")
    assert spark.table("both_a").count() == 1


def test_registry_makes_and_fills_tables(spark, catalog):
    registry = store.Registry()
    registry.table("reg_raw", LOG)

    @registry.step("reg_raw")
    def some(session):
        return session.createDataFrame([("a", 1)], LOG)

    registry.run(catalog)
    registry.run(catalog)
    assert rows(spark.table("reg_raw")) == [("a", 1), ("a", 1)]
    assert checks.wrong_schemas({"reg_raw": spark.table("reg_raw")}, registry.schemas) == []
    assert checks.wrong_schemas({"reg_raw": spark.table("reg_raw").select("ID")}, registry.schemas | {"more": LOG}) == ["more", "reg_raw"]


def test_export_by_age_state_and_runs(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.createDataFrame([(i, i * 10) for i in range(4)], "timestamp long, v long")
    assert store.export(df, path, most_age=100) == 4 and store.export(df, path, most_age=100) == 0
    assert store.export(df.where("timestamp < 3"), path, most_age=-1) == 3 and spark.read.parquet(path).count() == 3
    assert store.export_due(spark, path, 10, now=100) and not store.export_due(spark, path, 1000, now=100)
    with pytest.raises(Exception, match="misspelt"):
        store.high_water(spark, path, "misspelt")
    assert store.load_state(spark, str(tmp_path / "s")) is None
    store.save_state(spark, str(tmp_path / "s"), {"a": [1, 2.5]})
    assert store.load_state(spark, str(tmp_path / "s")) == {"a": [1, 2.5]}
    for i in range(2):
        store.append_run(spark, str(tmp_path / "r"), i, {"profit": 1 / 3 + i}, {"lags": 2, "kind": "x"})
    assert sorted((r.run, r.profit, r.kind) for r in store.read_runs(spark, str(tmp_path / "r")).collect()) == [(0, 0.3333, "x"), (1, 1.3333, "x")]


def test_both_sinks_views_and_reports(spark, catalog, tmp_path):
    log = store.CsvLog(spark, str(tmp_path / "log"), LOG)
    store.append_to_both(spark.createDataFrame([("a", 1), ("a", 1)], LOG), log, catalog, "both_sinks")
    assert log.read().count() == spark.table("both_sinks").count() == 2
    checks.make_views(spark, {"v_one": spark.table("both_sinks"), "v_two": spark.table("both_sinks").unionAll(log.read())})
    assert spark.table("v_two").count() == 4 and checks.drop_views(spark, ["v_one", "v_two", "v_none"]) == ["v_one", "v_two"]
    checks.report_duplicates(log.read(), str(tmp_path / "d"))
    assert spark.read.option("header", True).csv(str(tmp_path / "d")).count() == 1
    assert checks.preview(log.read(), 1) == [{"ID": "a", "timestamp": 1}]
