"""Distributions, coverage, pages, folders, candles of a service, and balanced training rows."""

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from statistics import NormalDist
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import normal
from tidewater.operators import checks, models, stats
from tidewater.sources import exchange, graph, store


def test_normal_distribution(spark):
    z = [-40.0, -8.0, -3.0, -0.5, 0.0, 0.1, 2.0, 7.2, 38.0]
    out = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal.cumulative(F.col("z")).alias("p"), normal.quantile(F.lit(0.975)).alias("q")).collect()
    for r in out:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-9, abs=1e-14)
        assert r.q == pytest.approx(1.959963984540054)


def test_keccak():
    assert normal.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert normal.keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert len({normal.keccak256(bytes(n)) for n in (135, 136, 137, 300)}) == 4


def test_distribution_equals_a_loop(spark):
    x = np.random.default_rng(1).normal(5, 2, 60).round(1)
    df = spark.createDataFrame([("f", float(v)) for v in x], "feed string, v double")
    factor, h = 60 ** -0.2, x.std(ddof=1) * 60 ** -0.2
    mesh = np.linspace(x.min() - x.std() / 2, x.max() + x.std() / 2, 11)
    pdf = [np.mean([NormalDist(v, h).pdf(m) for v in x]) for m in mesh]
    flat = [NormalDist(x.mean(), x.std()).pdf(m) for m in mesh]
    cdf = [np.mean([NormalDist().cdf((m - v) / factor) for v in x]) for m in mesh]
    out = stats.distribution(df, "v", 11).orderBy("i").collect()
    top = max(pdf + flat)
    np.testing.assert_allclose([r.x for r in out], mesh)
    np.testing.assert_allclose([r.pdf_kernel for r in out], np.array(pdf) / top, rtol=1e-9)
    np.testing.assert_allclose([r.pdf_normal for r in out], np.array(flat) / top, rtol=1e-9)
    np.testing.assert_allclose([r.cdf_kernel for r in out], cdf, rtol=1e-9)
    assert [r.cdf_normal for r in out] == sorted(r.cdf_normal for r in out)


def test_partial_autocorrelations_of_a_first_order_series(spark):
    rng, x = np.random.default_rng(3), [0.0]
    for _ in range(800):
        x.append(0.7 * x[-1] + rng.normal())
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(x)], "feed string, timestamp long, v double")
    out = {r.lag: r.pacf for r in stats.partial_autocorrelations(df, "v", 5).collect()}
    assert out[0] == 1.0 and abs(out[1] - 0.7) < 0.1 and all(abs(out[k]) < 0.12 for k in (2, 3, 4, 5))


def test_differences_take_the_unit_root_away(spark):
    x = 100 + np.random.default_rng(4).normal(size=400).cumsum()
    df = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(x)], "feed string, timestamp long, v double")
    out = {r["transform"]: r.stationary for r in stats.unit_root_variants(df, "v").collect()}
    assert out == {"none": False, "boxcox": False, "boxcox, difference": True, "boxcox, second difference": True}


def test_coverage_of_the_lake(spark):
    df = spark.createDataFrame([(10, 1.0), (20, float("nan")), (30, None)], "timestamp long, v double")
    assert checks.covers(df, 10).first() == (10, 30, True)
    assert not checks.covers(df, 9).first().covered
    assert not checks.covers(df.where("false"), 9).first().covered
    assert checks.has_nan(df, ["timestamp", "v"]).first() == (False, True, False, False)
    assert {tuple(r) for r in checks.latest({"a": df, "b": df.where("timestamp < 25")}).collect()} == {("a", 30), ("b", 20), ("all", 30)}


def test_a_page_that_runs_backwards_is_cut(spark):
    page = lambda ts: sorted(r.timestamp for r in graph.newest_first_cut(spark.createDataFrame(list(enumerate(ts)), "_page_row int, timestamp long")).collect())
    assert page([1, 3, 2, 5]) == [1, 2, 3, 5]
    assert page([5, 7, 2, 1]) == [5, 7]
    assert page([]) == []


def test_contract_info_without_data(spark):
    contract = "struct<token: struct<name: string>, secondsPerEpoch: long, nftData: array<struct<key: string, value: string>>>"
    data = [("0x" + normal.keccak256(b"pair").hex(), "0x" + b"A/B".hex())]
    df = spark.createDataFrame([((("X/Y",), 3600, None),), ((("X/Y",), 300, data),)], f"c {contract}")
    assert {tuple(r.i) for r in df.select(graph.contract_info(F.col("c")).alias("i")).collect()} == {("X/Y", "1h", "binance"), ("A/B", None, None)}


def test_true_value_batches(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("a", 2), ("b", 1)], "contract string, slot long")
    assert {(r.contract, r.batch, tuple(r.slots)) for r in graph.true_value_batches(df, 2).collect()} == {("a", 0, (1, 2)), ("a", 1, (3,)), ("b", 0, (1,))}


def test_folders_of_csv_and_parquet(spark, tmp_path):
    (tmp_path / "x.csv").write_text("close,timestamp\n1.5,10\n")
    spark.createDataFrame([(2.5, 20)], "close double, timestamp int").coalesce(1).write.parquet(str(tmp_path / "sub"))
    out = store.read_folder(spark, str(tmp_path), ["close", "timestamp"]).collect()
    assert sorted((r.close, r.timestamp) for r in out) == [(1.5, 10), (2.5, 20)] and "x" in {r.file for r in out}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        store.read_folder(spark, str(tmp_path / "none"), ["close"])


def test_statistics_file(spark, tmp_path):
    store.write_statistics(spark.createDataFrame([("a", 1.5)], "feed string, accuracy double"), str(tmp_path / "s"))
    assert store.read_statistics(spark, str(tmp_path / "s"), "feed string, accuracy double") == [{"feed": "a", "accuracy": 1.5}]


def test_replay_takes_what_the_table_lacks(spark, tmp_path):
    schema = T.StructType([T.StructField("ID", T.StringType()), T.StructField("timestamp", T.LongType())])
    log, catalog = store.CsvLog(spark, str(tmp_path / "log"), schema), store.Catalog(spark)
    spark.sql("DROP TABLE IF EXISTS replayed")
    log.append(spark.createDataFrame([("a", 1), ("b", 2)], schema))
    assert store.replay(log, catalog, "replayed") == 2
    log.append(spark.createDataFrame([("c", 3)], schema))
    assert store.replay(log, catalog, "replayed") == 1 and store.replay(log, catalog, "replayed") == 0
    assert catalog.row_count("replayed") == 3
    catalog.drop("replayed")


def test_candles_of_a_service(spark):
    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            ms = lambda t: int(np.datetime64(t.rstrip("Z"), "ms").astype(int))
            since, end = ms(q["start_time"]), ms(q["end_time"])
            times = [t for t in range(0, 1000, 100) if since <= t < end][: int(q["page_size"])]
            body = json.dumps({"result": "success", "data": [{"timestamp": t, **{k: None if t == 300 else str(t) for k in ("open", "high", "low", "close", "volume")}} for t in times]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/{exchange.market_path('binance', 'BTC/USDT', '5m')}"
        out = sorted((r.timestamp, r.close) for r in exchange.fetch(spark, "f", url=url, start="0", end="1000", step="500", page="2").collect())
    finally:
        server.shutdown()
    assert out == [(t, 200.0 if t == 300 else float(t)) for t in range(0, 1000, 100)]
    assert exchange.market_path("kraken", "ETH/USDT", "1h") == "kraken/spot/eth-usdt/aggregations/ohlcv?interval=1h"


def test_made_up_rows_lie_between_rare_ones(spark):
    rows = [("f", float(i), 0.0, 0) for i in range(20)] + [("f", 100.0 + i, 50.0, 1) for i in range(4)] + [("g", 1.0, 1.0, 1)]
    out = models.synthetic_oversample(spark.createDataFrame(rows, "feed string, x double, y double, label int"), ["x", "y"], "label", "feed").collect()
    rare = [r for r in out if r.feed == "f" and r.label == 1]
    assert len(rare) == 20 and sum(r.label == 0 for r in out) == 20 and sum(r.feed == "g" for r in out) == 1
    assert all(100 <= r.x <= 103 and r.y == 50 for r in rare)


def test_extended_trend_follows_a_line_to_both_ends(spark):
    season = [3.0, -1.0, -2.0, 0.0]
    df = spark.createDataFrame([("f", i, 2.0 * i + season[i % 4]) for i in range(20)], "feed string, timestamp long, v double")
    out = stats.seasonal(df, "v", 4, extend=True).orderBy("timestamp").collect()
    assert [r.trend for r in out] == pytest.approx([2.0 * i for i in range(20)])
    assert [r.season for r in out] == pytest.approx([season[i % 4] for i in range(20)])
    short = stats.seasonal(df.limit(3), "v", 4, extend=True).collect()
    assert len(short) == 3 and all(r.trend is None for r in short)
