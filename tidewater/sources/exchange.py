"""Candles of an exchange's HTTP service as a data source.

The `candlepages` source asks for one stretch of time per partition and follows the pages
of each. Rows come as the service has them; settle() fills candles without trades.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewater.operators.series import SIGNALS, settle_nulls

SCHEMA = "timestamp long, open double, high double, low double, close double, volume double"
#: Exchanges that the service calls by another name.
NAMES = {"binance": "binc"}


def market_path(exchange: str, pair: str, timeframe: str) -> str:
    """The service's path: base and quote of the pair in lower case, joined by a hyphen."""
    base, quote = (side.strip().lower() for side in pair.split("/"))
    return f"{NAMES.get(exchange, exchange)}/spot/{base}-{quote}/aggregations/ohlcv?interval={timeframe}"


class Stretch(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class CandleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.key = options["url"], options.get("key", "")
        self.start, self.end = int(options["start"]), int(options["end"])
        self.step, self.page, self.tries = int(options.get("step", 86_400_000)), int(options.get("page", 1000)), int(options.get("tries", 3))

    def partitions(self) -> list[Stretch]:
        return [Stretch(a, min(a + self.step, self.end)) for a in range(self.start, self.end, self.step)] or [Stretch(self.start, self.start)]

    def _get(self, since: int, end: int) -> list[dict]:
        """Candles from since on, oldest first; at most `page`."""
        stamp = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        query = urllib.parse.urlencode({"page_size": self.page, "start_time": stamp(since), "end_time": stamp(end), "sort": "asc"})
        answer = self._json(query)
        if answer.get("result") == "error":
            raise ValueError(answer.get("message"))
        return answer["data"]

    def _json(self, query: str):
        request = urllib.request.Request(self.url + ("&" if "?" in self.url else "?") + query, headers={"X-Api-Key": self.key})
        for i in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=60) as f:
                    return json.load(f)
            except (OSError, ValueError):
                if i == self.tries:
                    raise
                time.sleep(i * i)
        raise ValueError("no tries")

    def read(self, partition: Stretch) -> Iterator[tuple]:
        since = partition.start
        while since < partition.end:
            rows = [r for r in self._get(since, partition.end) if since <= int(r["timestamp"]) < partition.end]
            for r in rows:
                yield (int(r["timestamp"]), *(None if r[k] is None else float(r[k]) for k in SIGNALS))
            if len(rows) < self.page:
                return
            since = int(rows[-1]["timestamp"]) + 1


class SinceReader(CandleReader):
    """A service that is asked for so many candles since a time and answers with lists of time and values."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.symbol, self.timeframe = options["symbol"], options["timeframe"]

    def _get(self, since: int, end: int) -> list[dict]:
        found = self._json(urllib.parse.urlencode({"symbol": self.symbol, "timeframe": self.timeframe, "since": since, "limit": self.page}))
        return [dict(zip(("timestamp", *SIGNALS), r, strict=True)) for r in found]


class CandlePages(DataSource):
    """Options: url, key, start and end in ms, step of a partition in ms, page (rows of an answer), tries.

    With api=since also symbol and timeframe: the service has no end of a stretch, so an
    answer may reach beyond it and what lies there is left to the next stretch.
    """

    @classmethod
    def name(cls) -> str:
        return "candlepages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CandleReader:
        api = self.options.get("api", "pages")
        if api not in READERS:
            raise ValueError(f"no such service: {api}")
        return READERS[api](self.options)


#: Kinds of services by the name of option `api`.
READERS = {"pages": CandleReader, "since": SinceReader}


def fetch(spark: SparkSession, feed: str, path: str | None = None, **options: str) -> DataFrame:
    """feed and candles, from parquet, or from the service if no path is given; gaps without trades are settled."""
    if path is not None:
        raw = spark.read.schema(SCHEMA).parquet(path)
    else:
        spark.dataSource.register(CandlePages)
        raw = spark.read.format("candlepages").options(**options).load()
    return settle_nulls(raw.select(F.lit(feed).alias("feed"), "*"), "close", SIGNALS).withColumnRenamed("slot_ms", "timestamp")
