"""Tables and files of the lake: create, append, delete, export, log and cache."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a file that a compaction aims at.
FILE_BYTES = 128 << 20
LAYERS = ("bronze_", "silver_", "gold_")
STAGES = ("_temp_update_", "_temp_", "_new_events_", "_update_events_")


def is_etl_table(name: str) -> bool:
    """Does the name, without a stage in front, belong to an enriched layer?"""
    for s in STAGES:
        name = name.removeprefix(s)
    return name.startswith(LAYERS)


class Catalog:
    """Named tables of the session's catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.tableType != "TEMPORARY")

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def row_count(self, name: str) -> int:
        return self.spark.table(name).count()

    def create_empty(self, name: str, schema: T.StructType) -> None:
        if not self.exists(name):
            self.create(self.spark.createDataFrame([], schema), name)

    def create(self, df: DataFrame, name: str) -> None:
        df.write.saveAsTable(name)

    def insert(self, df: DataFrame, name: str) -> None:
        """Append by position; the table is made if it is missing."""
        if self.exists(name):
            df.write.insertInto(name)
        else:
            self.create(df, name)

    def replace(self, df: DataFrame, name: str) -> None:
        """New rows for a table that df may itself read: written aside, then swapped in."""
        self.replace_all({name: df})

    def replace_all(self, frames: dict[str, DataFrame]) -> None:
        """Several tables replaced together: all are written aside first, then swapped in by renames.

        What there was stays under another name until all are in place, and comes back if a
        rename fails. So a step of several tables takes effect as a whole or not at all.
        """
        mark = uuid.uuid4().hex[:8]
        try:
            for name, df in frames.items():
                self.create(df, f"{name}_new_{mark}")
        except Exception:
            for name in frames:
                self.drop(f"{name}_new_{mark}")
            raise
        moved: list[tuple[str, str]] = []
        try:
            for name in frames:
                for a, b in ((name, f"{name}_old_{mark}"), (f"{name}_new_{mark}", name)):
                    if self.exists(a):
                        self.spark.sql(f"ALTER TABLE {a} RENAME TO {b}")
                        moved.append((a, b))
        except Exception:
            for a, b in reversed(moved):
                self.spark.sql(f"ALTER TABLE {b} RENAME TO {a}")
            for name in frames:
                self.drop(f"{name}_new_{mark}")
            raise
        for name in frames:
            self.drop(f"{name}_old_{mark}")

    def move(self, source: str, target: str) -> None:
        self.insert(self.spark.table(source), target)
        self.drop(source)

    def delete_common(self, name: str, reference: DataFrame, key: str = "ID") -> None:
        """Delete the rows whose key the reference has."""
        self.replace(self.spark.table(name).join(reference.select(key).distinct(), key, "left_anti").select(self.spark.table(name).columns), name)

    def update(self, name: str, changes: DataFrame, key: str) -> None:
        """Set the columns that `changes` has, where it has the key; of several changes of a key the largest counts."""
        old = self.spark.table(name)
        others = [c for c in changes.columns if c != key]
        changes = changes.groupBy(key).agg(F.max(F.struct(*others)).alias("_x")).select(key, "_x.*")
        new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key), F.lit(True).alias("_hit"))
        cols = [F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in new.columns else F.col(c) for c in old.columns]
        self.replace(old.join(new, key, "left").select(cols), name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def truncate_from(self, start: int, etl: bool, column: str = "timestamp") -> dict[str, tuple[int, int]]:
        """Drop rows from a time on in all raw or all enriched tables; rows before and after of each."""
        out = {}
        for name in self.names():
            df = self.spark.table(name)
            if is_etl_table(name) == etl and column in df.columns:
                before = df.count()
                self.replace(df.where(F.col(column) < start), name)
                out[name] = (before, self.row_count(name))
        return out

    def query(self, sql: str, **frames: DataFrame) -> DataFrame | None:
        """A query, over DataFrames in it as {name}; None where a table is missing."""
        try:
            df = self.spark.sql(sql, **frames)
            return df
        except AnalysisException as e:
            if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                return None
            raise

    def scalar(self, sql: str):
        row = self.query(sql).first()
        return row[0] if len(row) == 1 else tuple(row)


def high_water(spark: SparkSession, path: str, column: str = "timestamp") -> int | None:
    """The largest time in exported files, none where nothing is exported.

    It comes from the statistics in the files' footers; no column is read.
    """
    try:
        found = newest(spark, path, column)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found.first()[0]


def newest(spark: SparkSession, path: str, column: str = "timestamp") -> DataFrame:
    """The maximum of a column of parquet files, as an aggregate that the reader answers from footers.

    Spark does so for its second kind of file sources only and when it is told to; both are
    set in a session of its own, so the caller's stays as it is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.max(column))


def export_due(spark: SparkSession, path: str, seconds: float, column: str = "timestamp", now: float | None = None) -> bool:
    """Is the newest exported time (ms) at least so many seconds ago?"""
    return (time.time() if now is None else now) - (high_water(spark, path, column) or 0) / 1000 >= seconds


def export(df: DataFrame, path: str, column: str = "timestamp", most_files: int | None = None, most_age: float | None = None) -> int:
    """Append what is newer than the exported files; rewrite all when there are more than `most_files`.

    With `most_age`, as for enriched tables whose old rows change, all is also rewritten once
    the oldest exported file is more than so many seconds old.
    """
    spark = df.sparkSession
    if most_age is not None and (old := _oldest(spark, path)) is not None and time.time() - old > most_age:
        df.write.mode("overwrite").parquet(path)
        return df.count()
    done = high_water(spark, path, column)
    if done is not None and most_files is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        needed = 1 + size // FILE_BYTES  # a large table keeps as many files as its size asks for
        if len(spark.read.parquet(path).inputFiles()) > max(most_files, needed):
            df.repartitionByRange(needed, column).write.mode("overwrite").parquet(path)
            return df.count()
    rows = df if done is None else df.where(F.col(column) > done)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def _oldest(spark: SparkSession, path: str) -> float | None:
    """When the oldest parquet file of a folder was written, in seconds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return min((s.getModificationTime() / 1000 for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")), default=None)


_RANGE = re.compile(r"from=(-?\d+)-to=(-?\d+)")


class CsvLog:
    """An append-only log of CSV folders that carry their time range in the name."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, rows: int = 1000, column: str = "timestamp"):
        self.spark, self.path, self.schema, self.rows, self.column = spark, path, schema, rows, column
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def append(self, df: DataFrame) -> None:
        lo, hi = df.agg(F.min(self.column), F.max(self.column)).first()
        if lo is not None:
            sorted_ = df.select(self.schema.names).repartitionByRange(self.column).sortWithinPartitions(self.column)
            sorted_.write.option("maxRecordsPerFile", self.rows).option("header", True).csv(f"{self.path}/from={lo}-to={hi}-{uuid.uuid4().hex[:8]}")

    def folders(self, start: int | None = None, end: int | None = None) -> list[str]:
        """Folders whose range meets [start, end]."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        held = [(n, *map(int, m.groups())) for n in names if (m := _RANGE.match(n))]
        return sorted(f"{self.path}/{n}" for n, lo, hi in held if (end is None or lo <= end) and (start is None or hi >= start))

    def read(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows in [start, end]; folders outside of it are not opened."""
        found = self.folders(start, end)
        df = self.spark.read.schema(self.schema).option("header", True).csv(found) if found else self.spark.createDataFrame([], self.schema)
        for limit, test in ((start, F.col(self.column).__ge__), (end, F.col(self.column).__le__)):
            df = df if limit is None else df.where(test(limit))
        return df

    def last(self) -> int | None:
        """The largest time, from names alone."""
        return max((int(_RANGE.search(f)[2]) for f in self.folders()), default=None)


class QueryCache:
    """Results of queries as parquet, used again until they are too old."""

    def __init__(self, spark: SparkSession, path: str, seconds: float):
        self.spark, self.path, self.seconds = spark, path, seconds

    def get(self, name: str, make) -> DataFrame:
        at = f"{self.path}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p) or time.time() - fs.getFileStatus(p).getModificationTime() / 1000 >= self.seconds:
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)


def write_feed_files(df: DataFrame, path: str, keys: list[str], order: str) -> None:
    """One folder of CSV per feed, sorted by time."""
    df.repartition(*keys).sortWithinPartitions(*keys, order).write.partitionBy(*keys).option("header", True).mode("append").csv(path)


def read_range(spark: SparkSession, path: str, columns: list[str], start: int, end: int, schema: T.StructType) -> DataFrame:
    """Candles in [start, end]: columns and range reach the scan."""
    return spark.read.schema(schema).parquet(path).select("timestamp", *(c for c in columns if c != "timestamp")).where(F.col("timestamp").between(start, end))


def to_frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """Rows of one class as a table, checked against its schema."""
    if len({type(r) for r in rows}) > 1:
        raise TypeError("rows of more than one class")
    return spark.createDataFrame([tuple(getattr(r, n) for n in schema.names) for r in rows], schema, verifySchema=True)


def read_piped(spark: SparkSession, text: str) -> DataFrame:
    """A small table written with | between columns, its first line the header."""
    lines = spark.createDataFrame([(x.strip(),) for x in text.strip().splitlines()], "value string")
    return spark.read.option("sep", "|").option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(lines.rdd.map(lambda r: r.value))


def read_folder(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of all CSV and parquet files below a folder, with the name of each row's file."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+$", 1).alias("file")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, kinds, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), set(), []
    while files.hasNext():
        kinds.add(files.next().getPath().getName().rpartition(".")[2])
    for kind in sorted(kinds & {"csv", "parquet"}):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
        df = reader.option("header", True).option("inferSchema", True).csv(path) if kind == "csv" else reader.parquet(path)
        found.append(df.select(name, *columns))
    if not found:
        raise FileNotFoundError(f"no CSV or parquet files below {path}")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def write_statistics(df: DataFrame, path: str) -> None:
    """A statistics table as lines of JSON, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def read_statistics(spark: SparkSession, path: str, schema: str) -> list[dict]:
    """What a statistics service answers: the lines as records; a report is one row per feed."""
    return [r.asDict(True) for r in spark.read.schema(schema).json(path).collect()]


def replay(log: CsvLog, catalog: Catalog, table: str) -> int:
    """Rows of the log that are newer than the table go into it; returns how many there were."""
    done = catalog.scalar(f"SELECT max({log.column}) FROM {table}") if catalog.exists(table) else None
    newer = log.read(done)
    newer = newer if done is None else newer.where(F.col(log.column) > done)
    n = newer.count()
    if n:
        catalog.insert(newer, table)
    return n


def append_to_both(df: DataFrame, log: CsvLog, catalog: Catalog, table: str) -> None:
    """New rows go into the log first and then into the table; replay() brings in what a failure leaves out."""
    log.append(df)
    catalog.insert(df, table)


def append_run(spark: SparkSession, path: str, run: int, figures: dict[str, float], point: dict[str, object]) -> None:
    """One row of a sweep: its number, its figures to four digits and its settings, as CSV with a header."""
    shown = {"run": run} | {k: f"{v:.4f}" for k, v in figures.items()} | {k: f"{v:.4f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for k, v in point.items()}
    spark.createDataFrame([tuple(str(v) for v in shown.values())], ", ".join(f"`{k}` string" for k in shown)).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """A dictionary of plain values as one JSON text, replaced as a whole."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict | None:
    """What save_state() wrote last, None where there is nothing."""
    try:
        return json.loads(spark.read.text(path).first()[0])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class Registry:
    """The tables of the lake with their schemas, and the steps that fill them, in order."""

    def __init__(self) -> None:
        self.schemas: dict[str, T.StructType] = {}
        self.steps: list[tuple[str, Callable[[SparkSession], DataFrame]]] = []

    def table(self, name: str, schema: T.StructType) -> None:
        self.schemas[name] = schema

    def step(self, name: str) -> Callable:
        """Register a function of the session that gives a table its new rows."""

        def put(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
            self.steps.append((name, f))
            return f

        return put

    def create(self, catalog: Catalog) -> None:
        """Make the registered tables that are missing."""
        for name, schema in self.schemas.items():
            catalog.create_empty(name, schema)

    def run(self, catalog: Catalog) -> None:
        """All steps in order; a step's rows are appended."""
        self.create(catalog)
        for name, f in self.steps:
            catalog.insert(f(catalog.spark), name)
