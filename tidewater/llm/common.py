"""Shared-folder tables and the reading of input tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of the bitmap that keeps rows out of a join: 4 MB.
SIEVE_BITS = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    The cluster names it in spark.checkpoint.dir; a temporary one is set only where
    nothing is set, as in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for the application."""
    return f"{shared_dir(spark)}/tidewater-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: work before it is not repeated when an executor is lost or
    when several later steps read it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Paths that materialize() wrote within each open scratch().
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() writes within are deleted at its end, but for those handed to the function that it gives."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_at)
        return df

    _SCRATCH.append([])
    try:
        yield keep
    finally:
        for path in _SCRATCH.pop():
            if path in kept:
                if _SCRATCH:
                    _SCRATCH[-1].append(path)
            else:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that materialize() returned and that nothing reads any more."""
    _delete(spark, df.written_at)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that this application's operators wrote in the shared folder."""
    _delete(spark, f"{shared_dir(spark)}/tidewater-{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that tell rows apart by what they hold, also where doc_id is null or repeated."""
    parts = [doc_id.isNull(), doc_id.cast("string"), text.isNull(), text]  # a hash alone skips nulls
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def sieve(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """rows without most of those whose columns `by` are not in keys; none of the others is lost.

    Keys set bits in a bitmap of SIEVE_BITS bits, which is all that is broadcast, however
    many keys there are. Where they fill it, rows pass that a join drops later.
    """
    at = F.pmod(F.xxhash64(*by), F.lit(SIEVE_BITS))
    part, bit = F.floor(at / 32768).alias("__part"), (at % 32768).alias("__bit")
    bits = keys.select(part, bit).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bits = materialize(bits, "sieve")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumns({"__part": part, "__bit": bit}).join(F.broadcast(bits), "__part")
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (F.col("__bit") % 8 + 1).cast("int"))
    return found.where(byte.bitwiseAND(mask) != 0).select(*rows.columns)
