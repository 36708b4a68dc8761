"""What the vector searches share: usable rows, packed vectors and the grid of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries; a tile of the grid is one of each.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
#: floor(SCALE * x) is a component's integer.
SCALE = 256
_LONG = (1 << 63) - 1


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with v array<double>, without null vectors and those with null, NaN or infinite components."""
    inf = F.lit(float("inf"))
    v = F.col(vec_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))


def first_copies(df: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors those with the k + 1 smallest different ids, up to k of each.

    Ties go to the smaller id, so no other copy can be among the k best of any query, whose
    own id is one of them at most. Rows that repeat id and vector are counted first, and each
    task keeps k + 1 ids of a vector before the shuffle, so neither a very common row nor a
    very common vector meets in one task.
    """
    counted = df.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    w = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    first = counted.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k + 1)
    return first.select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def packed(df: DataFrame) -> DataFrame:
    """(vec_id, v, ...) -> (vec_id, dim, vec, ...) with vec as little-endian doubles."""
    rest = [n for n in df.columns if n not in ("vec_id", "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(x.values, np.float64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary()), *b.columns[2:]], ["vec_id", "dim", "vec", *rest])

    kinds = dict(df.dtypes)
    return df.select("vec_id", "v", *rest).mapInArrow(run, ", ".join(["vec_id long, dim int, vec binary", *(f"{n} {kinds[n]}" for n in rest)]))


def queries(df: DataFrame, every: int) -> DataFrame:
    """(vec_id, v, times): the rows whose id is divisible by `every`; wholly equal ones are one with their number."""
    return df.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))


def each_time(df: DataFrame) -> DataFrame:
    """A row as often as its `times` says."""
    return df.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_time")).drop("times", "_time")


def grid(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deal candidates and queries over the tiles of a grid, in columns cb and qb.

    A block has BLOCK_ROWS candidates or BLOCK_QUERIES queries on average, whatever the
    size of the table: more rows make more tiles, never larger ones.
    """
    blocks = lambda df, n: max(1, math.ceil(df.count() / n))
    n_c, n_q = blocks(rows, BLOCK_ROWS), blocks(asked, BLOCK_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    return rows.withColumn("cb", at(n_c)).withColumn("qb", every(n_q)), asked.withColumn("qb", at(n_q)).withColumn("cb", every(n_c))


def matrix(column, dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), dim)


def whole(x: Column) -> Column:
    """floor(SCALE * x) as a double, which holds it exactly; beyond the range of doubles the last one in it."""
    most = F.lit(1.7976931348623157e308)
    y = F.greatest(F.least(x * SCALE, most), -most)
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)


def score_key(score: int) -> bytes:
    """A whole number of any size as bytes that sort as numbers do."""
    n = (score.bit_length() + 7) // 8
    return (0x8000 + n).to_bytes(2) + score.to_bytes(n) if score >= 0 else (0x7FFF - n).to_bytes(2) + ((1 << 8 * n) - 1 + score).to_bytes(n)


def score_of(key: bytes) -> int:
    n, value = len(key) - 2, int.from_bytes(key[2:])
    return value if key[0] >= 0x80 else value + 1 - (1 << 8 * n)


def shown(score: int) -> int:
    """The long that is nearest to a score."""
    return max(-_LONG - 1, min(score, _LONG))
