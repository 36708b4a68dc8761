"""Exact top-k by integer inner product with a vector-approximation file.

The file keeps one byte per component: the cell that the component lies in. A scan of the
cells bounds every score from both sides; only rows whose upper bound reaches the k-th
largest lower bound are read exactly, in the order of their bounds, until the k-th result
is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize
from tidewater.llm.vectors import each_time, first_copies, grid, matrix, queries, score_key, shown, usable, whole

_QUERY_ROWS = 256
#: Rows that a query reads in one task on average; a query with more is read in parts.
PART_ROWS = 256


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the whole numbers of each vector, as doubles."""
    return usable(df, id_col, vec_col).select("vec_id", F.transform("v", whole).alias("v"))


def cell_edges(rows: DataFrame) -> np.ndarray:
    """257 edges of 256 cells: even ones where nearly all components lie, two wide ones outside.

    The edges are fit on all rows and change only how much is read, never the result.
    """
    ends = rows.where(F.size("v") > 0).select(F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))
    lo, hi, least, most = ends.agg(F.percentile_approx("lo", 0.01), F.percentile_approx("hi", 0.99), F.min("lo"), F.max("hi")).first()
    if lo is None:
        lo = hi = least = most = 0
    lo, hi = (float(np.clip(x, -1e150, 1e150)) for x in (lo, hi))
    inner = np.linspace(min(lo, hi), max(lo, hi) + 1, 255)
    return np.concatenate([[least - 1.0], inner, [max(most + 1.0, inner[-1])]])


def approximation_file(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """(vec_id, v) -> (vec_id, dim, cells: a byte per component, ints: whole numbers as little-endian doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = [np.asarray(x.values, np.float64) for x in b.column(1)]
            cells = [np.clip(np.searchsorted(edges, x, "right") - 1, 0, 255).astype(np.uint8).tobytes() for x in ints]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ints], pa.int32()), pa.array(cells, pa.binary()), pa.array([x.tobytes() for x in ints], pa.binary())], ["vec_id", "dim", "cells", "ints"])

    return rows.mapInArrow(run, "vec_id long, dim int, cells binary, ints binary")


def scan(k: int, edges: np.ndarray):
    """The scan of one tile: rows that may be among a query vector's best, with their bounds.

    The bounds leave room for rounding in double precision, in proportion to the sizes of the products.
    """
    centre, half = edges[:-1] / 2 + edges[1:] / 2, edges[1:] / 2 - edges[:-1] / 2
    half = half + 1e-9 * (np.abs(centre) + half)

    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            dim = int(key[0])
            cells, ids, row = matrix(rows["cells"], np.uint8, dim), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            enough = k + 1 + len(ids) - len(np.unique(ids))  # so many rows have k + 1 different ids
            mid, wide = centre[cells].T, half[cells].T
            for i in range(0, len(asked), _QUERY_ROWS):
                q_ids = asked["vec_id"].to_numpy()[i : i + _QUERY_ROWS]
                q = matrix(asked["ints"].iloc[i : i + _QUERY_ROWS], np.float64, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    score, gap = q @ mid, np.abs(q) @ wide + 1
                    low, high = np.nan_to_num(score - gap, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(score + gap, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                kth = np.partition(low, -enough, axis=1)[:, -enough] if low.shape[1] > enough else np.full(len(q), -np.inf)
                a, b = np.nonzero(high >= kth[:, None])
                out.append(pd.DataFrame({"q": q_ids[a], "row": row[b], "vec_id": ids[b], "low": low[a, b], "high": high[a, b]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("q", "row", "vec_id", "low", "high")})

    return run


def product(q: np.ndarray, x: np.ndarray) -> int:
    """The exact inner product of two vectors of whole numbers."""
    if not len(q) or float(np.abs(q).max()) * float(np.abs(x).max()) * len(q) < 1 << 53:
        return int(q @ x)
    return sum(int(a) * int(b) for a, b in zip(q.tolist(), x.tolist(), strict=True))


def refine(k: int):
    """Read a part of a query vector's rows from the largest upper bound down, until no further row can be among the k best of k + 1 different ids."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, int] = {}  # the k + 1 best ids so far, each with its largest score
        worst, found = None, []
        rows = rows.sort_values("high", ascending=False)
        q = np.frombuffer(rows["asked"].iloc[0], np.float64)
        for vec_id, high, ints in zip(rows["vec_id"].tolist(), rows["high"], rows["ints"], strict=True):
            if worst is not None and high < worst[0]:
                break
            score = product(q, np.frombuffer(ints, np.float64))
            if worst is not None and (score, -vec_id) < worst:
                continue
            found.append((score, vec_id))
            best[vec_id] = max(score, best.get(vec_id, score))
            if len(best) > k + 1:
                del best[min(best, key=lambda i: (best[i], -i))]
            if len(best) == k + 1:
                worst = min((s, -i) for i, s in best.items())
        kept = [(score_key(s), shown(s), i) for s, i in found if i in best]
        return pd.DataFrame({"q": rows["q"].iloc[0], "vec_id": [i for _, _, i in kept], "key": [k for k, _, _ in kept], "score": [s for _, s, _ in kept]})

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Queries are the rows whose id is divisible by `every`, candidates all rows with another
    id and the same number of components; ties go to the smaller id. Vectors that are null
    or hold null or non-finite components take no part, nor do rows without id. Scores beyond
    a long are compared exactly and shown as the nearest that fits. Repeated rows are one
    candidate each. Every row with such an id is a query, repeated ones too, and gives its own
    k rows; equal query vectors are searched for once. Extra columns are ignored, and an empty table
    gives an empty result.
    """
    rows = integers(vectors, id_col, vec_col)
    edges = cell_edges(rows)
    file = materialize(approximation_file(first_copies(rows, k), edges).withColumn("row", F.monotonically_increasing_id()), "cells")
    by_id = materialize(queries(rows, every).withColumn("of", F.monotonically_increasing_id()), "queries")
    different = materialize(by_id.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "query-vectors")
    named = materialize(by_id.join(different, "v").select(F.col("vec_id").alias("query_id"), "of", "times", "q"), "query-names")
    asked = materialize(approximation_file(different.select(F.col("q").alias("vec_id"), "v"), edges).select("vec_id", "dim", "ints"), "asked")
    cells, asked_at = grid(file.select("row", "vec_id", "dim", "cells"), asked)
    by = ["dim", "qb", "cb"]
    found = asked_at.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(scan(k, edges), "q long, row long, vec_id long, low double, high double")
    found = materialize(found, "bounds")
    w = Window.partitionBy("q").orderBy(F.desc("low"))
    kth = found.groupBy("q", "vec_id").agg(F.max("low").alias("low")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    kth = materialize(kth.groupBy("q").agg(F.min("low").alias("kth"), F.count("*").alias("n")), "kth")
    kept = materialize(found.join(kth, "q").where((F.col("n") <= k) | (F.col("high") >= F.col("kth"))).select("q", "row", "high"), "kept")
    parts = kept.groupBy("q").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).alias("part")
    dealt = kept.join(materialize(parts, "parts"), "q", "left").select("q", "row", "high", part)
    read = dealt.join(file.select("row", "vec_id", "dim", "ints"), "row").join(asked.select(F.col("vec_id").alias("q"), "dim", F.col("ints").alias("asked")), ["q", "dim"])
    best = read.groupBy("q", "part").applyInPandas(refine(k), "q long, vec_id long, key binary, score long")
    w = Window.partitionBy("q").orderBy(F.desc("top"), "vec_id")
    ids = best.groupBy("q", "vec_id").agg(F.max("key").alias("top"), F.slice(F.sort_array(F.collect_list(F.struct("key", "score")), asc=False), 1, k).alias("scores"))
    ids = ids.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    ids = materialize(ids.select("q", "vec_id", F.explode("scores").alias("s")).select("q", "vec_id", "s.key", "s.score"), "best")
    w = Window.partitionBy("of").orderBy(F.desc("key"), "vec_id")
    ranked = named.join(ids, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return each_time(ranked).select("query_id", "rank", "vec_id", "score")
