"""Nearest neighbours by a block matrix join over int8 tiles.

Each vector is scaled to int8 within its tile and keeps the norm of what rounding took
away. One matrix product of the int8 blocks then bounds every distance of the tile from
both sides; pairs that the bounds cannot rule out are computed again in double precision
and kept in a heap per query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize
from tidewater.llm.vectors import each_time, first_copies, grid, matrix, packed, queries, usable

_QUERY_ROWS, _ROWS = 256, 2048


def _int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values as floats for the matrix product, scale, norm, and norm of the rounding error."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    whole = np.rint(x / scale[:, None])
    norm = lambda y: np.sqrt((y * y).sum(axis=1))
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integer sums stay exact in it
    return whole.astype(np.int8).astype(exact), scale, norm(x), norm(x - whole * scale[:, None])


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed over components in their order."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - c[:, j]
        total += d * d
    return np.sqrt(total)


def tile(k: int):
    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            dim = int(key[0])
            c_all, c_ids = matrix(rows["vec"], np.float64, dim), rows["vec_id"].to_numpy()
            c_int, c_scale, c_norm, c_err = _int8(c_all)
            for i in range(0, len(asked), _QUERY_ROWS):
                q_ids, q_rows = (asked[c].to_numpy()[i : i + _QUERY_ROWS] for c in ("vec_id", "q"))
                q = matrix(asked["vec"].iloc[i : i + _QUERY_ROWS], np.float64, dim)
                q_int, q_scale, q_norm, q_err = _int8(q)
                heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]  # (-distance, -vec_id): the worst first
                far = np.full(len(q), np.inf)  # the k-th smallest distance so far
                for j in range(0, len(rows), _ROWS):
                    s = slice(j, j + _ROWS)
                    with np.errstate(over="ignore", invalid="ignore"):
                        dot = (q_int @ c_int[s].T).astype(np.float64) * (q_scale[:, None] * c_scale[None, s])
                        off = q_norm[:, None] * c_err[None, s] + q_err[:, None] * (c_norm + c_err)[None, s]
                        both = q_norm[:, None] ** 2 + c_norm[None, s] ** 2
                        off = 2 * off + 1e-9 * both
                        low, high = both - 2 * dot - off, both - 2 * dot + off
                        own = q_ids[:, None] == c_ids[None, s]
                        high[own | np.isnan(high)] = np.inf
                        limit = far * far * (1 + 1e-9)
                        if high.shape[1] >= k:
                            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                        a, b = np.nonzero(~(low > limit[:, None]) & ~own)
                        d = distances(q[a], c_all[s][b])
                    for x, near, vec_id in zip(a.tolist(), d.tolist(), c_ids[s][b].tolist(), strict=True):
                        heap = heaps[x]
                        if len(heap) < k:
                            heapq.heappush(heap, (-near, -vec_id))
                        else:
                            heapq.heappushpop(heap, (-near, -vec_id))
                        if len(heap) == k:
                            far[x] = -heap[0][0]
                out += [(int(i), -v, -d) for i, heap in zip(q_rows, heaps, strict=True) for d, v in heap]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by Euclidean distance.

    Queries are the rows whose id is divisible by `every`, candidates all rows with another
    id and the same number of components; ties go to the smaller id. The bounds are certain,
    so recall is 1. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without id. Repeated rows are one candidate each; every row with
    such an id is a query, repeated ones too, and gives its own k rows. Extra columns are ignored, and an empty table
    gives an empty result. Distances beyond the range of doubles are infinite.
    """
    rows = usable(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    blocks = materialize(packed(first_copies(rows, k)), "blocks")
    asked = materialize(packed(queries(rows, every)).withColumn("q", F.monotonically_increasing_id()), "queries")
    cells, asked_at = grid(blocks, asked)
    by = ["dim", "qb", "cb"]
    found = asked_at.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(tile(k), "q long, vec_id long, score double")
    w = Window.partitionBy("q").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = each_time(asked.select("q", F.col("vec_id").alias("query_id"), "times"))
    return best.join(named, "q").select("query_id", "rank", "vec_id", "score")
