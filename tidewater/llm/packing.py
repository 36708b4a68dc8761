"""Best-fit packing of documents into sequences, with conflicts.

Two documents conflict if they share a source or a duplicate cluster; a bin holds at most
one of each. Bins are ordered by what room they have left and carry a bitmap of sources
and clusters. A piece goes to the tightest bin that takes it: the search starts at the
smallest sufficient room and goes on to the next larger until the bitmaps do not clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, row_key

CAPACITY = 2048
#: Documents packed together on average; more documents make more shards, not larger ones.
SHARD_DOCS = 4096


def count_words(text: Column) -> Column:
    """Runs without ASCII white space; none for null."""
    words = F.split(text, r"[ \t\n\x0B\f\r]+")
    return F.coalesce(F.size(words) - F.when(F.element_at(words, 1) == "", 1).otherwise(0) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0), F.lit(0)).cast("long")


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece, in order. Sizes must not exceed the capacity."""
    open_: list[tuple[int, int]] = []  # (room, bin), ascending
    held: list[int] = []
    out = []
    for size, mask in zip(sizes, masks, strict=True):
        i = bisect_left(open_, (size, -1))
        while i < len(open_) and held[open_[i][1]] & mask:
            i += 1
        if i < len(open_):
            room, b = open_.pop(i)
        else:
            room, b = capacity, len(held)
            held.append(0)
        held[b] |= mask
        out.append((b, capacity - room))
        if room > size:
            insort(open_, (room - size, b))
    return out


def _bits(values: pd.Series, first: int = 0) -> tuple[list[int], int]:
    """One bit for each value that more than one row has; rows with another or no value conflict with none."""
    counts = values.value_counts()
    at = {v: first + i for i, v in enumerate(sorted(counts[counts > 1].index))}
    return [1 << at[v] if v in at else 0 for v in values], first + len(at)


def pack_shard(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "k1", "k2"], kind="stable", ignore_index=True)
        source, n = _bits(rows["source"])
        cluster, _ = _bits(rows["cluster"], n)
        full = (rows["n_tokens"] // capacity).astype(int)
        doc, start, size = [], [], []
        for i, (whole, total) in enumerate(zip(full, rows["n_tokens"], strict=True)):
            cuts = [*range(0, whole * capacity, capacity)] + ([whole * capacity] if total % capacity or not total else [])
            doc += [i] * len(cuts)
            start += cuts
            size += [min(capacity, total - c) for c in cuts]
        order = sorted(range(len(doc)), key=lambda j: (-size[j], doc[j], start[j]))
        placed = best_fit([size[j] for j in order], [source[doc[j]] | cluster[doc[j]] for j in order], capacity)
        where = np.zeros((len(doc), 2), np.int64)
        where[order] = placed
        at = rows.loc[doc].reset_index(drop=True)
        return pd.DataFrame({
            "doc_id": at["doc_id"], "source": at["source"], "cluster": at["cluster"], "n_tokens": at["n_tokens"], "piece_start": start, "piece_tokens": size,
            "bin_id": (int(key[0]) << 32) + where[:, 0], "bin_offset": where[:, 1],
        })

    return run


PACKED = "doc_id long, source string, cluster long, n_tokens long, piece_start long, piece_tokens long, bin_id long, bin_offset long"


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document, with its bin and its offset there.

    `rows` has doc_id, source, cluster and n_tokens, and k1, k2 that tell rows apart. A
    document longer than the capacity is cut into full pieces and a rest; its pieces
    conflict with each other like any of one source. Each shard is packed by itself in
    one task, largest pieces first; documents go to shards by hash, so a frequent source
    or cluster is spread over all of them, and rows that repeat go there one by one. A null source or cluster conflicts with
    nothing. A document without words is one piece of size zero. Repeated rows are packed
    like any others, and an empty table gives an empty result.
    """
    rows = materialize(rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("long"), F.col("n_tokens").cast("long"), "k1", "k2", F.monotonically_increasing_id().alias("number")), "pieces")
    shards = max(1, math.ceil(rows.count() / SHARD_DOCS))
    again = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "repeated-rows")
    rows = rows.join(again, ["k1", "k2"], "left").withColumn("number", F.when(F.col("n").isNotNull(), F.col("number")).otherwise(F.lit(0).cast("long"))).drop("n")
    return rows.groupBy(F.pmod(F.xxhash64("k1", "k2", "number"), F.lit(shards)).alias("shard")).applyInPandas(pack_shard(capacity), PACKED)


def sized(docs: DataFrame, cluster: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What pack() needs of a table of documents."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), count_words(text).alias("n_tokens"), *row_key(doc_id, text))
