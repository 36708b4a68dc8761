"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Masks come from the covering construction for radius r: every bit position gets a nonzero
vector of r + 1 bits, and table v (each nonzero vector of r + 1 bits) keeps the positions
whose vector has an odd inner product with v. The vectors of r or fewer differing positions
span less than the whole space, so some v is orthogonal to all of them: that table masks
every difference out and the pair shares its bucket. No pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewater.llm.common import columns_of, materialize, row_key, scratch
from tidewater.llm.components import connected_components

SEED = 42
BITS = 64
RADIUS = 2
_CHUNK = 1 << 15


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than
    `width` is one shingle; a text without words, or null, has fingerprint zero.
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp, columns to keep) for every row; fp is the fingerprint as a signed long."""
    keep = keep or {}
    names = ["doc_id", "fp", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp, *b.columns[2:]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary"), *(c.alias(n) for n, c in keep.items()))
    kept = "".join(f", {n} {t}" for n, t in rows.dtypes[2:])
    return rows.mapInArrow(run, f"doc_id long, fp long{kept}")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per table, as signed longs."""
    size = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if bin(v & (1 + i % size)).count("1") % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) links that connect exactly the fingerprints within RADIUS bits.

    `fps` holds each fingerprint once, in column fp. Buckets of two are compared directly.
    In a larger bucket every fingerprint is listed under itself and under each string one
    masked-out bit away: two fingerprints within two bits share such a string, and all that
    share one are within two bits of each other. So a bucket costs rows in proportion to
    its size, however many pairs it holds, and a string has at most one member per bit.
    """
    masks = covering_masks()
    entry = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for t, m in enumerate(masks)))
    entries = fps.select("fp", F.explode(entry).alias("e")).select("fp", "e.t", "e.m")
    buckets = materialize(entries.groupBy("t", "m").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(BITS) if not m >> i & 1)) for m in masks))
    near = (
        entries.join(buckets.where("n > 2").select("t", "m"), ["t", "m"])
        .select("t", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
        .agg(F.min("fp").alias("src"), F.collect_set("fp").alias("all"))
        .where(F.size("all") > 1)
        .select("src", F.explode("all").alias("dst"))
        .where("src <> dst")
    )
    return pairs.union(near).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_copies, root and `keep` for every row of docs.

    Two rows are linked when their fingerprints differ in at most RADIUS bits; component_id
    is the smallest doc_id that links reach, a row's own included. Rows with equal
    fingerprints are one node, so copies never make pairs. n_copies counts the rows with
    the row's fingerprint, root is the component's smallest fingerprint as a long. A null or wordless text has fingerprint zero and is linked like
    any other; repeated rows stay repeated; a row with null doc_id takes part and gives no
    id (component_id is null if the whole component has none). Other columns are ignored,
    but for those given in `keep` by the name that they get.
    An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width, keep), "fingerprints")
    with scratch(docs.sparkSession) as keep_table:
        classes = keep_table(_classes(fps))
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies", "root", *(keep or {}))


def _classes(fps: DataFrame) -> DataFrame:
    """fp, component_id, n_copies, root of each fingerprint."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "nodes")
    found = connected_components(links(nodes.select("fp")))
    placed = materialize(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    smallest = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return materialize(placed.join(smallest, "root").select("fp", "component_id", "n_copies", "root"), "classes")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with all columns, but of each component only the row with the smallest doc_id.

    Of rows that repeat this doc_id the one with the smallest hash stays, and of wholly
    equal rows one. A component whose ids are all null keeps one row too.
    """
    keys = dict(zip(("k1", "k2"), row_key(F.col(id_col), F.col(text_col)), strict=True))
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "k1", "k2")
    first = near_duplicates(docs, id_col, text_col, width, keys).groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.k1").alias("__k1"), F.col("w.k2").alias("__k2"))
    w = Window.partitionBy("__k1", "__k2").orderBy("__k1")
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), keys["k1"].alias("__k1"), keys["k2"].alias("__k2"))
    kept = rows.join(first, ["__k1", "__k2"], "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return kept.select("row.*")
