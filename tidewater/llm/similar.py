"""Near-duplicates by the Jaccard similarity of their sets of five-word shingles.

Two sources give pairs, which are then compared exactly, by their sets of 64-bit hashes of
shingles: the covering tables of simhash.py over a fingerprint of the set, which miss no
pair of neighbours within RADIUS bits, and bands of minimum hashes for pairs that are less
alike. With BANDS bands of ROWS functions a pair of similarity s meets in some bucket with
probability 1 - (1 - s ** ROWS) ** BANDS: 0.999 at 0.8, more above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewater.llm import simhash
from tidewater.llm.common import columns_of, forget, materialize, row_key, scratch, sieve
from tidewater.llm.components import connected_components

SEED = 42
WIDTH = 5
BANDS, ROWS = 18, 5
_CHUNK = 512
_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than
    WIDTH is one shingle; a text without words, or null, has none.
    """
    words = (data or b"").lower().split()
    n = len(words)
    if n < WIDTH:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if n else [], np.uint64)
    by = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    total = sum(by[i : n - WIDTH + 1 + i] * _PLACE[i] for i in range(WIDTH))
    return np.unique((total ^ (total >> np.uint64(29))) * _PLACE[0])


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed long: a bit is set that is so in over half of them."""
    ones = np.zeros(simhash.BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band of a set that is not empty."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for i in range(0, len(short), _CHUNK):
        x = short[i : i + _CHUNK] ^ _FLIP
        x *= _TIMES
        np.minimum(least, x.min(axis=1), out=least)
    keys = (least * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return (keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(rows: DataFrame) -> DataFrame:
    """The text in column text gives way to node (hash of its set), size and fingerprint of the set and bands; no text without words has a band."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, fp, keys = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py())
                node.append(_signed(xxh64_intdigest(s.tobytes(), SEED)) if len(s) else 0)
                size.append(len(s))
                fp.append(fingerprint(s) if len(s) else None)
                keys.append(bands(s) if len(s) else [])
            new = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *new], [*others, "node", "size", "fp", "bands"])

    return rows.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in rows.dtypes if n != "text"), "node long, size long, fp long, bands array<long>"]))


def _sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, set) of each of the nodes, made from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "set"])

    nodes = materialize(nodes.select("node", "k1", "k2"), "to-compare")
    of = sieve(texts, nodes, ["k1"]).join(nodes, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "text")
    return materialize(of.mapInArrow(run, "node long, set array<long>"), "sets")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the (src, dst) pairs with a similarity of 0.8 or more."""
    both = pairs.distinct().join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
    return materialize(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("src", "dst"), "links")


def _fits(a, b):
    """No similarity exceeds the quotient of the sizes."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _covered(nodes: DataFrame) -> DataFrame:
    """(src, dst) pairs that join the nodes whose fingerprints the covering tables of simhash.py link."""
    nodes = nodes.select("node", "fp").where("fp is not null")
    fps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(fps, "fp").where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst"))
    near = simhash.links(fps.select("fp")).join(fps.toDF("src", "a"), "src").join(fps.toDF("dst", "b"), "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return same.union(near)


def _links(nodes: DataFrame, texts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(src, dst) links with the components of all similar pairs that share a bucket or are in `more`.

    First the members of a bucket are compared with the most central one: the member whose
    own buckets are the largest. Then what this leaves apart is compared too: pairs of a
    bucket whose ends are in different components, see _apart().
    """
    entries = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = entries.join(materialize(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes"), "key")
    shared = materialize(shared, "entries")
    weights = materialize(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    lead = F.max_by("node", "weight").alias("lead"), F.max_by("size", "weight").alias("lead_size")  # of one row: both follow the same comparisons
    buckets = materialize(shared.join(weights, "node").groupBy("key").agg(*lead), "buckets")
    pair = F.least("node", "lead").alias("src"), F.greatest("node", "lead").alias("dst")
    stars = shared.join(buckets, "key").where("node <> lead").where(_fits(F.col("size"), F.col("lead_size"))).select(*pair)
    if more is not None:
        more = materialize(more.distinct(), "covered")
        stars = stars.union(more)
    ends = weights.select("node")
    ends = ends.union(more.select("src")).union(more.select("dst")).distinct() if more is not None else ends
    sets = _sets(nodes.join(materialize(ends, "ends"), "node"), texts)
    found = _alike(stars, sets)
    return found.union(_alike(_apart(shared.where("n > 2"), buckets, found, sets), sets))


def _apart(shared: DataFrame, buckets: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a bucket that `found` leaves in different components and that may be similar, none missed.

    Only buckets that hold several components matter. Similar texts share at least
    4 / 9 of the sum of their sizes. Of a text's shingles those count that the bucket's
    central member has, and those that some other text of such buckets has: what neither
    has, no partner can have. So a pair's common shingles are bounded by the
    smaller counts of both kinds, and a member whose own counts are too small has no
    partner. Only members outside the largest component of the bucket look for partners.
    """
    roots = materialize(connected_components(found), "roots")
    placed = shared.join(buckets.select("key", "lead"), "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed.select("key", "node", "size", "root", "lead"), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main"), F.min("least").alias("least")).where("parts > 1")
    members = materialize(placed.join(materialize(mixed.drop("parts"), "mixed"), "key"), "members")
    own = sets.join(materialize(members.select("node").distinct(), "member-nodes"), "node")
    tokens = materialize(own.select("node", F.explode("set").alias("token")), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    common = materialize(tokens.join(materialize(common, "common-tokens"), "token").groupBy("node").agg(F.collect_list("token").alias("common")), "common")
    pairs = materialize(members.select("node", "lead").distinct(), "led")
    known = pairs.join(own.toDF("node", "a"), "node").join(sets.toDF("lead", "b"), "lead").join(common, "node", "left")
    none = F.array().cast("array<long>")
    counts = known.select("node", "lead", F.size(F.array_intersect("a", "b")).alias("with_lead"), F.size(F.array_except(F.coalesce("common", none), "b")).alias("beside"))
    open_ = members.join(materialize(counts, "counts"), ["node", "lead"]).where("node <> lead")
    open_ = open_.where(9 * (F.col("with_lead") + F.col("beside")) >= 4 * (F.col("size") + F.greatest(F.col("least"), F.ceil(F.col("size") * 4 / 5))))
    open_ = materialize(open_.select("key", "node", "size", "root", "main", "with_lead", "beside"), "open")
    keys = materialize(open_.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys")), "keys")
    open_ = open_.join(keys, "node")
    right = open_.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "size", "root", "with_lead", "beside", "keys")))
    may = 9 * (F.least("with_lead", "with_lead2") + F.least("beside", "beside2")) >= 4 * (F.col("size") + F.col("size2"))
    once = (F.col("root2") == F.col("main")) | (F.col("node") < F.col("node2"))
    first = F.get(F.array_intersect("keys", "keys2"), 0) == F.col("key")  # a pair of several buckets counts in one
    rest = open_.where("root <> main").join(right, "key").where(once & (F.col("root") != F.col("root2")) & _fits(F.col("size"), F.col("size2")) & may & first)
    return rest.select(F.least("node", "node2").alias("src"), F.greatest("node", "node2").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, component_id, root and `keep` for every row of docs.

    Two rows are linked when the sets of their shingles have a similarity of 0.8 or more and
    share a bucket or a covering table of their fingerprints; component_id is the smallest doc_id that links reach, a row's own
    included, and root the component's smallest node. Rows with equal sets are one node, so
    copies never make pairs; texts without words, and nulls, are one node too. Repeated rows
    stay repeated; a row with null doc_id takes part and gives no id. `keep` is as in
    simhash.near_duplicates(). An empty table gives an empty result.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    k1, k2 = row_key(F.col(id_col), text)
    keep = keep or {}
    rows = docs.select(doc_id.alias("doc_id"), k1.alias("__k1"), k2.alias("__k2"), text.cast("binary").alias("text"), *(c.alias(n) for n, c in keep.items()))
    fps = materialize(_nodes(rows), "shingled")
    one = F.min(F.struct("__k1", "__k2")).alias("one")
    nodes = fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), one)
    nodes = materialize(nodes.select("node", "least", "size", "fp", "bands", F.col("one.__k1").alias("k1"), F.col("one.__k2").alias("k2")), "nodes")
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text.cast("binary").alias("text"))
    with scratch(docs.sparkSession) as keep_table:
        found = connected_components(_links(nodes, texts, _covered(nodes)))
        placed = materialize(nodes.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        smallest = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
        classes = keep_table(materialize(placed.join(smallest, "root").select("node", "component_id", "root"), "classes"))
    forget(docs.sparkSession, nodes)
    return fps.drop("size", "fp", "bands", "__k1", "__k2").join(classes, "node").select("doc_id", "component_id", "root", *keep)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, but of each component only the row with the smallest doc_id, as in simhash.one_of_each()."""
    keys = dict(zip(("k1", "k2"), row_key(F.col(id_col), F.col(text_col)), strict=True))
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "k1", "k2")
    first = near_duplicates(docs, id_col, text_col, keys).groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.k1").alias("__k1"), F.col("w.k2").alias("__k2"))
    w = Window.partitionBy("__k1", "__k2").orderBy("__k1")
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), keys["k1"].alias("__k1"), keys["k2"].alias("__k2"))
    kept = rows.join(first, ["__k1", "__k2"], "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return kept.select("row.*")
