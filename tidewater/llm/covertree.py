"""Hard negatives by inner product, from cover trees over norm-augmented candidates.

One more component gives all vectors of a block the same length, so that inner products
follow from distances on a sphere. A cover tree over them keeps for every node a row as its
centre and the distance within which all rows below it lie; centres of one parent keep a
distance that shrinks from level to level. The covering radius bounds the inner products
below a node from both sides. A search goes down from the node with the largest upper bound,
leaves out nodes outside of every window that still takes rows, and computes scores of the
rows in leaves exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidewater.llm.common import materialize, scratch
from tidewater.llm.vectors import BLOCK_QUERIES, BLOCK_ROWS, score_key, score_of, shown, whole

#: Ratio of the covering radii of two levels, most children of a node, and most rows of a leaf.
RATIO, CHILDREN, LEAF_ROWS = 1.3, 64, 256
#: Nodes that a search takes from its queue at first; then twice as many each time.
AT_ONCE = 4
#: Room for rounding, as a part of the product of two lengths.
ROOM = 1e-9
#: Integer sums below this are exact in doubles.
EXACT = float(1 << 53)


@dataclass
class CoverTree:
    """Nodes in arrays: centre, radius, first and number of children, first and last row of what lies below; rows are in the order of leaves."""

    points: np.ndarray  # integers as doubles, a row each
    ids: np.ndarray
    labels: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __post_init__(self) -> None:
        self.largest = float(np.abs(self.points).max(initial=0))
        self.centres = self.points[self.centre]
        with np.errstate(over="ignore"):
            self.length = float(np.sqrt((self.points**2).sum(axis=1).max(initial=0)))
        inner = list(zip(self.start, self.end, strict=True))
        self.least_label = np.array([self.labels[a:b].min() for a, b in inner])
        self.most_label = np.array([self.labels[a:b].max() for a, b in inner])


NODES = ("centre", "radius", "child", "children", "start", "end")


def grow(points: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of rows in the leaves of a cover tree over the rows of `points`, and the tree's NODES.

    A node's centre is its first child's too; each further centre is the first row that lies
    beyond 1 / RATIO of the node's radius from all centres so far, until there is none or
    there are CHILDREN, or fewer where leaves would hold few rows. Rows go to the nearest centre.
    The root's children are the labels with LEAF_ROWS rows or more, and all other rows. Radii
    are measured, so they hold in any case.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (points * points).sum(axis=1)
    most = squares.max(initial=0)
    if not np.isfinite(most * 4):  # lengths beyond doubles: one leaf, all rows exactly
        return np.arange(len(points)), {"centre": np.zeros(1, np.int64), "radius": np.array([np.inf]), "child": np.zeros(1, np.int64), "children": np.zeros(1, np.int64), "start": np.zeros(1, np.int64), "end": np.array([len(points)])}
    raised = np.c_[points, np.sqrt(np.maximum(most - squares, 0))]

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        d = raised[rows] - raised[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    everything = np.arange(len(points))
    root = int(np.argmin(((raised - raised.mean(axis=0)) ** 2).sum(axis=1)))
    nodes = [[root, 0.0, 0, 0, 0, len(points)]]
    order, below, at = everything.copy(), [everything], 0
    while at < len(nodes):
        rows, (centre, _, _, _, start, end) = below[at], nodes[at]
        near = distances(rows, centre)
        radius = nodes[at][1] = float(near.max())
        order[start:end] = rows
        if at == 0 and len(parts := _by_label(labels)) > 1:
            nodes[0][2:4] = 1, len(parts)
            for own in parts:
                nodes.append([int(own[0]), 0.0, 0, 0, start, start + len(own)])
                below.append(own)
                start += len(own)
        elif len(rows) > LEAF_ROWS and radius > 0:
            centres, of = [centre], np.zeros(len(rows), np.int64)
            most_children = min(CHILDREN, max(2, 2 * len(rows) // LEAF_ROWS))
            while len(centres) < most_children and (far := near > radius / RATIO).any():
                new = int(rows[far.argmax()])
                d = distances(rows, new)
                closer = d < near
                near[closer], of[closer] = d[closer], len(centres)
                centres.append(new)
            nodes[at][2:4] = len(nodes), len(centres)
            for i, c in enumerate(centres):
                own = rows[of == i]
                nodes.append([c, 0.0, 0, 0, start, start + len(own)])
                below.append(own)
                start += len(own)
        below[at] = None
        at += 1
    columns = np.array([[n[0], *n[2:]] for n in nodes], np.int64).T
    room = ROOM * math.sqrt(most)
    columns[0] = np.argsort(order)[columns[0]]  # places of rows in their new order
    return order, {"centre": columns[0], "radius": np.array([n[1] for n in nodes]) + room, "child": columns[1], "children": columns[2], "start": columns[3], "end": columns[4]}


def _by_label(labels: np.ndarray) -> list[np.ndarray]:
    """The rows of each label with LEAF_ROWS or more, then the others."""
    _, of, n = np.unique(labels, return_inverse=True, return_counts=True)
    group = np.where(n >= LEAF_ROWS, np.arange(len(n)), len(n))[of]
    return [np.flatnonzero(group == g) for g in np.unique(group)]


class Query:
    """One anchor's bounds and exact scores in one tree."""

    def __init__(self, tree: CoverTree, vector: np.ndarray):
        self.tree, self.vector = tree, vector
        with np.errstate(over="ignore", invalid="ignore"):
            self.length = float(np.sqrt(vector @ vector))
        largest = float(np.abs(vector).max(initial=0))
        self.exact = largest * tree.largest * max(1, len(vector)) < EXACT
        self.room = ROOM * (self.length * tree.length + 1)

    def bounds(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and most that an inner product with a row below each node can be.

        Both by the radius times the query's length, and on the sphere: with the query
        stretched to its radius, distances change by the covering radius at most.
        """
        radius = self.tree.radius[nodes]
        with np.errstate(over="ignore", invalid="ignore"):
            score = self.tree.centres[nodes] @ self.vector
            low, high = score - self.length * radius, score + self.length * radius
            if self.length > 0 and self.tree.length > 0:
                stretch = self.tree.length / self.length
                apart, slack = np.sqrt(np.maximum(2 * self.tree.length**2 - 2 * stretch * score, 0)), 2 * ROOM**0.5 * self.tree.length
                inside = apart - slack <= radius  # the query may lie within the covering radius
                high = np.fmin(high, np.where(inside, self.length * self.tree.length, score + ((apart + slack) * radius - radius**2 / 2) / stretch))
                low = np.fmax(low, score - ((apart + slack) * radius + radius**2 / 2) / stretch)
            return np.nan_to_num(low - self.room, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high + self.room, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def scores(self, start: int, end: int) -> np.ndarray:
        """The scores of rows from start to end."""
        found = self.tree.points[start:end]
        if self.exact:
            return (found @ self.vector).astype(np.int64)
        own = [int(x) for x in self.vector]
        out = np.empty(len(found), object)
        out[:] = [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in found.tolist()]
        return out

    def best_first(self, windows: list[Kept], wanted: Wanted) -> None:
        """Offer rows to the windows until no node can hold one that any of them takes.

        Nodes wait in the order of their upper bounds; a step takes the first few of them.
        """
        tree = self.tree
        nodes = np.zeros(1, np.int64)
        low, high = self.bounds(nodes)
        at_once = AT_ONCE
        while True:
            some = np.logical_or.reduce([w.takes(low, high) for w in windows])
            nodes, low, high = nodes[some], low[some], high[some]
            if not len(nodes):
                return
            order = np.argpartition(-high, at_once) if len(nodes) > at_once else np.arange(len(nodes))
            first, rest = nodes[order[:at_once]], order[at_once:]
            leaf = tree.children[first] == 0
            found = list(zip(tree.start[first[leaf]].tolist(), tree.end[first[leaf]].tolist(), strict=True))
            if found:
                scores = np.concatenate([self.scores(i, j) for i, j in found])
                ids, labels = (np.concatenate([x[i:j] for i, j in found]) for x in (tree.ids, tree.labels))
                own = wanted.rows(ids, labels)
                scores, ids = scores[own], ids[own]
                for w in windows:
                    w.offer(scores, ids)
            inner = first[~leaf]
            new = _ranges(tree.child[inner], tree.child[inner] + tree.children[inner])
            new = new[wanted.nodes(tree, new)]
            new_low, new_high = self.bounds(new)
            nodes, low, high = np.r_[nodes[rest], new], np.r_[low[rest], new_low], np.r_[high[rest], new_high]
            at_once *= 2


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after another."""
    sizes = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def _double(score: float) -> float:
    """A whole number as the nearest double; bounds have more room than that."""
    return float(score) if abs(score) < 1 << 1000 else math.inf if score > 0 else -math.inf


class Kept:
    """The k first rows of a window of scores: larger scores first, ties by smaller id."""

    def __init__(self, k: int, low: float = -math.inf, high: float = math.inf):
        self.k, self.low, self.high = k, low, high
        self.ends = _double(low), _double(high)
        self.best: list[tuple[int, int]] = []  # (score, -vec_id), the first one first

    def takes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Can rows with scores from low to high hold one that is taken?"""
        least = _double(self.best[-1][0]) if len(self.best) == self.k else self.ends[0]
        return (low <= self.ends[1]) & (np.minimum(high, self.ends[1]) >= least)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.best[-1][0] if len(self.best) == self.k else self.low
        some = np.flatnonzero((scores >= least) & (scores <= self.high))
        if len(some) > self.k:
            kth = np.partition(scores[some], len(some) - self.k)[len(some) - self.k]
            some = some[scores[some] >= kth]
        if len(some):
            self.best = heapq.nlargest(self.k, [*self.best, *zip(scores[some].tolist(), (-ids[some]).tolist(), strict=True)])


@dataclass(frozen=True)
class Wanted:
    """Rows of one label but for one id, or rows of all other labels."""

    label: int
    same: bool
    but: int

    def nodes(self, tree: CoverTree, nodes: np.ndarray) -> np.ndarray:
        least, most = tree.least_label[nodes], tree.most_label[nodes]
        return (least <= self.label) & (most >= self.label) if self.same else (least != self.label) | (most != self.label)

    def rows(self, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (labels == self.label) & (ids != self.but) if self.same else labels != self.label


def candidates(vectors: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, v): usable rows with a label, v the integers of the vector as doubles."""
    inf = F.lit(float("inf"))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = named.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    return usable.select("vec_id", "label", F.transform("v", whole).alias("v"))


def forest(rows: DataFrame, k: int) -> DataFrame:
    """(dim, cb, ...): a cover tree as a row for each block of about BLOCK_ROWS candidates.

    Of rows with equal vector and label those with the k + 1 smallest ids stay, up to k of
    each: no other can be among the first k of any anchor. Tasks drop the others before the
    shuffle, so a very common vector does not meet in one task.
    """
    counted = rows.groupBy("vec_id", "label", "v").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    w = Window.partitionBy("label", F.xxhash64("v"), "v").orderBy("vec_id")
    first = counted.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k + 1)
    first = materialize(first.select("vec_id", "label", "v", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")), "candidates")
    blocks = max(1, math.ceil(first.count() / BLOCK_ROWS))

    def build(key: tuple, found: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        lists = found["v"].combine_chunks()
        points = np.asarray(lists.flatten(), np.float64).reshape(len(found), dim)
        order, nodes = grow(points, found["label"].to_numpy())
        binary = {"points": points[order], "ids": found["vec_id"].to_numpy()[order], "labels": found["label"].to_numpy()[order]} | nodes
        return pa.table({"dim": pa.array([dim], pa.int32()), "cb": pa.array([key[1].as_py()], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in binary.items()})

    columns = ", ".join(f"{c} binary" for c in ("points", "ids", "labels", *NODES))
    placed = first.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "copy"), F.lit(blocks)).cast("int").alias("cb"), "vec_id", "label", "v")
    return materialize(placed.groupBy("dim", "cb").applyInArrow(build, f"dim int, cb int, {columns}"), "cover-trees")


def _tree(found: pa.Table, dim: int) -> CoverTree:
    one = {c: found[c][0].as_py() for c in ("points", "ids", "labels", *NODES)}
    read = {c: np.frombuffer(b, np.float64 if c in ("points", "radius") else np.int64) for c, b in one.items()}
    return CoverTree(**read | {"points": read["points"].reshape(len(read["ids"]), dim)})


def _search(asked: DataFrame, trees: DataFrame, look: Callable[[CoverTree, pa.Table], list[tuple]], columns: dict[str, pa.DataType]) -> DataFrame:
    """Every query in every tree of its dimension: look(tree, queries) for each block of queries and each tree."""
    n_q = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    at = asked.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int")).join(trees.select("dim", F.col("cb").alias("block")), "dim").withColumnRenamed("block", "cb")
    dealt = trees.select(*(F.col(c).alias(c) for c in trees.columns)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def run(key: tuple, queries: pa.Table, found: pa.Table) -> pa.Table:
        rows = look(_tree(found, key[0].as_py()), queries) if len(queries) and len(found) else []
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns.items())})

    by = ["dim", "qb", "cb"]
    return at.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(run, from_arrow_schema(pa.schema(list(columns.items()))))


def _vectors(queries: pa.Table) -> list[np.ndarray]:
    return [np.asarray(x.values, np.float64) for x in queries["v"].combine_chunks()]


def hard_negatives(
    vectors: DataFrame, label: Column, every: int = 100, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are the
    first `positives` rows of its label with another id; of the rows of other labels, the
    first `negatives` with least[0] * positive_score <= least[1] * negative_score and
    negative_score <= positive_score are given for each positive. Scores are inner products
    of floor(256 * component), larger ones first, ties by smaller id.

    Rows without id or label, and vectors that are null or hold null or non-finite components
    take no part; only rows with as many components as the anchor are compared with it. Every
    anchor row is an anchor: of repeated ids each with its own vector, and of wholly equal
    rows each gives all its rows. Repeated rows are positives and negatives one by one. An
    anchor without another row of its label, or a positive with a negative score, gives
    nothing. Scores beyond a long are compared exactly and shown as the nearest that fits.
    Extra columns are ignored; an empty table gives an empty result.
    """
    up, below = least
    k = max(positives, negatives)
    with scratch(vectors.sparkSession) as keep:
        rows = candidates(vectors, label, id_col, vec_col)
        trees = forest(rows, k)
        anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.count("*").alias("times"))
        anchors = keep(materialize(anchors.withColumn("dim", F.size("v")).withColumn("q", F.monotonically_increasing_id()), "anchors"))

        def near(tree: CoverTree, queries: pa.Table) -> list[tuple]:
            out = []
            for q, vec_id, own, v in zip(*(queries[c].to_pylist() for c in ("q", "vec_id", "label")), _vectors(queries), strict=True):
                kept = Kept(positives)
                Query(tree, v).best_first([kept], Wanted(own, True, vec_id))
                out += [(q, -i, score_key(s), shown(s)) for s, i in kept.best]
            return out

        def hard(tree: CoverTree, queries: pa.Table) -> list[tuple]:
            out = []
            for q, own, tops, v in zip(*(queries[c].to_pylist() for c in ("q", "label", "tops")), _vectors(queries), strict=True):
                windows = [Kept(negatives, -(-up * p // below), p) for p in map(score_of, tops) if p >= 0]
                if windows:
                    Query(tree, v).best_first(windows, Wanted(own, False, 0))
                out += [(q, score_key(w.high), -i, score_key(s), shown(s)) for w in windows for s, i in w.best]
            return out

        found = _search(anchors, trees, near, {"q": pa.int64(), "positive_id": pa.int64(), "top": pa.binary(), "positive_score": pa.int64()})
        w = Window.partitionBy("q").orderBy(F.desc("top"), "positive_id")
        first = keep(materialize(found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= positives).drop("n"), "positives"))
        tops = first.groupBy("q").agg(F.collect_set("top").alias("tops"))  # `positives` of each at most
        found = _search(anchors.join(tops, "q"), trees, hard, {"q": pa.int64(), "top": pa.binary(), "negative_id": pa.int64(), "score": pa.binary(), "negative_score": pa.int64()})
        w = Window.partitionBy("q", "top").orderBy(F.desc("score"), "negative_id")
        ranked = keep(materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives), "negatives"))
    both = anchors.select("q", F.col("vec_id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("long"), "times"))).join(first, "q").join(ranked, ["q", "top"])
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
