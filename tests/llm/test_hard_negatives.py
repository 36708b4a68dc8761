"""Hard negatives against brute force, and the cover tree's bounds."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import covertree, vectors


def whole(v):
    return [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]


def brute(rows, every, k, n, up=80, below=100):
    used = [(i, label, whole(v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    clamp = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
    for i, label, v in used:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in used if len(w) == len(v)), key=lambda x: x[:2])
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:k]:
            hard = [(-t, m) for t, m, other in scored if other != label and up * -s <= below * -t <= below * -s][:n]
            out += [(i, j, r, m, clamp(-s), clamp(t)) for r, (t, m) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("q", F.lit("x")).withColumn("dim", F.lit(9)).withColumn("cb", F.lit(0))
    got = covertree.hard_negatives(df, F.col("label"), **kw)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def some_rows(n, seed=1, labels=4, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, int(rng.integers(labels)), [float(x) for x in centres[i % 5] + rng.normal(size=dim) / 4]) for i in range(n)]
    rows += [(1000 + i, i % labels, rows[0][2]) for i in range(60)]  # one vector many times
    rows += [(2000, 1, None), (2010, None, [1.0] * dim), (None, 1, [1.0] * dim), (2020, 2, [1.0, None] * (dim // 2)), (2030, 2, [math.nan] * dim), (2040, 2, [math.inf] * dim), (2050, 1, [0.0] * dim), (2060, 1, [1.0, 2.0]), (2070, 1, []), (2071, 1, []), (2072, 2, [])]
    return rows


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = some_rows(300)
    want = brute(rows, 10, 5, 5)
    assert len(want) > 500
    assert mined(spark, rows, every=10) == want
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 50)
    monkeypatch.setattr(covertree, "BLOCK_QUERIES", 7)
    assert mined(spark, rows, every=10, positives=3, negatives=4) == brute(rows, 10, 3, 4)


def test_every_row_is_an_anchor_a_positive_and_a_negative(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (0, 1, [0.0, 1.0]), (0, 2, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.9, 0.9]), (2, 2, [0.9, 0.9]), (3, 3, [1.0, 1.0])]
    assert mined(spark, rows, every=10) == brute(rows, 10, 5, 5)


def test_large_components_are_compared_exactly(spark):
    rows = [(0, 1, [2.0**40, 1.0]), (1, 1, [2.0**40, 1.0]), (2, 2, [2.0**40, 0.5]), (3, 3, [2.0**40, 0.25]), (4, 3, [2.0**40, 0.75]), (10, 5, [1e200, 0.0]), (11, 5, [1e200, 3.0]), (12, 6, [1e200, 1.0]), (13, 7, [0.9e200, 2.0])]
    assert mined(spark, rows, every=10) == brute(rows, 10, 5, 5)


def test_anchors_without_positives_and_negative_scores(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.9])]) == []
    assert mined(spark, [(0, 1, [0.0]), (1, 1, [5.0]), (2, 2, [7.0])]) == [(0, 1, 1, 2, 0, 0)]


def test_search_skips_most_rows_of_far_groups():
    rng = np.random.default_rng(2)
    points = np.floor(256 * (np.repeat(rng.normal(size=(40, 8)) * 3, 250, axis=0) + rng.normal(size=(10_000, 8)) / 50))
    labels = np.arange(10_000) % 2
    order, nodes = covertree.grow(points, labels)
    tree = covertree.CoverTree(points[order], order, labels[order], **nodes)
    seen = []
    query = covertree.Query(tree, points[0])
    scores = query.scores
    query.scores = lambda i, j: (seen.append(j - i), scores(i, j))[1]
    kept = covertree.Kept(5)
    query.best_first([kept], covertree.Wanted(0, True, 0))
    exact = sorted(((int(points[i] @ points[0]), -i) for i in range(2, 10_000, 2)), reverse=True)[:5]
    assert kept.best == exact
    assert sum(seen) < 4_000  # of 5,000 with the label


@given(st.integers(0, 10**6), st.integers(1, 5), st.floats(0, 12))
@settings(max_examples=40, deadline=None)
def test_covering_radii_bound_inner_products(seed, dim, size):
    rng = np.random.default_rng(seed)
    points = np.floor(10**size * rng.normal(size=(700, dim)))
    labels = rng.integers(0, 3, 700)
    order, nodes = covertree.grow(points, labels)
    assert sorted(order.tolist()) == list(range(700))
    tree = covertree.CoverTree(points[order], order, labels[order], **nodes)
    query = covertree.Query(tree, np.floor(10 ** rng.uniform(0, 12) * rng.normal(size=dim)))
    low, high = query.bounds(np.arange(len(tree.radius)))
    for i, (a, b) in enumerate(zip(tree.start, tree.end, strict=True)):
        own = tree.points[a:b] @ query.vector
        assert low[i] <= own.min() and own.max() <= high[i]


def test_keys_sort_as_numbers_do():
    rng = random.Random(3)
    numbers = [0, 1, -1, 255, 256, -255, -256, *(rng.choice((1, -1)) * rng.getrandbits(rng.randrange(2200)) for _ in range(500))]
    assert [vectors.score_of(k) for k in sorted(map(vectors.score_key, numbers))] == sorted(numbers)
    assert vectors.shown(1 << 70) == (1 << 63) - 1 and vectors.shown(-(1 << 70)) == -(1 << 63)


def test_whole_is_the_floor(spark):
    values = [0.0, -0.001, 0.999, 1e12 + 0.3, -1e15, 1e300, -1.7e308, 5e-324]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(vectors.whole(F.col("x"))).collect()]
    assert got[:-2] == pytest.approx([float(math.floor(256 * v)) for v in values[:-2]], rel=0)
    assert got[-2] == -1.7976931348623157e308 and got[-1] == 0
