"""Order statistics, nearest rows and made-up rows against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import selection


def feeds():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(size=3000).tolist(), "few": [2.0, 1.0], "one": [7.0], "equal": [3.0] * 500, "ties": rng.integers(0, 4, 900).astype(float).tolist(),
        "skewed": (10.0 ** rng.uniform(-200, 200, 1200)).tolist(), "hot": [5.0] * 1000 + rng.normal(size=500).tolist() + [None, math.nan],
    }


@pytest.mark.parametrize("bins", [4, 4096])
def test_quantiles_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    df = spark.createDataFrame([(f, v) for f, vs in feeds().items() for v in vs] + [("none", None)], "feed string, v double")
    at = [0.0, 0.013, 0.5, 0.999, 1.0]
    got = {(r.feed, r.p): r.value for r in selection.quantiles(df, "v", at).collect()}
    for f, vs in feeds().items():
        known = [v for v in vs if v is not None and not math.isnan(v)]
        for p in at:
            assert got.pop((f, p)) == pytest.approx(np.quantile(known, p), rel=1e-9, abs=1e-12)
    assert not got


def test_order_statistics_of_longs_are_exact(spark):
    rng = np.random.default_rng(6)
    values = sorted(int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 2000))
    df = spark.createDataFrame([("f", v) for v in values], "feed string, v long")
    ranks = spark.createDataFrame([("f", r) for r in (0, 1, 999, 1998, 1999, 2000)] + [("g", 0)], "feed string, rank long")
    got = {(r.feed, r["rank"]): r.found for r in selection.order_statistics(df, ranks, "feed", "v").collect()}
    assert {k: v for k, v in got.items() if v is not None} == {("f", r): values[r] for r in (0, 1, 999, 1998, 1999)}


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_rows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(selection, "BLOCK_ROWS", block)
    monkeypatch.setattr(selection, "AT_ONCE", 5)
    rng = np.random.default_rng(8)
    rows = [("a", i, rng.integers(0, 5, 2).astype(float).tolist()) for i in range(60)] + [("b", 100, [1.0, 1.0]), ("c", 200, [1.0, 1.0]), ("c", 201, [1.0, 1.0])]
    got = selection.nearest_rows(spark.createDataFrame(rows, "feed string, id long, x array<double>"), "feed", 4).collect()
    want = []
    for f, i, x in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for g, j, y in rows if g == f and j != i)[:4]
        want += [(f, i, r, j, d) for r, (d, j) in enumerate(near, 1)]
    assert sorted((r.feed, r.id, r["rank"], r.other, r.far) for r in got) == sorted(want)


def test_made_up_rows(spark):
    rng = np.random.default_rng(9)
    rare = [("f", float(a), float(b), 1) for a, b in rng.normal(size=(17, 2))] + [("f", 9.0, 9.0, 1)] * 5
    rows = rare + [("f", float(i), 0.0, 0) for i in range(75)] + [("g", 1.0, 1.0, 1), ("g", 2.0, 1.0, 0), ("h", 1.0, 1.0, 0), ("f", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "feed string, x double, y double, label int")
    made = selection.oversample(df, ["x", "y"], "label", "feed", neighbours=3, seed=4)
    out = [tuple(r) for r in made.collect()]
    assert out and sorted(out) == sorted(tuple(r) for r in made.repartition(3).collect())
    assert Counter((r[0], r[3]) for r in out) == {("f", 0): 75, ("f", 1): 75, ("g", 1): 1, ("g", 0): 1, ("h", 0): 1}
    points = np.array([r[1:3] for r in rare])
    new = Counter(out) - Counter(rows)
    assert sum(new.values()) + sum((Counter(out) & Counter(rows)).values()) == len(out)
    for (_, x, y, _), _ in new.items():  # on the line to one of the three nearest
        found = False
        for i, p in enumerate(points):
            order = [j for j in np.argsort(((points - p) ** 2).sum(axis=1), kind="stable") if j != i]
            far = ((points[order[2]] - p) ** 2).sum()
            for j in order:
                if ((points[j] - p) ** 2).sum() <= far + 1e-12:
                    d = points[j] - p
                    t = 0.0 if not d.any() else float(((x, y) - p) @ d / (d @ d))
                    found |= -1e-9 <= t <= 1 + 1e-9 and np.allclose(p + t * d, (x, y), atol=1e-9)
        assert found, (x, y)
    assert made.where(F.col("label") == 1).count() == 76
