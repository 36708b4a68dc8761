"""Bootstrap ensembles, densities on a grid, p-values and footers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import ensembles, stats
from tidewater.sources import store


def counted(key, model):
    h = int(hashlib.md5(f"{key}-{model}".encode()).hexdigest()[:8], 16)
    return sum(s <= h for s in ensembles.poisson_steps())


def test_counts_are_poisson_numbers(spark):
    df = spark.range(4000).withColumn("w", ensembles.poisson(F.col("id"), F.lit(3)))
    got = [r.w for r in df.orderBy("id").collect()]
    assert got == [counted(i, 3) for i in range(4000)]
    shares = np.bincount(got, minlength=5)[:5] / 4000
    assert shares == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=0.03)


def test_models_equal_weighted_regressions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=300)
    rows = [("f", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    rows += [("f", 900, None, 1.0, 1.0), ("f", 901, math.nan, 1.0, 1.0), ("g", 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "feed string, key long, a double, b double, y double")
    got = {(r.feed, r.model): r for r in ensembles.fit(df.repartition(5), "feed", "key", ["a", "b"], "y", 6).collect()}
    for m in range(6):
        w = np.array([counted(i, m) for i in range(300)])
        design = np.c_[np.ones(300), x]
        want = np.linalg.solve(design.T @ (design * w[:, None]) + 1e-6 * np.eye(3), design.T @ (w * y))
        assert got["f", m].weights == pytest.approx(want, rel=1e-9) and got["f", m].n == w.sum()
        assert (("g", m) in got) == (counted(1, m) > 0)
    weights = ensembles.fit(df, "feed", "key", ["a", "b"], "y", 6)
    found = ensembles.prob_above(df.where("feed = 'f'"), weights, "feed", ["a", "b"], F.lit(1.5)).collect()
    for r in found:
        if r.a is None:
            assert r.prob is None
        elif r.a == r.a:
            assert r.prob == np.mean([np.dot(got["f", m].weights, [1.0, r.a, r.b]) > 1.5 for m in range(6)])


def test_models_do_not_depend_on_the_place_of_rows(spark):
    df = spark.range(200).select(F.lit("f").alias("feed"), "id", (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    a, b = (sorted((r.model, r.n, tuple(r.sums)) for r in ensembles.normal_equations(d, "feed", "id", ["x"], "y", 4).collect()) for d in (df, df.repartition(7, "x")))
    assert a == b


@pytest.mark.parametrize("cells", [16, 256, 2048])
def test_the_error_of_the_grid_is_within_its_bound(spark, cells):
    rng = np.random.default_rng(2)
    rows = [("f", float(v)) for v in rng.gamma(2, size=700)] + [("g", float(v)) for v in rng.normal(size=50)] + [("g", None)]
    df = spark.createDataFrame(rows, "feed string, v double")
    exact = {(r.feed, r.i): r.density for r in stats.kernel_density(df.where("v is not null"), "v", 40).collect()}
    binned = stats.binned_density(df, "v", 40, cells).collect()
    assert len(binned) == len(exact) == 80
    worst = max(abs(r.density - exact[r.feed, r.i]) / r.bound for r in binned)
    assert 0 < worst <= 1


def test_p_values_of_the_unit_root_test(spark):
    known = {-3.43: 0.01, -2.86: 0.05, -2.57: 0.10, -19.0: 0.0, 3.0: 1.0, 0.0: 0.958}
    got = spark.createDataFrame([(t,) for t in known], "t double").withColumn("p", stats.dickey_fuller_p(F.col("t"))).collect()
    assert {r.t: r.p for r in got} == pytest.approx(known, abs=0.0015)
    line = [r.p for r in spark.range(-180, 27).select(stats.dickey_fuller_p(F.col("id") / 10).alias("p")).collect()]
    assert all(a <= b + 1e-3 for a, b in zip(line, line[1:]))


def test_newest_time_comes_from_footers(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(5000).select((F.col("id") * 7 % 4999).alias("timestamp"), F.lit(1.0).alias("v")).repartition(3).write.parquet(path)
    found = store.newest(spark, path)
    plan = found._jdf.queryExecution().toString()
    assert "PushedAggregation: [MAX(timestamp)]" in plan and "PushedGroupBy: []" in plan
    assert found.first()[0] == store.high_water(spark, path) == 4998
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false" and "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    assert store.high_water(spark, str(tmp_path / "none")) is None
