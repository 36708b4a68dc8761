import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import models


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.1 * rng.normal(size=300) > 0.5).astype(int)
    data = [(float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1)]
    return spark.createDataFrame(data, "a double, b double, y int").repartition(2).cache()


@pytest.mark.parametrize("name", ["logistic", "logistic_balanced", "linear_svc", "forest", "forest_balanced", "naive_bayes"])
def test_classifiers_find_the_feature(frame, name):
    model = models.fit(frame, ["a", "b"], "y", name)
    out = models.scores(model, frame, ["a", "b"])
    means = {r.y: r.s for r in out.groupBy("y").agg(F.avg("score").alias("s")).collect()}
    assert out.count() == 300 and means[1] > means[0]
    assert name == "naive_bayes" or models.weights(model, ["a", "b"])["a"] > 0.8


def test_calibration_and_permutation(frame):
    model = models.fit(frame, ["a", "b"], "y", "linear_svc")
    scored = models.scores(model, frame, ["a", "b"])
    assert models.calibrate(scored, "y", "isotonic").transform(scored).where("calibrated < 0 or calibrated > 1").count() == 0
    assert "calibrated" in models.calibrate(scored, "y").transform(scored).columns
    assert models.permutation_weights(model, frame, ["a", "b"], "y", repeats=2)["a"] > 0.8
    ensemble = models.cross_calibrate(frame, ["a", "b"], "y", "linear_svc", folds=2)
    out = models.probability(ensemble, frame, ["a", "b"])
    means = {r.y: r.s for r in out.groupBy("y").agg(F.avg("calibrated").alias("s")).collect()}
    assert out.count() == 300 and out.columns == [*frame.columns, "calibrated"] and means[1] > 0.7 > 0.3 > means[0]


def test_regressors(frame):
    df = frame.withColumn("t", 2 * F.col("a") + 1)
    for name in ("linear", "lasso", "huber"):
        out = models.scores(models.fit(df, ["a", "b"], "t", name, models.REGRESSORS), df, ["a", "b"])
        assert out.agg(F.corr("t", "score")).first()[0] > 0.99
