"""Features, ensembles and walk-forward back-tests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1e-6) -> np.ndarray:
    """Weights of a linear model, the first one the constant."""
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(a.T @ a + penalty * np.eye(a.shape[1]), a.T @ y)


def ensemble(x: np.ndarray, y: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Weights of `size` models on resampled rows."""
    picks = rng.integers(0, len(x), (size, len(x)))
    return np.array([ridge(x[p], y[p]) for p in picks])


def prob_above(weights: np.ndarray, x: np.ndarray, threshold: float) -> float:
    """Share of the models that predict more than the threshold."""
    return float((weights[:, 0] + weights[:, 1:] @ x > threshold).mean())


def walk_forward(candles: DataFrame, lags: int, train: int, steps: int | None = None, size: int = 10, refit: int = 1, by: tuple[str, ...] = ("feed",)) -> DataFrame:
    """For the last `steps` rows of each run, or all after the first `train`: the probability of a rise, from models of the rows before.

    Models are fit on the `train` rows before a step and see nothing later. Runs are
    independent and run in parallel.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp", kind="stable", ignore_index=True)
        close, out, weights = rows["close"].to_numpy(float), [], None
        for i in range(max(train if steps is None else len(rows) - steps, lags + 3), len(rows)):
            past = np.lib.stride_tricks.sliding_window_view(close[max(0, i - train - lags) : i], lags + 1)
            if weights is None or (i % refit) == 0:
                weights = ensemble(past[:, :-1], past[:, -1], size, np.random.default_rng(i))
            p = prob_above(weights, close[i - lags : i], close[i - 1])
            out.append((*rows.loc[i, [*by]], rows.loc[i, "timestamp"], p, close[i - 1], close[i], rows.loc[i, "high"], rows.loc[i, "low"]))
        return pd.DataFrame(out, columns=[*by, "timestamp", "prob_up", "before", "close", "high", "low"])

    kinds = dict(candles.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", timestamp long, prob_up double, before double, close double, high double, low double"
    return candles.select(*by, "timestamp", "close", "high", "low").groupBy(*by).applyInPandas(run, schema)


def metrics(steps: DataFrame, by: tuple[str, ...] = ("feed",)) -> DataFrame:
    """Running accuracy with bounds, precision, recall, F1 and log loss of steps with prob_up and up (did it rise)."""
    w = Window.partitionBy(*by).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said, up = F.col("prob_up") > 0.5, F.col("up")
    count = lambda c: F.count_if(c).over(w)
    p = F.least(F.greatest("prob_up", F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -F.log(F.when(up, p).otherwise(1 - p))
    rows = steps.select(*by, "timestamp", F.count("*").over(w).alias("n"), count(said == up).alias("right"), count(said & up).alias("tp"), count(said).alias("said"), count(up).alias("was"), F.avg(loss).over(w).alias("mean_loss"))
    acc = F.col("right") / F.col("n")
    half = F.sqrt(acc * (1 - acc) / F.col("n")) * Z95
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = rows.select(*by, "timestamp", "n", acc.alias("accuracy"), F.greatest(acc - half, F.lit(0.0)).alias("low"), F.least(acc + half, F.lit(1.0)).alias("high"), zero("tp", "said").alias("precision"), zero("tp", "was").alias("recall"), F.when((F.col("was") == 0) | (F.col("was") == F.col("n")), 3.0).otherwise(F.col("mean_loss")).alias("log_loss"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))


def predictor_profit(stake: Column, prob_up: Column, rose: Column, others: Column, accuracy: Column, revenue: Column) -> Column:
    """What a participant wins that splits a stake by its probability, against others of given stake and accuracy."""
    up, down = stake * prob_up, stake * (1 - prob_up)
    pot = revenue + others + stake
    won = F.when(rose, up).otherwise(down)
    return pot * F.try_divide(won, others * accuracy + won) - up - down


def stakes(approach: int, amount: Column, prob_up: Column) -> tuple[Column, Column]:
    """Stakes up and down: 1 splits evenly, 2 by probability, 3 puts the difference on the likelier side."""
    if approach == 1:
        return amount / 2, amount / 2
    up, down = amount * prob_up, amount * (1 - prob_up)
    if approach == 2:
        return up, down
    if approach == 3:
        return F.greatest(up - down, F.lit(0.0)), F.greatest(down - up, F.lit(0.0))
    raise ValueError(f"no such approach: {approach}")


def sweep(spark: SparkSession, settings: dict[str, list]) -> DataFrame:
    """Every combination of settings, numbered; the first setting changes fastest."""
    rows = spark.range(int(np.prod([len(v) for v in settings.values()]))).withColumnRenamed("id", "run_i")
    step = 1
    for name, values in settings.items():
        rows = rows.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("run_i") / step) % len(values) + 1).cast("int")))
        step *= len(values)
    return rows


def recent_weights(df: DataFrame, last: int, before: int, order: str = "timestamp") -> DataFrame:
    """Repeats the newest row of each feed `last` times more, and the one before it `before` times more."""
    n = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc(order)))
    times = F.when(F.col("_n") == 1, 1 + last).when(F.col("_n") == 2, 1 + before).otherwise(1)
    return df.withColumn("_n", n).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_n")


def numbered(df: DataFrame, hashed: Column, name: str) -> DataFrame:
    """Adds 1, 2, ... in the order of a 64-bit hash: rows are counted by its first 16 bits, and numbered among those that share them."""
    rows = df.withColumn("_h", hashed).withColumn("_b", F.shiftright("_h", 48))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over 65,536 counts at most
    start = rows.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    among = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    return rows.join(F.broadcast(start), "_b").withColumn(name, F.col("_start") + among).drop("_h", "_b", "_start")


def oversample(df: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """Rows of the rarer label again, in the order of a hash, until both labels have as many."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df
    rare = min(counts, key=counts.get)
    n, need = counts[rare], max(counts.values()) - min(counts.values())
    again = numbered(df.where(F.col(label) == rare), F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), "_i")
    copies = again.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(need // n)))).where(F.col("_c") * n + F.col("_i") <= need)
    return df.unionByName(copies.drop("_i", "_c"))


def importances(weights: dict[str, float]) -> dict[str, float]:
    """Absolute weights as shares."""
    total = sum(map(abs, weights.values())) or 1.0
    return {k: abs(v) / total for k, v in weights.items()}


def multi_run(candles: DataFrame, settings: dict[str, list], lags: int, train: int, steps: int | None = None) -> DataFrame:
    """Trades of every combination of trader settings on one walk-forward result."""
    from tidewater.operators.sequential import Trader

    signals = walk_forward(candles, lags, train, steps)
    runs = sweep(candles.sparkSession, settings)
    names = list(settings)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp", kind="stable")
        trader = Trader(**{n: float(rows[n].iloc[0]) for n in names})
        profits = [trader.step(r.prob_up, r.before, r.high, r.low) for r in rows.itertuples()]
        return pd.DataFrame({"run_i": [rows["run_i"].iloc[0]], "feed": [rows["feed"].iloc[0]], "n": [len(rows)], "profit": [float(np.sum(profits))]})

    every = signals.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(reduce(lambda a, b: a * b, (len(v) for v in settings.values()), 1) - 1))))
    joined = every.join(F.broadcast(runs), F.col("_r") == F.col("run_i")).drop("_r")
    return joined.groupBy("run_i", "feed").applyInPandas(run, "run_i long, feed string, n long, profit double")
