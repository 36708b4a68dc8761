"""Exact order statistics without a buffer of all values, and nearest rows in blocks."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram, and histograms one after another.
BINS, PASSES = 4096, 2
#: Rows of a block of a nearest-rows tile on average, and rows that are compared with a block at once.
BLOCK_ROWS, AT_ONCE = 4096, 256


def order_statistics(values: DataFrame, targets: DataFrame, by: str, value: str) -> DataFrame:
    """targets with `found`: the value at each target's `rank` from 0 on, among the values of its `by` in order.

    A pass counts the values between a target's ends in BINS equal bins and moves the ends to
    the least and the largest value of the bin that holds the rank; after PASSES of them few
    different values are left, which are counted one by one. All steps are aggregations with
    partial sums per task; what they hold is BINS counts for a target, and at the end one
    for each different value left, about a part in BINS ** PASSES of all. Null and NaN values
    do not count; a target whose rank is not there gets none.
    """
    x = F.col(value)
    known = values.where(x.isNotNull() & ~(F.isnan(x) if dict(values.dtypes)[value] in ("double", "float") else F.lit(False))).select(F.col(by).alias("_by"), x.alias("_x"))
    names = targets.columns
    ends = known.groupBy("_by").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    now = targets.withColumn("_t", F.struct(*names)).select("_t", F.col(by).alias("_by"), F.col("rank").alias("_r")).join(ends, "_by", "left")
    part = (F.col("_x").cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo"))
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")) & (F.col("_lo") < F.col("_hi"))
    for i in range(PASSES):
        bin_of = F.least(F.floor(F.nanvl(part, F.lit(0.0)) * BINS), F.lit(BINS - 1)).alias("_bin")
        if i == 0:  # all targets of a `by` have the same ends
            rows = known.join(ends.withColumnRenamed("_by", "_b"), F.col("_by") == F.col("_b")).where("_lo < _hi")
            counts = rows.groupBy("_by", bin_of).agg(F.count("*").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
            counts = now.where("_lo < _hi").drop("_lo", "_hi").join(counts, "_by")
        else:
            rows = known.join(now.withColumnRenamed("_by", "_b"), F.col("_by") == F.col("_b")).where(inside)
            counts = rows.groupBy("_t", "_by", "_r", bin_of).agg(F.count("*").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        w = Window.partitionBy("_t").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where("_before <= _r and _r < _before + _n")
        now = before.select("_by", "_t", (F.col("_r") - F.col("_before")).alias("_r"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi")).unionByName(now.where("not coalesce(_lo < _hi, false)").select("_by", "_t", "_r", "_lo", "_hi"))
    rows = known.join(now.withColumnRenamed("_by", "_b"), F.col("_by") == F.col("_b")).where(inside)
    counts = rows.groupBy("_t", "_r", "_x").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_t").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where("_before <= _r and _r < _before + _n").select("_t", F.col("_x").alias("found"))
    alone = now.where("not coalesce(_lo < _hi, false)").select("_t", F.col("_lo").alias("found"))
    return found.unionByName(alone).select("_t.*", "found")


def quantiles(df: DataFrame, c: str, at: list[float], by: str = "feed") -> DataFrame:
    """by, p, value: exact quantiles, interpolated between the two values beside them."""
    sizes = df.where(F.col(c).isNotNull() & ~F.isnan(c)).groupBy(by).agg(F.count("*").alias("_n"))
    place = F.col("p") * (F.col("_n") - 1)
    both = sizes.select(by, "_n", F.explode(F.array(*map(F.lit, at))).alias("p")).withColumn("share", place - F.floor(place))
    targets = both.select(by, "p", "share", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "_n").withColumn("rank", F.least(F.floor(F.col("p") * (F.col("_n") - 1)) + F.col("side"), F.col("_n") - 1))
    found = order_statistics(df.withColumn(c, F.col(c).cast("double")), targets.drop("_n"), by, c)
    ends = found.groupBy(by, "p", "share").agg(F.min("found").alias("lo"), F.max("found").alias("hi"))
    return ends.select(by, "p", (F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo"))).alias("value"))


def nearest_rows(rows: DataFrame, by: str, k: int) -> DataFrame:
    """by, id, x, rank, other, y, far: for each row its k nearest other rows of the same `by`.

    `rows` has by, id (a long that no other row of its `by` has) and x (an array of doubles).
    Rows are dealt over blocks of about BLOCK_ROWS; a task compares one block with another
    and keeps the k nearest of each row, so no array of all pairs is made. Ties go to the
    smaller id. `far` is the squared distance.
    """
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    placed = rows.select(by, "id", "x").join(sizes, by).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    every = F.explode(F.expr("sequence(0, _blocks - 1)"))
    asked = placed.withColumn("cb", every).withColumn("qb", F.col("_block")).select(by, "qb", "cb", "id", "x")
    again = placed.select(*(F.col(c).alias(c) for c in placed.columns))  # columns of their own, for the join of a table with itself
    beside = again.withColumn("qb", every).withColumn("cb", F.col("_block")).select(by, "qb", "cb", "id", "x")

    def tile(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("id")
            ids, points = right["id"].to_numpy(), np.stack(right["x"].to_numpy())
            for i in range(0, len(left), AT_ONCE):
                own = left.iloc[i : i + AT_ONCE]
                q = np.stack(own["x"].to_numpy())
                far = np.zeros((len(q), len(points)))
                for j in range(q.shape[1]):
                    far += (q[:, j, None] - points[None, :, j]) ** 2
                far[own["id"].to_numpy()[:, None] == ids[None]] = np.inf
                n = min(k, len(points))
                kth = np.partition(far, n - 1, axis=1)[:, n - 1]
                for r, (row_id, x) in enumerate(zip(own["id"], own["x"], strict=True)):
                    near = np.flatnonzero((far[r] <= kth[r]) & (far[r] < np.inf))
                    near = near[np.argsort(far[r][near], kind="stable")][:k]  # of equals the smaller ids
                    out += [(key[0], row_id, x, ids[b], points[b], far[r][b]) for b in near]
        return pd.DataFrame(out, columns=[by, "id", "x", "other", "y", "far"])

    kind = dict(rows.dtypes)[by]
    found = asked.groupBy(by, "qb", "cb").cogroup(beside.groupBy(by, "qb", "cb")).applyInPandas(tile, f"`{by}` {kind}, id long, x array<double>, other long, y array<double>, far double")
    w = Window.partitionBy(by, "id").orderBy("far", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rare_rows(df: DataFrame, features: list[str], label: str, by: str) -> tuple[DataFrame, DataFrame]:
    """(by, rare label, rows that it lacks, rows that it has) of each `by` with two labels and two rare rows or more, and (by, id, x) of the rare rows."""
    counts = df.groupBy(by, F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(by).agg(F.min(F.struct("_n", "_label")).alias("_rare"), F.max("_n").alias("_most"), F.count("*").alias("_labels"))
    sizes = sizes.where("_labels > 1 and _rare._n > 1").select(by, F.col("_rare._label").alias("_label"), (F.col("_most") - F.col("_rare._n")).alias("_lacks"), F.col("_rare._n").alias("_has"))
    rare = df.join(sizes, by).where(F.col(label) == F.col("_label")).groupBy(by, F.array(*features).alias("x")).agg(F.count("*").alias("_copies"))
    copies = rare.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return sizes, copies.select(by, F.xxhash64("x", "_copy").alias("id"), "x")


def oversample(df: DataFrame, features: list[str], label: str, by: str, neighbours: int = 5, seed: int = 0) -> DataFrame:
    """by, features and label, with made-up rows of the rarer label until both are as many.

    A made-up row lies between a row of the rarer label and one of its nearest rows of that
    label. Every rare row makes as many as any other, or one more; which ones do is chosen
    by a hash, and the last of these by selection, not by numbering rows in one task. The same
    rows and seed give the same result. Rows with a null take no part, and a `by` with
    fewer than two rows of the rarer label stays as it is.
    """
    known = df.select(by, *(F.col(f).cast("double").alias(f) for f in features), label).dropna()
    sizes, rare = rare_rows(known, features, label, by)
    order = rare.withColumn("_h", F.xxhash64(F.lit(seed), "id"))
    each = sizes.withColumn("_more", F.expr("_lacks % _has"))
    last = order_statistics(order, each.where("_more > 0").select(by, (F.col("_more") - 1).alias("rank")), by, "_h").select(by, F.col("found").alias("_last"))
    make = order.join(each, by).join(last, by, "left").withColumn("_times", F.expr("_lacks div _has") + F.coalesce((F.col("_h") <= F.col("_last")).cast("long"), F.lit(0)))
    near = nearest_rows(rare, by, neighbours)
    wide = near.groupBy(by, "id", "x").agg(F.array_sort(F.collect_list(F.struct("rank", "y"))).alias("_near"))  # `neighbours` of each at most
    made = wide.join(make.select(by, "id", "_label", "_times").where("_times > 0"), [by, "id"]).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "_i"), F.size("_near")).cast("int")
    share = F.pmod(F.xxhash64(F.lit(seed + 2), "id", "_i"), F.lit(1 << 52)) / float(1 << 52)
    made = made.withColumn("_y", F.get("_near", pick)["y"]).withColumn("_s", share)
    between = [(F.get("x", i) + F.col("_s") * (F.get("_y", i) - F.get("x", i))).alias(f) for i, f in enumerate(features)]
    return known.unionByName(made.select(by, *between, F.col("_label").alias(label)))
