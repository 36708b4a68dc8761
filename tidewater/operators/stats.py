"""Statistics of series: autocorrelation, unit roots, Box-Cox, seasons, distributions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import normal
from tidewater.operators import selection

Z95 = 1.959963984540054


def autocorrelation(df: DataFrame, c: str, lags: int) -> DataFrame:
    """feed, lag, acf with Bartlett's 95 % bounds; one pass of lags over each feed's window.

    Products are of differences from the feed's first value, which keeps them small, and the
    mean is taken off their sums.
    """
    t = Window.partitionBy("feed").orderBy("timestamp")
    x = df.select("feed", "timestamp", (F.col(c) - F.first(c, ignorenulls=True).over(t)).alias("x"))
    pairs = x.select("feed", "x", *(F.lag("x", k).over(t).alias(f"x{k}") for k in range(lags + 1)))
    m, parts = F.avg("x"), []
    for k in range(lags + 1):
        product = F.col("x") * F.col(f"x{k}")
        both = F.sum(F.when(product.isNotNull(), F.col("x") + F.col(f"x{k}")))
        parts.append((F.sum(product) - m * both + m * m * F.count(product)).alias(f"c{k}"))
    sums = pairs.groupBy("feed").agg(F.count("*").alias("n"), *parts)
    long = sums.select("feed", "n", F.posexplode(F.array(*(F.try_divide(F.col(f"c{k}"), F.col("c0")) for k in range(lags + 1)))).alias("lag", "acf"))
    before = Window.partitionBy("feed").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    spread = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before)
    half = F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1 + 2 * F.coalesce(spread, F.lit(0.0))) / F.col("n")) * Z95)
    return long.withColumn("low", F.col("acf") - half).withColumn("high", F.col("acf") + half)


def partial_autocorrelation(acf: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations, lag 0 first, by the Durbin-Levinson recursion."""
    out, phi = [1.0], []
    for k in range(1, len(acf)):
        num = acf[k] - sum(p * acf[k - 1 - j] for j, p in enumerate(phi))
        den = 1 - sum(p * acf[j + 1] for j, p in enumerate(phi))
        new = num / den if den else 0.0
        phi = [p - new * q for p, q in zip(phi, reversed(phi), strict=True)] + [new]
        out.append(new)
    return out


#: Asymptotic critical values of the Dickey-Fuller test with a constant.
DICKEY_FULLER = {0.01: -3.43, 0.05: -2.86, 0.10: -2.57}


def dickey_fuller(df: DataFrame, c: str) -> DataFrame:
    """The t statistic of the level in a regression of changes on it, and whether a unit root is rejected at 5 %."""
    w = Window.partitionBy("feed").orderBy("timestamp")
    rows = df.select("feed", (F.col(c) - F.lag(c).over(w)).alias("d"), F.lag(c).over(w).alias("x")).where("x is not null")
    fit = rows.groupBy("feed").agg(F.regr_slope("d", "x").alias("slope"), F.regr_sxx("d", "x").alias("sxx"), F.regr_syy("d", "x").alias("syy"), F.count("*").alias("n"))
    error = F.sqrt((F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return fit.select("feed", "n", (F.col("slope") / error).alias("t")).withColumn("stationary", F.col("t") < DICKEY_FULLER[0.05])


#: MacKinnon's response surface of the test with a constant: its ends, where its halves meet, and polynomials from the constant on.
SURFACE_ENDS, SURFACE_MIDDLE = (-18.83, 2.74), -1.61
SURFACE_LOW, SURFACE_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def dickey_fuller_p(t: Column) -> Column:
    """The asymptotic probability of a statistic as low as t under a unit root: the normal share below a polynomial of t."""
    at = lambda cs: reduce(lambda p, c: p * t + c, reversed(cs[:-1]), F.lit(cs[-1]))
    inside = normal.cumulative(F.when(t <= SURFACE_MIDDLE, at(SURFACE_LOW)).otherwise(at(SURFACE_HIGH)))
    return F.when(t > SURFACE_ENDS[1], 1.0).when(t < SURFACE_ENDS[0], 0.0).when(t.isNotNull(), inside)


def _solved(m: np.ndarray, n: int, lags: int) -> tuple[float, float]:
    """t of the level and Akaike's criterion, from sums of products of (d, 1, x, d1 .. d_lags)."""
    a, b = m[1 : lags + 3, 1 : lags + 3], m[1 : lags + 3, 0]
    inverse = np.linalg.pinv(a)
    w = inverse @ b
    rss, k = max(m[0, 0] - b @ w, 1e-300), lags + 2
    return float(w[1] / math.sqrt(rss / max(1, n - k) * inverse[1, 1])), n * math.log(rss / n) + 2 * k


def augmented_dickey_fuller(df: DataFrame, c: str, most_lags: int = 8) -> DataFrame:
    """feed, n, lags, t, stationary, p: the test with as many lagged differences as Akaike's criterion asks for.

    One pass gives each feed's sums of products of level, differences and their lags; the
    few regressions are solved from these sums, so no task holds a series. All candidates
    use the rows that have `most_lags` lags.
    """
    w = Window.partitionBy("feed").orderBy("timestamp")
    level = df.select("feed", "timestamp", F.col(c).cast("double").alias("y")).withColumn("x", F.lag("y").over(w)).withColumn("d", F.col("y") - F.col("x"))
    centred = level.withColumn("x", F.col("x") - F.avg("y").over(Window.partitionBy("feed")))
    names = ["d", "one", "x", *(f"d{i}" for i in range(1, most_lags + 1))]
    rows = centred.select("feed", "d", F.lit(1.0).alias("one"), "x", *(F.lag("d", i).over(w).alias(f"d{i}") for i in range(1, most_lags + 1))).dropna()
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy("feed").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in cells)).alias("sums"))

    @F.pandas_udf("lags int, t double")
    def chosen(n: pd.Series, products: pd.Series) -> pd.DataFrame:
        out = []
        for count, values in zip(n, products, strict=True):
            m = np.zeros((len(names), len(names)))
            for (i, j), v in zip(cells, values, strict=True):
                m[i, j] = m[j, i] = v
            fits = [(*_solved(m, int(count), k)[::-1], k) for k in range(most_lags + 1)]
            aic, t, k = min(fits, key=lambda f: (f[0], f[2]))
            out.append((k, t))
        return pd.DataFrame(out, columns=["lags", "t"])

    found = sums.where(F.col("n") > most_lags + 4).select("feed", "n", chosen("n", "sums").alias("f")).select("feed", "n", "f.lags", "f.t")
    return found.withColumn("stationary", F.col("t") < DICKEY_FULLER[0.05]).withColumn("p", dickey_fuller_p(F.col("t")))


def box_cox_lambdas(df: DataFrame, c: str, low: float = -2.0, high: float = 2.0, points: int = 21, rounds: int = 3) -> DataFrame:
    """feed, lambda: each feed's exponent of the largest likelihood, by aggregates over ever finer grids; values must be positive."""
    found = df.select("feed").distinct().select("feed", F.lit((low + high) / 2).alias("lambda"))
    half = (high - low) / 2
    for _ in range(rounds):
        at = [F.col("lambda") + half * (2 * i / (points - 1) - 1) for i in range(points)]
        moved = [F.when(F.abs(g) < 1e-12, F.log(c)).otherwise(F.try_divide(F.pow(c, g) - 1, g)) for g in at]
        sums = df.select("feed", c).join(found, "feed").groupBy("feed", "lambda").agg(F.sum(F.log(c)).alias("logs"), F.count(c).alias("n"), *(F.var_pop(m).alias(f"v{i}") for i, m in enumerate(moved)))
        like = [F.when(F.col(f"v{i}") > 0, (g - 1) * F.col("logs") - F.col("n") / 2 * F.log(f"v{i}")) for i, g in enumerate(at)]
        best = F.array_max(F.array(*(F.struct(F.coalesce(x, F.lit(float("-inf"))).alias("like"), F.lit(-i).alias("i"), g.alias("g")) for i, (x, g) in enumerate(zip(like, at, strict=True)))))
        found = sums.select("feed", best["g"].alias("lambda"))
        half = half * 2 / (points - 1)
    return found


def box_cox(df: DataFrame, c: str) -> DataFrame:
    """Adds `boxcox`: each feed's values standardized, shifted so that the least is 0.1, transformed, and scaled back."""
    fit = df.groupBy("feed").agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"), F.min(c).alias("_lo"))
    fit = fit.withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).withColumn("_shift", 0.1 - (F.col("_lo") - F.col("_m")) / F.col("_s"))
    z = df.join(fit, "feed").withColumn("_z", (F.col(c) - F.col("_m")) / F.col("_s") + F.col("_shift"))
    g = F.col("lambda")
    moved = F.when(F.abs(g) < 1e-12, F.log("_z")).otherwise(F.try_divide(F.pow("_z", g) - 1, g))
    return z.join(box_cox_lambdas(z, "_z"), "feed").withColumn("boxcox", (moved - F.col("_shift")) * F.col("_s") + F.col("_m")).select(*df.columns, "boxcox")


def seasonal(df: DataFrame, c: str, period: int, extend: bool = False) -> DataFrame:
    """Adds trend, season and rest of an additive decomposition.

    The trend is a centred moving average, with half weights at the ends of an even period,
    and null where it would leave the series; with `extend` it goes on there along the line
    through its two nearest points. The season is the mean of what is left at each position,
    less the mean over positions.
    """
    w = Window.partitionBy("feed").orderBy("timestamp")
    half = period // 2
    inner = F.sum(c).over(w.rowsBetween(-half, half))
    ends = (F.lag(c, half).over(w) + F.lead(c, half).over(w)) / 2 if period % 2 == 0 else F.lit(0.0)
    whole = F.count(c).over(w.rowsBetween(-half, half)) == 2 * half + 1
    rows = df.select("feed", "timestamp", F.col(c).alias("observed"), F.when(whole, (inner - ends) / period).alias("trend"), ((F.row_number().over(w) - 1) % period).alias("phase"))
    if extend:
        i, t, whole = F.row_number().over(w).alias("i"), F.col("trend").alias("t"), Window.partitionBy("feed")
        rows = rows.withColumn("_e", F.struct(i, t, F.lead("trend").over(w).alias("up"), F.lag("trend").over(w).alias("down")))
        known = F.when(F.col("trend").isNotNull(), F.col("_e.i"))
        rows = rows.withColumns({"_a": F.min_by("_e", known).over(whole), "_z": F.max_by("_e", known).over(whole)})
        line = lambda e, slope: F.col(f"{e}.t") + (F.col("_e.i") - F.col(f"{e}.i")) * F.coalesce(slope, F.lit(0.0))
        before, after = line("_a", F.col("_a.up") - F.col("_a.t")), line("_z", F.col("_z.t") - F.col("_z.down"))
        rows = rows.withColumn("trend", F.coalesce("trend", F.when(F.col("_e.i") < F.col("_a.i"), before).otherwise(after))).drop("_e", "_a", "_z")
    mean = rows.groupBy("feed", "phase").agg(F.avg(F.col("observed") - F.col("trend")).alias("raw"))
    mean = mean.withColumn("season", F.col("raw") - F.avg("raw").over(Window.partitionBy("feed"))).drop("raw")
    return rows.join(mean, ["feed", "phase"]).withColumn("rest", F.col("observed") - F.col("trend") - F.col("season"))


def relative_energy(parts: DataFrame) -> DataFrame:
    """How much of the observed deviation each part of a decomposition has."""
    whole = F.stddev_pop("observed")
    return parts.groupBy("feed").agg(*(F.try_divide(F.stddev_pop(p), whole).alias(p) for p in ("trend", "season", "rest")))


def bins(n: int, least: int = 3, most: int = 100) -> int:
    return max(least, min(most, n // 5))


def histogram(df: DataFrame, c: str, n_bins: int | None = None) -> DataFrame:
    """Counts and density of equal bins between a feed's ends; the last bin includes its upper edge.

    Without `n_bins` each feed has as many as bins() says of its rows.
    """
    ends = df.groupBy("feed").agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count("*").alias("rows"))
    number = F.greatest(F.lit(3), F.least(F.lit(100), F.floor(F.col("rows") / 5))) if n_bins is None else F.lit(n_bins)
    rows = df.select("feed", F.col(c).alias("x")).join(ends.withColumn("bins", number.cast("long")), "feed")
    rows = rows.withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) * F.col("bins") / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.col("bins") - 1))
    counts = rows.groupBy("feed", F.coalesce("bin", F.lit(0)).alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("bins").alias("bins"), F.first("rows").alias("rows"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return counts.select("feed", "bin", "n", (F.col("lo") + F.col("bin") * width).alias("start"), F.try_divide(F.col("n") / F.col("rows"), width).alias("density"))


def quantiles(df: DataFrame, c: str, at: list[float]) -> DataFrame:
    """Exact quantiles, interpolated, of each feed; values are counted in bins, never held together."""
    return selection.quantiles(df, c, at)


def kernel_density(df: DataFrame, c: str, points: int = 200) -> DataFrame:
    """Normal-kernel density of each feed on an even mesh, with the bandwidth n^(-1/5) times the deviation."""
    stats = df.groupBy("feed").agg(F.count(c).alias("n"), F.stddev_samp(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    counts = df.groupBy("feed", F.col(c).alias("v")).agg(F.count("*").alias("m"))
    mesh = _beside(counts, stats, points).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    h = F.col("s") * F.pow("n", F.lit(-0.2))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / h, F.lit(2))) / (h * math.sqrt(2 * math.pi))
    return mesh.groupBy("feed", "i", "x").agg(F.sum(F.col("m") * kernel / F.col("n")).alias("density"))


def binned_density(df: DataFrame, c: str, points: int = 200, cells: int = 2048) -> DataFrame:
    """feed, i, x, density, bound: kernel_density from counts on an even grid of `cells` cells.

    A value's weight is dealt to the two ends of its cell by its distance from them, and the
    kernel is put on the ends that have weight, so a mesh point costs cells + 1 rows at most,
    however many values there are. Between two ends this is the kernel's linear
    interpolation: the density differs by `bound`, the squared width of a cell times
    an eighth of the kernel's largest second derivative, at most.
    """
    known = df.where(F.col(c).isNotNull()).select("feed", F.col(c).alias("v"))
    stats = known.groupBy("feed").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / cells
    place = (F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))
    cell = F.least(F.floor(place), F.lit(cells - 1))
    ends = F.array(F.struct(cell.alias("k"), (1 - (place - cell)).alias("m")), F.struct((cell + 1).alias("k"), (place - cell).alias("m")))
    dealt = known.join(stats, "feed").select("feed", F.explode(ends).alias("e")).groupBy("feed", "e.k").agg(F.sum("e.m").alias("m"))
    mesh = _beside(dealt, stats, points).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).withColumn("v", F.col("lo") + F.col("k") * width)
    h = F.col("s") * F.pow("n", F.lit(-0.2))
    bound = width * width / (8 * F.pow(h, F.lit(3)) * math.sqrt(2 * math.pi))
    return mesh.groupBy("feed", "i", "x", bound.alias("bound")).agg(F.sum(F.col("m") / F.col("n") * normal.density(F.col("x"), F.col("v"), h)).alias("density"))


def _beside(values: DataFrame, stats: DataFrame, points: int) -> DataFrame:
    """Each value with its feed's statistics, once for every point i of a mesh; sums over values are partial in each task."""
    return values.join(stats, "feed").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))


def distribution(df: DataFrame, c: str, points: int = 200) -> DataFrame:
    """Densities, cumulative shares and normal quantiles of each feed, by a normal and by a kernel estimate.

    The mesh reaches half a deviation beyond the data. Densities are divided by the feed's
    largest. The kernel's cumulative share uses the bandwidth factor n^(-1/5) without the
    deviation, its density with it. Equal values are counted first, so a mesh point costs
    a row for each different value of its feed.
    """
    stats = df.groupBy("feed").agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.stddev_samp(c).alias("h"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    width = F.col("hi") - F.col("lo") + F.col("s")
    values = df.where(F.col(c).isNotNull()).groupBy("feed", F.col(c).alias("v")).agg(F.count("*").alias("k"))
    mesh = _beside(values, stats, points).withColumn("x", F.col("lo") - F.col("s") / 2 + width * F.col("i") / (points - 1))
    factor = F.pow("n", F.lit(-0.2))
    x, v, share = F.col("x"), F.col("v"), F.col("k") / F.col("n")
    sums = mesh.groupBy("feed", "i", "x", "m", "s").agg(F.sum(share * normal.density(x, v, F.col("h") * factor)).alias("pdf_kernel"), F.sum(share * normal.cumulative((x - v) / factor)).alias("cdf_kernel"))
    both = sums.withColumn("pdf_normal", normal.density(x, F.col("m"), F.col("s"))).withColumn("cdf_normal", normal.cumulative((x - F.col("m")) / F.col("s")))
    top = F.max(F.greatest("pdf_normal", "pdf_kernel")).over(Window.partitionBy("feed"))
    out = both.withColumn("top", top)
    return out.select(
        "feed", "i", "x", (F.col("pdf_normal") / F.col("top")).alias("pdf_normal"), (F.col("pdf_kernel") / F.col("top")).alias("pdf_kernel"), "cdf_normal", "cdf_kernel",
        normal.quantile("cdf_normal").alias("nq_normal"), normal.quantile("cdf_kernel").alias("nq_kernel"),
    )


def partial_autocorrelations(df: DataFrame, c: str, lags: int) -> DataFrame:
    """feed, lag, pacf: the recursion runs over each feed's few autocorrelations."""
    rows = autocorrelation(df, c, lags).groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("a"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def recursion(acf: pd.Series) -> pd.Series:
        return acf.map(lambda a: partial_autocorrelation(list(a)))

    return rows.select("feed", F.posexplode(recursion(F.transform("a", lambda r: r["acf"]))).alias("lag", "pacf"))


def unit_root_variants(df: DataFrame, c: str) -> DataFrame:
    """The unit-root test of a series as it is, after Box-Cox, and after one and two differences of that."""
    w = Window.partitionBy("feed").orderBy("timestamp")
    moved = box_cox(df.select("feed", "timestamp", c), c)
    moved = moved.withColumn("d1", F.col("boxcox") - F.lag("boxcox").over(w)).withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    names = {"none": c, "boxcox": "boxcox", "boxcox, difference": "d1", "boxcox, second difference": "d2"}
    return reduce(DataFrame.unionByName, (augmented_dickey_fuller(moved.where(F.col(col).isNotNull()), col).withColumn("transform", F.lit(n)) for n, col in names.items()))
