"""Fitting: weighted regression, goodness of fit, and searches over parameters.

Data stay in Spark: a regression is five sums, a grid of parameters is evaluated for all of its points in one aggregation,
and a search narrows such grids. The driver sees a few numbers for each parameter set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", error: str = "yerr") -> DataFrame:
    """keys, a, b, a_err, b_err, n: y = a x + b by weights 1 / error^2, in closed form from five sums."""
    w = 1 / (F.col(error) * F.col(error))
    sums = df.groupBy(*keys).agg(
        F.sum(w).alias("s"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"), F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(x) * F.col(y)).alias("sxy"), F.count(F.lit(1)).alias("n")
    )
    delta = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    return sums.select(
        *keys,
        ((F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / delta).alias("a"),
        ((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / delta).alias("b"),
        F.sqrt(F.col("s") / delta).alias("a_err"),
        F.sqrt(F.col("sxx") / delta).alias("b_err"),
        "n",
    )


def residuals(df: DataFrame, fits: DataFrame, keys: list[str], x: str = "x", y: str = "y", error: str = "yerr") -> DataFrame:
    """df with y_fit and residual = (y - a x - b) / error. fits has a row for each key."""
    joined = df.join(fits.select(*keys, "a", "b"), keys)
    return joined.withColumn("y_fit", F.col("a") * F.col(x) + F.col("b")).withColumn("residual", (F.col(y) - F.col("y_fit")) / F.col(error))


def chi2(df: DataFrame, fits: DataFrame, keys: list[str], parameters: int = 2, **columns: str) -> DataFrame:
    """keys, chi2, dof: rows less the parameters that were fitted (scale and offset, unless more are said to be)."""
    return residuals(df, fits, keys, **columns).groupBy(*keys).agg(F.sum(F.col("residual") * F.col("residual")).alias("chi2"), (F.count(F.lit(1)) - parameters).alias("dof"))


#: Up to so many points of a grid are aggregates of one pass; more are a broadcast table of rows, so that code doesn't grow.
GRID_COLUMNS = 64


def _grid(df: DataFrame, points: list[tuple[float, ...]], names: list[str], model: Callable[..., Column], keys: list[str], y: str, error: str) -> DataFrame:
    """keys, names, chi2 for each point of the grid."""

    def term(parameters: list[Column]) -> Column:
        return F.sum(F.pow((F.col(y) - model(*parameters)) / F.col(error), F.lit(2.0)))

    if len(points) <= GRID_COLUMNS:
        sums = df.groupBy(*keys).agg(*[term([F.lit(float(v)) for v in p]).alias(f"c{i}") for i, p in enumerate(points)])
        made = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, p, strict=True)], F.col(f"c{i}").alias("chi2")) for i, p in enumerate(points)])
        out = sums.select(*keys, F.explode(made).alias("r")).select(*keys, "r.*")
    else:
        inner = [f"__{n}" for n in names]
        table = df.sparkSession.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{n} double" for n in inner))
        out = df.join(F.broadcast(table)).groupBy(*keys, *inner).agg(term([F.col(n) for n in inner]).alias("chi2")).withColumnsRenamed(dict(zip(inner, names, strict=True)))
    return out.where(F.col("chi2").isNotNull() & ~F.isnan("chi2"))


def grid_scan(df: DataFrame, values: list[float], model: Callable[[Column], Column], keys: list[str], y: str = "y", error: str = "yerr") -> DataFrame:
    """keys, p, chi2 for each value of the parameter, in one pass over the data."""
    return _grid(df, [(v,) for v in values], ["p"], model, keys, y, error)


def best(scan: DataFrame, keys: list[str]) -> DataFrame:
    return scan.groupBy(*keys).agg(F.min(F.struct("chi2", "p")).alias("r")).select(*keys, "r.p", "r.chi2")


def refine(df: DataFrame, low: float, high: float, model: Callable[[Column], Column], y: str = "y", error: str = "yerr", steps: int = 16, tolerance: float = 1e-4) -> tuple[float, float]:
    """Least chi2 over low..high: a grid, then grids around its best value, until the bracket is within tolerance. Each round
    is one aggregation over the data; (parameter, chi2)."""
    while True:
        values = [low + (high - low) * i / steps for i in range(steps + 1)]
        found = best(grid_scan(df, values, model, [], y, error), []).first()
        step = (high - low) / steps
        if step <= tolerance:
            return found["p"], found["chi2"]
        low, high = max(low, found["p"] - step), min(high, found["p"] + step)


def landscape(df: DataFrame, first: list[float], second: list[float], model: Callable[[Column, Column], Column], y: str = "y", error: str = "yerr") -> DataFrame:
    """p1, p2, chi2 over a grid of two parameters, in one pass over the data."""
    return _grid(df, [(a, b) for a in first for b in second], ["p1", "p2"], model, [], y, error)


def valley(scan: DataFrame, allowance: float) -> DataFrame:
    """The parameters whose chi2 lies within allowance (a share) of the least: how well the minimum is known. A scan has few rows."""
    least = scan.agg(F.min("chi2").alias("__least"))
    return scan.join(F.broadcast(least)).where(F.col("chi2") <= F.col("__least") * (1 + allowance)).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.min("chi2").alias("chi2"), F.avg("chi2").alias("mean_chi2"))


def until_hopeless(scan: DataFrame, keys: list[str], limit: float, relative: bool = True, share: float = 0.7, window: int = 7, run: int = 3) -> DataFrame:
    """The rows of a scan (keys, p, chi2) from the greatest p down to where it would have been given up: after the first
    share of the values, once so many in a row, themselves and as the mean of the last window values, exceed limit (times the
    least value so far, if relative). Keys' scans are few rows each, so all values are evaluated at once and cut here."""
    down = Window.partitionBy(*keys).orderBy(F.desc("p"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bar = F.lit(float(limit)) * F.min("chi2").over(so_far) if relative else F.lit(float(limit))
    late = F.row_number().over(down) > F.count(F.lit(1)).over(Window.partitionBy(*keys)) * share
    over = late & (F.col("chi2") > bar) & (F.avg("chi2").over(down.rowsBetween(1 - window, 0)) > bar)
    marked = scan.withColumn("__over", over.cast("int")).withColumn("__run", F.sum("__over").over(down.rowsBetween(1 - run, 0)))
    ended = F.coalesce(F.max((F.col("__run") == run).cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__ended", ended).where("__ended = 0").drop("__over", "__run", "__ended")
