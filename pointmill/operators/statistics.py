"""Aggregates: moments, weighted means, modes, spans, histograms of scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.config import Axis


def series_statistics(df: DataFrame) -> DataFrame:
    """set_id, n, mean, variance and standard deviation (of a sample)."""
    return df.groupBy("set_id").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("variance"), F.stddev_samp("y").alias("std"))


def weighted_mean(value: str, error: str) -> tuple[Column, Column]:
    """Mean by inverse variance, and its error."""
    inverse = F.sum(F.pow(F.col(error), F.lit(-2.0)))
    return F.sum(F.col(value) * F.pow(F.col(error), F.lit(-2.0))) / inverse, F.sqrt(1 / inverse)


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value by keys; the smallest of equally frequent ones. Counted first, so no group is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias("mode"))


def spans(df: DataFrame) -> DataFrame:
    """Least and greatest x and y by series; the positive span leaves out y of 0 and below."""
    return df.groupBy("set_id").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min(F.when(F.col("y") > 0, F.col("y"))).alias("y_min_positive")
    )


def find_minimum(df: DataFrame, column: str = "y") -> DataFrame:
    """The row of each series where column is least (the first of equal ones)."""
    return df.groupBy("set_id").agg(F.min_by(F.struct("i", "x", "y"), F.struct(F.col(column), F.col("i"))).alias("r")).select("set_id", "r.*")


def bin_of(value: Column, axis: Axis) -> Column:
    """Bin number; values beyond either end fall in the last or first bin."""
    return F.least(F.greatest(F.floor((value + 1e-6 - axis.low) / axis.width), F.lit(0)), F.lit(axis.bins - 1)).cast("long")


def histogram(df: DataFrame, value: str, axis: Axis) -> DataFrame:
    """bin, count of the bins that hold anything."""
    return df.where(F.col(value).isNotNull()).groupBy(bin_of(F.col(value), axis).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def coarsen(hist: DataFrame, n: int, bins: int) -> DataFrame:
    """n bins in one; what is left over goes to the last whole one."""
    last = max(1, bins // n) - 1
    return hist.groupBy(F.least(F.floor(F.col("bin") / n), F.lit(last)).cast("long").alias("bin")).agg(F.sum("count").alias("count"))


def normalized(hist: DataFrame, by: str = "sum") -> DataFrame:
    """Adds share: count over the sum of all counts, or over the greatest. The total is one row that joins the bins."""
    total = hist.agg((F.sum("count") if by == "sum" else F.max("count")).alias("__total"))
    return hist.join(F.broadcast(total)).withColumn("share", F.col("count") / F.col("__total")).drop("__total")


def cumulative(hist: DataFrame) -> DataFrame:
    """Adds running: counts up to and with each bin. A histogram has few rows, whatever it was made from."""
    return hist.withColumn("running", F.sum("count").over(Window.orderBy("bin")))


def combine(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """a + scale * b, bin by bin."""
    return a.select("bin", F.col("count").cast("double")).unionByName(b.select("bin", (F.col("count") * F.lit(scale)).alias("count"))).groupBy("bin").agg(F.sum("count").alias("count"))


def shorten(hist: DataFrame, least: int = 10) -> DataFrame:
    """Without the empty bins at the end, but with bins up to least."""
    top = hist.where("count <> 0").agg(F.greatest(F.lit(least - 1), F.coalesce(F.max("bin"), F.lit(0))).alias("__top"))
    return hist.join(F.broadcast(top)).where(F.col("bin") <= F.col("__top")).drop("__top")
